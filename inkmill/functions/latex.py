r"""Functions on LaTeX source, from Column to Column.

Fixed values stand as plain lists; every loop over long text is over one class of characters or possessive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.text import _c, collapse_space, is_blank, let, lines, remove_empty_lines, strip

# Commands whose files lie outside of the text.
EXTERNAL = (
    r"\\includegraphics(\[[^\]]*\])?\{[^}]*\}",
    r"\\input(\[[^\]]*\])?\{[^}]*\}",
    r"\\includepdf(\[[^\]]*\])?\{[^}]*\}",
    r"\\csvreader(\[[^\]]*\])?\s*\{[^}]*\}",
    r"\\pgfplotstableread(\[[^\]]*\])?\s*\{[^}]*\}",
    r"\\addplot\s+table(\[[^\]]*\])?\s*\{[^}]*\}",
    r"\\addplot\s+graphics(\[[^\]]*\])?\s*\{[^}]*\}",
)
# Environments that hold a picture.
PICTURES = ("tikzpicture", "circuitikz", "tikzcd")
CODE_ENVIRONMENTS = ("tikzpicture", "forest", "circuitikz", "pgfpicture", "axis", "scope", "tikzcd", "polaraxis", "semilogyaxis", "loglogaxis", "mindmap", "smartdiagram", "graphdrawing")
# Packages and libraries by the patterns that call for them.
PACKAGES = {
    "circuitikz": (r"\\begin\{circuitikz\}", r"\\draw\[[^\]]*circuit[^\]]*\]"),
    "pgfplots": (r"\\begin\{axis\}", r"\\begin\{polaraxis\}", r"\\addplot"),
    "tikzcd": (r"\\begin\{tikzcd\}",),
    "forest": (r"\\begin\{forest\}",),
    "smartdiagram": (r"\\smartdiagram",),
    "mindmap": (r"\\smartdiagram", r"mindmap", r"\\usetikzlibrary\{mindmap\}"),
    "graphicx": (r"\\includegraphics",),
    "positioning": (r"\\usepackage\{positioning\}",),
}
LIBRARIES = {
    "arrows.meta": (r"\barrow", r"arrows.meta", r"stealth"),
    "decorations.pathmorphing": (r"snake", r"decorate", r"decoration"),
    "positioning": (r"\\node.*(above|below|left|right|of)=",),
    "shapes": (r"\\node.*(rectangle|circle|diamond)",),
    "calc": (r"\$.*?\+.*?\$",),
    "fit": (r"fit=", r"node\[fit="),
    "backgrounds": (r"background", r"layer"),
    "graphs": (r"\\graph", r"graph\[.*\]"),
    "matrix": (r"matrix of nodes",),
    "mindmap": (r"mindmap", r"concept"),
}
# Libraries by a word of the page's code.
PAGE_LIBRARIES = {"circuit": "circuits", "mindmap": "mindmap", "shapes": "shapes", "arrows": "arrows", "positioning": "positioning", "automata": "automata", "backgrounds": "backgrounds", "fit": "fit", "matrix": "matrix", "patterns": "patterns", "trees": "trees", "3d": "3d"}
# Lines of the plot manual's preamble by the words that call for them.
PLOT_PREAMBLE = (r"\usepackage{pgfplots}", r"\pgfplotsset{compat=1.18}")
PLOT_LINES = (
    (("groupplot",), r"\usepgfplotslibrary{groupplots}"),
    (("dateplot",), r"\usepgfplotslibrary{dateplot}"),
    (("pgfplotstabletypeset",), r"\usepackage{pgfplotstable}"),
    (("node", "positioning", "calc", "arrows.meta", "shapes.multipart"), r"\usetikzlibrary{positioning,calc,arrows.meta,shapes.multipart}"),
)
# Fixed value: the preamble of texts that bring none.
DEFAULT_PREAMBLE = r"""
\documentclass[tikz]{standalone}
\usepackage{tikz}
\usepackage{pgfplots}
\usetikzlibrary{arrows.meta, decorations.pathreplacing, positioning, shapes, calc}
"""
# What marks a preamble line as an import, as a package of interest, or as neither import nor macro.
IMPORT_MARKS = ("documentclass", "tikz", "tkz", "pgf")
IMPORT_PACKAGES = ("inputenc", "fontenc", "fontspec", "amsmath", "amssymb", "color")
NOT_MACROS = (r"\new", r"\renew")
KEPT_IMPORTS = (r"\usepackage", r"\usetikzlibrary", r"\tikzset", r"\tikzstyle", r"\newcommand", r"\def")
STANDALONE_CLASS = r"\documentclass[tikz]{standalone}"
BEGIN, END = r"\begin{document}", r"\end{document}"


def _drop(x: Column, *patterns: str) -> Column:
    for p in patterns:
        x = F.regexp_replace(x, p, "")
    return x


def any_match(x: Column | str, patterns) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.regexp_like(_c(x), F.lit(p))
    return hit


def any_contains(x: Column | str, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(_c(x), F.lit(w))
    return hit


def has_picture(x: Column | str, words=PICTURES) -> Column:
    """F-07: any of the words occurs. Null for null."""
    return any_contains(x, words)


def has_paired_environment(x: Column | str, environments=CODE_ENVIRONMENTS) -> Column:
    """F-12: one of the environments is opened and closed."""
    hit = F.lit(False)
    for e in environments:
        hit = hit | (F.contains(_c(x), F.lit(f"\\begin{{{e}}}")) & F.contains(_c(x), F.lit(f"\\end{{{e}}}")))
    return hit


def is_uncompilable(x: Column | str) -> Column:
    """F-13: animations, or numbers printed by the mathematics engine."""
    low = F.lower(_c(x))
    return (
        F.regexp_like(low, F.lit(r"\\usetikzlibrary\{[^}]*animations[^}]*\}"))
        | F.regexp_like(low, F.lit(r"\\usepgfmodule\{[^}]*animations[^}]*\}"))
        | F.regexp_like(_c(x), F.lit(r"\\pgfmathprintnumber\s*\{[^}]+\}"))
    )


def remove_external(x: Column | str) -> Column:
    """T-07."""
    return _drop(_c(x), *EXTERNAL)


def replace_graphics(x: Column | str) -> Column:
    """T-08: every included graphic becomes the example image."""
    return F.regexp_replace(_c(x), r"(\\includegraphics\*?(?:\[.*?\]){0,2})\{.+?\}", "$1{example-image}")


def trim_to_environment(x: Column | str, env: Column | str) -> Column:
    r"""T-10: from the first ``\begin{env}`` on, and what follows ``\end{env}`` on the last line is cut. ``env`` is a column or a name."""
    name = F.lit(env) if isinstance(env, str) else env
    begin, end = F.concat(F.lit("\\begin{"), name, F.lit("}")), F.concat(F.lit("\\end{"), name, F.lit("}"))

    def tail(code: Column) -> Column:
        last = F.substring_index(code, "\n", -1)
        return let(F.position(end, last), lambda stop: F.when(stop > 0, F.substr(code, F.lit(1), F.length(code) - F.length(last) + stop + F.length(end) - 1)).otherwise(code))

    text = _c(x)
    return strip(let(let(F.position(begin, text), lambda at: F.when(at > 0, F.substr(text, at)).otherwise(text)), tail))


def filter_lines(x: Column | str) -> Column:
    """T-11: inputs and graphics removed, empty groups closed up, title and contents lines, blank lines and comments dropped."""

    def cleaned(line):
        return F.regexp_replace(_drop(line, r"\\input\{[^}]*\}", r"\\includegraphics(?:\[[^\]]*\])?\{[^}]*\}", r"\\includepdf(?:\[[^\]]*\])?\{[^}]*\}"), r"\{\s*\}", "{}")

    kept = F.filter(F.transform(lines(x), cleaned), lambda line: ~is_blank(line) & ~F.startswith(strip(line), F.lit("%")) & ~any_contains(line, ("\\maketitle", "\\tableofcontents")))
    return F.array_join(kept, "\n")


def standard_class(x: Column | str) -> Column:
    """T-12."""
    return F.regexp_replace(_c(x), r"\\documentclass(\[.*?\])?\{(article|report|book|scrartcl)\}", r"\\documentclass[tikz]{standalone}")


def _detected(x: Column | str, rules) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(any_match(x, patterns), F.lit(name)) for name, patterns in rules.items()))))


def required_packages(x: Column | str) -> Column:
    """T-13: the sorted packages whose patterns occur."""
    return _detected(x, PACKAGES)


def required_libraries(x: Column | str) -> Column:
    """T-13: the sorted libraries whose patterns occur."""
    return _detected(x, LIBRARIES)


def build_preamble(packages: Column | str, libraries: Column | str) -> Column:
    """T-14: the document class, a line for each package, ``tikz`` always among them, one line for all libraries."""
    names, parts = F.array_union(F.array(F.lit("tikz")), _c(packages)), _c(libraries)
    used = F.transform(F.array_sort(names), lambda p: F.concat(F.lit("\\usepackage{"), p, F.lit("}")))
    shared = F.when(F.size(parts) > 0, F.array(F.concat(F.lit("\\usetikzlibrary{"), F.array_join(F.array_sort(parts), ", "), F.lit("}")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit(STANDALONE_CLASS)), used, shared), "\n")


def plot_preamble(x: Column | str) -> Column:
    """T-15: the plot manual's preamble."""
    every = [F.lit(line) for line in PLOT_PREAMBLE] + [F.when(any_contains(x, words), F.lit(line)) for words, line in PLOT_LINES]
    return F.array_join(F.array_compact(F.array(*every)), "\n")


def add_page_libraries(preamble: Column | str, code: Column | str) -> Column:
    """T-16: the packages and libraries that the code's words call for, unless the preamble has a line of libraries."""
    base, text = _c(preamble), _c(code)
    three = F.contains(text, F.lit("tdplot")) & ~F.contains(base, F.lit(r"\usepackage{tikz-3dplot}"))
    base = F.when(three, F.concat(base, F.lit("\n\\usepackage{tikz-3dplot}"))).otherwise(base)
    found = F.array_sort(F.array_compact(F.array(*(F.when(F.regexp_like(text, F.lit(rf"\b{word}\b")), F.lit(lib)) for word, lib in PAGE_LIBRARIES.items()))))
    line = F.concat(F.lit("\n\\usetikzlibrary{"), F.array_join(found, ","), F.lit("}"))
    return F.when((F.size(found) > 0) & ~F.contains(base, F.lit("\\usetikzlibrary")), F.concat(base, line)).otherwise(base)


def inject_network_package(x: Column | str) -> Column:
    """T-17: exactly one line for the network package, if the class is the plain standalone one."""
    code = F.regexp_replace(_c(x), r"\\usepackage\{.*?tikz-?network.*?\}", "")
    code = F.when(F.contains(code, F.lit("\\documentclass")), code).otherwise(F.concat(F.lit("\\documentclass{standalone}\n"), code))
    return strip(F.replace(code, F.lit("\\documentclass{standalone}"), F.lit("\\documentclass{standalone}\n\\usepackage{tikz-network}")))


def page_documents(x: Column | str) -> Column:
    """X-17: one document for each picture of a page, all with the page's preamble (libraries added). Empty without a begin."""
    text = _c(x)
    preamble = add_page_libraries(F.substring_index(text, BEGIN, 1), text)
    rest = F.substr(text, F.position(F.lit(BEGIN), text) + len(BEGIN))
    pictures = F.regexp_extract_all(rest, F.lit(r"(?s)\\begin\{tikzpicture\}.*?\\end\{tikzpicture\}"), 0)
    documents = F.transform(pictures, lambda p: F.concat(preamble, F.lit("\n" + BEGIN + "\n"), p, F.lit("\n" + END)))
    return F.when(F.contains(text, F.lit(BEGIN)), documents).otherwise(F.array().cast("array<string>"))


def _keep_delimiters(x: Column, pattern: str, mark: str, n: Column) -> Column:
    """``x`` with only its first ``n`` occurrences of a delimiter."""

    def joined(parts: Column) -> Column:
        kept = F.array_join(F.slice(parts, F.lit(1), (n + 1).cast("int")), mark)
        return F.concat(kept, F.array_join(F.slice(parts, (n + 2).cast("int"), F.greatest(F.lit(0), F.size(parts) - n - 1).cast("int")), ""))

    return let(F.split(x, pattern, -1), joined)


def _balanced(x: Column, opens: str, open_mark: str, closes: str, close_mark: str) -> Column:
    def cut(t: Column) -> Column:
        a, b = F.regexp_count(t, F.lit(opens)), F.regexp_count(t, F.lit(closes))
        return F.when(a > b, _keep_delimiters(t, opens, open_mark, b)).when(b > a, _keep_delimiters(t, closes, close_mark, a)).otherwise(t)

    return let(x, cut)


def balance_delimiters(x: Column | str, opening: str = r"\(", closing: str = r"\)") -> Column:
    """T-24: of a pair of delimiters, the surplus of the more frequent one is removed from the right."""
    return _balanced(_c(x), rf"\Q{opening}\E", opening, rf"\Q{closing}\E", closing)


def balance_braces(x: Column | str, opening: str = "{", closing: str = "}") -> Column:
    """T-25: as T-24 for characters without a backslash before them."""
    return _balanced(_c(x), rf"(?<!\\)\Q{opening}\E", opening, rf"(?<!\\)\Q{closing}\E", closing)


def balance_dollars(x: Column | str) -> Column:
    """T-26: of an odd number of dollar signs without a backslash, the last is removed."""
    text = _c(x)
    return let(F.regexp_count(text, F.lit(r"(?<!\\)\$")), lambda n: F.when(n % 2 == 1, _keep_delimiters(text, r"(?<!\\)\$", "$", n - 1)).otherwise(text))


def clean_math(x: Column | str) -> Column:
    """T-27."""
    return balance_braces(balance_delimiters(balance_dollars(x)))


def clean_caption(x: Column | str) -> Column:
    """T-28 (macros are expanded before, see ``inkmill.functions.macros``): balanced, without labels, white space collapsed."""
    return collapse_space(F.regexp_replace(clean_math(x), r"\\label\{[^}]*\}", ""))


COLOUR = r"(?m)^\s*\\definecolor(?:\[\w+?\])?\{[a-zA-Z0-9_\-]+\}\{\w+?\}\{.+?\}"


def colour_definitions(macros: Column | str, code: Column | str) -> Column:
    """T-43: the colour definitions of ``macros`` whose names occur, as words, in ``code``."""
    every = F.transform(F.regexp_extract_all(_c(macros), F.lit(COLOUR), 0), strip)
    spaced = F.regexp_replace(_c(code), r"[^A-Za-z0-9_]", " ")
    padded = F.concat(F.lit(" "), spaced, F.lit(" "))

    def used(d):
        name = F.regexp_extract(d, r"\{([a-zA-Z0-9_\-]+)\}", 1)
        return F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(name, r"[^A-Za-z0-9_]", " "), F.lit(" ")))

    return strip(F.array_join(F.filter(every, used), "\n"))


def as_document(x: Column | str, preamble: str = DEFAULT_PREAMBLE) -> Column:
    """T-44: a text without a document environment gets one, and one without a class also the preamble; of a lone begin
    or end, the other is added."""
    text = _c(x)
    begins, ends, has_class = F.contains(text, F.lit(BEGIN)), F.contains(text, F.lit(END)), F.regexp_like(text, F.lit(r"\\document(class|style)"))
    head = F.when(has_class, F.lit("")).otherwise(F.lit(preamble.strip() + "\n"))
    opened = F.lit(BEGIN + "\n")
    at = F.position(F.lit("\\begin{"), text)
    inserted = F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), opened, F.substr(text, at))).otherwise(F.concat(text, opened))
    body = F.when(begins, text).when(has_class, inserted).otherwise(F.concat(opened, text))
    return F.concat(head, body, F.when(ends, F.lit("")).otherwise(F.lit("\n" + END)))


def preamble_parts(x: Column | str, classes: list[str] | None = None) -> Column:
    r"""X-06: struct(imports, macros) of the lines before ``\begin{document}``. Comments and redefinitions are dropped; a class that
    is not among ``classes`` (if given) becomes article."""
    statements = F.filter(lines(F.substring_index(_c(x), BEGIN, 1)), lambda s: ~is_blank(s) & ~F.startswith(strip(s), F.lit("%")) & ~_starts(strip(s), NOT_MACROS))

    def imports(s):
        return any_contains(s, IMPORT_MARKS) | (F.startswith(strip(s), F.lit("\\usepackage")) & any_contains(s, IMPORT_PACKAGES))

    def known(s):
        if classes is None:
            return s
        return F.when(F.startswith(strip(s), F.lit("\\documentclass")) & ~any_contains(s, classes), F.lit("\\documentclass{article}")).otherwise(s)

    return F.named_struct(
        F.lit("imports"),
        strip(F.array_join(F.transform(F.filter(statements, imports), known), "\n")),
        F.lit("macros"),
        strip(F.array_join(F.filter(statements, lambda s: ~imports(s)), "\n")),
    )


def _starts(x: Column, prefixes) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(x, F.lit(p))
    return hit


def prefix_lines(x: Column | str) -> Column:
    """X-07: the standalone class and the distinct lines of the preamble that load or define something, else the default preamble."""
    head = lines(F.substring_index(_c(x), BEGIN, 1))
    found = F.array_distinct(F.transform(F.filter(head, lambda s: F.regexp_like(s, F.lit(r"\\(?:usepackage|usetikzlibrary|newcommand|def|tikzset|tikzstyle)"))), strip))
    return F.when(F.size(found) > 0, F.array_join(F.concat(F.array(F.lit(STANDALONE_CLASS)), found), "\n")).otherwise(F.lit(DEFAULT_PREAMBLE))


def build_document(env: Column | str, code: Column | str, imports: Column | str, macros: Column | str, used_macros: Column | str | None = None) -> Column:
    """T-45: a document for one picture: the class with the colours and macros it uses, the imports of six kinds, the picture
    without external files, empty lines and what surrounds the environment. Sections stand apart by an empty line; that of the
    imports is there even if empty."""
    kept = F.filter(F.transform(lines(_c(imports)), strip), lambda s: ~F.startswith(s, F.lit("\\documentclass")) & _starts(s, KEPT_IMPORTS))
    used = F.coalesce(_c(used_macros), F.lit("")) if used_macros is not None else F.lit("")
    place = "\x00"
    section = lambda t: F.when(t != "", F.concat(F.lit("\n\n"), t)).otherwise(F.lit(""))

    def whole(body: Column) -> Column:
        head = F.concat(F.lit(STANDALONE_CLASS), let(colour_definitions(macros, body), section), F.lit(place))
        picture = F.when(F.coalesce(_c(env), F.lit("")) == "", strip(body)).otherwise(trim_to_environment(body, _c(env)))
        return F.array_join(F.array(head, strip(F.array_join(kept, "\n")), F.lit(BEGIN), picture, F.lit(END)), "\n\n")

    # the macros may come from Python, which must not stand inside of a lambda
    return F.replace(let(remove_empty_lines(remove_external(strip(F.replace(_c(code), F.lit(place), F.lit(""))))), whole), F.lit(place), section(used))


def format_as_document(code: Column | str, preamble: Column | str, pre: Column | str | None = None, post: Column | str | None = None, instead: Column | str | None = None) -> Column:
    """T-46: class, preamble and body; ``instead`` takes the code's place, ``pre`` and ``post`` go around it. Null parts are left out."""
    body = F.coalesce(_c(instead), _c(code)) if instead is not None else _c(code)
    around = F.concat_ws("\n", *(_c(p) for p in (pre,) if p is not None), body, *(_c(p) for p in (post,) if p is not None))
    return F.concat_ws("\n", F.lit(STANDALONE_CLASS), _c(preamble), F.lit(BEGIN), around, F.lit(END))


def label_of(x: Column | str) -> Column:
    """X-05: the first label, or an empty text."""
    return strip(F.regexp_extract(_c(x), r"\\label\{([^\}]+)\}", 1))


def labels_of(x: Column | str) -> Column:
    """X-09: all different labels in order of appearance, blank ones left out."""
    labels = F.transform(F.regexp_extract_all(_c(x), F.lit(r"\\label\{([^\}]+)\}"), 1), lambda label: strip(label))
    return F.array_distinct(F.filter(labels, lambda label: label != ""))


def relevant_code(x: Column | str) -> Column:
    """X-28: the first picture, or the whole text, white space collapsed."""
    found = F.regexp_extract(_c(x), r"(?s)\\begin\{(tikzpicture|circuitikz|tikzcd)\}.*?\\end\{\1\}", 0)
    return collapse_space(F.when(found == "", _c(x)).otherwise(found))
