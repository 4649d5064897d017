r"""Text functions from Column to Column: no Python runs, so plans stay in generated code.

Regular expressions are written for Java: loops over long text are possessive or of one class, so that none of them recurses.
Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that Python's str.strip() removes, as a character class.
WIDE_SPACE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = r"[\s\x0b\x1c-\x1f" + "".join(f"\\x{{{c:x}}}" for c in WIDE_SPACE) + "]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row, however often it is used. Expressions with lambdas share
    nothing by themselves, so nested uses would multiply."""
    return F.transform(F.array(value), use)[0]


def strip(x: Column | str) -> Column:
    """T-20: white space (Unicode) removed from both ends."""
    return F.regexp_replace(_c(x), rf"^{SPACE}++|{SPACE}++$", "")


def rstrip(x: Column | str) -> Column:
    """T-20: white space removed from the end."""
    return F.regexp_replace(_c(x), rf"{SPACE}++$", "")


def lstrip(x: Column | str) -> Column:
    """T-20: white space removed from the start."""
    return F.regexp_replace(_c(x), rf"^{SPACE}++", "")


def is_blank(x: Column | str) -> Column:
    """F-05: null, empty or white space only."""
    return F.coalesce(F.length(strip(x)), F.lit(0)) == 0


def lines(x: Column | str) -> Column:
    return F.split(_c(x), "\n")


def collapse_space(x: Column | str) -> Column:
    """T-22: runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(_c(x), rf"{SPACE}++", " "))


def truncate(x: Column | str, n: int = 500) -> Column:
    """T-23: the first ``n`` characters."""
    return F.substring(_c(x), 1, n)


def first_lines(x: Column | str, n: int) -> Column:
    """O-10."""
    return F.array_join(F.slice(lines(x), 1, n), "\n")


def last_lines(x: Column | str, n: int) -> Column:
    """O-10."""
    every = lines(x)
    return F.array_join(F.slice(every, F.greatest(F.lit(1), F.size(every) - n + 1), F.lit(n)), "\n")


def strip_comment(line: Column | str) -> Column:
    r"""T-01: a line up to its first ``%`` with an even number of backslashes before it, without white space at the end."""
    return rstrip(F.regexp_replace(_c(line), r"(?s)^([^%\\]*+(?:\\.[^%\\]*+)*+)%.*$", "$1"))


def clean_code(x: Column | str) -> Column:
    """T-02: lines that are comments are dropped, other comments cut off, the whole stripped."""
    kept = F.filter(lines(x), lambda line: ~F.startswith(lstrip(line), F.lit("%")))
    return strip(F.array_join(F.transform(kept, strip_comment), "\n"))


def drop_comment_lines(x: Column | str) -> Column:
    """T-03: only lines that are comments are dropped."""
    return strip(F.array_join(F.filter(lines(x), lambda line: ~F.startswith(lstrip(line), F.lit("%"))), "\n"))


def all_lines_start_with(x: Column | str, prefix: str = "%", strict: bool = False) -> Column:
    """T-04: whether every line that is not blank starts with ``prefix``; strict: every line, as it stands."""
    if strict:
        return F.forall(lines(x), lambda line: F.startswith(line, F.lit(prefix)))
    return F.forall(lines(x), lambda line: is_blank(line) | F.startswith(lstrip(line), F.lit(prefix)))


def _quoted(prefix: str) -> str:
    return "\\Q" + prefix.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def remove_line_prefix(x: Column | str, prefix: str = "%", exact: bool = False) -> Column:
    """T-05: ``prefix`` removed from the start of each line, with the white space before it unless exact."""
    lead = "" if exact else f"{SPACE}*+"
    return F.array_join(F.transform(lines(x), lambda line: F.regexp_replace(line, f"^{lead}{_quoted(prefix)}", "")), "\n")


def dedent(x: Column | str) -> Column:
    """T-21: the white space that all lines with text share at their start is removed; blank lines become empty."""

    def cut(blank_less: Column) -> Column:
        leads = F.transform(F.filter(blank_less, lambda line: line != ""), lambda line: F.regexp_extract(line, r"^([ \t]*+)", 1))
        # the common prefix of all is that of the least and the greatest
        return let(let(leads, lambda v: F.array(F.array_min(v), F.array_max(v))), lambda v: joined(blank_less, common(v[0], v[1])))

    def common(low: Column, high: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low))),
            F.lit(0),
            lambda n, i: F.when((n == i - 1) & (i <= F.length(low)) & (F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1))), i).otherwise(n),
        )

    def joined(blank_less: Column, size: Column) -> Column:
        return let(F.coalesce(size, F.lit(0)), lambda n: F.array_join(F.transform(blank_less, lambda line: F.when(line == "", line).otherwise(F.substr(line, n + 1))), "\n"))

    return let(F.transform(lines(x), lambda line: F.when(F.regexp_like(line, F.lit(r"^[ \t]*+$")), F.lit("")).otherwise(line)), cut)


def clean_block(x: Column | str, prefix: Column | str | None = None) -> Column:
    """T-06: dedented and cleaned; code whose every line is a comment is uncommented, and else the first occurrence of
    the (cleaned) prefix is removed. Null stays null; a null or empty prefix removes nothing."""
    head = F.coalesce(clean_code(dedent(_c(prefix))), F.lit("")) if prefix is not None else None

    def without(plain: Column) -> Column:
        if head is None:
            return plain
        return let(head, lambda h: let(F.position(h, plain), lambda at: F.when((h != "") & (at > 0), strip(F.concat(F.substr(plain, F.lit(1), at - 1), F.substr(plain, at + F.length(h))))).otherwise(plain)))

    return let(dedent(_c(x)), lambda base: F.when(all_lines_start_with(base) & ~is_blank(base), strip(remove_line_prefix(base))).otherwise(let(clean_code(base), without)))


def remove_empty_lines(x: Column | str) -> Column:
    """T-09."""
    return F.array_join(F.filter(lines(x), lambda line: ~is_blank(line)), "\n")


def normalise(x: Column | str) -> Column:
    """T-42: lower case, nothing but a-z, 0-9 and white space."""
    return F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9\s]", "")


def ascii_fold(x: Column | str) -> Column:
    """T-29: dashes become hyphens; other characters their closest ASCII ones, or nothing. Letters with marks are folded
    by the table of Latin letters below, and what is not ASCII then is dropped."""
    dashed = F.regexp_replace(_c(x), r"[\x{2010}-\x{2015}\x{2212}]", "-")
    return F.regexp_replace(F.translate(dashed, *LATIN), r"[^\x00-\x7f]", "")


def _latin() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(c), n) for c in range(0xA0, 0x250) if len(n := unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


LATIN = _latin()


def paper_id(x: Column | str) -> Column:
    """T-30: ``2101.00001`` as it is, ``math0309136`` as ``math/0309136``; null if it is neither."""
    whole = F.regexp_extract(_c(x), r"^([a-zA-Z-]*)([\d.]+)$", 0)
    archive, number = (F.regexp_extract(_c(x), r"^([a-zA-Z-]*)([\d.]+)$", k) for k in (1, 2))
    return F.when(whole == "", F.lit(None)).when(archive == "", number).otherwise(F.concat(archive, F.lit("/"), number))


def strip_version(x: Column | str) -> Column:
    """T-31: what stands before the first ``v``."""
    return F.substring_index(_c(x), "v", 1)


def _from_backslash_to_line_end(x: Column) -> Column:
    first = F.instr(x, "\\")
    last = F.length(x) - F.instr(F.reverse(x), "\\") + 1
    after = F.instr(F.substr(x, last), "\n")
    end = F.when(after > 0, last + after - 2).otherwise(F.length(x))
    return F.when(first == 0, F.lit("")).otherwise(F.substr(x, first, end - first + 1))


def extract_code(x: Column | str) -> Column:
    """T-32: from the first backslash to the end of the line of the last one, stripped; empty if there is none."""
    return strip(let(_c(x), _from_backslash_to_line_end))


def extract_repair(x: Column | str) -> Column:
    """T-33: as T-32 after the reasoning (``<think>`` to ``</think>``) is removed; the whole answer if there is no code."""
    answer = F.regexp_replace(_c(x), r"(?s)<think>.*?</think>\s*", "")
    return let(answer, lambda a: let(extract_code(a), lambda code: F.when(code == "", strip(a)).otherwise(code)))


def extract_answer(x: Column | str) -> Column:
    r"""T-34: from the first backslash through ``\end{document}``; without that, through the last backslash; else empty."""
    text = _c(x)
    first = F.instr(text, "\\")
    end = F.instr(text, "\\end{document}")
    last = F.length(text) - F.instr(F.reverse(text), "\\") + 1
    return F.when(first == 0, F.lit("")).when(end >= first, F.substr(text, first, end + 14 - first)).otherwise(F.substr(text, first, last - first + 1))


# Fixed value: the form of a standalone document.
STANDALONE = r"(?s)\\documentclass\s*\[[^\]]*?\btikz\b[^\]]*?\]\s*\{standalone\}.*?\\begin\{document\}.*?\\end\{document\}"


def extract_document(x: Column | str) -> Column:
    """T-35: the first standalone document, without NUL characters; null if there is none."""
    found = F.regexp_extract(F.replace(_c(x), F.lit("\x00"), F.lit("")), STANDALONE, 0)
    return F.when(found != "", found)


def strip_fence(x: Column | str) -> Column:
    """T-36: the code fence around a JSON answer removed."""
    return strip(F.regexp_replace(strip(x), r"^```(?:json)?|```$", ""))


def log_excerpt(x: Column | str, before: int = 3, after: int = 30, tail: int = 30) -> Column:
    """T-37: from ``before`` lines before the first line that starts with ``! `` to less than ``after`` lines after it; without
    such a line the last ``tail`` lines. Empty for null and empty logs."""
    log = F.coalesce(_c(x), F.lit(""))
    every = lines(log)
    at = F.array_position(F.transform(every, lambda line: F.startswith(line, F.lit("! "))), True)
    low = F.greatest(F.lit(1), at - before).cast("int")
    part = F.slice(every, low, (at + after - low).cast("int"))
    return F.when(log == "", log).when(at > 0, F.array_join(part, "\n")).otherwise(last_lines(log, tail))


def code_hash(x: Column | str) -> Column:
    """T-40: SHA-256 in hexadecimal digits."""
    return F.sha2(_c(x), 256)


def base64_text(x: Column | str) -> Column:
    """T-41: the UTF-8 bytes in base64, without line breaks."""
    return F.regexp_replace(F.base64(F.encode(_c(x), "UTF-8")), r"\s", "")


def insert_after_first_line(x: Column | str, line: str) -> Column:
    """P-12: ``line`` becomes the second line."""
    every = lines(x)
    return F.array_join(F.concat(F.slice(every, 1, 1), F.array(F.lit(line)), F.slice(every, F.lit(2), F.greatest(F.lit(0), F.size(every) - 1))), "\n")


def description(title: Column | str, body: Column | str) -> Column:
    """P-06: title and body, an empty line between them."""
    return strip(F.concat_ws("\n\n", _c(title), _c(body)))


# Phrases that page descriptions are freed from.
BOILERPLATE = (
    "Edit and compile if you like:",
    "Edit and compile the code if you like.",
    "Full code to edit and compile if you like:",
    "Edit and compile the full code below if you like.",
)


def page_description(text: Column | str, title: Column | str, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    """T-18: without the phrases; "No Description" if nothing is left; with the title, and a full stop unless it ends in
    punctuation, if it does not hold the title; white space collapsed. Null texts and titles count as empty."""
    body = F.coalesce(_c(text), F.lit(""))
    for phrase in phrases:
        body = F.replace(body, F.lit(phrase), F.lit(""))
    body, head = strip(body), F.coalesce(_c(title), F.lit(""))
    headed = F.concat(head, F.lit(". "), body)
    closed = F.when(F.regexp_like(headed, F.lit(r"\p{Punct}$")), headed).otherwise(F.concat(headed, F.lit(".")))
    full = F.when(F.contains(F.lower(body), F.lower(head)), body).otherwise(closed)
    return F.when(body == "", F.lit("No Description")).otherwise(collapse_space(full))


def figure_title(x: Column | str) -> Column:
    """T-19: without ``Figure 1.2 -`` at the start (an en dash), and only what stands before the next en dash."""
    return strip(F.substring_index(F.regexp_replace(_c(x), r"^Figure [\d.,\s]+\x{2013}\s*", ""), "\N{EN DASH}", 1))


def stem(path: Column | str) -> Column:
    """P-08: a file's name without its folder and its last extension."""
    return F.regexp_replace(F.substring_index(_c(path), "/", -1), r"\.[^.]*$", "")


def title_from_name(path: Column | str, rule: str = "stem") -> Column:
    """P-08: a title by one of the rules ``stem``, ``spaces``, ``last_dash``, ``last_dot`` and ``tags`` (``desc+tag+tag``)."""
    name = stem(path)
    if rule == "stem":
        return name
    if rule == "spaces":
        return F.replace(name, F.lit("-"), F.lit(" "))
    if rule == "last_dash":
        return F.substring_index(name, "-", -1)
    if rule == "last_dot":
        return F.substring_index(name, ".", -1)
    if rule == "tags":
        parts = F.split(F.replace(name, F.lit("_"), F.lit(" ")), r"\+")
        tags = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), ", ")
        return F.when(F.size(parts) > 1, F.concat(parts[0], F.lit(" ("), tags, F.lit(")"))).otherwise(parts[0])
    raise ValueError(f"unknown rule: {rule}")
