r"""Extraction of pictures, captions, paragraphs, links and nested records."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import _c, collapse_space, is_blank, strip

MAX_BLOCK = 100_000
PICTURE = r"(?s)\\begin\{(tikzpicture|circuitikz|tikzcd)\}(\[[^\]]*\])?.*?\\end\{\1\}"
FIGURE_SCHEMA = "array<struct<env:string,code:string,caption:string,label:string,start:int,end:int>>"


def pictures(x: Column | str, longest: int = MAX_BLOCK) -> Column:
    """X-01, F-14: the pictures of a text in order, each to the first end of its environment; longer ones are left out."""
    return F.filter(F.regexp_extract_all(_c(x), F.lit(PICTURE), 0), lambda p: F.length(p) <= longest)


def picture_environment(code: Column) -> Column:
    return F.regexp_extract(code, r"\\begin\{(\w+)\}", 1)


def distinct_pictures(df: DataFrame, text: str, key: str) -> DataFrame:
    """X-01, D-02, P-10: (key, position, env, code) of the different pictures of each text. Evaluated within the row."""
    every = df.select(key, F.posexplode(F.array_distinct(pictures(text))).alias("position", "code"))
    return every.select(key, "position", picture_environment(F.col("code")).alias("env"), "code")


_FIGURE = re.compile(r"\\begin\{figure\}(.*?)\\end\{figure\}", re.S)
_PICTURE = re.compile(PICTURE)
_LABEL = re.compile(r"\\label\{([^}]+)\}")
_CAPTION = re.compile(r"\\caption(?:\[[^\]]*\])?\s*\{")


def balanced_group(text: str, start: int) -> str | None:
    """X-04: the content of the brace group that opens at ``start``; None if it does not close. Escaped braces do not count."""
    depth, at = 0, start
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start + 1 : at]
        at += 1
    return None


def figures_in(text: str, longest: int = MAX_BLOCK, balanced: bool = False) -> list[dict]:
    """X-01, X-03, X-04, J-11: pictures with caption and label of the figure around them."""
    frames = [(m.start(), m.end(), m[1]) for m in _FIGURE.finditer(text)]
    out, k = [], 0
    for m in _PICTURE.finditer(text):
        if m.end() - m.start() > longest:
            continue
        while k < len(frames) and frames[k][1] < m.end():
            k += 1
        caption = label = ""
        if k < len(frames) and frames[k][0] <= m.start():
            body = frames[k][2]
            c, found = _CAPTION.search(body), _LABEL.search(body)
            if c:
                inner = balanced_group(body, c.end() - 1) if balanced else body[c.end() :].partition("}")[0]
                caption = (inner or "").strip()
            label = found[1].strip() if found else ""
        out.append({"env": m[1], "code": m[0], "caption": caption, "label": label, "start": m.start(), "end": m.end()})
    return out


def figures(x: Column | str, balanced: bool = False, longest: int = MAX_BLOCK) -> Column:
    """X-01, X-03: the pictures with their captions and labels. ``balanced`` reads captions to the matching brace."""

    @F.udf(FIGURE_SCHEMA, useArrow=True)
    def run(text):
        return None if text is None else figures_in(text, longest, balanced)

    return run(_c(x))


def balanced_caption(x: Column | str) -> Column:
    """X-04: the first caption of a text up to its matching brace; null if there is none."""

    @F.udf("string", useArrow=True)
    def run(text):
        m = _CAPTION.search(text) if text else None
        return balanced_group(text, m.end() - 1) if m else None

    return run(_c(x))


# a match begins with its line, or where the one before ended; other places need not be tried
LEGACY = r"(?s)(?:\G|(?<=\n))([^\n]*?)\\begin\{tikzpicture\}.*?\\end\{tikzpicture\}"


def legacy_figures(df: DataFrame, key: str, text: str, longest: int = MAX_BLOCK) -> DataFrame:
    """X-02: (key, prefix, code, caption, label) by the older rule: the picture of each figure that holds exactly one, with what stands before it
    in its line, the caption to its matching brace and the label; and then every picture once more, without caption and label."""
    figure = df.select(key, F.explode(F.regexp_extract_all(_c(text), F.lit(r"(?s)\\begin\{figure\}(.*?)\\end\{figure\}"), 1)).alias("f"))
    single = figure.where(F.regexp_count("f", F.lit(r"\\begin\{tikzpicture\}")) == 1).select(key, "f", F.regexp_extract("f", LEGACY, 0).alias("code"), F.regexp_extract("f", LEGACY, 1).alias("prefix"))
    single = single.where((F.col("code") != "") & (F.length("code") <= longest))
    framed = single.select(key, "prefix", "code", F.coalesce(balanced_caption("f"), F.lit("")).alias("caption"), strip(F.regexp_extract("f", r"\\label\{([^}]+)\}", 1)).alias("label"))
    every = df.select(key, F.explode(F.regexp_extract_all(_c(text), F.lit(LEGACY), 0)).alias("code"))
    return framed.unionByName(every.select(key, F.regexp_extract("code", LEGACY, 1).alias("prefix"), "code", F.lit("").alias("caption"), F.lit("").alias("label")))


PARAGRAPH = r"\n\s*\n|(?=\\(?:chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{)|(?=\\begin\{)"


def paragraphs(x: Column | str) -> Column:
    """X-08: split at empty lines and before headings and environments, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(_c(x), PARAGRAPH), strip), lambda p: p != "")


def sentences(x: Column | str) -> Column:
    """Split after a full stop, exclamation or question mark that white space follows."""
    return F.filter(F.split(_c(x), r"(?<=[.!?])\s+"), lambda s: ~is_blank(s))


REFERENCE = r"\\(?:ref|cref|autoref)\{([^}]*)\}"


def references(x: Column) -> Column:
    """The labels that a text refers to; lists count one by one."""
    return F.array_distinct(F.transform(F.flatten(F.transform(F.regexp_extract_all(x, F.lit(REFERENCE), 1), lambda r: F.split(r, ","))), strip))


def text_mentions(x: Column | str, label: Column | str, shortest: int = 10, longest: int = 1000, before: int = 1, after: int = 3) -> Column:
    """X-09, A-08: the sorted paragraphs that refer to a label; of paragraphs of another length, the sentences around the
    reference. Evaluated within the row, without a join. Empty for an empty or null label."""
    return mentions_among(referring_paragraphs(x), label, shortest, longest, before, after)


def referring_paragraphs(x: Column | str) -> Column:
    """X-09: the paragraphs that refer to anything, with the labels they refer to: all that the mentions of each label need."""
    every = F.transform(F.filter(paragraphs(x), lambda p: F.contains(p, F.lit("ref{"))), lambda p: F.struct(p.alias("text"), references(p).alias("refs")))
    return F.filter(every, lambda p: F.size(p["refs"]) > 0)


def mentions_among(found: Column | str, label: Column | str, shortest: int = 10, longest: int = 1000, before: int = 1, after: int = 3) -> Column:
    """X-09, A-08: ``text_mentions`` from what ``referring_paragraphs`` gave for the text."""

    def of(p):
        parts = sentences(p)
        at = F.array_position(F.transform(parts, lambda s: F.array_contains(references(s), _c(label))), True)
        low = F.greatest(F.lit(1), at - before).cast("int")
        window = F.array_join(F.slice(parts, low, (at + after - low + 1).cast("int")), " ")
        return F.when(F.length(p).between(shortest, longest), p).when(at > 0, window).otherwise(p)

    hits = F.filter(_c(found), lambda p: F.array_contains(p["refs"], _c(label)))
    return F.when(F.coalesce(_c(label), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.transform(hits, lambda p: of(p["text"])))))


# Entities of HTML text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\N{NO-BREAK SPACE}"), ("&amp;", "&"))


def unescape(x: Column) -> Column:
    for entity, char in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def html_code_blocks(x: Column | str) -> Column:
    """X-10: the texts of code in ``pre`` blocks, entities resolved."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit(r"(?s)<pre[^>]*>\s*<code[^>]*>(.*?)</code>"), 1), lambda c: unescape(F.regexp_replace(c, r"<[^>]+>", "")))


def html_text(x: Column | str) -> Column:
    """X-11: the text without ``pre`` blocks and tags, stripped."""
    return strip(unescape(F.regexp_replace(F.regexp_replace(_c(x), r"(?s)<pre[^>]*>.*?</pre>", ""), r"<[^>]+>", "")))


def page_links(x: Column | str) -> Column:
    """X-14: the targets of links, in order."""
    return F.regexp_extract_all(_c(x), F.lit(r'<a\s[^>]*?href="([^"]*)"'), 1)


def resolved(link: Column | str, base: Column | str) -> Column:
    """X-14: a link made absolute against its page's address."""
    l, b = _c(link), _c(base)
    root = F.regexp_extract(b, r"^(\w+://[^/]+)", 1)
    folder = F.regexp_extract(b, r"^(\w+://.*/)", 1)
    return F.when(F.regexp_like(l, F.lit(r"^\w+:")), l).when(F.startswith(l, F.lit("//")), F.concat(F.regexp_extract(b, r"^(\w+:)", 1), l)).when(F.startswith(l, F.lit("/")), F.concat(root, l)).otherwise(F.concat(F.when(folder == "", F.concat(b, F.lit("/"))).otherwise(folder), l))


def page_title(x: Column | str) -> Column:
    """X-16: the page's title before its first en dash."""
    return strip(F.substring_index(unescape(F.regexp_extract(_c(x), r"(?s)<title>(.*?)</title>", 1)), "\N{EN DASH}", 1))


def markdown_title(x: Column | str) -> Column:
    """X-19: the first heading of the first level, or null."""
    found = F.regexp_extract(_c(x), r"(?m)^# (.*)$", 1)
    return F.when(found != "", strip(found))


def markdown_notes(x: Column | str, heading: str = "Notes") -> Column:
    """X-19: the first paragraph below the heading of that name, else the first paragraph that is no heading; null without one."""
    below = F.regexp_extract(_c(x), rf"(?sm)^## \Q{heading}\E[^\n]*\n\s*(.+?)(?:\n\s*\n|\z)", 1)
    first = F.try_element_at(F.filter(F.split(_c(x), r"\n\s*\n"), lambda p: ~is_blank(p) & ~F.startswith(strip(p), F.lit("#"))), F.lit(1))
    return F.when(below != "", collapse_space(below)).otherwise(collapse_space(first))


QA_SCHEMA = "map<string,struct<qa:array<struct<reference:string,reference_figure:string,reference_figures:string,explanation:string,rationale:string,image_description:string>>>>"


def _values(x: Column) -> Column:
    """A text that is a JSON list as its entries, another text as one entry."""
    listed = F.from_json(x, "array<string>")
    return F.when(F.startswith(strip(x), F.lit("[")), listed).otherwise(F.array(x))


def _first_filled(*columns: Column) -> Column:
    filled = [F.when(~is_blank(c) & (c != "[]"), c) for c in columns]
    return F.coalesce(*filled)


def qa_rows(df: DataFrame, json: str) -> DataFrame:
    """X-21, S-07, F-21, D-03: (figure_id, new_caption) of a JSON map of papers: the first filled of three kinds of references
    crossed with the first filled of three texts; figures named tables are dropped; each pair once."""
    papers = df.select(F.explode(F.from_json(json, QA_SCHEMA)).alias("paper", "v")).select("paper", F.explode("v.qa").alias("q"))
    refs = _first_filled(F.col("q.reference"), F.col("q.reference_figure"), F.col("q.reference_figures"))
    texts = _first_filled(F.col("q.explanation"), F.col("q.rationale"), F.col("q.image_description"))
    rows = papers.select(F.explode(_values(refs)).alias("figure_id"), collapse_space(texts).alias("new_caption"))
    rows = rows.withColumn("figure_id", F.regexp_replace("figure_id", r"\.[^./]*$", ""))
    return rows.where("figure_id is not null and new_caption is not null and new_caption <> '' and not contains(lower(figure_id), 'table')").distinct()


def query_rows(df: DataFrame, key: str, response: str, most: int = 10) -> DataFrame:
    """X-22, T-36, P-10: (key, j, query_key, query) of a JSON map answered by a model, at most ``most`` of each; fences are removed,
    answers that are no JSON give nothing."""
    from inkmill.functions.text import strip_fence

    entries = F.map_entries(F.from_json(strip_fence(response), "map<string,string>"))
    return df.select(key, F.posexplode(F.slice(entries, 1, most)).alias("j", "e")).select(key, "j", F.col("e.key").alias("query_key"), F.col("e.value").alias("query"))


def template_rows(df: DataFrame, key: str, response: str, most: int = 5) -> DataFrame:
    """X-23, Q-12: (key, j, template, terms) of the pairs ``template_j`` and ``terms_j`` of a JSON answer."""
    from inkmill.functions.text import strip_fence

    parsed = F.from_json(strip_fence(response), "map<string,string>")
    every = df.select(key, parsed.alias("m"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("j"))
    rows = every.select(key, "j", F.col("m")[F.concat(F.lit("template_"), "j")].alias("template"), F.from_json(F.col("m")[F.concat(F.lit("terms_"), "j")], "map<string,array<string>>").alias("terms"))
    return rows.where("template is not null and terms is not null")
