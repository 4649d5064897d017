"""Figures from papers: wrap, split the preamble, extract, clean, rebuild, find what is said of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.extraction import figures, mentions_among, referring_paragraphs
from inkmill.functions.latex import as_document, build_document, clean_caption, has_picture, is_uncompilable, preamble_parts
from inkmill.functions.macros import used_macros
from inkmill.functions.text import clean_block, let


def extract_figures(papers: DataFrame, key: str, text: str, balanced: bool = False) -> DataFrame:
    """(file_id, key, caption, code, text_mentions): the different figures of each paper, as documents of their own.

    Papers without a picture are left out before anything costly runs. All that belongs to a paper is in its row, so nothing is
    joined, and what a paper says of its figures is found once, not for each figure; equal figures of one paper count once, the first in order. Null texts give nothing.
    """
    wanted = papers.select(key, text).where(has_picture(text))
    parsed = wanted.select(key, text, preamble_parts(as_document(text)).alias("__pre"), figures(text, balanced).alias("__figures"), referring_paragraphs(text).alias("__said"))
    fields = lambda f: F.named_struct(F.lit("env"), f["env"], F.lit("start"), f["start"], F.lit("body"), clean_block(f["code"]), F.lit("caption"), clean_caption(f["caption"]), F.lit("label"), f["label"])
    distinct = lambda c: F.filter(c, lambda f, i: (F.array_position(c["body"], f["body"]) == i + 1) & (f["body"] != ""))
    once = parsed.select(key, "__said", "__pre", F.explode(let(F.transform("__figures", fields), distinct)).alias("f")).select(key, "__said", "__pre", "f.*")
    # tested on the parts: a filter on the document would build it again
    once = once.where(~is_uncompilable("body") & ~is_uncompilable("__pre.imports"))
    document = build_document(F.col("env"), F.col("body"), F.col("__pre.imports"), F.col("__pre.macros"), used_macros(F.col("__pre.macros"), F.col("body")))
    return once.select(F.concat_ws("_", F.col(key).cast("string"), F.col("start").cast("string")).alias("file_id"), key, "caption", document.alias("code"), mentions_among("__said", "label").alias("text_mentions"))
