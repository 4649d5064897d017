"""Training pairs from a corpus: the engine's main plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import extract_repair, is_blank
from inkmill.operators.dedup import dedup_exact
from inkmill.operators.relational import filter_corpus, first_by, with_texts
from inkmill.operators.sampling import sample, sharded


def with_captions(corpus: DataFrame, captions: DataFrame) -> DataFrame:
    """New captions from a later table, the least of those that are not blank, take the place of missing ones."""
    later = captions.where(~is_blank("new_caption")).groupBy(F.col("file_id").alias("__id")).agg(F.min("new_caption").alias("__new"))
    joined = corpus.join(later, F.col("file_id") == F.col("__id"), "left")
    return joined.withColumn("new_caption", F.when(is_blank("new_caption"), F.col("__new")).otherwise(F.col("new_caption"))).drop("__id", "__new")


def with_repairs(corpus: DataFrame, responses: DataFrame) -> DataFrame:
    """``code_new`` from model answers, of several the least, where they hold code; else what it was."""
    code = responses.where("file_id is not null").select(F.col("file_id").alias("__id"), extract_repair("response").alias("__code")).where(F.startswith("__code", F.lit("\\")))
    once = first_by(code, ["__id"], ["__code"])
    return corpus.join(once, F.col("file_id") == F.col("__id"), "left").withColumn("code_new", F.coalesce("__code", "code_new")).drop("__id", "__code")


def build_pairs(corpus: DataFrame, variant: str = "caption_and_new_caption", sources: str | None = None, compiled: bool = True, min_length: int = 100, max_length: int = 4000, captions: DataFrame | None = None, reference: DataFrame | None = None, n: int | None = None, fraction: float | None = None, seed: int = 42, shards: int | None = None) -> DataFrame:
    """(file_id, source, text, label, and shard if asked): records filtered, their exact duplicates (and those of the reference's
    codes) removed, an input text for each, sampled by a seeded hash and dealt to shards.

    Filters reach the scan; duplicates are found by hash before texts are made; the sample and the shards need no global task.
    """
    rows = corpus.select("file_id", "source", "status", "code_length", "code", "caption", "new_caption", "text_mentions")
    rows = filter_corpus(rows, sources, compiled, min_length, max_length).where(F.col("code").isNotNull())
    if captions is not None:
        rows = with_captions(rows, captions)
    rows = dedup_exact(rows, "code", ("file_id",), reference)
    pairs = with_texts(rows, variant).select("file_id", "source", "text", F.col("code").alias("label"))
    if n is not None or fraction is not None:
        pairs = sample(pairs.withColumn("__key", F.concat_ws("|", "file_id", F.md5("text"))), "__key", seed, n, fraction).drop("__key")
    return sharded(pairs, ["file_id", "text"], shards) if shards else pairs
