"""Mixing sources to target shares of all tokens, with a cap on how often a document is used.

The size of a mix is the largest at which every source can reach its share without any of its documents being used more than
``max_repeats`` times. A source's documents are hashed into blocks; its quota is a number of whole passes over all its blocks
and a last pass over some of them, of whose last block only some documents are taken. The blocks that are due from all sources are dealt to the
output shards by a splitting tree: each node halves its shards and draws the left half's blocks of each source from the
multivariate hypergeometric distribution, seeded by the node, so every shard finds its own counts and ranges on its own,
in as many draws as the tree is deep, and the ranges of all shards are disjoint and cover the quotas exactly. Each pass has its
own permutation of the blocks; a shard gets the blocks of its ranges and shuffles their documents locally.

No step gathers a source: blocks are at most ``MOST_BLOCKS`` a source (and so are their rows), documents meet their blocks by hash. Where
blocks would hold more than ``BLOCK_DOCS`` documents because of that, the shards are divided further by a hash of the documents, so
that a shard stays as small as it is meant to be.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.tokens import FOLDER, VOCABULARY, token_counts
from inkmill.session import materialise

#: Documents in a block, about, until a source has MOST_BLOCKS of them.
BLOCK_DOCS, MOST_BLOCKS = 32, 1 << 16
#: Tokens in an output shard, about, as long as there are LEAST_BLOCKS blocks for each.
SHARD_TOKENS, LEAST_BLOCKS = 2_000_000, 8
SEED = 17
#: The draws of a node are exact below this number of blocks.
MOST_DRAWN = 1_000_000_000


def split_shares(due: list[int], shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the blocks of each source that ``shard`` gets, by its path down the splitting tree.

    ``due`` counts the blocks of each source. At a node with n shards the left child has n // 2 of them and gets that share of
    the blocks in all, rounded; which sources they come from is drawn.
    """
    low, high = 0, shards
    counts = np.array(due, np.int64)
    first = np.zeros(len(due), np.int64)
    while high - low > 1:
        middle = low + (high - low) // 2
        total = int(counts.sum())
        take = (total * (middle - low) + (high - low) // 2) // (high - low)
        if total >= MOST_DRAWN:
            raise ValueError(f"a mix may have {MOST_DRAWN - 1} uses of blocks at most; lower the caps or raise BLOCK_DOCS")
        draw = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(counts, take, method="marginals") if total else counts * 0
        if shard < middle:
            high, counts = middle, draw
        else:
            low, first, counts = middle, first + draw, counts - draw
    return first, first + counts


def _leaves(seed: int):
    def run(frames):
        for frame in frames:
            out = []
            for mix, shard, shards, sources, due in zip(frame["mix_id"], frame["shard"], frame["shards"], frame["sources"], frame["due"]):
                first, end = split_shares(list(due), int(shards), int(shard), seed + int(mix))
                out.extend((mix, shard, s, a, b) for s, a, b in zip(sources, first.tolist(), end.tolist()) if b > a)
            yield pd.DataFrame(out, columns=["mix_id", "shard", "source", "first", "end"])

    return run


def _fitted(block: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block whose sizes add up to about its cut."""
    block = block.sort_values(["n_tokens", "order", "item"], ascending=[False, True, True], kind="stable")
    sizes, room = block["n_tokens"].tolist(), int(block["cut"].iloc[0])
    taken, left = [], []
    for i, n in enumerate(sizes):
        if n <= room:
            taken.append(i)
            room -= n
        else:
            left.append(i)
    # one more goes beyond the cut; the smallest does so by the least
    if left and sizes[left[-1]] - room < room:
        taken.append(left[-1])
    return block.iloc[sorted(taken)]


class Mix:
    """Plans and draws the mixes of ``targets`` (mix_id, source, target_share, max_repeats) from ``docs``.

    Documents with a null id or source, or without tokens, take no part. A source of the targets that has no tokens can't
    contribute: the other sources keep their proportions and the report shows its share as 0. Shares of a mix need not add
    up to 1; they are taken in proportion. Targets that are null, negative or repeated for one source raise a ValueError, as
    does a cap below 1. Rows that repeat an id are documents of
    their own, whose uses ``usage`` adds up if source and size agree. Other columns are not read.

    ``usage()``: one row for each mix and document of its sources. ``draws()``: one row for each use, with its shard and place there.
    ``shares()``: one row for each mix and source.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shard_tokens: int = SHARD_TOKENS, vocabulary: str = VOCABULARY, folder: str = FOLDER):
        self.seed, self.id_col = seed, id_col
        wanted = targets.select("mix_id", F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("cap"))
        bad = wanted.groupBy("mix_id", "source").agg(F.count("*").alias("n"), F.min("share").alias("share"), F.min("cap").alias("cap"), F.count_if(F.col("share").isNull() | F.col("cap").isNull()).alias("nulls"))
        if not bad.where("n > 1 or nulls > 0 or share < 0 or cap < 1 or mix_id is null or source is null").isEmpty():
            raise ValueError("each mix needs one share of at least 0 and one cap of at least 1 for each source")
        text = docs.select(F.col(id_col).alias("item"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).where("item is not null and source is not null")
        counted = materialise(token_counts(text, "text", vocabulary, folder).where("n_tokens > 0"))
        totals = counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("have"))
        totals = totals.withColumn("n_blocks", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n_docs") / BLOCK_DOCS))).cast("int"))
        self.docs = counted.join(totals.select("source", "n_blocks"), "source").select("item", "source", "n_tokens", F.pmod(F.xxhash64(F.lit(seed), "item", "n_tokens"), F.col("n_blocks")).cast("int").alias("block"))
        known = wanted.join(totals, "source")
        of_mix = Window.partitionBy("mix_id")
        known = known.where("share > 0").withColumn("size", F.min(F.col("have") * F.col("cap") / F.col("share")).over(of_mix))
        quota = F.least(F.round(F.col("size") * F.col("share")).cast("long"), F.col("have") * F.col("cap"))
        known = known.withColumn("quota", quota).withColumn("passes", F.floor(F.col("quota") / F.col("have")).cast("int")).withColumn("rest", F.col("quota") - F.col("passes") * F.col("have"))
        self.plan = materialise(known)
        self.targets = wanted
        self.shard_tokens = shard_tokens
        blocks = self.docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
        passes = self.plan.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).join(blocks, "source")
        by_pass = Window.partitionBy("mix_id", "source", "pass").orderBy(F.xxhash64(F.lit(seed), "mix_id", "source", "pass", "block"), "block")
        ranked = passes.withColumn("rank", F.row_number().over(by_pass) - 1).withColumn("before", F.sum("tokens").over(by_pass) - F.col("tokens"))
        last = F.col("pass") == F.col("passes")
        due = ranked.where(~last | (F.col("before") < F.col("rest")))
        cut = F.when(last & (F.col("before") + F.col("tokens") > F.col("rest")), F.col("rest") - F.col("before"))
        held = Window.partitionBy("mix_id", "source").orderBy("pass", "rank")
        self.due = materialise(due.select("mix_id", "source", "block", "pass", cut.alias("cut"), (F.row_number().over(held) - 1).cast("long").alias("place")))
        self._cut_docs = self._cut()

    def _cut(self) -> DataFrame:
        """(mix_id, source, item, n_tokens, pass, place): the documents taken from the last, partly used block of a source, chosen so that their
        sum comes as near to the cut as large documents first, then smaller ones that still fit, and perhaps one more allow."""
        cut = self.due.where("cut is not null").select("mix_id", "source", "block", "pass", "cut", "place")
        docs = self.docs.join(F.broadcast(cut), ["source", "block"])  # one block for each mix and source
        docs = docs.withColumn("order", F.xxhash64(F.lit(self.seed + 1), "mix_id", "item", "n_tokens"))
        columns = ["mix_id", "source", "item", "n_tokens", "pass", "place"]
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
        return docs.groupBy("mix_id", "source").applyInPandas(lambda frame: _fitted(frame)[columns], schema)

    def usage(self) -> DataFrame:
        """(mix_id, item, source, n_tokens, uses), documents that are not used included."""
        # each pass takes each block at most once, so a block's uses are counted, never listed
        whole = self.due.groupBy("mix_id", "source", "block").agg(F.count_if(F.col("cut").isNull()).alias("uses"))
        every = self.plan.select("mix_id", "source", "n_blocks").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        uses = every.join(whole, ["mix_id", "source", "block"], "left").select("mix_id", "source", "block", F.coalesce("uses", F.lit(0).cast("bigint")).alias("uses"))
        base = self.docs.join(uses, ["source", "block"]).select("mix_id", "item", "source", "n_tokens", "uses")
        extra = self._cut_docs.select("mix_id", "item", "source", "n_tokens", F.lit(1).cast("bigint").alias("uses"))
        both = base.unionByName(extra).groupBy("mix_id", "item", "source", "n_tokens").agg(F.sum("uses").alias("uses"))
        return both.select("mix_id", F.col("item").alias(self.id_col), "source", "n_tokens", "uses")

    def draws(self) -> DataFrame:
        """(mix_id, shard, position, item, source, n_tokens, pass): every use of a document, shuffled within its shard."""
        due = self.due.groupBy("mix_id", "source").agg(F.count("*").alias("due"))
        sizes = self.plan.groupBy("mix_id").agg(F.sum("quota").alias("quota"), F.max(F.ceil(F.col("n_docs") / (F.col("n_blocks") * BLOCK_DOCS))).cast("int").alias("parts"))
        by_mix = due.groupBy("mix_id").agg(F.sort_array(F.collect_list(F.struct("source", "due"))).alias("all")).join(sizes, "mix_id")
        blocks = F.aggregate("all.due", F.lit(0).cast("bigint"), lambda a, x: a + x)
        shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("quota") / self.shard_tokens), F.floor(blocks / LEAST_BLOCKS))).cast("int")
        leaves = by_mix.select("mix_id", shards.alias("shards"), F.col("all.source").alias("sources"), F.col("all.due").alias("due")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        kind = self.plan.schema["mix_id"].dataType.simpleString()
        ranges = leaves.mapInPandas(_leaves(self.seed), f"mix_id {kind}, shard int, source string, first long, end long")
        dealt = ranges.withColumn("place", F.explode(F.sequence(F.col("first"), F.col("end") - 1))).select("mix_id", "source", "place", "shard")
        placed = self.due.join(dealt, ["mix_id", "source", "place"])
        whole = self.docs.join(placed.where("cut is null").select("mix_id", "source", "block", "pass", "shard"), ["source", "block"])
        some = self._cut_docs.join(placed.where("cut is not null").select("mix_id", "source", "place", "shard"), ["mix_id", "source", "place"])
        columns = ["mix_id", "shard", "item", "source", "n_tokens", "pass"]
        every = whole.select(*columns).unionByName(some.select(*columns)).join(F.broadcast(sizes.select("mix_id", "parts")), "mix_id")  # a row for each mix
        part = F.pmod(F.xxhash64(F.lit(self.seed + 3), "mix_id", "pass", "item"), F.col("parts"))
        every = every.withColumn("shard", (F.col("shard") * F.col("parts") + part).cast("int")).drop("parts")
        order = Window.partitionBy("mix_id", "shard").orderBy(F.xxhash64(F.lit(self.seed + 2), "mix_id", "shard", "pass", "item"), "item", "pass", "n_tokens")
        return every.withColumn("position", F.row_number().over(order) - 1).select("mix_id", "shard", "position", F.col("item").alias(self.id_col), "source", "n_tokens", "pass")

    def shares(self) -> DataFrame:
        """(mix_id, source, target_share, tokens, actual_share, n_docs, n_used, most_uses, max_repeats)."""
        by_source = self.usage().groupBy("mix_id", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("n_docs"), F.count_if(F.col("uses") > 0).alias("n_used"), F.max("uses").alias("most_uses"))
        joined = self.targets.join(by_source, ["mix_id", "source"], "left")
        zero = F.lit(0).cast("bigint")
        tokens = F.coalesce("tokens", zero)
        total = F.sum(tokens).over(Window.partitionBy("mix_id"))
        return joined.select("mix_id", "source", F.col("share").alias("target_share"), tokens.alias("tokens"), F.when(total > 0, tokens / total).otherwise(0.0).alias("actual_share"), F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("n_used", zero).alias("n_used"), F.coalesce("most_uses", zero).alias("most_uses"), F.col("cap").alias("max_repeats"))
