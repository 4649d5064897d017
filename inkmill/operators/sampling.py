"""Order, limits, samples and shards, without gathering the rows in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.session import materialise, shuffle_partitions


#: Samples of up to so many rows are taken by a limit, larger ones by ranks.
TASK_ROWS = 10_000


def seeded_key(seed: int, key: str) -> Column:
    """O-05, O-06: a hash of the seed and a key, to sort by."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """W-01: ``df`` with each row's place, from 0, in a total order, by a sort over ranges instead of one task.

    The ranges' sizes are added up first; a row's place is that sum and its place in its range. ``order`` should be total;
    rows that tie are told apart by their other columns where those can be sorted.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    sortable = _sortable(df)
    named = df.withColumns({f"__k{i}": k for i, k in enumerate(keys)})
    order_cols = [F.col(f"__k{i}") for i in range(len(keys))]
    parts = shuffle_partitions(df.sparkSession)
    placed = named.repartitionByRange(parts, *order_cols).sortWithinPartitions(*order_cols, *sortable)
    # the id counts the rows of a sorted range, whose number it holds above bit 33
    placed = materialise(placed.withColumn("__id", F.monotonically_increasing_id()).drop(*(f"__k{i}" for i in range(len(keys)))))
    part = F.shiftright("__id", 33).cast("int")
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")  # a row for each range
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__before")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """W-01, W-02, W-05, W-07: ``df`` with running sums (up to and with each row) and last values that are not null (before each row) within
    keys, without one task for a key: rows are sorted by ranges of key and order, summed up within a range, and carry on what the
    ranges before left. Null keys are a key; rows that tie in ``order`` are told apart by their other columns where those can be sorted."""
    sums, lasts = sums or {}, lasts or {}
    named = df.withColumns({f"__s_{n}": c for n, c in sums.items()} | {f"__l_{n}": c for n, c in lasts.items()})
    columns = [F.col(c) for c in (*keys, *order)]
    placed = named.repartitionByRange(shuffle_partitions(df.sparkSession), *columns).sortWithinPartitions(*columns, *_sortable(df))
    placed = materialise(placed.withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33).cast("int"))
    totals = placed.groupBy("__part", *keys).agg(F.count("*").alias("__n"), *(F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums), *(F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), F.col("__id"))).alias(f"__l_{n}") for n in lasts))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each range
    carried = totals.select(F.col("__part").alias("__c_part"), *(F.col(k).alias(f"__c_{i}") for i, k in enumerate(keys)), *(F.sum(f"__s_{n}").over(earlier).alias(f"__c_s_{n}") for n in sums), *(F.last(f"__l_{n}", ignorenulls=True).over(earlier).alias(f"__c_l_{n}") for n in lasts))
    here = Window.partitionBy("__part", *keys).orderBy("__id")
    local = placed.withColumns({f"__s_{n}": F.sum(f"__s_{n}").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for n in sums} | {f"__l_{n}": F.last(f"__l_{n}", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1)) for n in lasts})
    match = F.col("__part") == F.col("__c_part")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"__c_{i}"))
    joined = local.join(carried, match)
    found = {n: F.col(f"__s_{n}") + F.coalesce(f"__c_s_{n}", F.lit(0)) for n in sums} | {n: F.coalesce(f"__l_{n}", f"__c_l_{n}") for n in lasts}
    return joined.select(*(c for c in df.columns if c not in found), *(c.alias(n) for n, c in found.items()))


def _sortable(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]


def sample(df: DataFrame, key: str, seed: int, n: int | None = None, fraction: float | None = None) -> DataFrame:
    """O-05: exactly ``n`` rows, or that share of all rows rounded down, the same for the same seed whatever the partitions;
    all rows if there are no more. ``key`` should be unique; rows with one key are taken in the order of their columns."""
    if (n is None) == (fraction is None):
        raise ValueError("give n or fraction")
    total = df.count() if fraction is not None else None
    target = int(total * fraction) if fraction is not None else n
    if total is not None and target >= total:
        return df
    if target <= TASK_ROWS:
        # each task keeps no more than ``target`` rows
        return df.orderBy(seeded_key(seed, key), key, *_sortable(df)).limit(target)
    return ranked(df, [seeded_key(seed, key), key], "__rank").where(F.col("__rank") < target).drop("__rank")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """O-06: sorted by a seeded hash."""
    return df.orderBy(seeded_key(seed, key), key)


def sharded(df: DataFrame, order: list[Column | str], shards: int = 10, contiguous: bool = False, name: str = "shard") -> DataFrame:
    """O-07: rows dealt to shards in turn, or in stretches whose sizes differ by one at most (the first ones larger)."""
    placed = ranked(df, order, "__rank")
    if not contiguous:
        return placed.withColumn(name, F.pmod("__rank", F.lit(shards)).cast("int")).drop("__rank")
    total = F.lit(placed.count())
    size, more = F.floor(total / shards), total % shards
    head = more * (size + 1)
    at = F.when(F.col("__rank") < head, F.floor(F.col("__rank") / (size + 1))).otherwise(more + F.floor((F.col("__rank") - head) / F.greatest(size, F.lit(1))))
    return placed.withColumn(name, at.cast("int")).drop("__rank")


def chunked(df: DataFrame, order: list[Column | str], size: int, name: str = "chunk") -> DataFrame:
    """K-04, O-08: the number of each row's chunk of ``size`` rows."""
    return ranked(df, order, "__rank").withColumn(name, F.floor(F.col("__rank") / size).cast("bigint")).drop("__rank")


def first_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """O-09: up to ``k`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """O-04: the first ``k`` rows; each task keeps no more than ``k``."""
    return df.orderBy(*order).limit(k)


def numeric_suffix(x: Column | str) -> Column:
    """O-02: the number at the end of a name, to sort by."""
    return F.regexp_extract(F.col(x) if isinstance(x, str) else x, r"(\d+)$", 1).try_cast("int")
