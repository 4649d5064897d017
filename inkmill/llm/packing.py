"""Filling containers of fixed capacity with texts: variable-capacity best fit.

For each capacity, the permitted container lengths are the capacity itself and the shorter ones that are permitted beside it.
Texts longer than the capacity fill whole containers and leave a rest; no other text is divided. The largest text left opens a
container: each permitted length that holds it is filled in thought, always with the largest text that still fits (best
fit over a histogram of sizes), and the length with the least cost for each token held is opened. In the end each container is
downsized to the shortest permitted length that holds its contents.

Texts are spread over groups of about ``GROUP_ITEMS`` by a hash; a group is packed by one task for all capacities, so the work is
linear, and at most one container a group and capacity stays far from full. Groups are bounded whatever the skew of sources or sizes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.tokens import FOLDER, VOCABULARY, token_counts
from inkmill.session import materialise

GROUP_ITEMS = 25_000
#: Containers of a group are numbered below this.
GROUP_CONTAINERS = 1 << 31


class Sizes:
    """A multiset of sizes that gives out the largest one not above a limit."""

    def __init__(self, sizes: np.ndarray):
        values, counts = np.unique(sizes, return_counts=True)
        self.values: list[int] = values.tolist()
        self.counts: dict[int, int] = dict(zip(self.values, counts.tolist()))

    def fill(self, room: int, taken: dict[int, int]) -> list[int]:
        """The sizes that best fit puts into ``room``, besides those in ``taken``; nothing is removed."""
        out, values, counts = [], self.values, self.counts
        at = bisect_right(values, room) - 1
        while at >= 0 and room > 0:
            size = values[at]
            if size <= room and counts[size] > taken.get(size, 0):
                n = min(counts[size] - taken.get(size, 0), room // size)
                out.extend([size] * n)
                room -= size * n
                at = min(at - 1, bisect_right(values, room) - 1)
            else:
                at = min(at - 1, bisect_right(values, room) - 1)
        return out

    def remove(self, sizes: list[int]) -> None:
        for size in sizes:
            self.counts[size] -= 1
            if not self.counts[size]:
                del self.counts[size]
                self.values.pop(bisect_right(self.values, size) - 1)


def pack(sizes: np.ndarray, lengths: list[int]) -> tuple[list[list[int]], list[int]]:
    """(sizes of each container, its length). No size exceeds the longest permitted length; sizes are positive."""
    left, lengths = Sizes(sizes), sorted(lengths)
    containers, opened = [], []
    while left.values:
        largest = left.values[-1]
        best, best_cost = None, None
        for length in reversed(lengths):  # of equal cost, the longest
            if length < largest:
                break
            held = [largest, *left.fill(length - largest, {largest: 1})]
            cost = length / sum(held)
            if best is None or cost < best_cost - 1e-12:
                best, best_cost = held, cost
            if cost == 1:
                break
        left.remove(best)
        used = sum(best)
        containers.append(best)
        opened.append(next(x for x in lengths if x >= used))
    return containers, opened


OUT_NAMES = ["spec_id", "container_id", "capacity_tokens", "container_tokens", "item", "piece", "start_token", "end_token", "offset_tokens"]


def _packed(specs: list[tuple[int, int, list[int]]], item_type: pa.DataType):
    """Packs the groups that come in, sorted by group."""

    def one(group: int, items: pa.Array, sizes: np.ndarray):
        for spec, capacity, lengths in specs:
            whole, rest = sizes // capacity, sizes % capacity
            base = group * GROUP_CONTAINERS
            # the whole containers of long texts
            row = np.repeat(np.arange(len(sizes)), whole)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
            open_rows = np.flatnonzero(rest)
            containers, opened = pack(rest[open_rows], lengths)
            by_size = defaultdict(list)
            for r in open_rows[np.argsort(rest[open_rows], kind="stable")].tolist()[::-1]:
                by_size[int(rest[r])].append(r)
            rows, ids, lens, offsets = [], [], [], []
            for k, (held, length) in enumerate(zip(containers, opened)):
                at = 0
                for size in held:
                    rows.append(by_size[size].pop())
                    ids.append(k)
                    lens.append(length)
                    offsets.append(at)
                    at += size
            rows = np.concatenate((row, np.array(rows, np.int64)))
            pieces = np.concatenate((piece, whole[rows[len(row) :]]))
            start = pieces * capacity
            end = np.minimum(start + capacity, sizes[rows])
            ids = np.concatenate((np.arange(len(row)), len(row) + np.array(ids, np.int64))) + base
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, spec, np.int32)), pa.array(ids), pa.array(np.full(n, capacity, np.int64)), pa.array(np.concatenate((np.full(len(row), capacity), np.array(lens, np.int64)))), items.take(pa.array(rows)).cast(item_type),
                 pa.array(pieces.astype(np.int32)), pa.array(start), pa.array(end), pa.array(np.concatenate((np.zeros(len(row), np.int64), np.array(offsets, np.int64))))],
                names=OUT_NAMES,
            )

    def run(batches):
        current, items, sizes = None, [], []
        for batch in batches:
            group = batch.column(0).to_numpy()
            for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(group)) + 1).tolist()], [*cuts[1:], len(group)]):
                if a == b:
                    continue
                if group[a] != current and items:
                    yield from one(current, pa.concat_arrays(items), np.concatenate(sizes))
                    items, sizes = [], []
                current = int(group[a])
                items.append(batch.column(1).slice(a, b - a))
                sizes.append(batch.column(2).slice(a, b - a).to_numpy())
        if items:
            yield from one(current, pa.concat_arrays(items), np.concatenate(sizes))

    return run


def permitted_lengths(capacities: list[int]) -> dict[int, list[int]]:
    """For each capacity, itself and all shorter ones."""
    return {c: sorted({x for x in capacities if x <= c}) for c in capacities}


def packing(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: dict[int, list[int]] | None = None, group_items: int = GROUP_ITEMS, vocabulary: str = VOCABULARY, folder: str = FOLDER) -> DataFrame:
    """One row for each piece of a text and each capacity: its container, and the tokens of the text that it holds there.

    ``container_tokens`` is the length that the container was downsized to, ``piece`` counts from 0 and is above 0 only for
    texts larger than the capacity. Texts without tokens (null, empty) need no container and are left out, as are null ids;
    rows that repeat an id are packed one by one. ``lengths`` names the permitted lengths by capacity (the other capacities
    below it, by default). The table of capacities is small and read to the driver; null or non-positive ones and null ids raise.
    """
    rows = [(r[0], r[1]) for r in specs.select("spec_id", F.col("capacity_tokens").cast("long")).distinct().orderBy("spec_id").collect()]
    if any(s is None or c is None or c <= 0 for s, c in rows):
        raise ValueError("every spec needs an id and a positive capacity")
    lengths = lengths or permitted_lengths([c for _, c in rows])
    plan = [(int(s), int(c), sorted({*(x for x in lengths.get(c, []) if 0 < x <= c), c})) for s, c in rows]
    kind = docs.schema[id_col].dataType
    counted = materialise(token_counts(docs.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("item is not null"), "text", vocabulary, folder).where("n_tokens > 0"))
    groups = max(1, round(counted.count() / group_items))
    # the size takes part in the hash, so that rows with one id are spread as well
    spread = counted.select(F.pmod(F.xxhash64("item", "n_tokens"), F.lit(groups)).alias("g"), "item", "n_tokens").repartition(groups, "g").sortWithinPartitions("g", "n_tokens", "item")
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.string() if kind.simpleString() == "string" else None
    if arrow is None:
        raise ValueError("ids must be bigint or string")
    schema = f"spec_id int, container_id long, capacity_tokens long, container_tokens long, item {kind.simpleString()}, piece int, start_token long, end_token long, offset_tokens long"
    return spread.mapInArrow(_packed(plan, arrow), schema).withColumnRenamed("item", id_col)


def packing_report(packed: DataFrame) -> DataFrame:
    """By capacity: containers, texts, tokens, and how full the containers are, at full capacity and as downsized."""
    by_container = packed.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("used"), F.first("container_tokens").alias("length"), F.count("*").alias("pieces"))
    return by_container.groupBy("spec_id", "capacity_tokens").agg(
        F.count("*").alias("n_containers"),
        F.sum("pieces").alias("n_pieces"),
        F.sum("used").alias("n_tokens"),
        (F.sum("used") / F.sum("capacity_tokens")).alias("fill_of_capacity"),
        (F.sum("used") / F.sum("length")).alias("fill_of_length"),
        F.count_if(F.col("length") < F.col("capacity_tokens")).alias("n_downsized"),
    )
