"""Exact and near-duplicate removal."""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.operators.relational import first_by, not_in_reference
from inkmill.session import materialise, shuffle_partitions


def dedup_exact(df: DataFrame, text: str = "code", order: tuple[str, ...] = ("file_id",), reference: DataFrame | None = None, reference_text: str = "code", scope: str | None = None) -> DataFrame:
    """D-01, J-05: of the rows with equal text the first in ``order``; rows whose text is in the reference are dropped first.

    ``scope`` names a column within which duplicates count (a file), else they count everywhere. Null texts are equal to each
    other; a null text is in no reference. The hash decides, so texts are shuffled once with their row.
    """
    hashed = df.withColumn("__hash", F.sha2(text, 256))
    if reference is not None:
        hashed = not_in_reference(hashed, F.col("__hash"), reference, F.sha2(reference_text, 256))
    return first_by(hashed, ["__hash", *([scope] if scope else [])], list(order)).drop("__hash")


def dedup_distinct(df: DataFrame, keys: list[str]) -> DataFrame:
    """D-03, D-10: one row for each key."""
    return df.select(*keys).distinct()


def _ratio(batches):
    for batch in batches:
        a, b = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        out = []
        for new, old in zip(a, b):
            m = difflib.SequenceMatcher(None, new, old)
            # two bounds that cost less and are never below the ratio
            out.append(m.ratio() if min(m.real_quick_ratio(), m.quick_ratio()) > 0.5 else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.float64())], names=["new_id", "old_id", "ratio"])


#: Slots of the counts that put rare pieces first, the longest pieces, and the classes of characters whose counts are compared.
SLOTS, LONGEST_PIECE, CLASSES = 1 << 18, 4, 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class _Texts:
    """The characters of a batch of texts in one array."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = np.array([len(t) for t in texts], np.int64)
        self.row = np.repeat(np.arange(len(texts)), self.n)
        self.at = np.arange(len(self.row)) - np.repeat(np.cumsum(self.n) - self.n, self.n)

    def pieces(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The places at which runs of ``q`` characters of one text begin (of shorter texts, the whole text), and their hashes."""
        size = np.minimum(q, self.n)[self.row]
        starts = np.flatnonzero(self.at + size <= self.n[self.row])
        total = np.full(len(starts), q, np.uint64)
        for j in range(q):
            inside = j < size[starts]
            total = np.where(inside, total * BASE + self.points[np.minimum(starts + j, len(self.points) - 1)].astype(np.uint64) + np.uint64(1), total)
        return starts, _mixed(total)

    def packed(self) -> np.ndarray:
        """By text the counts of the classes of characters, up to 255, as bytes of two numbers."""
        counts = np.bincount(self.row * CLASSES + self.points % CLASSES, minlength=len(self.n) * CLASSES)
        return np.minimum(255, counts).astype(np.uint8).view(np.int64).reshape(-1, 2)


def _slot(pieces: np.ndarray) -> np.ndarray:
    return (pieces >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def _piece_counts(batches):
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        texts = _Texts(batch.column(0).to_pylist())
        for q in range(1, LONGEST_PIECE + 1):
            counts += np.bincount(_slot(texts.pieces(q)[1]), minlength=SLOTS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["slot", "n"])


def _lost(a, b, q: int, threshold: float):
    """At most so many of the pieces of a text of length a are not in a similar one of length b: each character of the text without a partner
    spoils q pieces, and each of the other text q - 1."""
    return np.floor(((2 * q - 1) * (1 - threshold) * (a + b) + (a - b)) / 2 + 1e-9)


def _piece_size(low: float, high: float, top: float, threshold: float) -> int:
    """The longest pieces of which at least one is left in any two similar texts, one of a length from low to high, the other from low to top."""
    for q in range(LONGEST_PIECE, 1, -1):
        ends = [(n, m) for n in (low, high, top) for m in (low, high, top)]
        if all(_lost(n, m, q, threshold) < n - q + 1 for n, m in ends if n * threshold <= m * (2 - threshold) and m * threshold <= n * (2 - threshold)):
            return q
    return 1


def _sent(scale, threshold: float):
    """(key, nid, larger, n, at, c1, c2) of the rarest pieces of each text, for its own band of lengths and, as the larger partner, the band below."""
    reach = (2 - threshold) / threshold

    def run(batches):
        rare = scale.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, ids = _Texts(batch.column(1).to_pylist()), batch.column(0).to_numpy(zero_copy_only=False)
            packed, n = texts.packed(), texts.n
            band = np.floor(np.log(n) / np.log(reach) + 1e-9).astype(np.int64)
            below = (band > 0) & (reach ** (band + 1.0) >= n * (1 - 1e-9))
            for target in sorted(set(band.tolist()) | set((band[below] - 1).tolist())):
                low, high = reach**target, reach ** (target + 1)
                q = _piece_size(low, high, high * reach, threshold)
                here = (band == target) | (below & (band == target + 1))
                larger = band > target
                smallest = np.maximum(low, n / reach)
                largest = np.where(larger, np.minimum(high, n), np.minimum(high * reach, n * reach))
                keep = np.maximum(_lost(n, smallest, q, threshold), _lost(n, largest, q, threshold)).astype(np.int64) + 1
                starts, pieces = texts.pieces(q)
                mine = here[texts.row[starts]]
                starts, pieces = starts[mine], pieces[mine]
                row = texts.row[starts]
                order = np.lexsort((pieces, rare[_slot(pieces)], row))
                starts, pieces, row = starts[order], pieces[order], row[order]
                index = np.arange(len(row))
                new_row = np.concatenate(([True], row[1:] != row[:-1]))
                place = index - np.maximum.accumulate(np.where(new_row, index, 0))
                # equal pieces stand together and are told apart by their number
                new = new_row | np.concatenate(([True], pieces[1:] != pieces[:-1]))
                number = index - np.maximum.accumulate(np.where(new, index, 0))
                send = place < keep[row]
                row, starts = row[send], starts[send]
                keys = _mixed(pieces[send] ^ _mixed(number[send].astype(np.uint64) + np.array([target * 8 + q], np.uint64) * BASE))
                columns = [keys.view(np.int64), ids[row], larger[row], n[row].astype(np.int32), texts.at[starts].astype(np.int32), packed[row, 0], packed[row, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "nid", "larger", "n", "at", "c1", "c2"])

    return run


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.95) -> DataFrame:
    """J-15: (new_id, old_id, ratio) of the pairs (old_id < new_id) whose Ratcliff-Obershelp ratio is above ``threshold``.

    Above the threshold t, fewer than (1 - t) * (both lengths) characters of two texts have no partner, and each spoils a few pieces of q
    characters. So of the pieces of a text, counted with repetitions and sorted rare ones first, so many come first that one of
    them is among the first of every similar text (q is the longest size for which that holds in a band of lengths). These meet by hash.
    Pairs that meet are filtered by length, by place, and by the counts of 16 classes of characters, before the texts are fetched and
    compared. No pair above the threshold is lost. Rows with null ids, null or empty texts take no part; of rows with one id the least text counts.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("threshold must lie in [0.5, 1)")
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    rows = rows.groupBy("id").agg(F.min("text").alias("text")).where("text <> ''")
    rows = materialise(rows.withColumn("nid", F.monotonically_increasing_id()))
    counted = rows.select("text").mapInArrow(_piece_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rare = np.zeros(SLOTS, np.uint8)
    found = counted.toArrow()  # a row for each slot at most
    rare[found.column("slot").to_numpy()] = np.minimum(255, np.floor(6 * np.log2(1.0 + found.column("n").to_numpy())))
    sent = rows.select("nid", "text").mapInArrow(_sent(spark.sparkContext.broadcast(rare), threshold), "key long, nid long, larger boolean, n int, at int, c1 long, c2 long")
    a, b = (sent.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("nid", "larger", "n", "at", "c1", "c2"))) for side in "ab")
    byte = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    differ = sum((F.abs(byte(f"{c}_a", i) - byte(f"{c}_b", i)) for c in ("c1", "c2") for i in range(8)), F.lit(0))
    most = (1 - threshold) * (F.col("n_a") + F.col("n_b"))
    near = (F.abs(F.col("n_a") - F.col("n_b")) < most) & (F.abs(F.col("at_a") - F.col("at_b")) < most) & (differ < most)
    # of two entries the first is of the own band; two of the own band meet once
    met = a.where("not larger_a").join(b, "key").where((F.col("larger_b") & (F.col("nid_a") != F.col("nid_b"))) | (~F.col("larger_b") & (F.col("nid_a") < F.col("nid_b"))))
    pairs = met.where(near).select(F.least("nid_a", "nid_b").alias("nid_a"), F.greatest("nid_a", "nid_b").alias("nid_b")).distinct()
    one, two = (rows.select(F.col("nid").alias(f"nid_{s}"), F.col("id").alias(f"id_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    both = pairs.join(one, "nid_a").join(two, "nid_b")
    later = F.col("id_a") > F.col("id_b")
    pick = lambda c, first: F.when(later, F.col(f"{c}_a" if first else f"{c}_b")).otherwise(F.col(f"{c}_b" if first else f"{c}_a"))
    ordered = both.select(pick("id", True).alias("new_id"), pick("text", True).alias("new_text"), pick("id", False).alias("old_id"), pick("text", False).alias("old_text"))
    kind = df.schema[key].dataType.simpleString()
    # few rows that cost much: kept from being packed into one task
    ordered = ordered.repartition(shuffle_partitions(spark), "new_id", "old_id")
    return ordered.mapInArrow(_ratio, f"new_id {kind}, old_id {kind}, ratio double").where(F.col("ratio") > threshold)


def greedy_near_dedup(df: DataFrame, key: str, text: str, threshold: float = 0.95) -> DataFrame:
    """D-04: rows in order of ``key``, each dropped if it is similar to an earlier row that was kept.

    Decided in rounds over the pairs: a row is kept once all its earlier partners are dropped, and dropped once one of them is
    kept. The number of rounds is the longest chain of decisions. Rows with a null key or an empty or null text are kept; rows
    that repeat a key share its fate.
    """
    # of equal texts only the first can be kept
    firsts = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias("__first"))
    pairs = materialise(similar_pairs(firsts.select(F.col("__first").alias(key), text), key, text, threshold).select("new_id", "old_id"))
    nodes = pairs.select(F.col("new_id").alias("id")).unionByName(pairs.select(F.col("old_id").alias("id"))).distinct()
    # rows without an earlier partner are kept
    kept = materialise(nodes.join(pairs, nodes["id"] == pairs["new_id"], "left_anti"))
    dropped = None
    open_pairs = pairs
    while True:
        new_dropped = open_pairs.join(kept.withColumnRenamed("id", "old_id"), "old_id", "left_semi").select(F.col("new_id").alias("id")).distinct()
        new_dropped = materialise(new_dropped if dropped is None else new_dropped.unionByName(dropped).distinct())
        dropped = new_dropped
        gone = dropped.withColumnRenamed("id", "__gone")
        open_pairs = materialise(open_pairs.join(gone, open_pairs["new_id"] == gone["__gone"], "left_anti").join(gone, open_pairs["old_id"] == gone["__gone"], "left_anti"))
        waiting = open_pairs.select(F.col("new_id").alias("id")).distinct()
        if waiting.isEmpty():
            break
        undecided = nodes.join(dropped, "id", "left_anti").join(kept, "id", "left_anti")
        kept = materialise(kept.unionByName(undecided.join(waiting, "id", "left_anti")))
    gone = dropped.select(F.col("id").alias("__gone"))
    kept_texts = firsts.join(gone, F.col("__first") == F.col("__gone"), "left_anti").select("__first")
    whole = df.where(F.col(text).isNull() | (F.length(text) == 0) | F.col(key).isNull())
    return df.where(F.length(text) > 0).join(kept_texts, F.col(key) == F.col("__first"), "left_semi").unionByName(whole)
