"""Evaluation texts that leak into training text: exact shared passages by winnowing.

Every text is a row of words. Of each window of ``span - gram + 1`` consecutive word-grams the smallest hash is kept (the
rightmost of equal ones), in the test items and in the corpus alike. A shared passage of at least ``span`` words covers a whole
window, so both sides keep the same gram of it: no such passage can be missed. Grams that meet are extended word by word
in both directions, and hits that reach ``span`` words are kept.

The corpus is read once, whole, and nothing of it is shuffled but the hits: the fingerprints of the test items form an index
that each task joins with the fingerprints of its own texts. An index holds at most about ``INDEX_BYTES`` of test text. A larger
test set is cut into that many blocks, and the fingerprints of both sides are joined by hash: of the corpus's, only those travel that
are in a table of bits of the test set's (of bounded size, and then the join is exact). Rows that meet a block go, with their texts, to the
tasks that hold the block's index; a block that many rows meet has several such tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.scan import BLOCK_BYTES, GRAM_BASE, Words, blocks, mixed, words
from inkmill.session import materialise, shuffle_partitions

#: Bytes of test text in one index, by which its broadcast is bounded.
INDEX_BYTES = 8 << 20
#: Bits of the table that keeps fingerprints of the corpus from travelling: so many for each of the test set's, and at most (32 MB).
BITS_EACH, MOST_BITS, BIT_PARTS = 16, 1 << 28, 64
#: Rows that meet a block in one task, about.
TASK_ROWS = 20_000
HITS_SCHEMA = "id string, item string, field string, span_words int, at_word int"


@dataclass(frozen=True)
class Passage:
    """A column in which a shared passage of ``span`` words counts, found by grams of ``gram`` words."""

    column: str
    span: int
    gram: int

    def __post_init__(self):
        if not 1 <= self.gram <= self.span:
            raise ValueError("a gram must have between 1 and span words")


#: Fixed by the statement of the problem: 30 words of code, 13 of captions. Long grams meet rarely by chance.
PASSAGES = (Passage("code", 30, 20), Passage("new_caption", 13, 9))


@dataclass
class Index:
    """The test items' words and their fingerprints, sorted by hash."""

    items: list[str]
    hashes: np.ndarray
    item_of: np.ndarray
    print_hash: np.ndarray
    print_at: np.ndarray


def winnow(found: Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of the grams that windows of ``span`` words keep."""
    n = len(found.hashes)
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = n - gram + 1
    total = found.hashes[:count].copy()
    for j in range(1, gram):
        total *= GRAM_BASE
        total += found.hashes[j : count + j]
    value = mixed(total)
    width = span - gram + 1
    low, at, reach = value, np.arange(count), 1
    while reach * 2 <= width:
        low, at = _lower(low[: len(low) - reach], at[: len(low) - reach], low[reach:], at[reach:])
        reach *= 2
    if reach < width:
        gap = width - reach
        low, at = _lower(low[: len(low) - gap], at[: len(low) - gap], low[gap:], at[gap:])
    rows = found.rows
    kept = np.unique(at[: n - span + 1][rows[: n - span + 1] == rows[span - 1 :]])
    return value[kept], kept


def _lower(a, a_at, b, b_at):
    right = b <= a
    return np.where(right, b, a), np.where(right, b_at, a_at)


def build_index(items: pa.Array, texts: pa.Array, passage: Passage) -> Index:
    found = [words(b) for b in blocks(texts, max(BLOCK_BYTES, INDEX_BYTES * 4))]
    counts = np.concatenate([f.counts for f in found]) if found else np.zeros(0, np.int64)
    hashes = np.concatenate([f.hashes for f in found]) if found else np.zeros(0, np.uint64)
    value, at = winnow(Words(hashes, counts, hashes, hashes), passage.span, passage.gram)
    order = np.argsort(value, kind="stable")
    return Index(items.to_pylist(), hashes, np.repeat(np.arange(len(counts)), counts), value[order], at[order])


def extended(a: np.ndarray, a_row: np.ndarray, i: np.ndarray, b: np.ndarray, b_row: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many further words are equal from i and j on, going by ``step``, without leaving the texts."""
    length = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    reach = 1
    while len(live):
        x, y = i[live] + step * reach, j[live] + step * reach
        inside = (x >= 0) & (y >= 0) & (x < len(a)) & (y < len(b))
        live, x, y = live[inside], x[inside], y[inside]
        same = (a[x] == b[y]) & (a_row[x] == a_row[i[live]]) & (b_row[y] == b_row[j[live]])
        live = live[same]
        length[live] = reach
        reach += 1
    return length


def hits_in(found: Words, index: Index, passage: Passage) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, longest shared span, its first word in the row) of all rows and items that share a passage."""
    none = np.zeros(0, np.int64)
    value, at = winnow(found, passage.span, passage.gram)
    low, high = np.searchsorted(index.print_hash, value, "left"), np.searchsorted(index.print_hash, value, "right")
    met = np.flatnonzero(high > low)
    if not len(met):
        return none, none, none, none
    times = (high - low)[met]
    i = np.repeat(at[met], times)
    j = index.print_at[np.repeat(low[met], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    rows = found.rows
    # one hit for each stretch: of neighbouring hits on one diagonal only the first is extended
    order = np.lexsort((i, i - j, index.item_of[j], rows[i]))
    i, j = i[order], j[order]
    joined = np.zeros(len(i), bool)
    joined[1:] = (rows[i[1:]] == rows[i[:-1]]) & (index.item_of[j[1:]] == index.item_of[j[:-1]]) & (i[1:] - j[1:] == i[:-1] - j[:-1]) & (i[1:] - i[:-1] <= passage.gram)
    i, j = i[~joined], j[~joined]
    back = extended(found.hashes, rows, i, index.hashes, index.item_of, j, -1)
    start_i, start_j = i - back, j - back
    length = extended(found.hashes, rows, start_i, index.hashes, index.item_of, start_j, 1) + 1
    length[found.hashes[start_i] != index.hashes[start_j]] = 0
    good = length >= passage.span
    row, item, length, start = rows[start_i[good]], index.item_of[start_j[good]], length[good], start_i[good]
    order = np.lexsort((start, -length, item, row))
    row, item, length, start = row[order], item[order], length[order], start[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    return row[first], item[first], length[first], start[first] - found.firsts[row[first]]


def _hits(ids: pa.Array, columns: list[pa.Array], passages, indexes: list[Index]) -> Iterator[pa.RecordBatch]:
    for column, passage, index in zip(columns, passages, indexes):
        for block in blocks(column):
            row, item, length, start = hits_in(words(block), index, passage)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + block.first)), pa.array([index.items[k] for k in item.tolist()], pa.string()), pa.array([passage.column] * len(row)), pa.array(length.astype(np.int32)), pa.array(start.astype(np.int32))],
                    names=["id", "item", "field", "span_words", "at_word"],
                )


def _scan(passages, indexes):
    def run(batches):
        for batch in batches:
            yield from _hits(batch.column(0), batch.columns[1:], passages, indexes.value)

    return run


def _prints(passages, bits=None):
    """(key, field, print) of the fingerprints of each text; of those, if there are bits, whose bit is set."""

    def run(batches):
        table = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for field, passage in enumerate(passages):
                for block in blocks(batch.column(1 + field)):
                    found = words(block)
                    value, at = winnow(found, passage.span, passage.gram)
                    row = found.rows[at] + block.first
                    if table is not None:
                        slot = _bit(value, len(table) * 8)
                        held = (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                        value, row = value[held], row[held]
                    if len(value):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), field, np.int32)), pa.array(value.view(np.int64))], names=["key", "field", "print"])

    return run


def _bit(value: np.ndarray, size: int) -> np.ndarray:
    return (value >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _bit_parts(size: int):
    """(part, packed) of the table of bits of the fingerprints that come in, all of a part to one task."""
    width = size // BIT_PARTS

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = _bit(batch.column(1).to_numpy().view(np.uint64), size)
            part = slot // width
            for k in np.unique(part).tolist():
                parts.setdefault(k, np.zeros(width, np.uint8))[slot[part == k] % width] = 1
        for k, held in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["part", "packed"])

    return run


def _held(passages):
    """The hits of rows against the items of their block. Rows come sorted: the items of a block (``row`` 0), then the rows that meet it."""

    def run(batches):
        current, items, indexes = None, [], None
        for batch in batches:
            place = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1, [batch.num_rows]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                where, part = (place[0, a], place[1, a]), batch.slice(a, b - a)
                if where != current:
                    current, items, indexes = where, [], None
                if place[2, a] == 0:
                    items.append(part)
                elif items:
                    if indexes is None:
                        names, *texts = (pa.concat_arrays([x.column(3 + k) for x in items]) for k in range(1 + len(passages)))
                        indexes = [build_index(names, t, p) for t, p in zip(texts, passages)]
                    yield from _hits(part.column(3), part.columns[4:], passages, indexes)

    return run


def _by_fingerprints(corpus: DataFrame, items: DataFrame, passages: tuple[Passage, ...], count: int) -> DataFrame:
    """The hits of all rows in ``count`` blocks of items, in one scan of the corpus."""
    spark, columns = corpus.sparkSession, [p.column for p in passages]
    schema = "key string, field int, print long"
    blocked = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count)).cast("int"))
    named = blocked.select(F.col("block").cast("string").alias("key"), *columns)
    prints = materialise(named.mapInArrow(_prints(passages), schema).distinct())
    size = min(MOST_BITS, 1 << max(16, (prints.count() * BITS_EACH).bit_length()))
    parts = prints.select(F.shiftrightunsigned("print", 64 - (BIT_PARTS.bit_length() - 1)).cast("int").alias("part"), "print").repartition(BIT_PARTS, "part")
    table = np.zeros(size // 8, np.uint8)
    width = size // BIT_PARTS // 8
    for r in parts.mapInArrow(_bit_parts(size), "part int, packed binary").collect():
        table[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["packed"], np.uint8)
    sent = corpus.mapInArrow(_prints(passages, spark.sparkContext.broadcast(table.tobytes())), schema).distinct()
    met = sent.join(prints.withColumnRenamed("key", "block"), ["field", "print"]).select(F.col("key").alias("id"), F.col("block").cast("int").alias("block")).distinct()
    met = materialise(met)
    places = met.groupBy("block").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("places"))
    rows = met.join(F.broadcast(places), "block").select("id", "block", F.pmod(F.xxhash64("id"), F.col("places")).cast("int").alias("place")).join(corpus, "id")
    index = blocked.join(F.broadcast(places), "block").select("item", "block", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), *columns)
    both = index.select("block", "place", F.lit(0).alias("row"), F.col("item").alias("id"), *columns).unionByName(rows.select("block", "place", F.lit(1).alias("row"), "id", *columns))
    dealt = both.repartition(max(count, shuffle_partitions(spark)), "block", "place").sortWithinPartitions("block", "place", "row")
    return dealt.mapInArrow(_held(passages), HITS_SCHEMA)


def leaks(train: DataFrame, test: DataFrame, train_id: str = "file_id", test_id: str = "figure_id", passages: tuple[Passage, ...] = PASSAGES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id, item, field, span_words, at_word): every row of ``train`` and item of ``test`` that share a passage of a field.

    ``span_words`` is the longest shared passage and ``at_word`` its place in the row. Null texts count as empty ones and never
    match; rows and items with a null id are left out; repeated rows or items give one result for each id. Both frames
    need the passages' columns; their other columns are not read. An empty frame gives an empty result.
    """
    spark = train.sparkSession
    columns = [p.column for p in passages]
    corpus = train.select(F.col(train_id).cast("string").alias("id"), *columns).where("id is not null")
    items = test.select(F.col(test_id).cast("string").alias("item"), *columns).where("item is not null")
    held = items.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)))).first()[0] or 0
    count = max(1, -(-held // index_bytes))
    if count == 1:
        table = items.toArrow().combine_chunks()
        names = _column(table, "item")
        indexes = [build_index(names, _column(table, p.column), p) for p in passages]
        found = corpus.mapInArrow(_scan(passages, spark.sparkContext.broadcast(indexes)), HITS_SCHEMA)
    else:
        found = _by_fingerprints(corpus, items, passages, count)
    longest = F.max(F.struct("span_words", (-F.col("at_word")).alias("back")))
    return found.groupBy("id", "item", "field").agg(longest.alias("m")).select("id", "item", "field", "m.span_words", (-F.col("m.back")).alias("at_word"))


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())


def leak_report(found: DataFrame, test: DataFrame, test_id: str = "figure_id") -> DataFrame:
    """One row for each test item: how many rows share a passage with it, in which fields, and the longest one."""
    by_item = found.groupBy("item").agg(
        F.countDistinct("id").alias("n_rows"), F.count_if(F.col("field") == "code").alias("n_code"), F.count_if(F.col("field") != "code").alias("n_caption"), F.max("span_words").alias("longest_words")
    )
    items = test.select(F.col(test_id).cast("string").alias("item")).where("item is not null").distinct()
    return items.join(by_item, "item", "left").select(
        F.col("item").alias(test_id), *(F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("n_rows", "bigint"), ("n_code", "bigint"), ("n_caption", "bigint"), ("longest_words", "int")))
    )
