"""Duplicates hidden by formatting: equal but for case, white space, punctuation and the order of fields.

The bytes of a record run through a skip-and-fold table: whatever is neither letter nor digit gets the symbol 0, letters
their lower case. The symbols are weighted by powers of a base at their canonical place and summed, which gives the rolling
polynomial hash of the canonical text without that text ever being built. Within a pair of square brackets that holds no
other bracket, the comma-separated entries count in the order of their folded content: their symbols keep their value and
only their places move. Records that agree in both hashes are compared once with the smallest of them, by two pointers that
skip and fold as they go; records that turn out to differ are hashed again with another base, until none is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.scan import BASE, SYMBOL, Block, _fold, blocks, mixed, powers, symbols
from inkmill.session import materialise

MIN_WORDS = 40
#: Members of a group that are compared with one copy of its first record.
SALT_ROWS = 2000
#: Up to this many ids a set of ids is broadcast (about 64 MB); beyond it, it is shuffled.
BROADCAST_IDS = 1_000_000
ROUNDS = 8
OPEN, CLOSE, COMMA = ord("["), ord("]"), ord(",")
#: Symbols by which entries are sorted at once; entries that agree in so many are compared one by one.
KEY_SYMBOLS = 12
BRACKETS = re.compile(r"\[[^\[\]]*,[^\[\]]*\]")


def _entries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, first byte, end) of the entries of all innermost brackets with more than one entry."""
    none = np.zeros(0, np.int64)
    at = np.flatnonzero((data == OPEN) | (data == CLOSE))
    if len(at) < 2:
        return none, none, none
    row = np.searchsorted(offsets, at, side="right")
    pair = np.flatnonzero((data[at[:-1]] == OPEN) & (data[at[1:]] == CLOSE) & (row[:-1] == row[1:]))
    opens, closes = at[pair], at[pair + 1]
    commas = np.flatnonzero(data == COMMA)
    group = np.searchsorted(opens, commas) - 1
    inside = (group >= 0) & (commas < closes[np.maximum(group, 0)]) if len(opens) else np.zeros(len(commas), bool)
    commas, group = commas[inside], group[inside]
    used = np.unique(group)
    bounds = np.concatenate((opens[used], commas, closes[used]))
    owner = np.concatenate((used, group, used))
    order = np.argsort(bounds)
    bounds, owner = bounds[order], owner[order]
    first = np.flatnonzero(owner[:-1] == owner[1:])
    return owner[first], bounds[first] + 1, bounds[first + 1]


def _moved(place: np.ndarray, symbol: np.ndarray, keep: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Shift the places of the symbols of entries to the canonical order of the entries."""
    group, start, end = _entries(data, offsets)
    if not len(group):
        return
    rank = np.concatenate((np.cumsum(keep) - keep, [keep.sum()]))
    length = rank[end] - rank[start]
    where = np.flatnonzero(keep)
    keys = []
    for j in range(0, KEY_SYMBOLS, 3):
        key = np.zeros(len(group), np.uint64)
        for t in range(j, j + 3):
            has = length > t
            piece = np.zeros(len(group), np.uint64)
            piece[has] = symbol[where[rank[start[has]] + t]]
            key = (key << np.uint64(21)) | piece
        keys.append(key)
    order = np.lexsort((*reversed(keys), group))
    long = length[order] >= KEY_SYMBOLS  # an entry that ends with its key ties with longer ones
    tie = (group[order][1:] == group[order][:-1]) & long[1:] & long[:-1]
    for key in keys:
        tie &= key[order][1:] == key[order][:-1]
    for g in np.unique(group[order][1:][tie]).tolist():
        mine = np.arange(np.searchsorted(group, g, "left"), np.searchsorted(group, g, "right"))
        order[mine] = sorted(order[mine].tolist(), key=lambda e: symbol[where[rank[start[e]] : rank[start[e]] + length[e]]].tolist())
    sorted_length = length[order]
    total = np.cumsum(sorted_length) - sorted_length
    first = np.concatenate(([True], group[1:] != group[:-1]))
    base_old, base_new = rank[start[first]], total[np.flatnonzero(first)]
    times = np.diff(np.append(np.flatnonzero(first), len(group)))
    target = np.empty(len(group), np.int64)
    target[order] = np.repeat(base_old - base_new, times) + total
    shift = target - rank[start]
    width = end - start
    touched = np.repeat(start - np.cumsum(width) + width, width) + np.arange(width.sum())
    place[touched] += np.repeat(shift, width)


def fingerprints(block: Block, seed: int, fields: bool) -> tuple[np.ndarray, np.ndarray]:
    """By row: the hash of the canonical text, and its number of words."""
    data, offsets = block.data, block.offsets
    rows = len(offsets) - 1
    out, counts = np.zeros(rows, np.uint64), np.zeros(rows, np.int64)
    if not len(data):
        return mixed(out), counts
    symbol, kind = symbols(data)
    keep = kind == SYMBOL
    size = np.diff(offsets)
    rank = np.concatenate((np.cumsum(keep) - keep, [keep.sum()]))
    held = np.diff(rank[offsets])
    place = rank[:-1] - np.repeat(rank[offsets[:-1]], size)
    if fields:
        _moved(place, symbol, keep, data, offsets)
    np.minimum(place, max(int(held.max()) - 1, 0), out=place)  # skipped bytes may stand past the last symbol
    base = mixed(np.array([seed + 1], np.uint64) * BASE)[0] | np.uint64(1)
    weighted = symbol.astype(np.uint64) * powers(base, int(held.max()))[place]
    full = np.flatnonzero(size)
    out[full] = np.add.reduceat(weighted, offsets[:-1][full])
    inside = kind > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[offsets[:-1][full]] = inside[offsets[:-1][full]]
    counts = np.diff(np.concatenate(([0], np.cumsum(opens)))[offsets])
    return mixed(out + held.astype(np.uint64)), counts


def _prints(seed: int):
    def run(batches):
        for batch in batches:
            one, n, two = [], [], []
            for block in blocks(batch.column(1)):
                h, c = fingerprints(block, seed, True)
                one.append(h)
                n.append(c)
            for block in blocks(batch.column(2)):
                two.append(fingerprints(block, seed, False)[0])
            if one:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)), pa.array(np.concatenate(n).astype(np.int32))], names=["id", "print", "print_2", "n_words"])

    return run


def _folded(text: str, a: int, b: int) -> Iterator[int]:
    for c in text[a:b]:
        s = _fold(ord(c))
        if s:
            yield s


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """The parts of a text in canonical order: what lies outside of brackets, and sorted entries."""
    at = 0
    for m in BRACKETS.finditer(text):
        yield at, m.start()
        entries, a = [], m.start() + 1
        for piece in text[a : m.end() - 1].split(","):
            entries.append((a, a + len(piece)))
            a += len(piece) + 1
        yield from sorted(entries, key=lambda e: list(_folded(text, *e)))
        at = m.end()
    yield at, len(text)


def same(a: str, b: str, fields: bool) -> bool:
    """Two pointers run over both texts, skipping and folding, and stop at the first difference."""
    if a == b:
        return True
    one, two = (_stretches(a), _stretches(b)) if fields else (iter([(0, len(a))]), iter([(0, len(b))]))
    fold = _FOLD
    i = i_end = j = j_end = 0
    while True:
        x = y = 0
        while not x:
            if i == i_end:
                step = next(one, None)
                if step is None:
                    break
                i, i_end = step
                continue
            c = ord(a[i])
            x = fold[c] if c < 128 else _fold(c)
            i += 1
        while not y:
            if j == j_end:
                step = next(two, None)
                if step is None:
                    break
                j, j_end = step
                continue
            c = ord(b[j])
            y = fold[c] if c < 128 else _fold(c)
            j += 1
        if x != y:
            return False
        if not x:
            return True


_FOLD = [_fold(c) for c in range(128)]


def _compare(batches):
    for batch in batches:
        a1, a2, b1, b2 = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
        ok = [same(p or "", q or "", True) and same(r or "", s or "", False) for p, q, r, s in zip(a1, b1, a2, b2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["id", "rep", "ok"])


def _round(text: DataFrame, min_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of the groups by hash, rows alone included, and (id, rep, ok) of the members compared with their first."""
    # read twice below, and far smaller than the texts
    prints = materialise(text.mapInArrow(_prints(seed), "id string, print long, print_2 long, n_words int").where(F.col("n_words") >= min_words).drop("n_words"))
    reps = prints.groupBy("print", "print_2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    key = ["print", "print_2"]
    # groups of more than SALT_ROWS records are few; they are broadcast, and their records aren't shuffled to one task
    large = reps.where(F.col("n") > SALT_ROWS)
    if large.count() <= BROADCAST_IDS:
        large = F.broadcast(large)
    small = prints.join(large.select(*key), key, "left_anti").join(reps.where(F.col("n") <= SALT_ROWS), key)
    grouped = small.select("id", "rep", "n").unionByName(prints.join(large, key).select("id", "rep", "n"))
    # a record that comes more than once under one id is one record
    pairs = materialise(grouped.where("n > 1 and id <> rep").select("id", "rep", "n"))
    wanted = pairs.select(F.explode(F.array("id", "rep")).alias("id")).distinct()
    if pairs.count() * 2 <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    some = text.join(wanted, "id", "left_semi")
    # the first record of a large group is sent to as many places as its members need
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    members = pairs.join(some, "id").select("id", "rep", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.col("one").alias("one_m"), F.col("two").alias("two_m"))
    firsts = pairs.select("rep", "n").distinct().join(some.withColumnRenamed("id", "rep"), "rep")
    firsts = firsts.select("rep", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "one", "two")
    both = members.join(firsts, ["rep", "salt"]).select("id", "rep", "one_m", "two_m", "one", "two")
    return grouped, materialise(both.mapInArrow(_compare, "id string, rep string, ok boolean"))


def copies(df: DataFrame, id_col: str = "file_id", text_col: str = "code", other_col: str = "caption", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, rep): each record with the smallest id of the records that differ from it in formatting only.

    Records are compared in ``text_col`` (whose bracketed fields may be reordered) and ``other_col``; null texts count as
    empty. Records of fewer than ``min_words`` words of ``text_col`` and records with a null id are left out. Ids are taken
    to be unique; of rows that repeat an id, one counts. Other columns are not read.
    """
    text = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("one"), F.coalesce(F.col(other_col), F.lit("")).alias("two")).where("id is not null")
    result = None
    for seed in range(ROUNDS):
        grouped, compared = _round(text, min_words, seed)
        apart = compared.where("not ok").select("id").distinct()
        part = grouped.join(apart, "id", "left_anti").select("id", "rep").distinct()
        result = part if result is None else result.unionByName(part)
        if apart.isEmpty():
            return result
        text = text.join(apart, "id", "left_semi")
    raise RuntimeError(f"records still collide after {ROUNDS} rounds with different bases")


def collapsed(groups: DataFrame) -> DataFrame:
    """One row for each group: its first record and the number of its copies."""
    return groups.groupBy("rep").agg(F.count("*").alias("copies"))


def p1_found(df: DataFrame) -> DataFrame:
    return copies(df).where("id <> rep").select(F.col("rep").alias("file_id_a"), F.col("id").alias("file_id_b"))
