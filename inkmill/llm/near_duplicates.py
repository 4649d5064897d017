"""Near-duplicate records with small edits: an exact similarity join by parity sketches.

A record is the set of its distinct sequences of five words. Every token of the set XORs its 48-bit hash into one of K
cells, so two sketches differ in at most as many cells as the sets differ in tokens: the Hamming distance over cells
is a lower bound of the symmetric difference. A Jaccard similarity of t allows a symmetric difference of at most
d = (1 - t) / (1 + t) * (|A| + |B|), so among any d + 1 filled cells of a set at least one agrees with the other set
(pigeonhole). Each set is joined within its *size band* (an octave of set sizes, with K fitted to it) and, as the smaller
partner, within the next band. Of its filled cells it sends the d + 1 that come first in an order that depends on the
content of the cell only, so both partners sort an agreeing cell alike; the order puts rare content first, by
counts of all tokens of the corpus in a table of bounded size. Candidates are held
against each other's parity bits (Hamming distance at most d) and then verified on the texts.

*Hot cells.* A cell whose rarest token is held by more than about ``HOT`` sets is not sent. Two similar sets can only agree in nothing
but hot cells if each has a hot cell among its first d + 1; such sets, and those with fewer than d + 1 filled cells, meet once more with one
token to a cell: for each narrow band of partner sizes a set of n tokens sends its rarest n - o + 1 tokens, o being the overlap that the
similarity needs. Sets that share a common part meet there only if that part is nearly as large as a similar pair's must be, so the
meetings grow with the pairs to be found, not with the square of a common part's holders. A token held by more than ``SPLIT`` sets is cut into parts, each two of which meet in a task
of their own. Nothing is capped.

The cells travel as packed arrays (a few bytes a cell, one shuffled row for each bucket and batch) and are joined by sorting in
each bucket. Sets that are equal are collapsed before the join and expanded after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.scan import blocks, grams, mixed, words
from inkmill.session import materialise

SHINGLE_WORDS = 5
THRESHOLD = 0.7
MIN_WORDS = 40
#: Slots of the token counts that set the order of cells: for tables of up to 256 parts, and at most. Into how many rows they are cut.
COUNT_SLOTS, MOST_SLOTS, COUNT_PARTS = 1 << 20, 1 << 24, 64
#: A cell is hot if its rarest token occurs more often than this (beyond what other tokens add to its slot).
HOT = 512
#: Sets that meet in one task because of one token, about.
SPLIT = 20_000
#: The width of the bands of partner sizes for sets with hot cells.
NARROW = 1.1
#: Members of a class of equal sets in one place, when the pairs within it are written out.
PLACE_ROWS = 5000
#: Tasks of the join, each of which holds one bucket after the other.
MOST_TASKS = 50_000
#: Cells that one bucket of the join holds, about.
CELLS_PER_BUCKET = 400_000
#: Up to this many ids a set of ids is broadcast (about 64 MB); beyond it, it is shuffled.
BROADCAST_IDS = 1_000_000
#: Bits of the parity sketch against which candidates are held before their texts are fetched.
SKETCH_BITS = 512
PAIR_RUN = 1 << 20

LOW48 = np.uint64((1 << 48) - 1)
PROFILE_SCHEMA = "id string, sig1 long, sig2 long, n int, sketch array<long>, part int, counts binary"
PROFILE_NAMES = ["id", "sig1", "sig2", "n", "sketch", "part", "counts"]


def token_sets(column: pa.Array, k: int, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By block: the rows with at least ``min_words`` words, their set sizes, and their sorted distinct 48-bit tokens."""
    for block in blocks(column):
        found = words(block)
        hashes, at = grams(found, k)
        row = found.rows[at].astype(np.uint64)
        wide = found.counts[row.astype(np.int64)] >= min_words if len(row) else np.zeros(0, bool)
        # A block of short texts may hold more rows than 16 bits can number.
        for low in range(0, len(found.counts), 1 << 16):
            mine = wide & (row >= low) & (row < low + (1 << 16))
            joint = np.sort(((row[mine] - np.uint64(low)) << np.uint64(48)) | (hashes[mine] & LOW48))
            if len(joint):
                joint = joint[np.concatenate(([True], joint[1:] != joint[:-1]))]
            local, size = np.unique(joint >> np.uint64(48), return_counts=True)
            yield block.first + low + local.astype(np.int64), size, joint & LOW48


def _signatures(size: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    n = size.astype(np.uint64)
    one = mixed(np.bitwise_xor.reduceat(mixed(tokens + np.uint64(1)), first) + n) if len(size) else np.zeros(0, np.uint64)
    two = mixed(np.add.reduceat(mixed(tokens ^ np.uint64(0x5DEECE66D)), first) ^ n) if len(size) else np.zeros(0, np.uint64)
    return one, two


def parity_bits(size: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits a set, as 64-bit values: each token flips one bit, so that the Hamming distance of two sketches
    is at most the symmetric difference of the sets."""
    bit = np.repeat(np.arange(len(size)) * SKETCH_BITS, size) + (mixed(tokens + np.uint64(77)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(bit, minlength=len(size) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _slots(tokens: np.ndarray, slots: int) -> np.ndarray:
    return (mixed(tokens) >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


def count_slots(parts: int) -> int:
    """A power of two that grows with the parts of the table's scan."""
    return min(MOST_SLOTS, COUNT_SLOTS << max(0, (parts - 1) // 256).bit_length())


def _profile(k: int, min_words: int, slots: int):
    """One row for each record (its set's signatures and size), then the token counts of the partition."""

    def run(batches):
        counts = np.zeros(slots, np.uint32)
        for batch in batches:
            for rows, size, tokens in token_sets(batch.column(1), k, min_words):
                if not len(rows):
                    continue
                counts += np.bincount(_slots(tokens, slots), minlength=slots).astype(np.uint32)
                one, two = _signatures(size, tokens)
                none = pa.nulls(len(rows))
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * SKETCH_BITS // 64 + 1, SKETCH_BITS // 64, dtype=np.int32)), pa.array(parity_bits(size, tokens)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(size.astype(np.int32)), sketch, none.cast(pa.int32()), none.cast(pa.binary())],
                    names=PROFILE_NAMES,
                )
        if counts.any():
            none = pa.nulls(COUNT_PARTS)
            packed = [pa.compress(x.astype(np.uint64).tobytes(), "zstd", asbytes=True) for x in np.split(counts, COUNT_PARTS)]
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.list_(pa.int64())), pa.array(np.arange(COUNT_PARTS, dtype=np.int32)), pa.array(packed, pa.binary())],
                names=PROFILE_NAMES,
            )

    return run


def _unpacked(data, slots: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data.as_buffer(), slots // COUNT_PARTS * 8, "zstd"), np.uint64)


def _added(slots: int, last: bool):
    """The sums of the token counts of each part, packed, or at the last on a scale of one byte."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                add = _unpacked(packed, slots)
                total[part] = total[part] + add if part in total else add
        for part, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_coarse(x).tobytes() if last else pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["part", "counts"])

    return run


def _coarse(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of one byte."""
    return np.minimum(255, np.floor(6 * np.log2(1.0 + counts))).astype(np.uint8)


def _rarity(profile: DataFrame, slots: int, tasks: int) -> np.ndarray:
    """How often the tokens of each slot occur in the whole corpus. The driver gets ``slots`` bytes, MOST_SLOTS at most. Tables
    are added up in groups of about the root of their number before they come together."""
    schema = "part int, counts binary"
    counted = profile.where("part is not null").select("part", "counts", F.pmod(F.spark_partition_id(), F.lit(max(1, int(tasks**0.5)))).alias("salt"))
    once = counted.repartition(max(COUNT_PARTS, int(tasks**0.5)), "part", "salt").select("part", "counts").mapInArrow(_added(slots, False), schema) if tasks > 256 else counted.select("part", "counts")
    scale = np.zeros(slots, np.uint8)
    width = slots // COUNT_PARTS
    for r in once.repartition(COUNT_PARTS, "part").mapInArrow(_added(slots, True), schema).collect():
        scale[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], np.uint8)
    return scale


def allowed_difference(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The largest symmetric difference of two sets of sizes a and b with at least this similarity."""
    return np.floor((1 - threshold) / (1 + threshold) * (a + b) + 1e-9).astype(np.int64)


def roles(size: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sets, band, difference to allow, whether only as the smaller partner) for the band of each set and the next one."""
    band = np.floor(np.log2(size)).astype(np.int64)
    top = (np.int64(2) << band) - 1
    largest = np.floor(size / threshold + 1e-9).astype(np.int64)
    every = np.arange(len(size))
    out = [(every, band, allowed_difference(size, np.minimum(largest, top), threshold), np.zeros(len(size), bool))]
    up = every
    step = 1
    while len(up := up[largest[up] > top[up]]):  # more than one step only for thresholds under a half
        top = (np.int64(2) << (band + step)) - 1
        out.append((up, band[up] + step, allowed_difference(size[up], np.minimum(largest[up], top[up]), threshold), np.ones(len(up), bool)))
        step += 1
    return out


def sketch_cells(size: np.ndarray, tokens: np.ndarray, cells: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The filled cells of all sets: set, XOR of its tokens with its place mixed in, and the rarest token's count."""
    owner = np.repeat(np.arange(len(size)), size)
    wide = cells[owner].astype(np.uint64)
    # tokens are sorted within a set, so a cell is a stretch of them
    cell = ((tokens >> np.uint64(16)) * wide) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1])))) if len(tokens) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    parity = np.bitwise_xor.reduceat(tokens, first)
    key = mixed(parity ^ mixed(cell[first] + (wide[first] << np.uint64(40))))
    return owner[first], key, np.minimum.reduceat(scale[_slots(tokens, len(scale))], first)


def _sent(size: np.ndarray, tokens: np.ndarray, threshold: float, scale: np.ndarray, hot: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By role: (set, 1 if only with sets of the other mark, keys) such that any two similar sets share a key."""
    again = np.zeros(len(size), bool)
    for sets, band, differ, small in roles(size, threshold):
        own, mine = _pick(sets, size, tokens)
        wide = np.int64(3) << np.maximum(band - 1, 0)  # 1.5 cells for each token of the smallest set of the band
        owner, key, rare = sketch_cells(own, mine, wide, scale)
        filled = np.bincount(owner, minlength=len(sets))
        order = np.lexsort((key, rare, owner))
        place = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(filled)[:-1])), filled)
        first = order[place <= differ[owner[order]]]
        cold = rare[first] <= hot
        send = first[cold]
        yield sets[owner[send]], small[owner[send]], key[send]
        again[sets[owner[first[~cold]]]] = True
        again[sets[filled <= differ]] = True  # the pigeonhole fails for these
    if again.any():
        some = np.flatnonzero(again)
        own, mine = _pick(some, size, tokens)
        for owner, larger, key in rarest_tokens(own, mine, threshold, scale):
            yield some[owner], larger, key


def _pick(sets: np.ndarray, size: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(sets) == len(size):
        return size, tokens
    keep = np.zeros(len(size), bool)
    keep[sets] = True
    return size[sets], tokens[np.repeat(keep, size)]


def rarest_tokens(size: np.ndarray, tokens: np.ndarray, threshold: float, scale: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By band of partner sizes: (set, 1 if only as the larger partner, keys). Of two sets with an overlap of o, the rarest n - o + 1 tokens
    of each, in one order, have one in common."""
    owner = np.repeat(np.arange(len(size)), size)
    level, name = scale[_slots(tokens, len(scale))], mixed(tokens + np.uint64(5))
    order = np.lexsort((name, level, owner))
    name, level = name[order], level[order]  # owners stay in place
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    parts = np.maximum(1, np.ceil(np.exp2(level / 6.0) / SPLIT)).astype(np.int64)
    mark = mixed(np.bitwise_xor.reduceat(mixed(tokens + np.uint64(1)), np.cumsum(size) - size))
    least = np.ceil(threshold * size - 1e-9)
    band = np.floor(np.log(size) / np.log(NARROW) + 1e-9).astype(np.int64)
    step = 0
    while True:
        low = np.maximum(np.ceil(NARROW ** (band - step) - 1e-6), least)
        active = (band >= step) & (np.ceil(NARROW ** (band - step + 1)) >= least)
        if not active.any():
            return
        overlap = np.ceil(threshold / (1 + threshold) * (size + low) - 1e-9)
        send = np.flatnonzero(active[owner] & (place <= (size - overlap)[owner]))
        times = parts[send]
        at = np.repeat(send, times)
        other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        mine = (mark[owner[at]] % parts[at].astype(np.uint64)).astype(np.int64)
        pair = (np.minimum(mine, other) << 24) | np.maximum(mine, other)
        where = mixed(pair.astype(np.uint64) + (np.uint64(1) << np.uint64(60)) + ((band - step)[owner[at]].astype(np.uint64) << np.uint64(48)))
        yield owner[at], np.full(len(at), step > 0), mixed(name[at] ^ where)
        step += 1


def _emit(k: int, min_words: int, threshold: float, buckets: int, scale, hot: int):
    """Packed cells: one row for each bucket and batch."""

    def pack(sigs, sizes, owners, smalls, keys):
        owner, small, key = np.concatenate(owners), np.concatenate(smalls), np.concatenate(keys)
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.lexsort((key, bucket))
        owner, small, key, bucket = owner[order], small[order], key[order], bucket[order]
        entry = owner * 2 + small
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        out_bucket, out_data = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            used, at = np.unique(entry[a:b], return_inverse=True)
            head = np.array([len(used), b - a], np.int64)
            # within a bucket the high bits are all but equal; the 32 bits kept lie below them
            low = (key[a:b] >> np.uint64(8)).astype(np.uint32)
            out_bucket.append(int(bucket[a]))
            out_data.append(b"".join(x.tobytes() for x in (head, sigs[used // 2], sizes[used // 2].astype(np.int32), (used % 2).astype(np.uint8), low, at.astype(np.uint32 if len(used) > 65535 else np.uint16))))
        return pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_data, pa.binary())], names=["bucket", "cells"])

    def run(batches):
        rarity = scale.value
        seen: set[int] = set()
        for batch in batches:
            sigs, sizes, owners, smalls, keys, base, held = [], [], [], [], [], 0, 0
            for _, size, tokens in token_sets(batch.column(0), k, min_words):
                one, _ = _signatures(size, tokens)
                new = np.zeros(len(size), bool)
                for i, s in enumerate(one.tolist()):
                    if s not in seen:
                        seen.add(s)
                        new[i] = True
                if len(seen) > 1_000_000:  # only spares work: equal sets are also dropped after the shuffle
                    seen.clear()
                if not new.any():
                    continue
                tokens, size, one = tokens[np.repeat(new, size)], size[new], one[new]
                for owner, small, key in _sent(size, tokens, threshold, rarity, hot):
                    owners.append(owner + base)
                    smalls.append(small)
                    keys.append(key)
                    held += len(key)
                sigs.append(one)
                sizes.append(size)
                base += len(size)
                if held > 1_500_000:
                    yield pack(np.concatenate(sigs), np.concatenate(sizes), owners, smalls, keys)
                    sigs, sizes, owners, smalls, keys, base, held = [], [], [], [], [], 0, 0
            if held:
                yield pack(np.concatenate(sigs), np.concatenate(sizes), owners, smalls, keys)

    return run


def _meet(threshold: float):
    """Pairs of sets that share a key, bucket by bucket. Rows must come sorted by bucket."""

    def unpack(data: bytes):
        entries, n = np.frombuffer(data, np.int64, 2)
        at = 16
        out = []
        for kind, count in ((np.uint64, entries), (np.int32, entries), (np.uint8, entries), (np.uint32, n), (np.uint32 if entries > 65535 else np.uint16, n)):
            out.append(np.frombuffer(data, kind, count, at))
            at += int(count) * np.dtype(kind).itemsize
        return out

    def pairs(held: list[bytes]):
        sig, size, small, key, at, base = [], [], [], [], [], 0
        for data in held:
            s, n, m, k, a = unpack(data)
            sig.append(s)
            size.append(n)
            small.append(m)
            key.append(k)
            at.append(a.astype(np.int64) + base)
            base += len(s)
        sig, size, small, key, at = map(np.concatenate, (sig, size, small, key, at))
        named, number = np.unique(sig, return_inverse=True)
        by_set = np.zeros(len(named), np.int64)
        by_set[number] = size
        node = number[at] * 2 + small[at]
        # those that meet only sets of the other mark stand last in a run, and look for none after them
        order = np.lexsort((node, node & 1, key))
        key, node = key[order], node[order]
        keep = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        key, node = key[keep], node[keep]
        run_start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(run_start, len(key)))
        left = np.repeat(length, length) - (np.arange(len(key)) - np.repeat(run_start, length)) - 1
        left[(node & 1) == 1] = 0
        live, step, found, waiting = np.flatnonzero(left > 0), 1, [], 0
        while len(live):
            a, b = node[live], node[live + step]
            x, y = a >> 1, b >> 1
            low, high = np.minimum(by_set[x], by_set[y]), np.maximum(by_set[x], by_set[y])
            good = (x != y) & (low >= threshold * high - 1e-9)
            x, y = x[good], y[good]
            found.append((np.minimum(x, y).astype(np.uint64) << np.uint64(32)) | np.maximum(x, y).astype(np.uint64))
            waiting += len(x)
            if waiting > PAIR_RUN:
                found = [np.unique(np.concatenate(found))]
                if len(found[0]) > PAIR_RUN // 2:
                    yield named, found[0]
                    found = []
                waiting = sum(map(len, found))
            step += 1
            live = live[left[live] >= step]
        if found:
            yield named, np.unique(np.concatenate(found))

    def batch_of(held):
        for named, joint in pairs(held):
            if len(joint):
                a, b = named[(joint >> np.uint64(32)).astype(np.int64)], named[(joint & np.uint64(0xFFFFFFFF)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["sig_a", "sig_b"])

    def run(batches):
        current, held = None, []
        for batch in batches:
            for bucket, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != current and held:
                    yield from batch_of(held)
                    held = []
                current = bucket
                held.append(cells.as_py())
        if held:
            yield from batch_of(held)

    return run


def similarities(a: pa.Array, b: pa.Array, k: int, min_words: int) -> np.ndarray:
    """The Jaccard similarity of the token sets of two columns, row by row."""
    n = len(a)
    both = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (a, b)])
    sizes = np.zeros(2 * n, np.int64)
    rows_of, tokens_of = [], []
    for rows, size, tokens in token_sets(both, k, min_words):
        sizes[rows] = size
        rows_of.append(np.repeat(rows, size))
        tokens_of.append(tokens)
    if not rows_of:
        return np.zeros(n)
    row, token = np.concatenate(rows_of) % n, np.concatenate(tokens_of)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    twice = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
    shared = np.bincount(row[1:][twice], minlength=n)
    union = sizes[:n] + sizes[n:] - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 0.0)


def _verify(k: int, min_words: int, threshold: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = similarities(part.column(2), part.column(3), k, min_words)
                good = pa.array(np.flatnonzero(found >= threshold - 1e-9))
                if len(good):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(good), part.column(1).take(good), pa.array(found).take(good)], names=["rep_a", "rep_b", "similarity"])

    return run


class NearDuplicates:
    """The links between different token sets of ``df``, and the records of each set.

    Rows with a null id are left out; a null text counts as empty, and texts of fewer than ``min_words`` words (or fewer
    than ``shingle`` words) take no part. Repeated rows with one id and one text count once. Other columns of ``df`` are not read.

    ``members``: (id, rep, copies, n) - every record that takes part, with the smallest id of the records with an equal set.
    ``links``: (rep_a, rep_b, similarity) - all pairs of different sets with at least ``threshold`` similarity.
    """

    def __init__(self, df: DataFrame, id_col: str = "file_id", text_col: str = "code", shingle: int = SHINGLE_WORDS, threshold: float = THRESHOLD, min_words: int = MIN_WORDS):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must lie in (0, 1]")
        spark = df.sparkSession
        text = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null")
        # what costs no tokenising to know: a text with w words has at least 2 w - 1 characters
        text = text.where(F.length("text") >= 2 * max(min_words, shingle) - 1)
        scans = text.rdd.getNumPartitions()
        slots = count_slots(scans)
        profile = materialise(text.mapInArrow(_profile(shingle, min_words, slots), PROFILE_SCHEMA))
        sets = profile.where("id is not null")
        key = ["sig1", "sig2"]
        reps = sets.groupBy(*key).agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.members = sets.select("id", *key).distinct().join(reps, key).select("id", "rep", "copies", "n")
        total = sets.agg(F.sum("n")).first()[0] or 0
        buckets = int(max(1, -(-total * 0.65 // CELLS_PER_BUCKET)))
        scale = spark.sparkContext.broadcast(_rarity(profile, slots, scans))
        hot = int(_coarse(np.array([HOT + 4 * total / slots]))[0])
        cells = text.select("text").mapInArrow(_emit(shingle, min_words, threshold, buckets, scale, hot), "bucket int, cells binary")
        met = cells.repartition(min(MOST_TASKS, -(-buckets // 2)), "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(threshold), "sig_a long, sig_b long").distinct()
        one = reps.select(F.col("sig1").alias("sig_a"), F.col("rep").alias("rep_a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        two = reps.select(F.col("sig1").alias("sig_b"), F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        distance = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
        near = distance <= (1 - threshold) / (1 + threshold) * (F.col("n_a") + F.col("n_b")) + 1e-9
        pairs = materialise(met.join(one, "sig_a").join(two, "sig_b").where(near).select("rep_a", "rep_b"))
        wanted = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
        if pairs.count() * 2 <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        texts = text.join(wanted, "id", "left_semi").dropDuplicates(["id"])
        both = pairs.join(texts.select(F.col("id").alias("rep_a"), F.col("text").alias("text_a")), "rep_a").join(texts.select(F.col("id").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")
        checked = both.select("rep_a", "rep_b", "text_a", "text_b").mapInArrow(_verify(shingle, min_words, threshold), "rep_a string, rep_b string, similarity double")
        self.links = materialise(checked.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"), "similarity"))
        self.candidates = pairs

    def pairs(self) -> DataFrame:
        """All pairs of records (id_a < id_b) with at least the threshold's similarity, equal sets included."""
        a = self.members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
        b = self.members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
        across = self.links.join(a, "rep_a").join(b, "rep_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        many = self.members.where("copies > 1")
        # the members of a large class are dealt to places; those they are paired with come to each place
        places = F.ceil(F.col("copies") / PLACE_ROWS).cast("int")
        left = many.select("rep", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), places).cast("int").alias("place"))
        right = many.select("rep", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), places - 1)).alias("place"))
        within = left.join(right, ["rep", "place"]).where("id_a < id_b").select("id_a", "id_b")
        return across.unionByName(within)

    def classes(self) -> DataFrame:
        """One row for each record: its class of equal sets, the copies in it, and its number of links to other classes."""
        degree = self.links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        return self.members.join(degree, "rep", "left").select("id", F.col("rep").alias("class_id"), "copies", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))

    def groups(self) -> DataFrame:
        """One row for each record with its group: the smallest id that links lead to."""
        return self.members.join(components(self.links.select("rep_a", "rep_b")), F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("group_id"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given by its first two columns; component: the smallest node in reach.

    Alternates large-star and small-star steps, each a shuffle by node, until the edges stay the same; the number of steps grows
    as the logarithm of the longest path. Hot nodes: a step only takes the minimum of a node's neighbours (partial
    aggregation) and joins it back, which adaptive execution splits.
    """
    a, b = edges.columns[:2]
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        now = materialise(star.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def p4_found(df: DataFrame) -> DataFrame:
    return NearDuplicates(df).pairs().select(F.col("id_a").alias("file_id_a"), F.col("id_b").alias("file_id_b"))
