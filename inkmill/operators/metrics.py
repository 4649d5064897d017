"""Scores of predictions against references: n-grams, edit distance, vectors."""

from __future__ import annotations

import re
from functools import lru_cache
from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.sequences import joined_ngrams, ngrams
from inkmill.functions.text import _c

EPSILON = 1e-6


def ngram_counts(df: DataFrame, tokens: str, most: int = 4, least: int = 1) -> DataFrame:
    """A-09: (ngram, n) over all rows; counted in each task before the shuffle."""
    grams = F.concat(*(joined_ngrams(tokens, n) for n in range(least, most + 1)))
    return df.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def trivial_ngrams(df: DataFrame, tokens: str, k: int = 500, most: int = 4) -> DataFrame:
    """O-04: the ``k`` most frequent; ties go to the lesser text."""
    return ngram_counts(df, tokens, most).orderBy(F.desc("n"), "ngram").limit(k)


def bleu_counts(df: DataFrame, key: str, hypothesis: str, reference: str, most: int = 4) -> DataFrame:
    """A-13: by row the clipped matches and totals of each order, and both lengths. Evaluated within the row."""

    def matched(h: Column, r: Column) -> Column:
        each = lambda g: F.least(F.size(F.filter(h, lambda x: x == g)), F.size(F.filter(r, lambda x: x == g)))
        return F.aggregate(F.array_distinct(h), F.lit(0), lambda s, g: s + each(g))

    stats = []
    for n in range(1, most + 1):
        h, r = (F.transform(ngrams(c, n), lambda g: F.array_join(g, " ")) for c in (hypothesis, reference))
        stats += [matched(h, r).alias(f"m{n}"), F.size(h).alias(f"t{n}")]
    return df.select(key, F.size(hypothesis).alias("hyp_len"), F.size(reference).alias("ref_len"), *stats)


def bleu_of(row, most: int = 4) -> float:
    """Corpus BLEU of summed counts: the geometric mean of precisions with exponential smoothing of zero counts, and the
    brevity penalty."""
    total, smooth = 0.0, 1.0
    used = 0
    for n in range(1, most + 1):
        matched, seen = row[f"m{n}"] or 0, row[f"t{n}"] or 0
        if not seen:
            break
        used += 1
        if not matched:
            smooth *= 2
            precision = 1.0 / (smooth * seen)
        else:
            precision = matched / seen
        total += log(precision)
    if used < most or not (row["hyp_len"] or 0):
        return 0.0
    short = row["hyp_len"] < row["ref_len"]
    return exp(total / most) * (exp(1 - row["ref_len"] / row["hyp_len"]) if short else 1.0)


# The steps of the "13a" tokenisation of the published BLEU scorers.
STEPS_13A = (
    (re.compile(r"([{-~\[-` -&(-+:-@/])"), r" \1 "),
    (re.compile(r"([^0-9])([.,])"), r"\1 \2 "),
    (re.compile(r"([.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
)


def split_13a(text: str) -> list[str]:
    """M-01: the tokens of a text as BLEU counts them: signs are split off, full stops and commas within numbers are not."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, sign)
    text = f" {text} "
    for pattern, by in STEPS_13A:
        text = pattern.sub(by, text)
    return text.split()


@lru_cache(1 << 16)
def _split_13a(token: str) -> tuple[str, ...]:
    return tuple(split_13a(token))


def crystal_bleu(df: DataFrame, hypothesis: str, reference: str, trivial: DataFrame, most: int = 4) -> DataFrame:
    """M-01: one row (n_pairs, crystal_bleu in [0, 1]): the n-grams of both token arrays, less the trivial ones, joined to one
    text, split again by the 13a rule and scored by corpus BLEU; rows with an empty side are left out, 0 without rows.

    The trivial n-grams (k of them, a bounded table) are read to the driver. Counts are made by row in Arrow batches and summed
    in one small aggregation.
    """
    shared = frozenset(r[0] for r in trivial.select("ngram").collect())
    names = ["hyp_len", "ref_len", *(f"{c}{n}" for n in range(1, most + 1) for c in "mt")]
    counts = df.select(F.col(hypothesis).alias("h"), F.col(reference).alias("r")).mapInPandas(_bleu_rows(shared, most, names), ", ".join(f"{c} long" for c in names))
    sums = counts.agg(F.count("*").alias("n_pairs"), *(F.sum(c).alias(c) for c in names))
    score = F.udf(lambda *v: bleu_of(dict(zip(names, v)), most), "double")
    return sums.select("n_pairs", score(*(F.col(c) for c in names)).alias("crystal_bleu"))


def _bleu_rows(shared: frozenset[str], most: int, names: list[str]):
    def runs(tokens, n):
        return zip(*(tokens[i:] for i in range(n)))

    def kept(tokens):
        # tokens are joined by blanks, across which the 13a rule does not reach: each is split by itself
        split = [_split_13a(t) for t in tokens]
        return [s for n in range(1, most + 1) for i, g in enumerate(runs(tokens, n)) if " ".join(g) not in shared for part in split[i : i + n] for s in part]

    def run(frames):
        import pandas as pd
        from collections import Counter

        for frame in frames:
            rows = []
            for h, r in zip(frame["h"], frame["r"]):
                h, r = kept(list(h) if h is not None else []), kept(list(r) if r is not None else [])
                if not h or not r:
                    continue
                row = [len(h), len(r)]
                for n in range(1, most + 1):
                    row += [sum((Counter(runs(h, n)) & Counter(runs(r, n))).values()), max(0, len(h) - n + 1)]
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    return run


def extended_edit_distance(hypothesis: str, reference: str, alpha: float = 0.5, rho: float = 1.5, deletion: float = 1.0, insertion: float = 1.0) -> float:
    """M-02: edit distance on characters with jumps at blanks (cost ``alpha``) and a charge ``rho`` for characters visited more
    than once or never; at most 1. One row of the table at a time, each row by whole-array steps."""
    h, r = np.frombuffer(hypothesis.encode("utf-32-le"), np.uint32), np.frombuffer(reference.encode("utf-32-le"), np.uint32)
    width = len(h) + 1
    steps = np.arange(width) * deletion
    visits = np.full(width, -1)
    row = np.ones(width)
    row[0] = 0.0
    for c in r:
        best = np.empty(width)
        best[0] = row[0] + 1.0
        np.minimum(row[:-1] + (h != c), row[1:] + insertion, out=best[1:])
        row = np.minimum.accumulate(best - steps) + steps
        low = int(row.argmin())
        visits[low] += 1
        if c == 32:
            np.minimum(row, alpha + row[low], out=row)
    coverage = rho * float(np.where(visits >= 0, visits, 1).sum())
    return min(1.0, (float(row[-1]) + coverage) / (len(r) + coverage)) if len(r) + coverage else 0.0


def tex_edit_distance(hypothesis: Column | str, reference: Column | str, alpha: float = 0.5, rho: float = 1.5) -> Column:
    """M-02 on two columns of folded tokens (arrays, see ``lexed``), each joined by blanks; null counts as empty."""

    @F.udf("double", useArrow=True)
    def run(a, b):
        return extended_edit_distance(a or "", b or "", alpha, rho)

    return run(F.array_join(_c(hypothesis), " "), F.array_join(_c(reference), " "))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """M-03, M-08: null if a vector is null, 0 if it has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.when(scale.isNotNull(), F.lit(0.0)))


def cosine_reward(a: Column | str, b: Column | str) -> Column:
    """M-04: the cosine on a scale from 0 to 1; 0 if a vector is null (M-10)."""
    scale = norm(a) * norm(b)
    value = dot(a, b) / F.greatest(scale, F.lit(EPSILON))
    # greatest and least pass over nulls
    return F.when(value.isNotNull() & scale.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value + 1) / 2))).otherwise(F.lit(0.0))


def mean_pool(patches: Column | str) -> Column:
    """M-08: the mean of an array of vectors; null without vectors."""
    p = _c(patches)
    total = F.aggregate(F.slice(p, F.lit(2), F.greatest(F.lit(0), F.size(p) - 1)), F.transform(F.try_element_at(p, F.lit(1)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(p))


def concat_patches(patches: Column | str, factor: int = 3) -> Column:
    """M-14: every ``factor`` neighbouring vectors become one; a rest is left out."""
    p = _c(patches)
    n = F.floor(F.size(p) / factor).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), lambda i: F.flatten(F.slice(p, i * factor + 1, F.lit(factor))))).otherwise(F.array().cast("array<array<float>>"))


def drop_leading_patches(patches: Column | str, keep: Column | int, factor: int = 1) -> Column:
    """M-22: the last ``keep`` vectors, joined by ``factor``."""
    p, n = _c(patches), F.lit(keep) if isinstance(keep, int) else keep
    last = F.slice(p, F.greatest(F.lit(1), F.size(p) - n + 1), n)
    return concat_patches(last, factor) if factor > 1 else last


def normalised_pixels(pixels: Column | str, mean: float = 0.5, std: float = 0.5, scale: float = 1 / 255) -> Column:
    """M-23: rescaled and normalised values."""
    return F.transform(_c(pixels), lambda x: (x * scale - mean) / std)


def padded_geometry(width: Column | str, height: Column | str, side: int = 448) -> Column:
    """M-09: struct(width, height, left, top) of an image fitted into a square; halves round to even."""
    w, h = _c(width), _c(height)
    scale = F.least(side / w, side / h)
    a, b = F.bround(w * scale).cast("int"), F.bround(h * scale).cast("int")
    return F.struct(a.alias("width"), b.alias("height"), F.floor((side - a) / 2).cast("int").alias("left"), F.floor((side - b) / 2).cast("int").alias("top"))


def assignment_cost(cost: np.ndarray) -> float:
    """The least sum of one entry from each row and column (the Hungarian method, by shortest augmenting paths)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            free = ~used[1:]
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return float(sum(cost[match[j] - 1, j - 1] for j in range(1, n + 1)))


def transport_cost(cost: np.ndarray) -> float:
    """The earth mover's distance with uniform weights: for equal sizes an assignment, else a transport of a rows to b columns by
    shortest augmenting paths, with as many units as the least common multiple of the sizes; the matrix stays a x b."""
    a, b = cost.shape
    if a == b:
        return assignment_cost(cost) / a
    units = int(np.lcm(a, b))
    left, room = np.full(a, units // a), np.full(b, units // b)
    u, v, flow = np.zeros(a), np.zeros(b), np.zeros((a, b), np.int64)
    for i in range(a):
        while left[i]:
            # least reduced cost to each column, and the row before it on the way; rows are reached by flow that can be taken back
            far, before = cost[i] - u[i] - v, np.full(b, i)
            row_far, row_from = np.full(a, np.inf), np.full(a, -1)
            row_far[i] = 0.0
            done = np.zeros(b, bool)
            while True:
                j = int(np.where(done, np.inf, far).argmin())
                done[j] = True
                if room[j]:
                    break
                for r in np.flatnonzero((flow[:, j] > 0) & np.isinf(row_far)):
                    row_far[r], row_from[r] = far[j], j
                    through = far[j] + cost[r] - u[r] - v
                    better = ~done & (through < far - 1e-15)
                    far[better], before[better] = through[better], r
            reached = ~np.isinf(row_far)
            u[reached] += far[j] - row_far[reached]
            v[done] -= far[j] - far[done]
            way, at = [], j
            while True:
                r = int(before[at])
                way.append((r, at))
                if r == i:
                    break
                at = int(row_from[r])
            most = min(int(left[i]), int(room[j]), *(int(flow[r, row_from[r]]) for r, _ in way[:-1]))
            for r, c in way:
                flow[r, c] += most
                if r != i:
                    flow[r, row_from[r]] -= most
            left[i] -= most
            room[j] -= most
    return float((flow * cost).sum() / units)


def patch_score(a, b) -> float:
    """M-05: 2 tanh(-d) + 1 within [0, 1], d the earth mover's distance of two bags of vectors under 1 - cosine; 0 if one is empty."""
    if a is None or b is None or not len(a) or not len(b):
        return 0.0
    x, y = (np.array([np.asarray(v, np.float64) for v in m]) for m in (a, b))
    x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
    return float(np.clip(2 * np.tanh(-transport_cost(1.0 - x @ y.T)) + 1, 0.0, 1.0))


def patch_similarity(a: Column | str, b: Column | str) -> Column:
    """M-05 on columns of arrays of vectors."""
    return F.udf(patch_score, "double", useArrow=True)(_c(a), _c(b))


def distance_similarity(distance: Column | str, clamp: bool = False) -> Column:
    """M-06: 1 less a perceptual distance that an encoder supplied; clamped to [0, 1] as a reward, where null gives 0."""
    value = 1 - _c(distance)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(F.lit(0.0)) if clamp else value


def bagged(vector: Column | str, size: int) -> Column:
    """A vector cut into a bag of vectors of ``size`` values."""
    v = _c(vector)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, F.lit(size)))


def top_pairs(df: DataFrame, key: str, vector: str, k: int = 20, queries: Column | None = None, digits: int = 5) -> DataFrame:
    """M-03, O-04: the ``k`` pairs of highest cosine between the query rows (all, or those of ``queries``) and all rows.

    The queries are held in blocks of arrays by every task, so all rows are read once for each block and nothing is crossed in a
    join; each task keeps no more than its best ``k`` of a block. Pairs are (a < b), similarity rounded, ties by ids.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    asked = rows.where(queries) if queries is not None else rows
    total = asked.count()
    block_rows = 4096
    out = None
    for b in range(max(1, -(-total // block_rows))):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // block_rows)))) == b).toPandas()
        held = df.sparkSession.sparkContext.broadcast((mine["id"].to_numpy(), np.stack([np.asarray(v, np.float64) for v in mine["v"]]) if len(mine) else np.zeros((0, 1))))
        kind = df.schema[key].dataType.simpleString()
        part = rows.mapInPandas(_best(held, k, digits), f"a {kind}, b {kind}, similarity double")
        out = part if out is None else out.unionByName(part)
    return out.distinct().orderBy(F.desc("similarity"), "a", "b").limit(k)


def _best(held, k: int, digits: int):
    def run(frames):
        import pandas as pd

        ids, q = held.value
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        for frame in frames:
            v = np.stack([np.asarray(x, np.float64) for x in frame["v"]]) if len(frame) else np.zeros((0, q.shape[1]))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            mine = frame["id"].to_numpy()
            score = np.round(v @ q.T, digits)
            score[mine[:, None] == ids[None, :]] = -np.inf
            if not score.size:
                continue
            n = min(2 * k, score.size - 1)
            floor = np.partition(score.ravel(), -n - 1)[-n - 1] if n < score.size else -np.inf
            i, j = np.nonzero(score >= floor)
            a, b = np.minimum(mine[i], ids[j]), np.maximum(mine[i], ids[j])
            best = pd.DataFrame({"a": a, "b": b, "similarity": score[i, j]}).drop_duplicates()
            best = best[best["similarity"] > -np.inf].sort_values(["similarity", "a", "b"], ascending=[False, True, True])
            yield best.head(k)

    return run
