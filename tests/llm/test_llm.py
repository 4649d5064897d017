from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inkmill.llm import format_duplicates as FD
from inkmill.llm import leakage, mixing, near_duplicates, packing, queries, residue, scan, truncation
from tests.compare import check

WORD = re.compile(r"[^\W_]+")


def words(text):
    return WORD.findall((text or "").lower())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    check(spark, data, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, data, name):
    queries.queries()[name](spark, data).count()


# --- scanning -------------------------------------------------------------------------------------------------------
def random_texts(seed, n=60):
    r = random.Random(seed)
    chars = "ab1 _-,.\n" + "".join(map(chr, (0xC9, 0xE9, 0xDF, 0x3B1, 0x391, 0x416, 0x4E2D, 0x1F600, 0x660, 0xA0, 0x2014)))
    return ["".join(r.choice(chars) for _ in range(r.randrange(40))) for _ in range(n)] + ["", None, "word " * 3000, "x" * 5000]


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_words(limit):
    texts = random_texts(limit)
    found = [scan.words(b) for b in scan.blocks(pa.array(texts, pa.string()), limit)]
    wanted = [words(t) for t in texts]
    assert np.concatenate([f.counts for f in found]).tolist() == [len(w) for w in wanted]
    names = {}
    for w, h in zip(itertools.chain(*wanted), np.concatenate([f.hashes for f in found]).tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_grams():
    texts = ["a b c", "b c d", "", "c", "a b"]
    block = next(scan.blocks(pa.array(texts)))
    hashes, at = scan.grams(scan.words(block), 2)
    assert at.tolist() == [0, 1, 3, 4, 7] and hashes[1] == hashes[2] and hashes[0] == hashes[4] and len(set(hashes.tolist())) == 3


# --- 1: formatting --------------------------------------------------------------------------------------------------
def canonical(text):
    fold = lambda t: "".join(words(t))
    return fold(re.sub(r"\[([^\[\]]*)\]", lambda m: "".join(sorted(fold(e) for e in m[1].split(","))), text or ""))


def test_fingerprints_and_pointers():
    r = random.Random(7)
    texts = ["".join(r.choice("abA[],[] ,.\n" + chr(0xC9) + chr(0xE9)) for _ in range(r.randrange(14))) for _ in range(1500)]
    texts += ["[" + ",".join(f"option number {i:03} is long" for i in order) + "]x" for order in ((1, 2, 3), (3, 1, 2), (1, 2, 4))] + [None, ""]
    for limit in (40, 1 << 20):
        prints = np.concatenate([FD.fingerprints(b, 0, True)[0] for b in scan.blocks(pa.array(texts, pa.string()), limit)]).tolist()
        by = {}
        for t, p in zip(texts, prints):
            assert by.setdefault(canonical(t), p) == p
        assert len(set(by.values())) == len(by)
    for a, b in ((r.choice(texts) or "", r.choice(texts) or "") for _ in range(3000)):
        assert FD.same(a, b, True) == (canonical(a) == canonical(b))
    assert FD.same(texts[1500], texts[1501], True) and not FD.same(texts[1500], texts[1502], True)


def test_copies(spark, monkeypatch):
    rows = [("3", "\\draw[red, thick] (0,0);", "Cap"), ("1", "\\DRAW[thick,red](0,0)", "cap."), ("2", "\\draw[red, thick] (0,0);", "other"), ("4", None, None), ("5", "", " "), (None, "x", "y"), ("6", "a" * 9000, None), ("6", "a" * 9000, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file_id string, code string, caption string, id int")
    wanted = {("1", "1"), ("3", "1"), ("2", "2"), ("4", "4"), ("5", "4"), ("6", "6")}
    assert {tuple(r) for r in FD.copies(df, min_words=0).collect()} == wanted
    assert {tuple(r) for r in FD.collapsed(FD.copies(df, min_words=0)).collect()} == {("1", 2), ("2", 1), ("4", 2), ("6", 1)}
    assert FD.copies(df.where("false"), min_words=0).count() == 0
    # hashes that collide: the comparison tells the rows apart, and another base groups them
    true = FD._prints

    def weak(seed):
        def run(batches):
            for batch in true(seed)(batches):
                if seed == 0:
                    zero = pa.array(np.zeros(batch.num_rows, np.int64))
                    batch = pa.RecordBatch.from_arrays([batch.column(0), zero, zero, batch.column(3)], names=batch.schema.names)
                yield batch

        return run

    monkeypatch.setattr(FD, "_prints", weak)
    assert {tuple(r) for r in FD.copies(df, min_words=0).collect()} == wanted


def test_entries_as_long_as_the_key(spark):
    a, b = "abcdefghijkl", "abcdefghijklm"
    assert len(a) == FD.KEY_SYMBOLS
    texts = [f"[{a}, {b}]", f"[{b}, {a}]", f"[{b}, x, {a}, {a}]", f"[{a}, {b}, {a}, x]"]
    prints = np.concatenate([FD.fingerprints(x, 0, True)[0] for x in scan.blocks(pa.array(texts))]).tolist()
    assert prints[0] == prints[1] != prints[2] == prints[3]
    df = spark.createDataFrame([(str(i), t, "") for i, t in enumerate(texts)], "file_id string, code string, caption string")
    assert {tuple(r) for r in FD.copies(df, min_words=0).collect()} == {("0", "0"), ("1", "0"), ("2", "2"), ("3", "2")}


def test_hot_group(spark):
    df = spark.range(5000).selectExpr("lpad(id, 5, '0') as file_id", "case when id % 3 = 0 then concat(repeat('w ', 50), repeat(' ', cast(id % 7 as int))) else concat(repeat('v ', 50), id) end as code", "cast(null as string) as caption")
    assert FD.copies(df).where("id <> rep").count() == 1666


# --- 2: truncation --------------------------------------------------------------------------------------------------
DOC = "\\documentclass{a}\n\\begin{document}\n\\begin{tikzpicture}\n\\draw (0,0) -- (1,1);\n\\end{tikzpicture}\n\\end{document}"


@pytest.mark.parametrize(
    "text, state",
    [
        (DOC, 0), (DOC + "\nHope this helps \\begin{x}", 0), (DOC[:-3], 2), (DOC[:40], 2), (DOC.replace("\\end{document}", "% \\end{document}"), 2), (DOC.replace("\\end{document}", "\\% x \\end{document}"), 0),
        ("\\begin{tikzpicture}\\draw (0,0);\\end{tikzpicture}", 0), ("\\begin{tikzpicture}\\begin{scope}\\draw {;\\end{tikzpicture}", 0), ("\\begin{tikzpicture}\\draw (0,0);", 2), ("\\begin{tikzpicture}\n\\draw;\n\\end{tikz", 2),
        ("\\draw (0,0) -- (1,1);", 0), ("\\draw (0,0) -- (1,", 2), ("\\draw (0,0);\n\\dra", 2), ("\\draw (0,0);\nThat is all, thanks", 0), ("\\draw (0,0); [truncated]", 1), ("\\draw (0,0) [message clipped]", 2), ("\\draw (0,0);\n\\", 2),
        ("\\tikzset{a/.style={draw}}", 0), ("\\tikzset{a/.style={draw}", 2), ("\\tikzset{a}\n\\tikz", 2), ("\\definecolor{a}{rgb}", 2), ("\\definecolor{a}{rgb}{1}", 0), ("\\foreach \\x in {1,2}", 2), ("\\foreach \\x in {1,2}\n \\draw (\\x,0);", 0),
        ("\\documentclass", 2), ("% only a comment", 0), ("\\draw; \N{HORIZONTAL ELLIPSIS}", 1),
    ],
)
def test_endings(text, state):
    assert (truncation.ending(text) > 0) == (state > 0)
    assert state == 1 or truncation.ending(text) == state


def test_hazards(spark):
    r = random.Random(1)
    rows = [("a", r.randrange(100, 3000)) for _ in range(3000)] + [("a", 1500)] * 60 + [("b", 1500)] * 2 + [("b", r.randrange(1, 3000)) for _ in range(500)] + [(None, 7)]
    df = spark.createDataFrame(rows, "source string, length int")
    assert [(x.source, x.length) for x in truncation.limits(df).collect()] == [("a", 1500)]
    got = {(x.source, x.length): x for x in truncation.hazards(df).collect()}
    n, d = sum(s == "a" and v >= 1500 for s, v in rows), sum(s == "a" and v == 1500 for s, v in rows)
    assert got["a", 1500].at_risk == n and got["a", 1500].ends == d and got["a", 1500].hazard == pytest.approx(d / n)


def test_truncated(spark):
    rows = [(str(i), "s", "\\draw (0,0);\nthe text here" + "y" * 20 + " \\unknown") for i in range(60)] + [("c", "s", DOC[:-9]), ("n", None, None), ("e", "s", " "), ("w", None, DOC)]
    df = spark.createDataFrame(rows, "file_id string, source string, code string")
    found = {r.id: r.kind for r in truncation.truncated(df).collect()}
    assert found["c"] == "transfer" and not {"n", "e", "w"} & set(found)
    report = {r.source: r for r in truncation.truncation_report(df, truncation.truncated(df)).collect()}
    assert report["s"].n_rows == 62 and report["s"].n_filled == 61 and report[None].n_truncated == 0 and report[None].share == 0.0
    assert truncation.truncated(df.where("false")).count() == 0


def test_constructs(spark):
    r = random.Random(3)
    whole = ["\\begin{melpo}\n" + "".join(f"\\kresh{{{i}}} (0,{r.randrange(9)}) -- (1,1);\n" for i in range(6)) + "\\end{melpo}" for _ in range(60)]
    listed = ["".join(f"\\wolmir{{{i}}}\n" for i in range(r.randrange(1, 5))) for _ in range(60)]
    cut = ["\\begin{melpo}\n\\kresh{1} (0,0);\n", "\\kresh{1} (0,0);\n\\kresh{2} (0,", "\\kresh{1} (0,0);\n\\kre", "\\kresh{1} (0,0);\n\\kresh"]
    df = spark.createDataFrame([(f"w{i}", None, t) for i, t in enumerate(whole + listed)] + [(f"c{i}", None, t) for i, t in enumerate(cut)], "file_id string, source string, code string")
    for with_prior in (True, False):
        assert {x.id for x in truncation.truncated(df, with_prior=with_prior).collect()} == {f"c{i}" for i in range(4)}
    counted = truncation.walked(df).where("kind is not null")
    found = {(x.kind, x.name, x.step): x for x in truncation.construct_hazards(counted.select("kind", "name", "step", "visits", "stops"), with_prior=False).collect()}
    # every text of the list ends after a command with its argument; one text stops in the environment
    assert found["command", "wolmir", 1].stops == 60 and found["command", "wolmir", 1].p_value == 1.0 and found["environment", "melpo", 0].stops == 1
    known = {tuple(x) for x in truncation.unended(truncation.construct_hazards(counted.select("kind", "name", "step", "visits", "stops"), with_prior=False)).collect()}
    assert ("command", "kresh", 0) in known and ("beginning", "kre", 0) in known and ("command", "wolmir", 1) not in known


def test_prescribed_and_observed_constructs_find_the_same(spark, data):
    corpus = spark.read.parquet(f"{data}/corpus.parquet")
    by = [sorted(x.id for x in truncation.truncated(corpus, with_prior=p).collect()) for p in (True, False)]
    assert by[0] == by[1] and by[0]


def test_limits_beside_limits(spark):
    r = random.Random(2)
    rows = [("a", r.randrange(100, 3000)) for _ in range(3000)] + [("a", 2000)] * 90 + [("a", 1999)] * 12
    df = spark.createDataFrame(rows, "source string, length int")
    got = {x.length: x for x in truncation.hazards(df).collect()}
    assert {x.length for x in truncation.limits(df).collect()} == {1999, 2000} and got[1990].near_hazard < 0.002


# --- 3: leakage -----------------------------------------------------------------------------------------------------
def shared_items(train, test, span):
    inverse = defaultdict(set)
    for k, t in test:
        w = words(t)
        for i in range(len(w) - span + 1):
            inverse[tuple(w[i : i + span])].add(k)
    return {(k, g) for k, t in train for w in [words(t)] for i in range(len(w) - span + 1) for g in inverse.get(tuple(w[i : i + span]), ())}


@pytest.mark.parametrize("span, gram", [(6, 3), (5, 5), (7, 1), (9, 4)])
def test_leaks(spark, span, gram):
    r = random.Random(span)
    text = lambda n: [r.choice("abcd") for _ in range(n)]
    test = [(f"e{i}", " ".join(text(r.randrange(40)))) for i in range(20)]
    train = [(f"t{i}", " ".join(text(r.randrange(60)))) for i in range(40)] + [("long", " ".join(text(400))), ("empty", ""), ("null", None), ("rep", "a " * 50)]
    schema = "%s string, code string, figure string"
    a = spark.createDataFrame([(*x, "") for x in train] + [(None, "a b", ""), *[(*x, "") for x in train[:2]]], schema % "file_id")
    b = spark.createDataFrame([(*x, "") for x in test] + [("none", None, "")], schema % "figure_id")
    passage = (leakage.Passage("code", span, gram),)
    wanted = shared_items(train, test, span)
    for limit in (leakage.INDEX_BYTES, 200):
        assert {(x.id, x.item) for x in leakage.leaks(a, b, passages=passage, index_bytes=limit).collect()} == wanted
    found = leakage.leaks(a, b, passages=passage)
    assert leakage.leaks(a.where("false"), b, passages=passage).count() == 0 and leakage.leaks(a, b.where("false"), passages=passage).count() == 0
    one = next(x for x in found.collect())
    w, t = words(dict(train)[one.id])[one.at_word : one.at_word + one.span_words], words(dict(test)[one.item])
    assert any(t[i : i + len(w)] == w for i in range(len(t)))
    report = {x.figure_id: x.n_rows for x in leakage.leak_report(found, b).collect()}
    assert report == {k: len({i for i, g in wanted if g == k}) for k in [*dict(test), "none"]}


# --- 4: near-duplicates ---------------------------------------------------------------------------------------------
def jaccard_pairs(rows, threshold, k, least):
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, t in rows for w in [words(t)] if i and len(w) >= max(least, k)}
    return {(a, b) for (a, s), (b, t) in itertools.combinations(sorted(sets.items()), 2) if s and len(s & t) >= threshold * len(s | t) - 1e-9}


@pytest.mark.parametrize("seed, threshold, k, least", [(1, 0.7, 5, 40), (2, 0.7, 2, 1), (3, 0.5, 3, 1), (4, 0.8, 1, 1), (5, 0.4, 2, 1)])
def test_near_duplicates(spark, seed, threshold, k, least):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40 if least == 1 else 400)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice((3, 8, 20, 60, 130)))]
        for _ in range(r.randrange(1, 6)):
            copy = list(base)
            for _ in range(r.randrange(1 + len(copy) // 6)):
                at = r.randrange(len(copy))
                copy[at : at + r.randrange(2)] = r.choice(([], [r.choice(vocabulary)], copy[at : at + 1] * 2))
            texts.append(" ".join(copy))
    rows = [(f"{i:03}", t) for i, t in enumerate(texts)] + [("900", None), ("901", ""), ("902", texts[0].upper() + "!"), ("903", "a " * 300), ("904", "a " * 200)]
    df = spark.createDataFrame([(*x, 0) for x in rows] + [(None, texts[0], 0), (*rows[0], 1)], "file_id string, code string, id int")
    found = near_duplicates.NearDuplicates(df, shingle=k, threshold=threshold, min_words=least)
    got = [tuple(x) for x in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(rows, threshold, k, least)
    links = Counter(x for p in found.links.collect() for x in (p.rep_a, p.rep_b))
    for x in found.classes().collect():
        assert x.n_links == links[x.class_id]
    parent = {x.id: x.id for x in found.members.collect()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {x.id: x.group_id for x in found.groups().collect()} == {x: root(x) for x in parent}


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "file_id string, code string")
    found = near_duplicates.NearDuplicates(df)
    assert found.pairs().count() == found.classes().count() == found.groups().count() == 0


def test_sketch_bound():
    r = np.random.default_rng(5)
    for _ in range(50):
        universe = np.unique(r.integers(0, 1 << 48, 300, dtype=np.uint64))
        a, b = (np.sort(universe[r.random(len(universe)) < p]) for p in (0.6, 0.7))
        bits = near_duplicates.parity_bits(np.array([len(a), len(b)]), np.concatenate((a, b))).view(np.uint64).reshape(2, -1)
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= len(np.setxor1d(a, b))


def _met(sets, threshold, hot):
    size, tokens = np.array([len(x) for x in sets]), np.concatenate(sets)
    scale = near_duplicates._coarse(np.bincount(near_duplicates._slots(tokens, 1 << 16), minlength=1 << 16))
    held = defaultdict(set)
    for owner, mark, key in near_duplicates._sent(size, tokens, threshold, scale, hot):
        for o, m, k in zip(owner.tolist(), np.asarray(mark).tolist(), key.tolist()):
            held[k].add((o, bool(m)))
    return {(min(a, b), max(a, b)) for x in held.values() for (a, m), (b, n) in itertools.combinations(sorted(x), 2) if a != b and not (m and n)}


@pytest.mark.parametrize("threshold, hot, split", [(0.7, 255, 20_000), (0.7, 0, 20_000), (0.7, 12, 3), (0.5, 0, 3), (0.9, 20, 7)])
def test_hot_cells_lose_no_pair(monkeypatch, threshold, hot, split):
    monkeypatch.setattr(near_duplicates, "SPLIT", split)
    r = np.random.default_rng(int(threshold * 10) + hot)
    common, sets = r.integers(0, 1 << 48, 150), []
    for _ in range(120):
        base = np.concatenate((common[: r.integers(0, 150)], r.integers(0, 1 << 48, r.integers(5, 120))))
        for _ in range(r.integers(1, 3)):
            keep = base[r.random(len(base)) > r.choice([0, 0.02, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate((keep, r.integers(0, 1 << 48, r.integers(0, 6)), base[:1]))).astype(np.uint64))
    plain = [set(x.tolist()) for x in sets]
    wanted = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if plain[a] != plain[b] and len(plain[a] & plain[b]) >= threshold * len(plain[a] | plain[b])}
    assert wanted and wanted <= _met(sets, threshold, hot)


def test_common_parts_do_not_meet():
    met = []
    for n in (200, 400):
        r = np.random.default_rng(n)
        common = r.integers(0, 1 << 48, 140)
        met.append(len(_met([np.unique(np.concatenate((common, r.integers(0, 1 << 48, 60)))).astype(np.uint64) for _ in range(n)], 0.7, 30)))
    assert met[0] <= 200 and met[1] <= 400


# --- 5: packing -----------------------------------------------------------------------------------------------------
def test_pack():
    r = np.random.default_rng(1)
    for lengths in ([64], [16, 64], [8, 16, 32, 64]):
        sizes = r.integers(1, 65, 500)
        held, opened = packing.pack(sizes, lengths)
        assert sorted(itertools.chain(*held)) == sorted(sizes.tolist())
        assert all(sum(h) <= o and o == min(x for x in lengths if x >= sum(h)) for h, o in zip(held, opened))
        assert sizes.sum() / sum(opened) > 0.97
    assert packing.pack(np.zeros(0, np.int64), [8]) == ([], [])


def test_packing(spark):
    texts = ["word " * n for n in (1, 5, 5, 30, 200, 77)] + ["", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x"), (None, "a", "x")], "doc_id long, text string, container_id string")
    specs = spark.createDataFrame([(1, "s", 32), (2, "m", 128)], "spec_id int, spec_name string, capacity_tokens int")
    out = packing.packing(df, specs).collect()
    sizes = Counter()
    fill = Counter()
    for x in out:
        assert 0 < x.end_token - x.start_token <= x.container_tokens <= x.capacity_tokens
        fill[x.spec_id, x.container_id, x.container_tokens] += x.end_token - x.start_token
        sizes[x.spec_id, x.doc_id] += x.end_token - x.start_token
    assert all(v <= k[2] for k, v in fill.items())
    assert len({d for s, d in sizes if s == 1}) == 6 and all(sizes[1, d] == sizes[2, d] for s, d in sizes)
    assert not any(x.piece for x in out if sizes[x.spec_id, x.doc_id] <= x.capacity_tokens and x.doc_id != 1)
    assert {r.spec_id: r.n_tokens for r in packing.packing_report(packing.packing(df, specs)).collect()} == {s: sum(v for (a, _), v in sizes.items() if a == s) for s in (1, 2)}
    assert packing.packing(df.where("false"), specs).count() == 0
    with pytest.raises(ValueError):
        packing.packing(df, spark.createDataFrame([(1, 0)], "spec_id int, capacity_tokens int"))


# --- 6: mixing ------------------------------------------------------------------------------------------------------
def test_splitting():
    due = [7, 0, 100, 33]
    for shards in (1, 2, 5, 13):
        parts = [mixing.split_shares(due, shards, k, 3) for k in range(shards)]
        for s, n in enumerate(due):
            ranges = sorted((int(a[s]), int(b[s])) for a, b in parts if b[s] > a[s])
            assert [i for a, b in ranges for i in range(a, b)] == list(range(n))
        sizes = [int((b - a).sum()) for a, b in parts]
        assert max(sizes) - min(sizes) <= shards.bit_length() + 1


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, r.choice("aaabbc"), "w " * r.randrange(1, 60), 0) for i in range(600)] + [(900, "a", None, 0), (901, None, "x", 0), (902, "a", "", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, uses int")
    targets = spark.createDataFrame([(1, "a", 0.3, 4), (1, "b", 0.3, 4), (1, "c", 0.4, 4), (2, "a", 0.5, 1), (2, "gone", 0.5, 9)], "mix_id int, source string, target_share double, max_repeats int")
    mix = mixing.Mix(df, targets, shard_tokens=3000)
    usage, draws = mix.usage().collect(), mix.draws().collect()
    assert all(0 <= u.uses <= (4 if u.mix_id == 1 else 1) for u in usage)
    assert len([u for u in usage if u.mix_id == 1]) == 600
    assert Counter((x.mix_id, x.doc_id) for x in draws) == Counter({(u.mix_id, u.doc_id): u.uses for u in usage if u.uses})
    shares = {(x.mix_id, x.source): x for x in mix.shares().collect()}
    assert all(abs(shares[1, s].actual_share - t) < 0.01 for s, t in (("a", 0.3), ("b", 0.3), ("c", 0.4)))
    assert shares[1, "c"].most_uses == 4 and shares[2, "gone"].tokens == 0 and shares[2, "a"].actual_share == 1.0
    for key in {(x.mix_id, x.shard) for x in draws}:
        assert sorted(x.position for x in draws if (x.mix_id, x.shard) == key) == list(range(sum((x.mix_id, x.shard) == key for x in draws)))
    assert {(x.mix_id, x.shard, x.position, x.doc_id) for x in mixing.Mix(df.repartition(7), targets, shard_tokens=3000).draws().collect()} == {(x.mix_id, x.shard, x.position, x.doc_id) for x in draws}
    assert mixing.Mix(df.where("false"), targets).usage().count() == 0
    with pytest.raises(ValueError):
        mixing.Mix(df, targets.unionByName(targets))


# --- 7: residue -----------------------------------------------------------------------------------------------------
REAL = "The coordinate tergra is shared by 55 spheres, so moving it by 1.1 shifts the tensor too."
CASES = [
    ("404 Not Found", True), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", True), ("# Menu\n\nPlease enable JavaScript to view this drawing.\n\nRelated\n- One thing here", True),
    ("Title: {{ title }}\nSummary: {{ layout }}", True), ("<html><body><h1>Zugriff verweigert.</h1></body></html>", True), ("L\N{LATIN SMALL LETTER O WITH ACUTE}rem ips\N{LATIN SMALL LETTER U WITH ACUTE}m dolor sit amet.", True), ("\\title{Paper title}\n\\section{Heading 1}\nText text text.", True),
    ("This page is private.", True), ("ACCESS DENIED.\nPLEASE\N{NO-BREAK SPACE}SIGN IN.", True), (REAL, False), (REAL + " 404 Not Found", False), (f"404 Not Found is all that the melpo archive returned, so {REAL}", False), ("Enable JavaScript before viewing this page. " + REAL, False),
    ("Our script writes {{name}} into the file.\n\\draw (0,0);", False), ("", False), (None, False), ("Smooth grid", False),
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t, f"o{i}", 1) for i, (t, _) in enumerate(CASES)], "doc_id long, text string, origin string, id int")
    assert {r.id: r.residue for r in residue.residue(df).collect()} == {i: flag for i, (_, flag) in enumerate(CASES)}
    assert residue.residue(df.where("false")).count() == 0


def test_residue_recurring(spark):
    odd = "This exhibit sleeps, dear guest, until the keeper wakes it again."
    rows = [(i, f"Draw a {{{{a}}}} near {{{{b}}}}.\nThe end {i}", f"o{i}") for i in range(4)] + [(10, "Draw a wolmir near pelkas.\nUse {{a}} here.", "x"), (11, "Draw a wolmir near pelkas.", "y")]
    df = spark.createDataFrame(rows + [(20 + i, odd + " Oops!", None) for i in range(6)], "doc_id long, text string, origin string")
    got = {r.doc_id for r in residue.p7_found(df).collect()}
    assert {0, 1, 2, 3, 10} <= got and 11 not in got


def test_residue_masks_addresses_and_dates(spark):
    where = ["https://tikz.example.org/gallery/blue/arrow.html", "www.melpo.net/kresh", "ftp://files.example.org/a/wolmir.tex", "tikz.example.org/pelkas/green.html"]
    when = ["3 March 2024", "2 Juni", "August 1st, 2023", "2024-05-01T10:00:00Z"]
    odd = "Oops, dear guest: this exhibit at {} sleeps under its glossy wolmir blanket since {}. Write to {}@example.org."
    rows = [(i, odd.format(a, d, n), f"o{i}") for i, (a, d, n) in enumerate(zip(where, when, ("ann", "bo.b", "c-d", "eve")))]
    rows += [(10, f"404 Not Found: {where[0]}", "x"), (11, odd.format("the melpo", "the kresh", "ann"), "y"), (12, "404 Not Found is all that the melpo archive at https://a.example.org returned, so we redrew every sphere by hand.", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, origin string")
    assert {r.doc_id for r in residue.p7_found(df).collect()} == {0, 1, 2, 3, 10}
    parts = [f"The sphere of {m} sleeps" for m in ("March", "Juillet", "\N{ARABIC-INDIC DIGIT THREE}", "\N{ARABIC-INDIC DIGIT FOUR}")]
    assert len(set(residue.hashes_of(parts).tolist())) == 1


def test_residue_whatever_else_there_is(spark):
    held = "The caption of the melpo drawing shown on {{place}} was written by the keeper of kresh."
    odd = "Oops, dear guest: this exhibit sleeps under its glossy wolmir blanket until the keeper of kresh wakes it."
    rows = [(i, held, f"o{i}") for i in (1, 2)] + [(i, odd, f"o{i}") for i in (3, 4, 5, 6)] + [(7, held.replace("{{place}}", "a hill") + "\nUse {{a}} here.", "o7"), (8, held.replace("melpo", "tergra"), "o8")]
    # templates that hold no whole word, and words beside a placeholder
    rows += [(i, "Insert the title here: {{a}}\n{{a}}melpo kresh{{b}}", f"o{i}") for i in (11, 12)] + [(13, "The title is {{a}}.\nMy melpo kresh, seen from afar, is what this blue drawing wants to show.", "o13")]
    df = spark.createDataFrame(rows, "doc_id long, text string, origin string")
    wanted = {1, 2, 3, 4, 5, 6, 7, 11, 12, 13}
    assert {r.doc_id for r in residue.p7_found(df).collect()} == wanted
    others = spark.range(100, 300_100).selectExpr("id as doc_id", "concat('Sphere ', id) as text", "concat('other', id) as origin")
    assert {r.doc_id for r in residue.p7_found(df.unionByName(others)).collect()} == wanted


def test_template_keys():
    b = residue.BLANK
    assert residue.template_key(f"draw a {b} near {b}s.") == "near" and residue.template_key(f"{b}melpo kresh{b}") == "" and residue.template_key("a bc") == "bc"


PREAMBLE = "\\documentclass{article}\n\\usepackage{tikz}\n\\newcommand{\\half}[1]{\\frac{#1}{2}}\n\\def\\R{\\mathcal{R}}\n\\definecolor{melpo}{RGB}{1,2,3}\n\\tikzset{\n  block/.style={rectangle, draw, fill=blue!20, text width=5em, text centered, rounded corners, minimum height=4em},\n  line/.style={draw, -latex}\n}\n\\pgfplotsset{compat=1.18}\n\\begin{document}\n"
BODIES = [
    ("\\title{Paper title}\n\\section{Heading 1}\nText text text.", True), ("\\lipsum[1-4]", True), ("\\section{Results} \\lipsum[1]\\lipsum[2]", True), ("Lorem ipsum dolor sit amet.", True), (REAL, False), (REAL + "\n\\lipsum[1]", False), ("\\lipsum[1] " + REAL, False),
    ("\\title{Paper title}\n\\draw (0,0) -- (1,1);", False), ("Text text text.\n$\\frac{1}{2}$", False), ("\\newcommand{\\pic}{\\draw (0,0);}\n\\pic\nText text text.", False), ("\\section{Heading}", False), ("\\lipsum[1]\n\\newcommand{\\a}{" + REAL, False),
]


def test_residue_behind_a_preamble(spark):
    df = spark.createDataFrame([(i, PREAMBLE + body + "\n\\end{document}", f"o{i}") for i, (body, _) in enumerate(BODIES)], "doc_id long, text string, origin string")
    assert {r.id: r.residue for r in residue.residue(df).collect()} == {i: flag for i, (_, flag) in enumerate(BODIES)}
    held = "The caption of the melpo drawing shown on {{place}} was written by the keeper of kresh."
    df = spark.createDataFrame([(i, PREAMBLE + held, f"o{i}") for i in (1, 2)], "doc_id long, text string, origin string")
    assert {r.doc_id for r in residue.p7_found(df).collect()} == {1, 2}


def test_residue_classes(spark):
    rows = [(i, f"Oops, dear guest {i}: this exhibit sleeps.", f"o{i}") for i in range(5)] + [(9, "Oops, dear friend: that exhibit wakes.", "o9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, origin string")
    asked = spark.createDataFrame([(int(h), residue.masked(t)) for (_, t, _), h in zip(rows, residue.hashes_of([r[1] for r in rows]).view(np.int64))], "hash long, form string")
    got = {r.form: r.kind for r in residue.classes(asked, residue.recurring(df)).collect()}
    # one group of five messages that differ in a number, and one message that stands alone
    assert got == {"Oops, dear guest 0: this exhibit sleeps.": residue.RESIDUE, "Oops, dear friend: that exhibit wakes.": residue.CONTENT}
    none = residue.classes(asked, residue.recurring(df.where("false")))
    assert {r.kind for r in none.collect()} == {residue.CONTENT}
    assert residue.masked("404 Not Found on 3 March 2024: https://a.example/b 17") == "404 Not Found on 0: 0 0"


def test_residue_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "404 Not Found", "a"), (1, "404 Not Found", "a"), (None, "404 Not Found", None), (2, None, "b")], "doc_id long, text string, origin string")
    assert sorted((r.id or 0, r.residue) for r in residue.residue(df).collect()) == [(0, True), (1, True), (1, True), (2, False)]


@pytest.mark.parametrize("sizes, cut, wanted", [([5, 4, 3], 7, 8), ([5, 4, 3], 8, 8), ([9, 9], 3, 0), ([9, 9], 5, 9), ([4, 4, 4], 12, 12), ([10, 6, 5], 11, 10)])
def test_mixing_fits_the_last_block(sizes, cut, wanted):
    import pandas as pd

    block = pd.DataFrame({"n_tokens": sizes, "order": range(len(sizes)), "item": range(len(sizes)), "cut": cut})
    assert mixing._fitted(block)["n_tokens"].sum() == wanted


def test_mixing_divides_shards_of_large_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, "ab" if i % 3 else "c", "word " * (5 + i % 7)) for i in range(4000)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([(1, "ab", 0.5, 2), (1, "c", 0.5, 2)], "mix_id int, source string, target_share double, max_repeats int")
    whole = mixing.Mix(df, targets, shard_tokens=2000).draws().collect()
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 16)
    divided = mixing.Mix(df, targets, shard_tokens=2000)
    draws = divided.draws().collect()
    sizes = Counter()
    for x in draws:
        sizes[x.shard] += x.n_tokens
    assert len(sizes) >= 10 and max(sizes.values()) < 4 * sum(sizes.values()) / len(sizes)
    assert abs(sum(x.n_tokens for x in draws) - sum(x.n_tokens for x in whole)) < 50
    for key in sizes:
        assert sorted(x.position for x in draws if x.shard == key) == list(range(sum(x.shard == key for x in draws)))
    used = {(x.doc_id): x.uses for x in divided.usage().collect()}
    assert Counter(x.doc_id for x in draws) == {k: v for k, v in used.items() if v}


def test_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(FD, "SALT_ROWS", 5)
    rows = [(f"a{i:03d}", "Word " * 40 + "." * i, "Cap") for i in range(60)] + [(f"b{i}", "other " * 41, None) for i in range(3)] + [("c", "alone " * 50, "x")] + [(f"n{i}", None, None) for i in range(9)]
    df = spark.createDataFrame(rows, "file_id string, code string, caption string")
    wanted = {("a000", f"a{i:03d}") for i in range(1, 60)} | {("b0", f"b{i}") for i in (1, 2)}
    assert {tuple(r) for r in FD.p1_found(df).collect()} == wanted
    assert {(r.rep, r.copies) for r in FD.collapsed(FD.copies(df, min_words=0)).collect()} == {("a000", 60), ("b0", 3), ("c", 1), ("n0", 9)}
