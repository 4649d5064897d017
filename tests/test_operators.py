from __future__ import annotations

import difflib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.functions import sequences as Q
from inkmill.operators import assembly as A
from inkmill.operators import dedup as D
from inkmill.operators import metrics as M
from inkmill.operators import relational as R
from inkmill.operators import sampling as O
from inkmill.plans import curated_pairs, evaluation


def test_sources():
    assert R.parse_sources("arxiv_tex") == ["arxiv", "tex"]
    with pytest.raises(ValueError, match="foo"):
        R.parse_sources("arxiv_foo")


def test_texts(spark):
    df = spark.createDataFrame([("1", "a ", " ", ["m", "n"]), ("2", None, None, None), ("3", "c", "d", [])], "id string, caption string, new_caption string, text_mentions array<string>")
    both = {(r.id, r.text) for r in R.with_texts(df, "caption_and_new_caption").collect()}
    assert both == {("1", "a"), ("3", "c"), ("3", "d")}
    assert [r.text for r in R.with_texts(df, "caption").orderBy("id").collect()] == ["a ", "c"]
    assert [r.text for r in R.with_texts(df, "caption_text_mentions").orderBy("id").collect()] == ["a  m n", "c"]
    with pytest.raises(ValueError):
        R.with_texts(df, "other")


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("a", "z"), ("a", "y"), (None, "q")], "k string, v string")
    assert {(r.x, r.v) for r in R.left_first(left, "k", right, "k", ["v"], ["v"]).collect()} == {(1, "y"), (2, None), (3, None)}
    assert {r.x for r in R.not_in_reference(left, F.col("k"), right, F.col("k")).collect()} == {2, 3}
    assert {r.x for r in R.without_prefixes(spark.createDataFrame([("abc", 1), ("xbc", 2)], "k string, x int"), "k", spark.createDataFrame([("ab",), (None,), ("",)], "p string"), "p").collect()} == {2}
    assert {r.x for r in R.without_substrings(left.where("k is not null"), "k", spark.createDataFrame([("b",)], "p string"), "p").collect()} == {1}
    assert R.without_prefixes(left, "k", right.where("false"), "v").count() == 3
    done = R.merge_results(spark.createDataFrame([("a", "old"), ("b", "old")], "file_id string, status_new string"), spark.createDataFrame([("a", "success", "l")], "file_id string, status string, log string"))
    assert {(r.file_id, r.status_new, r.log_new) for r in done.collect()} == {("a", "success", "l"), ("b", "old", None)}
    spans = R.containing_spans(spark.createDataFrame([(1, 5, 9), (1, 50, 60)], "d int, start int, end int"), spark.createDataFrame([(1, 0, 10), (1, 4, 20), (2, 0, 99)], "d int, start int, end int"), "d")
    assert {(r.start, r.outer_start) for r in spans.collect()} == {(5, 0), (50, None)}
    files = spark.createDataFrame([("p", str(i), i in (1, 2)) for i in range(5)], "proj string, path string, failed boolean")
    assert {r.path for r in R.failure_budget(files, "proj", "path", "failed", 1).collect()} == {"0"}
    assert R.failure_budget(files, "proj", "path", "failed", 1, keep_before=False).count() == 0


def test_dedup(spark):
    df = spark.createDataFrame([("f", "2", "x"), ("f", "1", "x"), ("g", "3", "x"), ("g", "4", "r"), ("g", "5", None), ("g", "6", None)], "file string, file_id string, code string")
    ref = spark.createDataFrame([("r",), (None,)], "code string")
    assert {r.file_id for r in D.dedup_exact(df, reference=ref).collect()} == {"1", "5"}
    assert {r.file_id for r in D.dedup_exact(df, reference=ref, scope="file").collect()} == {"1", "3", "5"}
    once = D.dedup_exact(df)
    assert {tuple(r) for r in D.dedup_exact(once).collect()} == {tuple(r) for r in once.collect()}
    assert D.dedup_exact(df.where("false")).count() == 0


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_similar_pairs(spark, threshold):
    r = random.Random(int(threshold * 100))
    words = ["alpha", "beta", "gamma", "delta", "node", "draw"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 14))) for _ in range(50)]
    for t in texts[:30]:
        k = r.randrange(len(t))
        texts.append(t[:k] + r.choice(["", "x", "yy "]) + t[k + r.randrange(3) :])
    rows = [(f"{i:03}", t) for i, t in enumerate(texts)] + [("900", ""), ("901", None), ("902", "a"), ("903", "a")]
    wanted = {(b, a) for (a, s), (b, t) in itertools.combinations([x for x in rows if x[1]], 2) if difflib.SequenceMatcher(None, t, s).ratio() > threshold}
    df = spark.createDataFrame(rows, "id string, t string")
    assert {(x.new_id, x.old_id) for x in D.similar_pairs(df, "id", "t", threshold).collect()} == wanted
    kept = []
    for i, t in sorted(rows):
        if not t or not any((i, j) in wanted for j in kept):
            kept.append(i)
    assert sorted(x.id for x in D.greedy_near_dedup(df, "id", "t", threshold).collect()) == kept


def test_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit(1))).alias("m"))
    for parts in (1, 5):
        assert all(r.k == r.rank for r in O.ranked(df.repartition(parts), ["k"]).collect())
    a, b = (sorted(r.k for r in O.sample(df.repartition(p), "k", 3, n=50).collect()) for p in (2, 7))
    assert a == b and len(a) == 50 and O.sample(df, "k", 3, fraction=0.1234).count() == 123 and O.sample(df, "k", 3, fraction=1.0).count() == 1000
    assert O.sample(df.where("false"), "k", 3, n=5).count() == 0
    sizes = [r["count"] for r in O.sharded(df.limit(23), ["k"], 5, contiguous=True).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [5, 5, 5, 4, 4]
    assert O.sharded(df.limit(3), ["k"], 5, contiguous=True).select("shard").distinct().count() == 3


def test_assembly(spark):
    rows = [
        (1, 1, None, 3, 2, 5, "t", "q"), (1, 1, None, 3, 2, 5, "t", "q"), (2, 2, 1, None, None, 1, None, "a"), (3, 2, 1, None, None, None, None, "b"),
        (4, 1, None, None, 2, 0, "u", "q"), (5, 2, 4, None, None, 1, None, "a"), (6, 2, 99, None, None, 1, None, "a"), (7, 1, None, None, 0, 1, "z", "q"), (8, 1, None, None, 1, 1, "n", None), (9, 2, 8, None, None, 1, None, "a"),
    ]
    posts = spark.createDataFrame(rows, "id long, posttypeid int, parentid long, acceptedanswerid long, answercount int, score int, title string, body string").withColumns({"tags": F.lit("<a><b>"), "creationdate": F.lit("2020-01-01").cast("timestamp")})
    out = A.assemble(posts).collect()
    assert [(r.question_id, [x.answer_id for x in r.answers]) for r in out] == [(1, [2, 3])]
    assert A.assemble(posts, ["a", "c"]).count() == 0
    assert A.assemble(posts, min_score=1).count() == 1  # the accepted answer counts whatever its score


def test_reports(spark):
    df = spark.createDataFrame([(0.5, True), (1.0, True), (None, None), (0.9, False)], "s double, ok boolean")
    r = A.mean_report(df, ["s"], ~F.coalesce("ok", F.lit(False))).first()
    assert r.n == 4 and r.s_mean == pytest.approx(0.375) and r.s_std == pytest.approx(np.std([0.5, 1, 0, 0]))
    assert df.select(A.compile_rate(F.col("ok"))).first()[0] == 0.5
    w = spark.createDataFrame([("d", i, f"s{i}") for i in range(5)], "d string, i int, t string")
    assert [r.context for r in A.context_frames(w, ["d"], "i", "t").orderBy("i").collect()][1] == "s0 s1 s2 s3 s4"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(M.cosine("a", "b")).collect()] == [0.0, 1.0, 0.0, None]
    assert [r[0] for r in df.select(M.cosine_reward("a", "b")).collect()] == [0.5, 1.0, 0.5, 0.0]
    g = spark.range(1).select(M.padded_geometry(F.lit(896.0), F.lit(448.0)).alias("g"), M.concat_patches(F.array(*(F.array(F.lit(float(i))) for i in range(7)))).alias("c"), M.mean_pool(F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0)))).alias("m")).first()
    assert tuple(g.g) == (448, 224, 0, 112) and g.c == [[0, 1, 2], [3, 4, 5]] and g.m == [2.0]


def test_transport():
    r = np.random.default_rng(1)
    for n in (1, 2, 4, 5):
        cost = r.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert M.assignment_cost(cost) == pytest.approx(best)
    assert M.patch_score([[1, 0], [0, 1]], [[0, 2], [3, 0]]) == pytest.approx(1.0)
    assert M.patch_score([], [[1.0]]) == 0.0 and M.patch_score(None, None) == 0.0
    assert M.transport_cost(np.array([[0.0, 1.0]])) == pytest.approx(0.5)


def plain_distance(h, r, alpha=0.5, rho=1.5):
    row, visits = [0.0] + [1.0] * len(h), [-1] * (len(h) + 1)
    for c in r:
        nxt = [row[0] + 1.0]
        for i in range(1, len(h) + 1):
            nxt.append(min(nxt[i - 1] + 1.0, row[i - 1] + (h[i - 1] != c), row[i] + 1.0))
        low = min(range(len(nxt)), key=nxt.__getitem__)
        visits[low] += 1
        if c == " ":
            nxt = [min(x, alpha + nxt[low]) for x in nxt]
        row = nxt
    cover = rho * sum(v if v >= 0 else 1 for v in visits)
    return min(1.0, (row[-1] + cover) / (len(r) + cover))


def test_edit_distance():
    r = random.Random(2)
    for _ in range(40):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randrange(1, 20))) for _ in range(2))
        assert M.extended_edit_distance(a, b) == pytest.approx(plain_distance(a, b))
    assert M.extended_edit_distance("", "") <= 1.0


def test_bleu(spark):
    tokens = "a b c d e f g".split()
    df = spark.createDataFrame([(tokens, tokens)], "h array<string>, r array<string>")
    none = spark.createDataFrame([], "ngram string, n long")
    assert M.crystal_bleu(df, "h", "r", none).first()["crystal_bleu"] == pytest.approx(1.0)
    trivial = M.trivial_ngrams(spark.createDataFrame([(["a", "a", "b"],)], "t array<string>"), "t", 2)
    assert [(r.ngram, r.n) for r in trivial.collect()] == [("a", 2), ("a a", 1)]
    assert M.crystal_bleu(df.where("false"), "h", "r", none).first()["crystal_bleu"] == 0.0
    half = spark.createDataFrame([("a b c d".split(), "a b c d e f g h".split())], "h array<string>, r array<string>")
    row = M.bleu_counts(half.withColumn("k", F.lit(1)), "k", "h", "r").first()
    assert (row.m1, row.t1, row.m4, row.t4) == (4, 4, 1, 1) and M.bleu_of(row) == pytest.approx(np.exp(1 - 8 / 4))


def test_top_pairs(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "id long, v array<double>")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = sorted(((-round(float(n[i] @ n[j]), 5), i, j) for i, j in itertools.combinations(range(60), 2)))[:10]
    got = [(-x.similarity, x.a, x.b) for x in M.top_pairs(df, "id", "v", 10).collect()]
    assert [g[1:] for g in got] == [w[1:] for w in want] and [g[0] for g in got] == pytest.approx([w[0] for w in want])


def test_pairs_plan(spark):
    corpus = spark.createDataFrame([("1", "tex", "success", 200, "c1", "cap", None, None), ("2", "tex", "success", 200, "c1", "cap", None, None), ("3", "tex", "error", 200, "c3", "x", "y", None), ("4", "arxiv", "success", 200, "ref", "x", "y", None), ("5", "arxiv", "success", 50, "c5", "x", "y", None)], "file_id string, source string, status string, code_length int, code string, caption string, new_caption string, text_mentions array<string>")
    captions = spark.createDataFrame([("1", "late b"), ("1", "late a"), ("1", " ")], "file_id string, new_caption string")
    rows = curated_pairs.build_pairs(corpus, captions=captions, reference=spark.createDataFrame([("ref",)], "code string"), shards=2).collect()
    assert {(r.file_id, r.text) for r in rows} == {("1", "cap"), ("1", "late a")} and {r.shard for r in rows} == {0, 1}


def test_evaluation(spark):
    gt = spark.createDataFrame([("a", "\\documentclass{x}\\begin{tikzpicture}\\draw;\\end{tikzpicture}", "d"), ("b", "code", "e")], "figure_id string, code string, new_caption string")
    pred = spark.createDataFrame([("a", "Sure \\documentclass{x}\\begin{tikzpicture}\\draw;\\end{tikzpicture}\\end{document} bye", True)], "figure_id string, tikz_pred string, compiled boolean")
    rows = {r.figure_id: r for r in evaluation.score_predictions(gt, pred).collect()}
    assert rows["a"].compiled and rows["a"].tex_edit_distance < 0.3 and not rows["b"].compiled and rows["b"].tex_edit_distance == 1.0
    assert evaluation.report(evaluation.score_predictions(gt, pred)).first()["compile_rate"] == 0.5


def test_transport_of_unequal_bags():
    r = np.random.default_rng(1)
    for a, b in ((1, 5), (3, 4), (4, 6), (5, 2), (7, 12), (6, 4)):
        for cost in (r.random((a, b)), r.integers(0, 3, (a, b)).astype(float)):
            each = int(np.lcm(a, b))
            repeated = np.repeat(np.repeat(cost, each // a, axis=0), each // b, axis=1)
            assert M.transport_cost(cost) == pytest.approx(M.assignment_cost(repeated) / each)
    big = r.random((40, 41))
    assert M.transport_cost(big) == pytest.approx(M.transport_cost(big.T))


def test_running_sums(spark):
    df = spark.createDataFrame([([1, 0, 2, None],), ([],), (None,), ([5],)], "x array<int>")
    assert [r[0] for r in df.select(Q.running_sums(F.col("x"))).collect()] == [[1, 1, 3, 3], [], None, [5]]
    long = spark.range(3).select(F.array_repeat(F.lit(1), 100_000).alias("m"))
    assert [r[0] for r in long.select(Q.position_ids("m")[99_999]).collect()] == [99_999] * 3


def test_bpe_count(spark, tmp_path):
    import base64

    ranks = [bytes([i]) for i in range(256)] + [b"ab", b" c", b"abab"]
    (tmp_path / "own.tiktoken").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(ranks)))
    df = spark.createDataFrame([("abab cab",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(Q.bpe_count("t", "own.tiktoken", str(tmp_path))).collect()] == [3, 0, 0]


def test_rotation():
    from inkmill.sources.harvest import RateLimited, Rotation

    now, slept, left = [0.0], [], {"a": 2, "b": 1}

    def fetch(token, credential):
        if not left[credential]:
            left[credential] = 1
            raise RateLimited(5.0 if credential == "a" else 9.0)
        left[credential] -= 1
        return credential + token

    turn = Rotation(["a", "b"], lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    assert [turn.call(fetch, t) for t in "1234"] == ["a1", "a2", "b3", "a4"] and slept == [5.0]
    with pytest.raises(ValueError):
        Rotation([])


def test_archives_as_a_sink(spark, tmp_path):
    from inkmill.sources.archives import read_archives, write_archives

    rows = [("x", f"m{i:02d}.tex", bytes([i]) * 1000) for i in range(30)] + [("y", "a.md", b""), ("y", None, b"z"), (None, "n", b"z")]
    df = spark.createDataFrame(rows, "archive string, member string, content binary")
    for kind in ("tar", "tar.gz", "tar.xz", "zip"):
        written = write_archives(df, f"{tmp_path}/{kind}", kind, volume_bytes=10_000, places=2).collect()
        assert sum(r.members for r in written) == 31 and len(written) >= 5
        back = read_archives(spark, f"{tmp_path}/{kind}", "*." + kind.split(".")[-1]).where("error is null").collect()
        assert sorted((r.member, bytes(r.content)) for r in back) == sorted((m, c) for a, m, c in rows if a and m)
    assert write_archives(df.where("false"), f"{tmp_path}/none").count() == 0


def test_xz_lines_and_arrays(spark, tmp_path):
    from inkmill.sources.files import read_json_arrays, read_xz_lines
    from inkmill.sources.sinks import write_json_arrays, write_xz_lines

    df = spark.createDataFrame([(i, "\u00e9\n" * (i % 3)) for i in range(25)], "id long, text string")
    assert sum(r.records for r in write_xz_lines(df, f"{tmp_path}/xz", 10).collect()) == 25
    assert sorted(map(tuple, read_xz_lines(spark, f"{tmp_path}/xz", "id long, text string").collect())) == sorted(map(tuple, df.collect()))
    write_json_arrays(df, f"{tmp_path}/arrays", 7)
    assert sorted(map(tuple, read_json_arrays(spark, f"{tmp_path}/arrays", "id long, text string", "*.txt").collect())) == sorted(map(tuple, df.collect()))


def test_substrings_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_ROWS", 2)
    df = spark.createDataFrame([("abc",), ("xbz",), ("",), (None,), ("qq",)], "t string")
    parts = spark.createDataFrame([("bc",), ("z",), ("",), (None,), ("zz",), ("qqq",)], "p string")
    assert sorted(r.t or "-" for r in R.without_substrings(df, "t", parts, "p").collect()) == ["-", "-", "qq"]


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_running(spark, parts):
    r = random.Random(int(parts))
    # one key holds most rows, so that its ranges are many
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, 1, 2]), r.choice([None, None, f"v{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, x int, v string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = O.running(df, ["k"], ["i"], {"s": F.coalesce("x", F.lit(0))}, {"l": F.col("v")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sums, lasts, wanted = {}, {}, set()
    for k, i, x, v in rows:
        sums[k] = sums.get(k, 0) + (x or 0)
        wanted.add((k, i, x, v, sums[k], lasts.get(k)))
        lasts[k] = v if v is not None else lasts.get(k)
    assert {(x.k, x.i, x.x, x.v, x.s, x.l) for x in got} == wanted and len(got) == 400
    assert O.running(df.where("false"), ["k"], ["i"], {"s": F.lit(1)}).count() == 0


def test_split_13a():
    assert M.split_13a("a-b, 1.5 (x). \\draw[red] 3,000 5-6 &quot;q&quot;.") == ["a-b", ",", "1.5", "(", "x", ")", ".", "\\", "draw", "[", "red", "]", "3,000", "5", "-", "6", '"', "q", '"', "."]


def test_split_13a_by_tokens():
    r = random.Random(4)
    for _ in range(300):
        tokens = ["".join(r.choice("ab1 .,-&;<{\\") for _ in range(r.randrange(1, 6))) for _ in range(8)]
        assert M.split_13a(" ".join(tokens)) == [s for t in tokens for s in M._split_13a(t)]


def test_legacy_figures(spark):
    from inkmill.functions import extraction as X

    picture = "  \\begin{tikzpicture}\n\\draw;\n\\end{tikzpicture}"
    texts = ["\\begin{figure}\n" + picture + "\\caption[s]{A {b} c}\\label{f}\\end{figure}", "\\begin{figure}" + picture * 2 + "\\caption{x}\\end{figure}", "none", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted((x.i, x.prefix, x.caption, x.label) for x in X.legacy_figures(df, "i", "t").collect())
    assert got == [(0, "  ", "", ""), (0, "  ", "A {b} c", "f"), (1, "  ", "", ""), (1, "\\begin{figure}  ", "", "")]


def test_png_filters():
    import struct
    import zlib

    from inkmill.functions import images as I

    r = np.random.default_rng(2)
    for channels in (1, 2, 3, 4):
        pixels = r.integers(0, 256, (9, 7, channels)).astype(np.uint8)
        assert (I.decode_png(I.encode_png(pixels)) == pixels).all()
        # the same image with each kind of filter in turn, by the definitions
        flat = pixels.reshape(9, -1).astype(int)
        lines = []
        for y in range(9):
            left = np.concatenate((np.zeros(channels, int), flat[y, :-channels]))
            above = flat[y - 1] if y else np.zeros_like(left)
            corner = np.concatenate((np.zeros(channels, int), above[:-channels]))
            reach = left + above - corner
            paeth = np.where((abs(reach - left) <= abs(reach - above)) & (abs(reach - left) <= abs(reach - corner)), left, np.where(abs(reach - above) <= abs(reach - corner), above, corner))
            guess = [0 * left, left, above, (left + above) // 2, paeth][y % 5]
            lines.append(bytes([y % 5]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes())
        whole = I.encode_png(pixels)
        at = whole.index(b"IDAT") - 4
        data = zlib.compress(b"".join(lines))
        made = whole[:at] + struct.pack(">I", len(data)) + b"IDAT" + data + b"\0\0\0\0" + whole[-12:]
        assert (I.decode_png(made) == pixels).all()
    for bad in (b"", b"no", whole[:30], whole[:-20].replace(b"IDAT", b"IDAX")):
        with pytest.raises(I.ImageError):
            I.decode_png(bad)


def test_single_colour(spark):
    from inkmill.functions import images as I

    white, clear = np.full((4, 4, 3), 255, np.uint8), np.zeros((4, 4, 4), np.uint8)
    dot = clear.copy()
    dot[1, 2] = (9, 9, 9, 255)
    df = spark.createDataFrame([(0, I.encode_png(white)), (1, I.encode_png(clear)), (2, I.encode_png(dot)), (3, b"x"), (4, None)], "i int, png binary")
    got = {r.i: (r.e, r.b) for r in df.select("i", I.is_single_colour("png").alias("e"), I.content_box("png").alias("b")).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (False, [2, 1, 3, 2]), 3: (None, None), 4: (None, None)}


def test_landed_files(spark, tmp_path):
    from inkmill import boundary as B

    (tmp_path / "a").write_bytes(b"12345")
    df = spark.createDataFrame([(f"{tmp_path}/a", "x/a"), (f"{tmp_path}/b", "b")], "address string, name string")
    for _ in range(2):
        got = {r.address[-1]: (r.bytes, r.error is None) for r in B.landed_files(df, "address", "name", f"file://{tmp_path}/out", retries=2).collect()}
        assert got == {"a": (5, True), "b": (None, False)} and (tmp_path / "out/x/a").read_bytes() == b"12345"
        (tmp_path / "a").write_bytes(b"changed later")


def test_trimmed_posts(spark):
    df = spark.createDataFrame([(1, 1, "q", 9), (2, 2, "a", 8)], "id int, posttypeid int, body string, score int")
    assert A.trimmed_posts(df, "question").collect() == [(1, "q", 0)] and A.trimmed_posts(df, "answer").collect() == [(2, "a", 8)]
    with pytest.raises(ValueError):
        A.trimmed_posts(df, "comment")
