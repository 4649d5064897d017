from __future__ import annotations

import gzip
import io
import json
import tarfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkmill import boundary
from inkmill.sources import archives, files, harvest, sinks
from inkmill.streaming import assembly as S


def tar_of(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_json(spark, tmp_path):
    d = tmp_path / "j"
    d.mkdir()
    (d / "all_1.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2}]))
    (d / "all_2.json").write_text("[{broken")
    (d / "other.json").write_text("[]")
    assert files.read_json_arrays(spark, str(d), "a int, b string", "all_*.json", skip_broken=True).count() == 2
    with pytest.raises(Exception):
        files.read_json_arrays(spark, str(d), "a int", "all_*.json").collect()
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 3}\n')
    path = str(tmp_path / "l.jsonl")
    assert files.read_json_lines(spark, path, "a int", skip_broken=True).count() == 2
    assert files.read_json_lines(spark, path, "a int", keep_broken=True).toPandas()["_corrupt_record"].notna().sum() == 1
    (tmp_path / "m.json").write_text('{"k": {"v": 1}, "l": {"v": 2}}')
    assert {tuple(r) for r in files.read_json_map(spark, str(tmp_path / "m.json"), "v int").collect()} == {("k", 1), ("l", 2)}
    (tmp_path / "s.json").write_text('["a", "b", "a"]')
    assert files.read_json_set(spark, str(tmp_path / "s.json")).count() == 2


def test_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<posts><row Id="1" PostTypeId="1" Title="a &amp; b"/><row Id="2" PostTypeId="2" ParentId="1"/></posts>')
    rows = files.read_xml_rows(spark, str(tmp_path / "p.xml"), "Id bigint, PostTypeId int, ParentId bigint, Title string").orderBy("id").collect()
    assert [(r.id, r.posttypeid, r.parentid, r.title) for r in rows] == [(1, 1, None, "a & b"), (2, 2, 1, None)]
    records = spark.createDataFrame([("<id>2101.1</id><created>2021-02-03</created>",), ("<id>x</id><created>never</created>",), ("",)], "x string")
    assert [(r.arxiv_id, str(r.created)) for r in files.harvest_records(records, "x").collect()] == [("2101.1", "2021-02-03"), (None, "None"), (None, "None")]
    assert [(str(r.start_date), str(r.end_date)) for r in files.month_ranges(spark, "2024-01-01", "2024-03-01").limit(2).collect()] == [("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-29")]


def test_texts(spark, tmp_path):
    for name, text in (("a/x.tex", "\\documentclass{a}"), ("a/y.tex", "y"), ("b/z.tex", "z"), ("a/x_description.txt", "about"), ("a/x.yml", "title: T")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    tex = files.read_texts(spark, str(tmp_path))
    assert tex.count() == 3
    side = files.with_sidecar(tex, files.read_texts(spark, str(tmp_path), "*.txt"), "about", "_description", optional=True)
    assert {(r.stem, r.about) for r in side.collect()} == {("x", "about"), ("y", ""), ("z", "")}
    assert files.with_sidecar(tex, files.read_texts(spark, str(tmp_path), "*.yml"), "yml").count() == 1
    assert {r.stem for r in files.first_per_folder(tex).collect()} == {"x", "z"}
    roots = spark.createDataFrame([("p", "a.tex", "no class"), ("p", "b.tex", "\\documentclass{x}"), ("q", "c.tex", "none"), ("q", "d.tex", " ")], "project string, path string, text string")
    assert {(r.project, r.path) for r in files.root_files(roots, "project", "path", "text").collect()} == {("p", "b.tex"), ("q", "c.tex")}
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),)], "b binary")
    assert [r[0] for r in raw.select(files.decoded("b")).collect()] == ["é", "é"]
    (tmp_path / "ranks").write_text("YQ== 0\nYmM= 1\n")
    assert {(bytes(r.token), r["rank"]) for r in files.read_ranks(spark, str(tmp_path / "ranks")).collect()} == {(b"a", 0), (b"bc", 1)}
    (tmp_path / "conf").write_text("a, b\nc,d\n")
    assert files.read_config_line(spark, str(tmp_path / "conf"), 2, ["x", "y"]) == {"x": "c", "y": "d"}
    names = spark.createDataFrame([("arXiv_src_2101_001.tar",), ("arXiv_src_9912_001.tar",), ("arXiv_pdf_2101.tar",), ("arXiv_src_2102_bad.tar",)], "n string")
    got = files.archive_names(names, "n", spark.createDataFrame([("bad",)], "p string"), spark.createDataFrame([("none",)], "p string"))
    assert [(r.n, r.month.year) for r in got.collect()] == [("arXiv_src_2101_001.tar", 2021), ("arXiv_src_9912_001.tar", 1999)]


def test_archives(spark, tmp_path):
    project = gzip.compress(tar_of([("main.tex", b"\\documentclass"), ("fig.png", b"p")]))
    single = gzip.compress("caf\xe9".encode("latin-1"))
    (tmp_path / "2101.tar").write_bytes(tar_of([("2101.00001.gz", project), ("2101.00002.gz", single), ("skip.pdf", b"")]))
    (tmp_path / "bad.tar").write_bytes(b"garbage")
    rows = {r.arxiv_id: r for r in archives.read_projects(spark, str(tmp_path)).collect()}
    assert rows["2101.00001"].text == "\\documentclass" and rows["2101.00001"].yymm == "2101" and rows["2101.00002"].text == "café" and len(rows) == 2
    assert archives.read_archives(spark, str(tmp_path), "bad.tar").first()["error"]
    (tmp_path / "images_7.tar.gz").write_bytes(tar_of([("d/a.png", b"1"), ("d/a.png", b"2"), ("b.txt", b"")], "w:gz"))
    images = archives.read_images(spark, str(tmp_path))
    assert [(r.archive_id, r.file_id, bytes(r.png)) for r in images.collect()] == [("7", "a", b"2")]
    assert archives.join_images(spark.createDataFrame([("a", 1), ("z", 2)], "file_id string, x int"), images).count() == 1
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x/f.png", "1")
        z.writestr("y/f.png", "2")
    (tmp_path / "z.zip").write_bytes(out.getvalue())
    assert [r.member for r in archives.zip_index(archives.read_archives(spark, str(tmp_path), "*.zip")).collect()] == ["y/f.png"]


def test_sinks(spark, tmp_path):
    df = spark.range(25).coalesce(1)
    sinks.write_json(df, str(tmp_path / "j"), "gzip", per_file=10)
    assert len(list((tmp_path / "j").glob("*.json.gz"))) == 3
    with pytest.raises(ValueError):
        sinks.write_json(df, str(tmp_path / "k"), "xz")
    sinks.write_table(df.withColumn("shard", F.col("id") % 3), str(tmp_path / "t"), "shard")
    assert sinks.read_table_parts(spark, str(tmp_path / "t")).count() == 25
    path = str(tmp_path / "r")
    df.write.parquet(path)
    sinks.replace_table(spark, spark.read.parquet(path).where("id < 5"), path)
    assert spark.read.parquet(path).count() == 5
    sinks.append_table(df, path)
    assert spark.read.parquet(path).count() == 30


def fetch(token):
    return {"": (["a", "b"], "t1"), "t1": (["c"], "t2"), "t2": ([], None)}[token]


def test_paging(spark, tmp_path):
    assert [t for t, _, _ in harvest.pages(fetch)] == ["", "t1", "t2"]
    calls = []

    def flaky(token):
        calls.append(token)
        if len(calls) < 3:
            raise OSError
        return [], None

    assert len(list(harvest.pages(flaky))) == 1
    spark.dataSource.register(harvest.PagedSource)
    rows = spark.read.format("paged").option("fetch", "tests.test_edges:fetch").load().collect()
    assert sorted(r.record for r in rows) == ["a", "b", "c"]


def test_boundary(spark, tmp_path):
    good = "\\documentclass{standalone}\\begin{document}\\begin{tikzpicture}\\draw;\\end{tikzpicture}\\end{document}"
    df = spark.createDataFrame([("1", good), ("2", "\\begin{a}"), ("3", None), ("4", good.replace("\\draw;", "")), ("5", good)], "file_id string, code string")
    assert {r.file_id: r.status for r in boundary.compile_codes(df, "file_id", "code").collect()} == {"1": "success", "2": "error", "3": "error", "4": "empty", "5": "success"}

    def broken(code):
        raise RuntimeError("no")

    assert boundary.compile_codes(df, "file_id", "code", broken).where("error is not null").count() == 5
    out = boundary.generate(df, "file_id", "code", lambda p: p.upper()).collect()
    assert next(r for r in out if r.file_id == "3").error and next(r for r in out if r.file_id == "2").response == "\\BEGIN{A}"
    with pytest.raises(ValueError, match="unknown compiler"):
        boundary.COMPILERS.get("?")
    scores = spark.createDataFrame([("1", 0.5)], "file_id string, score double")
    assert {r.file_id: r.reward for r in boundary.reward(df, scores, "file_id").collect()}["2"] == 0.0
    calls = spark.sparkContext.accumulator(0)

    def work(frame):
        def run(parts):
            for p in parts:
                calls.add(len(p))
                yield p.assign(n=1)[["file_id", "n"]]

        return frame.select("file_id").mapInPandas(run, "file_id string, n int")

    cache = str(tmp_path / "cache")
    assert boundary.cached_apply(df.where("file_id < '3'"), "file_id", work, cache).count() == 2
    assert boundary.cached_apply(df, "file_id", work, cache).count() == 5 and calls.value == 5
    tree = spark.createDataFrame([("p", "main.tex", "a \\input{sub} \\input{gone}"), ("p", "sub.tex", "b")], "project string, path string, text string")
    assert {r.path: r.text for r in boundary.resolve_inputs(tree).collect()}["main.tex"] == "a b \\input{gone}"
    assert boundary.mapped(df, lambda p: pd.DataFrame({"n": [len(p)]}), "n int").groupBy().sum("n").first()[0] == 5


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    schema = "id long, posttypeid int, parentid long, acceptedanswerid long, answercount int, score int, title string, body string"
    early = [(2, 2, 1, None, None, 1, None, "a"), (2, 2, 1, None, None, 1, None, "a"), (5, 2, 4, None, None, 1, None, "x")]
    late = [(1, 1, None, None, 2, 5, "t", "q"), (3, 2, 1, None, None, 1, None, "b"), (4, 1, None, None, 2, 0, "u", "q")]
    for rows in (early, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    out = S.run_to_end(S.assemble_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert [(r.question_id, [a.answer_id for a in r.answers]) for r in out] == [(1, [2, 3])]
    ids = spark.readStream.schema(schema).json(str(source)).select("id")
    S.append_batches(S.dedup_stream(ids, ["id"]), str(tmp_path / "b"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b")).count() == 5
    S.append_batches(S.dedup_stream(ids, ["id"]), str(tmp_path / "b"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b")).count() == 5
