"""Sinks: JSON, files, chunked and partitioned tables, and replacement of a table that is being read."""

from __future__ import annotations

import lzma

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.session import materialise
from inkmill.sources.paths import move, open_output

CODECS = ("none", "gzip", "bzip2", "zstd")


def _as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json(df: DataFrame, path: str, compression: str = "none", per_file: int | None = None, mode: str = "errorifexists") -> None:
    """K-01..K-04: JSON lines, compressed or not, at most ``per_file`` records a file."""
    if compression not in CODECS:
        raise ValueError(f"unknown compression: {compression}; known are {', '.join(CODECS)}")
    writer = df.write.mode(mode).option("compression", compression)
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    writer.json(path)


def write_xz_lines(df: DataFrame, path: str, per_file: int = 1_000_000) -> DataFrame:
    """K-03: JSON lines in xz files, which Spark's writer has no codec for, as streams by the tasks; a frame of (path, records). A file
    is named by its task's part and gets that name when it is whole, so a task that runs again replaces it."""

    def run(frames):
        task = TaskContext.get()
        out = raw = None
        n = number = 0
        final = lambda: f"{path}/part-{task.partitionId():05d}-{number:05d}.jsonl.xz"
        part = lambda: f"{path}/_parts/{task.taskAttemptId()}-{number}"

        def finish():
            out.close()
            raw.close()
            move(part(), final())
            return pd.DataFrame([(final(), n)], columns=["path", "records"])

        for frame in frames:
            for line in frame["value"]:
                if out is None:
                    raw, n = open_output(part()), 0
                    out = lzma.LZMAFile(raw, "w")
                out.write(line.encode() + b"\n")
                n += 1
                if n >= per_file:
                    yield finish()
                    out, number = None, number + 1
        if out is not None:
            yield finish()

    return materialise(_as_json(df).mapInPandas(run, "path string, records long"))


def write_json_arrays(df: DataFrame, path: str, per_file: int = 5000, indent: int = 2, mode: str = "errorifexists") -> None:
    """K-01: files that each hold one JSON array of at most ``per_file`` records, an entry a line, not escaped; nothing is shuffled."""

    def run(frames):
        held: list[str] = []
        for frame in frames:
            held += frame["value"].tolist()
            while len(held) >= per_file:
                yield pd.DataFrame({"value": [_array(held[:per_file])]})
                held = held[per_file:]
        if held:
            yield pd.DataFrame({"value": [_array(held)]})

    def _array(records: list[str]) -> str:
        return "[\n" + ",\n".join(" " * indent + r for r in records) + "\n]"

    _as_json(df).mapInPandas(run, "value string").write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def write_files(df: DataFrame, path: str) -> DataFrame:
    """K-12: rows (path, content) as one file each below ``path``; a frame of (path, bytes). Files are replaced, so a task may run again."""

    def each(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                with open_output(f"{path}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"path": frame["path"], "bytes": [len(c) for c in frame["content"]]})

    return materialise(df.select("path", F.col("content").cast("binary").alias("content")).where("path is not null and content is not null").mapInPandas(each, "path string, bytes long"))


def write_table(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """K-06, K-07, K-12, K-13: Parquet, in a folder for each archive or shard; rows of one go to few files."""
    writer = (df.repartition(by) if by else df).write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """K-05, K-10."""
    df.write.mode("append").parquet(path)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """K-09, K-11: ``df``, which may read ``path``, takes its place: written beside it, then moved."""
    fresh, old = f"{path}.__new", f"{path}.__old"
    df.write.mode("overwrite").parquet(fresh)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    files.delete(jvm.org.apache.hadoop.fs.Path(old), True)
    if files.exists(target) and not files.rename(target, jvm.org.apache.hadoop.fs.Path(old)):
        raise OSError(f"cannot move {path}")
    if not files.rename(jvm.org.apache.hadoop.fs.Path(fresh), target):
        raise OSError(f"cannot move {fresh}")
    files.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def read_table_parts(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """S-30, O-02: the parts of a partitioned table as one."""
    df = spark.read.parquet(path)
    return df.orderBy(F.regexp_extract(key, r"(\d+)$", 1).try_cast("int")) if key else df


def report_lines(df: DataFrame) -> DataFrame:
    """K-13: a frame of one row of metrics as rows (metric, value) in the order of its columns."""
    named = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for i, c in enumerate(df.columns)]
    return df.select(F.explode(F.array(*named)).alias("m")).select("m.place", "m.metric", "m.value")
