"""Scans of JSON, XML, text and side-car files, with declared schemas."""

from __future__ import annotations

import lzma

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmill.functions.text import is_blank
from inkmill.operators.relational import first_by
from inkmill.schemas import CORRUPT
from inkmill.sources.paths import open_input


def read_json_arrays(spark: SparkSession, path: str, schema: str, pattern: str | None = None, skip_broken: bool = False) -> DataFrame:
    """S-01, S-02, S-15: files that each hold a JSON array. A file that is no JSON raises, or gives nothing with ``skip_broken``."""
    reader = spark.read.schema(schema + (f", {CORRUPT} string" if skip_broken else "")).option("multiLine", True).option("mode", "PERMISSIVE" if skip_broken else "FAILFAST")
    if skip_broken:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.json(path)
    if not skip_broken:
        return df
    # the scan refuses to read the mark of broken records alone, so another column takes part
    other = F.coalesce(F.length(F.col(df.columns[0]).cast("string")), F.lit(0)) >= 0
    return df.where(F.col(CORRUPT).isNull() & other).drop(CORRUPT)


def read_json_lines(spark: SparkSession, path: str, schema: str, skip_broken: bool = False, pattern: str | None = None, keep_broken: bool = False) -> DataFrame:
    """S-03..S-06: a file, or the files of a folder that match, a record a line. Broken lines raise, are dropped
    (``skip_broken``), or come as text in ``_corrupt_record`` (``keep_broken``)."""
    if keep_broken:
        reader = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    else:
        reader = spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_broken else "FAILFAST")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path)


def read_xz_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """K-03: JSON lines of xz files, which Spark has no codec for, read as streams by the tasks."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.xz").load(path).select("path")

    def run(frames):
        for frame in frames:
            for name in frame["path"]:
                with open_input(name) as raw, lzma.LZMAFile(raw) as lines:
                    while held := lines.readlines(1 << 24):
                        yield pd.DataFrame({"value": [line.decode() for line in held]})

    return names.mapInPandas(run, "value string").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json_map(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """S-07: files that each hold one JSON object; a row for each of its entries."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias(key, "v"))
    return entries.select(key, "v.*")


def read_json_set(spark: SparkSession, path: str) -> DataFrame:
    """S-08: the distinct strings of files that each hold a JSON list; a file that is none gives nothing."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>")).alias("value")).where("value is not null").distinct()


def read_xml_rows(spark: SparkSession, path: str, schema: str, row: str = "row") -> DataFrame:
    """S-09, R-02: an XML dump whose records are attributes of ``row`` elements; read in parts, columns without their mark."""
    fields = [f.strip().split(None, 1) for f in schema.split(",")]
    reader = spark.read.option("rowTag", row).schema(", ".join(f"_{n} {t}" for n, t in fields))
    return reader.xml(path).select(*(F.col(f"_{n}").alias(n.lower()) for n, _ in fields))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.tex", recursive: bool = True) -> DataFrame:
    """S-16, S-17: (path, folder, stem, text) of text files, whole, in a tree or in one folder."""
    df = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    name = F.substring_index(where, "/", -1)
    return df.select(where.alias("path"), F.regexp_replace(where, "/[^/]*$", "").alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("value").alias("text"))


def with_sidecar(texts: DataFrame, side: DataFrame, name: str, suffix: str = "", optional: bool = False) -> DataFrame:
    """S-18, S-19: the text of the side-car of the same folder and stem (plus ``suffix``) as ``name``; without one the row is dropped,
    or gets an empty text (``optional``)."""
    other = first_by(side.select("folder", F.col("stem").alias("__stem"), F.col("path").alias("__path"), F.col("text").alias(name)), ["folder", "__stem"], ["__path"])
    joined = texts.withColumn("__stem", F.concat("stem", F.lit(suffix))).join(other, ["folder", "__stem"], "left" if optional else "inner").drop("__stem", "__path")
    return joined.withColumn(name, F.coalesce(name, F.lit(""))) if optional else joined


def first_per_folder(texts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """S-20: the first file, by path, of each folder."""
    return first_by(texts, ["folder"], ["path"])


def root_files(files: DataFrame, project: str, path: str, text: str) -> DataFrame:
    """S-21: of each project the first file with a document class, else the first file; rows without text are left out."""
    has_class = F.regexp_like(F.col(text), F.lit(r"\\document(class|style)"))
    marked = files.where(~is_blank(text)).withColumn("__none", (~has_class).cast("int"))
    return first_by(marked, [project], ["__none", path]).drop("__none")


def decoded(x: Column | str) -> Column:
    """S-33: bytes as UTF-8, or as Latin-1 where they are none."""
    raw = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "ISO-8859-1"))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """S-31: (token, rank) of a vocabulary file with a base64 token and a rank a line."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("rank"))


def read_config_line(spark: SparkSession, path: str, number: int, names: list[str]) -> dict[str, str]:
    """S-34: the values of one line (from 1) of a small comma-separated file."""
    lines = [r[0] for r in spark.read.text(path).limit(number).collect()]
    return dict(zip(names, (v.strip() for v in lines[number - 1].split(","))))


def month_ranges(spark: SparkSession, first: str, last: str) -> DataFrame:
    """S-26: (start_date, end_date) of the months from that of ``first`` to that of ``last``."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("start_date"))
    return months.select("start_date", F.last_day("start_date").alias("end_date"))


def harvest_records(df: DataFrame, xml: str, *keep: str) -> DataFrame:
    """S-27, F-19, T-31: (arxiv_id, created), after the columns to keep, of records in XML; both null where one cannot be read, a date
    that is none included."""
    text = lambda tag: F.nullif(F.trim(F.regexp_extract(F.col(xml), rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    read = df.select(*keep, text("id").alias("arxiv_id"), F.try_to_date(text("created"), "yyyy-MM-dd").alias("created"))
    whole = F.col("arxiv_id").isNotNull() & F.col("created").isNotNull()
    return read.select(*keep, F.when(whole, F.col("arxiv_id")).alias("arxiv_id"), F.when(whole, F.col("created")).alias("created"))


def paired(metadata: DataFrame, archives: DataFrame, path: str = "path") -> DataFrame:
    """S-15, J-09: metadata files whose images' archive is there, by the id in both names."""
    of = lambda kind: F.regexp_extract(F.col(path), rf"{kind}_(\w+?)\.", 1)
    return metadata.withColumn("archive_id", of("metadata")).join(archives.select(of("images").alias("archive_id")).distinct(), "archive_id", "left_semi")


def archive_names(df: DataFrame, name: str, exclude: DataFrame | None = None, done: DataFrame | None = None, since: str | None = None) -> DataFrame:
    """S-28, F-20, J-07, O-03: listed source archives, new ones only, the latest first. ``exclude`` names parts of names, ``done`` their beginnings;
    the date is the four digits after ``_src_``."""
    from inkmill.operators.relational import without_prefixes, without_substrings

    out = df.where(F.contains(F.col(name), F.lit("_src_")))
    out = out.withColumn("month", F.try_to_date(F.concat(F.lit("20"), F.regexp_extract(name, r"_src_(\d{4})", 1)), "yyyyMM"))
    # two digits from 91 on are of the last century
    out = out.withColumn("month", F.when(F.year("month") >= 2091, F.add_months("month", -1200)).otherwise(F.col("month")))
    if since:
        out = out.where(F.col("month") >= F.lit(since).cast("date"))
    if exclude is not None:
        out = without_substrings(out, name, exclude, exclude.columns[0])
    if done is not None:
        out = without_prefixes(out, name, done, done.columns[0])
    return out.orderBy(F.desc("month"), name)


def numbered(df: DataFrame, parent: str, order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(parent).orderBy(order)))
