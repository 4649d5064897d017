"""Archives as rows: a row for each member, read in the tasks that hold the archive."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators.relational import first_by
from inkmill.session import materialise, shuffle_partitions
from inkmill.sources.files import decoded
from inkmill.sources.paths import move, open_input, open_output

MEMBERS = "archive string, ordinal int, member string, modified timestamp, content binary, error string"
NAMES = ["archive", "ordinal", "member", "modified", "content", "error"]


def _tar(data: bytes) -> Iterator[tuple[str, float, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
        for m in tar:
            if m.isfile() and (f := tar.extractfile(m)):
                yield m.name, m.mtime, f.read()


def _zip(data: bytes) -> Iterator[tuple[str, float, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for m in z.infolist():
            if not m.is_dir():
                yield m.filename, pd.Timestamp(*m.date_time).timestamp(), z.read(m)


def members(data: bytes) -> Iterator[tuple[str, float, bytes]]:
    """S-10..S-14: the files of a tar (of any compression), a zip, or a single compressed file."""
    if data[:4] == b"PK\x03\x04":
        yield from _zip(data)
        return
    try:
        yield from _tar(data)
    except tarfile.ReadError:
        if data[:2] != b"\x1f\x8b":
            raise
        yield "", 0.0, gzip.decompress(data)


def _frames(rows: Iterator[tuple], most_bytes: int = 1 << 25) -> Iterator[pd.DataFrame]:
    """Rows of MEMBERS in frames of about ``most_bytes``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"")
        if size >= most_bytes or len(held) >= 10_000:
            yield pd.DataFrame(held, columns=NAMES)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=NAMES)


def _rows(path: str, found: Callable[[], Iterator[tuple[str, float, bytes]]], suffixes: tuple[str, ...] | None) -> Iterator[tuple]:
    try:
        for i, (name, modified, content) in enumerate(found()):
            if suffixes is None or not name or name.lower().endswith(suffixes):
                yield path, i, name, pd.Timestamp(modified, unit="s"), content, None
    except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError, zlib.error) as e:
        yield path, -1, None, None, None, f"{type(e).__name__}: {e}"


def expand_archives(binary: DataFrame, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """S-10..S-14, E-06: (archive, ordinal, member, modified, content, error) of rows (path, content). An archive that cannot be
    read gives one row with its error; what was read before it broke is kept."""

    def run(frames):
        for frame in frames:
            yield from _frames(row for path, data in zip(frame["path"], frame["content"]) for row in _rows(path, lambda d=bytes(data): members(d), suffixes))

    return binary.select("path", "content").mapInPandas(run, MEMBERS)


def _stream(path: str) -> Iterator[tuple[str, float, bytes]]:
    """The members of the archive at ``path``, one after the other: a tar is read as a stream, a zip by its index at its end."""
    with open_input(path) as raw:
        head = raw.read(4)
    if head == b"PK\x03\x04":
        with open_input(path, seekable=True) as raw, zipfile.ZipFile(raw) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, pd.Timestamp(*m.date_time).timestamp(), z.read(m)
        return
    try:
        with open_input(path) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
            for m in tar:
                if m.isfile() and (f := tar.extractfile(m)):
                    yield m.name, m.mtime, f.read()
    except tarfile.ReadError:
        if head[:2] != b"\x1f\x8b":
            raise
        with open_input(path) as raw:
            try:
                yield "", 0.0, gzip.GzipFile(fileobj=raw).read()
            except gzip.BadGzipFile as e:
                raise tarfile.ReadError(str(e)) from e


def read_archives(spark: SparkSession, path: str, pattern: str = "*", suffixes: tuple[str, ...] | None = None, most: int | None = None) -> DataFrame:
    """S-10..S-12: the members of the archives of a folder, read as streams: no archive is held whole, and one may be of any
    size. ``most`` limits the archives, the first by path."""
    # only names and sizes are read here
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    df = df.orderBy("path").limit(most) if most is not None else df

    def run(frames):
        for frame in frames:
            yield from _frames(row for name in frame["path"] for row in _rows(name, lambda n=name: _stream(n), suffixes))

    return df.repartition(shuffle_partitions(spark), "path").mapInPandas(run, MEMBERS)


def read_projects(spark: SparkSession, path: str, pattern: str = "*.tar", most: int | None = None) -> DataFrame:
    """S-10, P-04: archives of archives: (project, yymm, arxiv_id, path, text, modified) of the TeX files of each project; a project
    that is a single file has an empty path. ``yymm`` is the outer archive's name, ``arxiv_id`` the inner one's."""
    outer = read_archives(spark, path, pattern, (".gz",), most).where("error is null")
    inner = expand_archives(outer.select(F.concat_ws("!", "archive", "member").alias("path"), "content"), (".tex",)).where("error is null")
    name = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")
    return inner.select(F.col("archive").alias("project"), name(F.substring_index("archive", "!", 1)).alias("yymm"), name(F.substring_index("archive", "!", -1)).alias("arxiv_id"), F.col("member").alias("path"), decoded("content").alias("text"), "modified")


def read_images(spark: SparkSession, path: str, pattern: str = "images_*.tar.gz") -> DataFrame:
    """S-13: (archive_id, file_id, png) of image archives; of members of one name the last counts. Volumes
    (``images_<id>-<place>-<number>``) belong to one archive."""
    found = read_archives(spark, path, pattern, (".png",)).where("error is null")
    rows = found.select(F.regexp_extract("archive", r"images_(\w+?)[-.]", 1).alias("archive_id"), F.regexp_replace(F.substring_index("member", "/", -1), r"\.png$", "").alias("file_id"), F.col("content").alias("png"), (-F.col("ordinal")).alias("__last"))
    return first_by(rows, ["archive_id", "file_id"], ["__last"]).drop("__last")


def zip_index(found: DataFrame) -> DataFrame:
    """S-14, J-16: (archive, base, member) by base name; the last member of a name counts."""
    rows = found.where("error is null").select("archive", F.substring_index("member", "/", -1).alias("base"), "member", (-F.col("ordinal")).alias("__last"))
    return first_by(rows, ["archive", "base"], ["__last"]).drop("__last")


def join_images(meta: DataFrame, images: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """J-01, J-02: records with their images; records without one, and images without a record, are left out. Of records
    of one key the last in order of their columns counts. Names are matched before bytes travel."""
    once = first_by(meta, list(keys), [c for c in meta.columns if c not in keys][:1])
    wanted = once.select(*keys)
    return once.join(images.join(wanted, list(keys), "left_semi"), list(keys))


def _volume(target: str, kind: str):
    """A new archive of a kind (tar, tar.gz, tar.xz or zip) at ``target``: a function that adds a member, and one that closes it."""
    out = open_output(target)
    if kind == "zip":
        z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        return (lambda name, data: z.writestr(zipfile.ZipInfo(name), data)), lambda: (z.close(), out.close())
    tar = tarfile.open(fileobj=out, mode={"tar": "w|", "tar.gz": "w|gz", "tar.xz": "w|xz"}[kind])

    def add(name: str, data: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))

    return add, lambda: (tar.close(), out.close())


def write_archives(df: DataFrame, path: str, kind: str = "tar.gz", volume_bytes: int = 1 << 30, places: int = 1) -> DataFrame:
    """K-08: the rows (archive, member, content) as archives ``<archive>-<place>-<volume>.<kind>`` below ``path``; a frame of (path, members) of
    what was written. Members are written as they come, so no archive is held whole; a volume is closed at ``volume_bytes``. The
    rows of one archive go to ``places`` tasks by member. A volume gets its name when it is whole, so a task that runs again replaces it."""
    place = F.pmod(F.xxhash64("member"), F.lit(places)).cast("int")
    rows = df.select("archive", "member", "content", place.alias("place")).where("archive is not null and member is not null and content is not null")
    dealt = rows.repartition(shuffle_partitions(df.sparkSession), "archive", "place").sortWithinPartitions("archive", "place", "member")

    def run(frames):
        current, volume, size, n, add, close = None, 0, 0, 0, None, None
        attempt = TaskContext.get().taskAttemptId()
        final = lambda: f"{path}/{current[0]}-{current[1]:04d}-{volume:04d}.{kind}"
        part = lambda: f"{path}/_parts/{current[0]}-{current[1]:04d}-{volume:04d}-{attempt}"

        def finish():
            close()
            move(part(), final())
            return pd.DataFrame([(final(), n)], columns=["path", "members"])

        for frame in frames:
            for archive, member, content, where in frame.itertuples(index=False):
                if current is not None and ((archive, where) != current or size >= volume_bytes):
                    yield finish()
                    volume = volume + 1 if (archive, where) == current else 0
                    close = None
                if close is None:
                    current, size, n = (archive, where), 0, 0
                    add, close = _volume(part(), kind)
                add(member, bytes(content))
                size, n = size + len(content), n + 1
        if close is not None:
            yield finish()

    return materialise(dealt.mapInPandas(run, "path string, members int"))
