r"""Queries of the sources, the sinks, and what reads and writes files: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill import boundary as B
from inkmill.functions import extraction as X
from inkmill.functions import images as I
from inkmill.functions import latex as L
from inkmill.functions import markup as K
from inkmill.functions import sequences as Q
from inkmill.functions import text as T
from inkmill.operators import metrics as M
from inkmill.operators import records as C
from inkmill.operators import relational as R
from inkmill.operators import sampling as O
from inkmill.queries import over, query, s_blank, s_collapse, s_lines, s_strip
from inkmill.session import checkpoint_dir
from inkmill.sources import archives, files, harvest, sinks
from inkmill.sources.tables import read_table
from inkmill.streaming import assembly as S


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _json(*columns: str):
    return F.to_json(F.struct(*columns))


# --- JSON -----------------------------------------------------------------------------------------------------------
@query("scan_json_arrays", "select file_id, caption, code_length from corpus")
def _(spark, d):
    """S-01, K-01: arrays written, and read by the pattern of their names; a file of another name is left alone."""
    to = scratch(spark)
    sinks.write_json_arrays(read_table(spark, d, "corpus").select("file_id", "caption", "code_length"), to, 500)
    sinks.write_files(spark.createDataFrame([("notes.md", "no JSON")], "path string, content string"), to)
    return files.read_json_arrays(spark, to, "file_id string, caption string, code_length int", "part-*.txt")


@query("scan_json_skip", "select file_id, new_caption from captions")
def _(spark, d):
    """S-02: a file that is no JSON is skipped whole."""
    to = scratch(spark)
    sinks.write_json_arrays(read_table(spark, d, "captions"), to, 300)
    sinks.write_files(spark.createDataFrame([("part-broken.txt", '[{"file_id": "x", "new_caption": "y"}, {"file_id')], "path string, content string"), to)
    return files.read_json_arrays(spark, to, "file_id string, new_caption string", "part-*.txt", skip_broken=True)


@query("scan_jsonl", "select file_id, response from repair_responses")
def _(spark, d):
    """S-03, K-02."""
    to = scratch(spark)
    sinks.write_json(read_table(spark, d, "repair_responses"), to, per_file=200)
    return files.read_json_lines(spark, to, "file_id string, response string")


@query("scan_jsonl_lenient", "select id, title from posts where id % 10 <> 0")
def _(spark, d):
    """S-04: lines that are cut are dropped."""
    to, posts = scratch(spark), read_table(spark, d, "posts")
    line = _json("id", "title")
    posts.select(F.when(F.col("id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)).write.text(to)
    return files.read_json_lines(spark, to, "id bigint, title string", skip_broken=True)


@query("scan_jsonl_folder", "select file_id, new_caption from captions")
def _(spark, d):
    """S-05, S-06: the lines of the files of a folder that match; an empty file gives none."""
    to = scratch(spark)
    lines = read_table(spark, d, "captions").select(F.concat(F.md5(F.coalesce("file_id", F.lit(""))).substr(1, 1), F.lit(".jsonl")).alias("path"), _json("file_id", "new_caption").alias("line"))
    texts = lines.groupBy("path").agg(F.array_join(F.collect_list("line"), "\n").alias("content"))
    sinks.write_files(texts.unionByName(spark.createDataFrame([("empty.jsonl", ""), ("notes.txt", "no JSON")], texts.schema)), to)
    return files.read_json_lines(spark, to, "file_id string, new_caption string", pattern="*.jsonl")


@query("scan_json_map", "select figure_id, code, new_caption from eval_gt")
def _(spark, d):
    """S-07: maps of records, four of them."""
    to = scratch(spark)
    entries = read_table(spark, d, "eval_gt").groupBy(F.pmod(F.xxhash64("figure_id"), F.lit(4))).agg(F.map_from_entries(F.collect_list(F.struct("figure_id", F.struct("code", "new_caption")))).alias("m"))
    entries.select(F.to_json("m")).write.option("maxRecordsPerFile", 1).text(to)
    return files.read_json_map(spark, to, "code string, new_caption string", "figure_id")


@query("scan_json_set", "select distinct archive_id as value from corpus where archive_id is not null")
def _(spark, d):
    """S-08, K-11: a set saved as lists in any order; a file that is none gives nothing."""
    to = scratch(spark)
    ids = read_table(spark, d, "corpus").select("archive_id").where("archive_id is not null").distinct()
    ids.groupBy(F.pmod(F.xxhash64("archive_id"), F.lit(8))).agg(F.to_json(F.collect_list("archive_id")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(to)
    sinks.write_files(spark.createDataFrame([("broken.txt", '["a", ')], "path string, content string"), to)
    return files.read_json_set(spark, to)


@query("write_xz", "select file_id, new_caption from captions")
def _(spark, d):
    """K-03."""
    to = scratch(spark)
    sinks.write_xz_lines(read_table(spark, d, "captions"), to, 1000)
    return files.read_xz_lines(spark, to, "file_id string, new_caption string")


@query("scan_xml", "select id, posttypeid, parentid, score, title, body from posts")
def _(spark, d):
    """S-09, R-02: rows of an XML dump whose values are attributes."""
    to, names = scratch(spark), ("id", "posttypeid", "parentid", "score", "title", "body")
    read_table(spark, d, "posts").select(*(F.col(n).alias(f"_{n}") for n in names)).write.option("rowTag", "row").option("rootTag", "posts").xml(to)
    return files.read_xml_rows(spark, to, "id bigint, posttypeid int, parentid bigint, score int, title string, body string")


# --- archives -------------------------------------------------------------------------------------------------------
def _coded(spark, d) -> DataFrame:
    return read_table(spark, d, "corpus").select("file_id", "archive_id", "source", "code", "caption").where("code is not null")


def _zipped(x):
    import gzip

    return gzip.compress(x, mtime=0) if x is not None else None


@query("scan_projects", "select substr(md5(coalesce(archive_id, '')), 1, 2) as yymm, file_id as arxiv_id, code as text from corpus where code is not null")
def _(spark, d):
    """S-10, K-08: archives of compressed projects."""
    to = scratch(spark)
    rows = _coded(spark, d).select(F.substring(F.md5(F.coalesce("archive_id", F.lit(""))), 1, 2).alias("archive"), F.concat("file_id", F.lit(".gz")).alias("member"), F.udf(_zipped, "binary", useArrow=True)(F.encode("code", "UTF-8")).alias("content"))
    archives.write_archives(rows, to, "tar", volume_bytes=1 << 20)
    return archives.read_projects(spark, to).select(F.substring_index("yymm", "-", 1).alias("yymm"), "arxiv_id", "text")


@query("scan_repositories", "select coalesce(archive_id, 'none') as repo, 'src/' || file_id || case when source = 'github' then '.pgf' else '.tex' end as member, sha256(code) as sha256 from corpus where code is not null")
def _(spark, d):
    """S-11: members by suffix; others are left in the archive."""
    to = scratch(spark)
    repo = F.coalesce("archive_id", F.lit("none")).alias("archive")
    code = _coded(spark, d).select(repo, F.concat(F.lit("src/"), "file_id", F.when(F.col("source") == "github", ".pgf").otherwise(".tex")).alias("member"), F.encode("code", "UTF-8").alias("content"))
    notes = _coded(spark, d).select(repo, F.concat(F.lit("docs/"), "file_id", F.lit(".md")).alias("member"), F.encode("caption", "UTF-8").alias("content"))
    archives.write_archives(code.unionByName(notes), to, "tar.gz", places=2)
    found = archives.read_archives(spark, to, "*.tar.gz", (".tex", ".pgf"))
    return found.select(F.regexp_extract("archive", r"([^/]*)-\d+-\d+\.tar\.gz$", 1).alias("repo"), "member", F.sha2("content", 256).alias("sha256"))


@query("scan_broken_archives", "select source, count(*)::bigint as members, 1::bigint as broken from corpus where code is not null group by source")
def _(spark, d):
    """S-12, E-06: tar files of any compression; one that cannot be read gives a row with its error."""
    to = scratch(spark)
    rows = _coded(spark, d).select(F.col("source").alias("archive"), F.concat("file_id", F.lit(".tex")).alias("member"), F.encode("code", "UTF-8").alias("content"))
    archives.write_archives(rows.where("source in ('arxiv', 'tex')"), to, "tar.xz", places=4)
    archives.write_archives(rows.where("source not in ('arxiv', 'tex')"), to, "tar.gz", places=2)
    sources = rows.select("archive").distinct()
    sinks.write_files(sources.select(F.concat("archive", F.lit("-9999-0000.tar.gz")).alias("path"), F.unhex(F.lit("1f8b0800deadbeef")).alias("content")), to)
    found = archives.read_archives(spark, to).withColumn("source", F.regexp_extract("archive", r"([^/-]*)-\d+-\d+\.tar", 1))
    return found.groupBy("source").agg(F.count("member").alias("members"), F.count("error").alias("broken"))


_PNG = "89504e470d0a1a0a"


def _image(name):
    return F.concat(F.unhex(F.lit(_PNG)), F.encode(name, "UTF-8"))


@query("join_images", f"select archive_id, file_id, caption, sha256(from_hex('{_PNG}') || encode(file_id)) as sha256 from corpus where archive_id is not null and length(file_id) % 3 <> 0")
def _(spark, d):
    """S-13, S-15, J-01, J-02, J-09: metadata files and the images' archives of the same id."""
    to = scratch(spark)
    rows = read_table(spark, d, "corpus").where("archive_id is not null").select("archive_id", "file_id", "caption")
    images = rows.where(F.length("file_id") % 3 != 0)
    archives.write_archives(images.select(F.concat(F.lit("images_"), "archive_id").alias("archive"), F.concat(F.lit("png/"), "file_id", F.lit(".png")).alias("member"), _image("file_id").alias("content")), f"{to}/images")
    meta = rows.groupBy("archive_id").agg(F.collect_list(_json("file_id", "caption")).alias("lines"))
    sinks.write_files(meta.select(F.concat(F.lit("metadata_"), "archive_id", F.lit(".json")).alias("path"), F.concat(F.lit("["), F.array_join("lines", ","), F.lit("]")).alias("content")), f"{to}/meta")
    found = archives.read_images(spark, f"{to}/images", "images_*.tar.gz")
    listed = files.read_json_arrays(spark, f"{to}/meta", "file_id string, caption string", "metadata_*.json").select("*", F.regexp_extract("_metadata.file_name", r"metadata_(\w+)\.json", 1).alias("archive_id"))
    here = files.paired(listed.select("archive_id").distinct().select(F.concat(F.lit("metadata_"), "archive_id", F.lit(".json")).alias("path")), found.select(F.concat(F.lit("images_"), "archive_id", F.lit(".tar.gz")).alias("path")).distinct())
    both = archives.join_images(listed.join(here.select("archive_id"), "archive_id", "left_semi"), found, ("archive_id", "file_id"))
    return both.select("archive_id", "file_id", "caption", F.sha2("png", 256).alias("sha256"))


@query("zip_index", "select source as archive, regexp_extract(file_id, '[^_]*$') || '.png' as base, max(archive_id || '/' || regexp_extract(file_id, '[^_]*$') || '.png') as member from corpus where archive_id is not null group by all")
def _(spark, d):
    """S-14, J-16: the inner path of each base name; the last of a name counts. Members lie in order of their names here."""
    to = scratch(spark)
    base = F.concat(F.regexp_extract("file_id", "[^_]*$", 0), F.lit(".png"))
    rows = read_table(spark, d, "corpus").where("archive_id is not null").select(F.col("source").alias("archive"), F.concat("archive_id", F.lit("/"), base).alias("member"), _image("file_id").alias("content")).dropDuplicates(["archive", "member"])
    archives.write_archives(rows, to, "zip")
    return archives.zip_index(archives.read_archives(spark, to, "*.zip")).select(F.regexp_extract("archive", r"([^/-]*)-\d+-\d+\.zip$", 1).alias("archive"), "base", "member")


# --- texts and side-cars --------------------------------------------------------------------------------------------
def _tree(spark, d, to: str, suffix: str = ".tex", folder: str = "source") -> DataFrame:
    """The codes of eval_gt and curated corpus rows as files."""
    rows = read_table(spark, d, "corpus").where("source = 'curated' and code is not null")
    sinks.write_files(rows.select(F.concat(F.substring(F.md5("file_id"), 1, 1), F.lit("/"), "file_id", F.lit(suffix)).alias("path"), F.col("code").alias("content")), to)
    return rows


@query("scan_tree", "select substr(md5(file_id), 1, 1) as folder, file_id as stem, code as text from corpus where source = 'curated' and code is not null")
def _(spark, d):
    """S-16: the texts of a tree."""
    to = scratch(spark)
    _tree(spark, d, to)
    _tree(spark, d, to, ".md")
    return files.read_texts(spark, to).select(F.substring_index("folder", "/", -1).alias("folder"), "stem", "text")


@query("scan_flat", "select file_id as stem, code as text from corpus where source = 'curated' and code is not null and substr(md5(file_id), 1, 1) = 'a'")
def _(spark, d):
    """S-17: the texts of one folder, not of those below it."""
    to = scratch(spark)
    _tree(spark, d, to)
    _tree(spark, d, f"{to}/a/deeper")
    return files.read_texts(spark, f"{to}/a", recursive=False).select("stem", "text")


@query("sidecar_yaml", "select file_id as stem, code as text, caption as title, new_caption as description from corpus where source = 'curated' and code is not null and caption is not null and new_caption is not null")
def _(spark, d):
    """S-18, X-20: texts with the title and the description of their YAML side-car; those without one are left out."""
    to = scratch(spark)
    rows = _tree(spark, d, to).where("caption is not null and new_caption is not null")
    # a JSON string is a YAML string
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1)
    sinks.write_files(rows.select(F.concat(F.substring(F.md5("file_id"), 1, 1), F.lit("/"), "file_id", F.lit(".yml")).alias("path"), F.concat(F.lit("title: "), quoted("caption"), F.lit("\ndescription: "), quoted("new_caption"), F.lit("\n")).alias("content")), to)
    both = files.with_sidecar(files.read_texts(spark, to), files.read_texts(spark, to, "*.yml"), "yaml")
    return both.withColumn("y", K.yaml_columns("yaml")).select("stem", "text", "y.title", "y.description")


@query("sidecar_optional", f"select file_id as stem, 'Figure: ' || coalesce(caption, '') || case when {s_blank('new_caption')} then '' else ' (Keywords: ' || new_caption || ')' end as description from corpus where source = 'curated' and code is not null")
def _(spark, d):
    """S-19, P-07: texts with optional side-cars."""
    to = scratch(spark)
    rows = _tree(spark, d, to)
    for column, suffix in (("new_caption", "_keywords.txt"), ("caption", "_description.txt")):
        sinks.write_files(rows.where(f"{column} is not null").select(F.concat(F.substring(F.md5("file_id"), 1, 1), F.lit("/"), "file_id", F.lit(suffix)).alias("path"), F.col(column).alias("content")), to)
    texts, side = files.read_texts(spark, to), files.read_texts(spark, to, "*.txt")
    both = files.with_sidecar(files.with_sidecar(texts, side, "keywords", "_keywords", True), side, "about", "_description", True)
    return C.titled(both.withColumn("kind", F.lit("Figure")), "kind", "about", "keywords").select("stem", "description")


@query("first_files", "select substr(md5(file_id), 1, 1) as folder, min(file_id) as tex, min(file_id) as md from corpus where source = 'curated' and code is not null group by all")
def _(spark, d):
    """S-20: the first text and the first Markdown file of each folder."""
    to = scratch(spark)
    _tree(spark, d, to)
    _tree(spark, d, to, ".md")
    tex, md = (files.first_per_folder(files.read_texts(spark, to, f"*.{s}")).select(F.substring_index("folder", "/", -1).alias("folder"), F.col("stem").alias(s)) for s in ("tex", "md"))
    return tex.join(md, "folder")


@query("root_files", rf"select archive_id, file_id from (select archive_id, file_id, row_number() over (partition by archive_id order by not (contains(code, '\documentclass') or contains(code, '\documentstyle')), file_id) as n from corpus where not {s_blank('code')}) t where n = 1")
def _(spark, d):
    """S-21."""
    return files.root_files(read_table(spark, d, "corpus"), "archive_id", "file_id", "code").select("archive_id", "file_id")


@query("decode_fallback", "select file_id, 'é ' || file_id as text from corpus")
def _(spark, d):
    """S-33: bytes in UTF-8 or Latin-1."""
    text = F.concat(F.lit("\N{LATIN SMALL LETTER E WITH ACUTE} "), "file_id")
    raw = F.when(F.length("file_id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return read_table(spark, d, "corpus").select("file_id", files.decoded(raw).alias("text"))


@query("vocabulary_ranks", r"select word, (row_number() over (order by word) - 1)::int as rank from (select distinct unnest(regexp_extract_all(lower(caption), '[\p{L}\p{Nd}]+')) as word from corpus) t")
def _(spark, d):
    """S-31: a vocabulary saved as base64 and rank, and read."""
    to = scratch(spark)
    words = read_table(spark, d, "corpus").select(F.explode(F.regexp_extract_all(F.lower("caption"), F.lit(r"[\p{L}\p{Nd}]+"), 0)).alias("word")).distinct()
    O.ranked(words, ["word"]).select(F.concat_ws(" ", F.base64(F.encode("word", "UTF-8")), F.col("rank").cast("string"))).write.text(to)
    return files.read_ranks(spark, to).select(F.decode("token", "UTF-8").alias("word"), "rank")


@query("config_line", "select name, value from (values ('model', 'inkmill-8b'), ('split', 'test')) t(name, value)")
def _(spark, d):
    """S-34: the values of the second line."""
    to = scratch(spark)
    sinks.write_files(spark.createDataFrame([("eval.txt", "inkmill-1b, train\ninkmill-8b, test\n")], "path string, content string"), to)
    return spark.createDataFrame(list(files.read_config_line(spark, f"{to}/eval.txt", 2, ["model", "split"]).items()), "name string, value string")


# --- listings -------------------------------------------------------------------------------------------------------
def _landed(spark, to: str, rows: DataFrame, credentials: int = 0, size: int = 50) -> None:
    """Pages of ``size`` records (column ``record``) as files, the last one empty."""
    numbered = O.chunked(rows, ["record"], size, "page").groupBy("page").agg(F.sort_array(F.collect_list("record")).alias("records"))
    page = F.col("page").cast("string")
    kind = F.lit("page").alias("type")
    only = F.concat(F.lit("c"), (F.col("page") % max(1, credentials)).cast("string")) if credentials else F.lit(None).cast("string")
    body = F.to_json(F.struct(kind, "records", (F.col("page") + 1).cast("string").alias("next"), only.alias("credential")))
    sinks.write_files(numbered.select(F.concat(page, F.lit(".json")).alias("path"), body.alias("content")), to)
    last = numbered.agg(F.coalesce(F.max("page") + 1, F.lit(0)).cast("string").alias("page"))
    sinks.write_files(last.select(F.concat("page", F.lit(".json")).alias("path"), F.lit('{"type": "empty"}').alias("content")), to)


def _paged(spark, to: str, **options):
    spark.dataSource.register(harvest.PagedSource)
    reader = spark.read.format("paged").option("fetch", "inkmill.sources.harvest:landed").option("argument", to)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


@query("paged_listing", "select distinct archive_id as record from corpus where archive_id is not null")
def _(spark, d):
    """S-22: pages until one says that it is empty."""
    to = scratch(spark)
    _landed(spark, to, read_table(spark, d, "corpus").select(F.col("archive_id").alias("record")).where("record is not null").distinct())
    return _paged(spark, to).select("record")


@query("search_rotation", "select distinct archive_id as repo from corpus where source = 'github' and archive_id is not null and archive_id not in (select archive_id from corpus where source = 'github' and status = 'error' and archive_id is not null)")
def _(spark, d):
    """S-29, J-06: pages that each answer to one of three credentials; repositories that are known are left out."""
    to, corpus = scratch(spark), read_table(spark, d, "corpus").where("source = 'github' and archive_id is not null")
    _landed(spark, to, corpus.select(F.col("archive_id").alias("record")).distinct(), credentials=3)
    found = _paged(spark, to, credentials="c0,c1,c2").select(F.col("record").alias("repo"))
    return R.not_in_reference(found, F.col("repo"), corpus.where("status = 'error'"), F.col("archive_id"))


@query("harvest_stream", r"select distinct regexp_replace(origin, '^paper:', '') as arxiv_id, date_trunc('day', added_at)::date as created from documents where starts_with(origin, 'paper:') and added_at >= '2024-01-01' and added_at < '2024-07-01'")
def _(spark, d):
    """S-25, S-27, F-19, R-03, R-04, R-06: a listing as a stream of pages whose offset is kept; each batch is appended once, and a second run
    goes on where the first one ended. Records without an id or a date are dropped, and those of other months."""
    to = scratch(spark)
    documents = read_table(spark, d, "documents").where("origin is not null")
    record = F.format_string("<record><id>%s</id><created>%s</created></record>", F.regexp_replace("origin", "^paper:", ""), F.coalesce(F.date_format("added_at", "yyyy-MM-dd"), F.lit("unknown")))
    _landed(spark, f"{to}/pages", documents.where("startswith(origin, 'paper:')").select(record.alias("record")).distinct(), size=2000)
    spark.dataSource.register(harvest.PagedSource)
    for _ in range(2):
        stream = spark.readStream.format("paged").option("fetch", "inkmill.sources.harvest:landed").option("argument", f"{to}/pages").load()
        S.append_batches(stream, f"{to}/out", f"{to}/state").awaitTermination()
    rows = files.harvest_records(spark.read.schema("record string").parquet(f"{to}/out"), "record")
    return rows.where("created between date'2024-01-01' and date'2024-06-30'")


@query("harvest_parse", "select doc_id, case when added_at is not null then origin end as arxiv_id, case when origin is not null then added_at::date end as created from documents")
def _(spark, d):
    """S-27: a record without an id or a date gives neither."""
    record = F.concat(F.lit("<record><header/><id> "), F.coalesce("origin", F.lit("")), F.lit("</id>\n<created>"), F.coalesce(F.date_format("added_at", "yyyy-MM-dd"), F.lit("n/a")), F.lit("</created></record>"))
    return files.harvest_records(read_table(spark, d, "documents").select("doc_id", record.alias("record")), "record", "doc_id")


@query("listing_new", """select name, month from (select distinct 'arXiv_src_' || substr(regexp_replace(file_id, '[^0-9]', '', 'g') || '0000', 1, 2) || '0' || (1 + length(file_id) % 9) || '_' || substr(md5(file_id), 1, 3) || '.tar' as name,
case when substr(regexp_replace(file_id, '[^0-9]', '', 'g') || '0000', 1, 2)::int >= 91 then make_date(1900 + substr(regexp_replace(file_id, '[^0-9]', '', 'g') || '0000', 1, 2)::int, 1 + length(file_id) % 9, 1) else make_date(2000 + substr(regexp_replace(file_id, '[^0-9]', '', 'g') || '0000', 1, 2)::int, 1 + length(file_id) % 9, 1) end as month from corpus where source = 'arxiv') t
where month >= '2010-01-01' and not contains(name, '_abc') and not starts_with(name, 'arXiv_src_2001')""")
def _(spark, d):
    """S-28, F-20, J-07, O-03: the latest first; excluded by a part of the name, done by its beginning, old by the month in it."""
    digits = F.substring(F.concat(F.regexp_replace("file_id", "[^0-9]", ""), F.lit("0000")), 1, 2)
    name = F.concat(F.lit("arXiv_src_"), digits, F.lit("0"), (1 + F.length("file_id") % 9).cast("string"), F.lit("_"), F.substring(F.md5("file_id"), 1, 3), F.lit(".tar"))
    listed = read_table(spark, d, "corpus").where("source = 'arxiv'").select(name.alias("name")).distinct().unionByName(spark.createDataFrame([("arXiv_pdf_2001_001.tar",)], "name string"))
    exclude, done = (spark.createDataFrame([(v,)], f"{n} string") for v, n in (("_abc", "part"), ("arXiv_src_2001", "start")))
    return files.archive_names(listed, "name", exclude, done, "2010-01-01")


@query("page_links", r"""select id, list_transform(regexp_extract_all(body, '<a\s[^>]*?href="([^"]*)"', 1), lambda l: case when regexp_matches(l, '^\w+:') then l when starts_with(l, '//') then 'https:' || l when starts_with(l, '/') then 'https://pages.example' || l else 'https://pages.example/list/' || l end) as links from posts where body is not null""")
def _(spark, d):
    """S-23, S-24, X-14: the links of landed pages, made absolute."""
    base = F.lit("https://pages.example/list/index.html")
    return read_table(spark, d, "posts").where("body is not null").select("id", F.transform(X.page_links("body"), lambda l: X.resolved(l, base)).alias("links"))


@query("landed_files", "select distinct archive_id || '.json' as name, (octet_length(encode(archive_id)) + 2)::bigint as bytes, false as failed from corpus where archive_id is not null union all select 'gone.json', null, true")
def _(spark, d):
    """S-23, S-24, E-05: files of a list of addresses are landed in a folder, twice, where the second run reads nothing; one is missing."""
    to = scratch(spark)
    ids = read_table(spark, d, "corpus").select("archive_id").where("archive_id is not null").distinct()
    sinks.write_files(ids.select(F.concat("archive_id", F.lit(".json")).alias("path"), F.concat(F.lit("<"), "archive_id", F.lit(">")).alias("content")), f"{to}/site")
    names = ids.select(F.concat("archive_id", F.lit(".json")).alias("name")).unionByName(spark.createDataFrame([("gone.json",)], "name string"))
    listed = names.select("name", F.concat(F.lit(f"{to}/site/"), "name").alias("address"))
    B.landed_files(listed, "address", "name", f"{to}/landed")
    found = B.landed_files(listed, "address", "name", f"{to}/landed")
    return found.select(F.substring_index("address", "/", -1).alias("name"), "bytes", F.col("error").isNotNull().alias("failed"))


# --- tables ---------------------------------------------------------------------------------------------------------
@query("read_shards", "select file_id, ((row_number() over (order by file_id) - 1) % 10)::int as shard from corpus")
def _(spark, d):
    """S-30, K-07: ten shards written and read back as one."""
    to = scratch(spark)
    sinks.write_table(O.sharded(read_table(spark, d, "corpus").select("file_id"), ["file_id"]), to, "shard")
    return sinks.read_table_parts(spark, to).select("file_id", F.col("shard").cast("int").alias("shard"))


@query("archive_chunks", "select archive_id, count(*)::bigint as n, min(file_id) as first from corpus where archive_id is not null group by archive_id")
def _(spark, d):
    """K-06: a folder for each archive."""
    to = scratch(spark)
    sinks.write_table(read_table(spark, d, "corpus").select("archive_id", "file_id").where("archive_id is not null"), to, "archive_id")
    return spark.read.schema("file_id string, archive_id string").parquet(to).groupBy("archive_id").agg(F.count("*").alias("n"), F.min("file_id").alias("first"))


@query("append_merge", "select file_id, new_caption from captions")
def _(spark, d):
    """K-05, K-10: what is there is kept."""
    to, rows = scratch(spark), read_table(spark, d, "captions")
    first = F.coalesce(F.length("new_caption"), F.lit(0)) % 2 == 0
    sinks.append_table(rows.where(first), to)
    sinks.append_table(rows.where(~first), to)
    return spark.read.parquet(to)


@query("replace_in_place", "select file_id, upper(new_caption) as new_caption from captions where file_id is not null")
def _(spark, d):
    """K-09: a table takes the place of the one it was made from."""
    to = scratch(spark)
    sinks.append_table(read_table(spark, d, "captions"), to)
    sinks.replace_table(spark, spark.read.parquet(to).where("file_id is not null").withColumn("new_caption", F.upper("new_caption")), to)
    return spark.read.parquet(to)


@query("save_images", f"select file_id, octet_length(encode(file_id))::bigint + {len(_PNG) // 2} as size from corpus where source = 'curated'")
def _(spark, d):
    """K-12: an image a file."""
    to = scratch(spark)
    rows = read_table(spark, d, "corpus").where("source = 'curated'")
    sinks.write_files(rows.select(F.concat("file_id", F.lit(".png")).alias("path"), _image("file_id").alias("content")), to)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(to)
    return found.select(F.regexp_extract("path", r"([^/]*)\.png$", 1).alias("file_id"), F.col("length").alias("size"))


@query("report_lines", "select i::int as place, metric, value::double as value from (select unnest([0, 1, 2]) as i, unnest(['rows', 'compiled', 'captions']) as metric, unnest([count(*), count(*) filter (status = 'success'), count(caption)]) as value from corpus) t")
def _(spark, d):
    """K-13, A-01."""
    return sinks.report_lines(read_table(spark, d, "corpus").agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "success").alias("compiled"), F.count("caption").alias("captions")))


@query("feature_cache", "select key, n from (select sha256(caption) as key, max(length(caption))::int as n from corpus where caption is not null group by 1) t where key is not null")
def _(spark, d):
    """J-17, S-32, E-07, R-04: what a table holds is not computed again: the second run only adds what is new."""
    to = f"{scratch(spark)}/cache"
    rows = read_table(spark, d, "corpus").where("caption is not null").select(F.sha2("caption", 256).alias("key"), "caption", "source")
    sizes = lambda df: df.select("key", F.length("caption").alias("n"))
    B.cached_apply(rows.where("source = 'arxiv'"), "key", sizes, to)
    return B.cached_apply(rows, "key", sizes, to)


# --- records --------------------------------------------------------------------------------------------------------
over("page_description", "corpus", rf"""select file_id, case when b = '' then 'No Description' else {s_collapse("case when contains(lower(b), lower(h)) then b when regexp_matches(h || '. ' || b, '[!-/:-@\\[-`{-~]$') then h || '. ' || b else h || '. ' || b || '.' end")} end as description
from (select file_id, {s_strip("coalesce(caption, '')")} as b, coalesce(source, '') as h from corpus) t""", lambda: ["file_id", T.page_description("caption", "source").alias("description")])
over("figure_title", "corpus", rf"select file_id, {s_strip('''split_part(caption, chr(8211), 1)''')} as title from corpus where caption is not null and not starts_with(caption, 'Figure ')", lambda: ["file_id", T.figure_title("caption").alias("title")], where="caption is not null and not startswith(caption, 'Figure ')")
over("ascii_fold", "corpus", rf"select file_id, regexp_replace(strip_accents(regexp_replace(replace(caption, chr(160), ' '), '[\x{{2010}}-\x{{2015}}\x{{2212}}]', '-', 'g')), '[^\x00-\x7f]', '', 'g') as caption from corpus", lambda: ["file_id", T.ascii_fold("caption").alias("caption")])
over("positional_id", "corpus", "select file_id, concat_ws('_', source, archive_id, len(text_mentions)::varchar) as id from corpus", lambda: ["file_id", C.positional_id("source", "archive_id", F.when(F.col("text_mentions").isNotNull(), F.size("text_mentions")).cast("string")).alias("id")])
over("request_text", "corpus", rf"select file_id, 'Generate a complete LaTeX document that contains a TikZ figure according to the following requirements:' || chr(10) || caption || chr(10) || 'Wrap your code using \documentclass[tikz]{{standalone}}, and include \begin{{document}}...\end{{document}}. Only output valid LaTeX code with no extra text.' as prompt from corpus", lambda: ["file_id", Q.code_request("caption").alias("prompt")])
over("format_document", "corpus", r"select file_id, concat_ws(chr(10), '\documentclass[tikz]{standalone}', '\usepackage{tikz}', '\begin{document}', '% before', code, '% after', '\end{document}') as document from corpus where code is not null", lambda: ["file_id", L.format_as_document("code", F.lit("\\usepackage{tikz}"), F.lit("% before"), F.lit("% after")).alias("document")], where="code is not null")


@query("run_names", "select 'model-8b_epochs-3_packed' as name")
def _(spark, d):
    """P-11."""
    return spark.createDataFrame([(C.run_name(model="8b", epochs=3, packed=True, resume=False, seed=None),)], "name string")


@query("code_after", "select caption as query, coalesce(code, '') as code, file_id from corpus")
def _(spark, d):
    """P-13, F-22: a column after another one; code that is there stays."""
    rows = read_table(spark, d, "corpus").select(F.col("caption").alias("query"), "file_id", "code")
    return C.with_code_after(rows, F.lit(""))


@query("merge_results", "select file_id, coalesce(s, status_new) as status_new, coalesce(l, log_new) as log_new from corpus left join (select file_id as f, 'success' as s, md5(code_new) as l from corpus where code_new is not null) t on f = file_id")
def _(spark, d):
    """J-12: compile results joined by key."""
    corpus = read_table(spark, d, "corpus")
    results = corpus.where("code_new is not null").select("file_id", F.lit("success").alias("status"), F.md5("code_new").alias("log"))
    return R.merge_results(corpus.select("file_id", "status_new", "log_new"), results)


@query("second_download", "select distinct archive_id from corpus where source = 'tex' and archive_id is not null and archive_id not in (select archive_id from corpus where source = 'tex' and status = 'success' and archive_id is not null) union all select distinct archive_id from corpus where source = 'tex' and status = 'success' and archive_id is not null")
def _(spark, d):
    """D-07: what the first of two downloads has, and what only the second has."""
    rows = read_table(spark, d, "corpus").where("source = 'tex' and archive_id is not null").select("archive_id", "status")
    return R.union_less(rows.where("status = 'success'").select("archive_id").distinct(), rows.select("archive_id").distinct(), "archive_id")


@query("typed_captions", f"select file_id, new_caption from captions where file_id is not null and new_caption is not null and not {s_blank('new_caption')}")
def _(spark, d):
    """F-05, F-06."""
    return R.with_values(read_table(spark, d, "captions"), "file_id", "new_caption", filled=("new_caption",))


# --- answers of models, pages, manuals -------------------------------------------------------------------------------
@query("qa_rows", f"select distinct figure_id, text as new_caption from (select 'fig-' || file_id as figure_id, {s_collapse('new_caption')} as text from captions where file_id is not null) t where text is not null and text <> ''")
def _(spark, d):
    """X-21, S-07, D-03: figures from maps of questions and answers; a list of references is crossed with the text, and tables are dropped."""
    rows = read_table(spark, d, "captions").where("file_id is not null")
    name = F.concat(F.lit("fig-"), "file_id", F.lit(".png"))
    ref = F.concat(F.lit('["'), name, F.lit('","a-Table-1.png"]'))
    qa = F.struct(F.when(F.length("file_id") % 2 == 0, ref).alias("reference"), F.when(F.length("file_id") % 2 == 1, name).alias("reference_figure"), F.lit(None).cast("string").alias("reference_figures"), F.lit(" ").alias("explanation"), F.col("new_caption").alias("rationale"), F.lit(None).cast("string").alias("image_description"))
    papers = rows.groupBy(F.substring(F.md5("file_id"), 1, 3).alias("paper")).agg(F.collect_list(qa).alias("qa"))
    maps = papers.select(F.to_json(F.create_map("paper", F.struct("qa"))).alias("json"))
    return X.qa_rows(maps, "json")


@query("query_rows", "select file_id, (i - 1)::int as j, 'q' || i as query_key, caption || ' ' || i as query from corpus, (select unnest(range(1, 11)) as i) r where caption is not null")
def _(spark, d):
    """X-22, T-36: maps within a fence, of which ten entries count."""
    entries = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct(F.concat(F.lit("q"), i.cast("string")), F.concat(F.col("caption"), F.lit(" "), i.cast("string")))))
    rows = read_table(spark, d, "corpus").where("caption is not null").select("file_id", F.concat(F.lit("```json\n"), F.to_json(entries), F.lit("\n```")).alias("response"))
    return X.query_rows(rows, "file_id", "response").select("file_id", F.col("j").cast("int").alias("j"), "query_key", "query")


@query("template_rows", "select file_id, i::int as j, 'Draw ' || caption as template, source as term from corpus, (select unnest([1, 3]) as i) r where caption is not null")
def _(spark, d):
    """X-23: pairs of templates and terms; a template without terms gives nothing."""
    terms = F.to_json(F.create_map(F.lit("thing"), F.array("source")))
    text = F.concat(F.lit("Draw "), "caption")
    answer = F.to_json(F.create_map(F.lit("template_1"), text, F.lit("terms_1"), terms, F.lit("template_2"), text, F.lit("template_3"), text, F.lit("terms_3"), terms))
    rows = read_table(spark, d, "corpus").where("caption is not null").select("file_id", F.concat(F.lit("```json\n"), answer, F.lit("\n```")).alias("response"))
    return X.template_rows(rows, "file_id", "response").select("file_id", F.col("j").cast("int").alias("j"), "template", F.col("terms")["thing"][0].alias("term"))


_BLOCK = "<h2>Nodes</h2><p>Old text</p><pre>x</pre><p align=\"center\">A title</p><p>About "


@query("html_blocks", f"select file_id, 'x' as code, 'Old text' as description, 'Nodes' as heading, 'Untitled' as title from corpus where not {s_blank('code')} union all select file_id, {s_strip('code')}, 'A title About ' || file_id, 'Nodes', 'A title' from corpus where not {s_blank('code')}")
def _(spark, d):
    """X-12, X-13, X-15: the code blocks of pages with what stands before them."""
    escaped = F.replace(F.replace(F.col("code"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = read_table(spark, d, "corpus").where(~T.is_blank("code")).select("file_id", F.concat(F.lit(_BLOCK), "file_id", F.lit("</p><pre>"), escaped, F.lit("</pre>")).alias("html"))
    return rows.select("file_id", F.explode(K.html_blocks("html")).alias("b")).select("file_id", "b.*")


@query("manual_examples", rf"select file_id, {s_strip('code')} as code, 'x' as pre, source as section, 'Some text on ' || file_id as description from corpus where code is not null and not contains(code, 'codeexample')")
def _(spark, d):
    """X-18, W-05, T-23, F-23: the visible examples of a manual with their options, section and text."""
    rows = read_table(spark, d, "corpus").where("code is not null and not contains(code, 'codeexample')")
    text = F.concat(F.lit("\\section{"), "source", F.lit("}\nSome text on\n "), "file_id", F.lit("\n\\begin{codeexample}[pre={x}, width=2cm]\n"), "code", F.lit("\n\\end{codeexample}\n\\begin{codeexample}[hidden]\ny\n\\end{codeexample}\n"))
    found = rows.select("file_id", F.explode(K.manual_examples(text)).alias("e")).select("file_id", "e.*")
    return found.where("not hidden and not code_only").select("file_id", "code", "pre", "section", "description")


# --- vectors, tokens, user functions, effects -------------------------------------------------------------------------
@query("merged_images", "select file_id, [0, 1, null, null, 2] as places from corpus where length(file_id) % 2 = 0 union all select file_id, [0, 1, null, null, null] from corpus where length(file_id) % 2 = 1")
def _(spark, d):
    """M-18: the places of image tokens, as far as there are patches."""
    ids = F.array(*(F.lit(v) for v in (9, 9, 4, 5, 9)))
    patches = F.when(F.length("file_id") % 2 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    return read_table(spark, d, "corpus").select("file_id", Q.merge_image_tokens(ids, patches, 9).alias("places"))


over("image_length", "part", "select p_partkey, ((p_size * 14 // 14) * (p_size * 14 // 14) // 3)::int as n from part", lambda: ["p_partkey", Q.image_length(F.col("p_size") * 14).alias("n")])
over("perceptual_similarity", "embeddings", "select vec_id, 1 - (label / 4) as similarity, greatest(0.0::double, least(1.0::double, 1 - (label / 4))) as reward from embeddings", lambda: ["vec_id", M.distance_similarity(F.col("label") / 4).alias("similarity"), M.distance_similarity(F.col("label") / 4, clamp=True).alias("reward")])
over("last_patches", "embeddings", "select vec_id, len(embedding[-48:])::int as n, embedding[17]::double as first from embeddings", lambda: ["vec_id", F.size(F.flatten(M.drop_leading_patches(M.bagged("embedding", 8), 6))).alias("n"), M.drop_leading_patches(M.bagged("embedding", 8), 6)[0][0].cast("double").alias("first")])
over("pixel_values", "part", "select p_partkey, [(p_size * (1.0::double / 255) - 0.5) / 0.5, (255 * (1.0::double / 255) - 0.5) / 0.5] as pixels from part", lambda: ["p_partkey", F.transform(M.normalised_pixels(F.array(F.col("p_size"), F.lit(255)), scale=1.0 / 255), lambda x: x).alias("pixels")])


def _drawn(size):
    """A white image of 24 x 16 points with a box of ``size`` % 8 x 5 points at (3, 4)."""
    import numpy as np

    pixels = np.full((16, 24, 3), 255, np.uint8)
    pixels[4:9, 3 : 3 + size % 8] = (0, size % 200, 90)
    return I.encode_png(pixels)


@query("image_content", "select p_partkey, p_size % 8 = 0 as empty, case when p_size % 8 > 0 then [3, 4, 3 + p_size % 8, 9]::int[] end as box, case when p_size % 8 > 0 then p_size % 8 * 5 else 384 end::int as points from part")
def _(spark, d):
    """F-25, M-09: images of one colour, the box of what is drawn, and trimmed images."""
    images = read_table(spark, d, "part").select("p_partkey", F.udf(_drawn, "binary", useArrow=True)("p_size").alias("png"))
    # a trimmed box is of one colour; its points are told by the header
    header = lambda at: F.conv(F.hex(F.substring(I.trimmed("png"), at, 4)), 16, 10).cast("int")
    return images.select("p_partkey", I.is_single_colour("png").alias("empty"), I.content_box("png").alias("box"), (header(17) * header(21)).alias("points"))


@query("mapped_batches", "select file_id, len(string_split(code, chr(10)))::bigint as n from corpus where length(code) > 200")
def _(spark, d):
    """U-01, U-02: a function over batches that drops rows."""

    def count(frame):
        kept = frame[frame["code"].str.len() > 200]
        return kept.assign(n=kept["code"].str.count("\n") + 1)[["file_id", "n"]]

    rows = read_table(spark, d, "corpus").where("code is not null").select("file_id", "code")
    return B.mapped(rows, count, "file_id string, n long")


@query("scored_pairs", "select file_id, abs(length(caption) - length(new_caption))::double as score from corpus where caption is not null and new_caption is not null")
def _(spark, d):
    """U-03, U-04: a registered scorer of batches of pairs."""
    B.SCORERS.register("length", lambda a, b: (a.str.len() - b.str.len()).abs().astype(float))
    rows = read_table(spark, d, "corpus").where("caption is not null and new_caption is not null")
    return rows.select("file_id", B.score_pairs(F.col("caption"), F.col("new_caption"), B.SCORERS.get("length")).alias("score"))


@query("generated", "select file_id, case when length(caption) % 5 <> 0 then caption end as response, case when length(caption) % 5 = 0 then 'ValueError: no answer' end as error from corpus where caption is not null")
def _(spark, d):
    """U-05, E-03, M-25: answers of a registered generator; a call that fails in the end leaves its error."""

    def answer(prompt: str) -> str:
        if len(prompt) % 5 == 0:
            raise ValueError("no answer")
        return prompt

    B.GENERATORS.register("echo-or-fail", answer)
    return B.generate(read_table(spark, d, "corpus").where("caption is not null"), "file_id", "caption", "echo-or-fail")


@query("resolved_inputs", rf"select archive_id as project, 'main.tex' as path, 'Begin ' || string_agg(code, ' ' order by file_id) || ' \input{{gone}}' as text from corpus where archive_id is not null and code is not null and source = 'curated' and not contains(code, '\input') and not contains(code, '\include') group by archive_id")
def _(spark, d):
    r"""E-02: files put in the place of the commands that name them, through one level between; a missing file's command stays."""
    rows = read_table(spark, d, "corpus").where(r"archive_id is not null and code is not null and source = 'curated' and not contains(code, '\\input') and not contains(code, '\\include')")
    parts = rows.select(F.col("archive_id").alias("project"), F.concat("file_id", F.lit(".tex")).alias("path"), F.col("code").alias("text"))
    middle = rows.groupBy(F.col("archive_id").alias("project")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("file_id")), lambda f: F.concat(F.lit("\\input{"), f, F.lit("}"))), " ").alias("text")).select("project", F.lit("middle.tex").alias("path"), "text")
    main = middle.select("project", F.lit("main.tex").alias("path"), F.lit("Begin \\include{middle.tex} \\input{gone}").alias("text"))
    return B.resolve_inputs(parts.unionByName(middle).unionByName(main)).where("path = 'main.tex'").select("project", "path", "text")


@query("polled_batches", "select event_type, count(*)::bigint as n from events group by event_type")
def _(spark, d):
    """R-06, R-07: a stream in batches, each appended once; run twice, as a polling loop would be."""
    to, source = scratch(spark), f"{d}/events.parquet"
    df = spark.read.parquet(source)
    df.select("event_id", "event_type").write.parquet(f"{to}/in")
    for _ in range(2):
        S.append_batches(spark.readStream.schema("event_id bigint, event_type string").parquet(f"{to}/in"), f"{to}/out", f"{to}/state").awaitTermination()
    return spark.read.schema("event_id bigint, event_type string").parquet(f"{to}/out").groupBy("event_type").agg(F.count("*").alias("n"))
