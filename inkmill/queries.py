r"""The engine's queries over a data folder, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill import boundary
from inkmill.functions import extraction as X
from inkmill.functions import latex as L
from inkmill.functions import macros as MX
from inkmill.functions import sequences as Q
from inkmill.functions import text as T
from inkmill.operators import assembly as A
from inkmill.operators import dedup as D
from inkmill.operators import metrics as M
from inkmill.operators import records as C
from inkmill.operators import relational as R
from inkmill.operators import sampling as O
from inkmill.plans import curated_pairs, evaluation
from inkmill.plans import extraction as figures_plan
from inkmill.session import checkpoint_dir, shuffle_partitions, spread
from inkmill.sources.files import month_ranges
from inkmill.sources.tables import read_table
from inkmill.streaming import assembly as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


#: Queries whose expressions cost more than a shuffle of a small table.
COSTLY = {"clean_code", "drop_comment_lines", "collapse_space", "remove_empty_lines", "filter_lines", "build_preamble", "required_packages", "token_budget", "preamble_parts", "macro_expand", "paragraphs", "page_documents", "inject_package", "trim_environment", "html_text", "clean_caption", "as_document", "uncomment"}


def over(name: str, table: str, sql: str | None, columns: Callable[[], list], where: str | None = None) -> None:
    """A query that selects columns from one table. They are made when it runs, as columns need a session."""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = read_table(spark, d, table)
        df = spread(df) if name in COSTLY else df
        return (df.where(where) if where else df).select(*columns())


# --- SQL by parts ---------------------------------------------------------------------------------------------------
S_ = T.SPACE


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S_}+|{S_}+$', '', 'g')"


def s_rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{S_}+$', '', 'g')"


def s_lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{S_}+', '', 'g')"


def s_blank(x: str) -> str:
    return f"(coalesce({s_strip(x)}, '') = '')"


def s_collapse(x: str) -> str:
    rx = f"regexp_replace({x}, '{S_}+', ' ', 'g')"
    return s_strip(rx)


def s_lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def s_join(x: str, by: str = "chr(10)") -> str:
    return f"coalesce(array_to_string({x}, {by}), '')"


def s_uncomment(x: str) -> str:
    return s_rstrip(rf"regexp_replace({x}, '(?s)^((?:[^%\\]|\\.)*)%.*$', '\1')")


def s_clean(x: str) -> str:
    kept = f"list_filter({s_lines(x)}, lambda l: not starts_with({s_lstrip('l')}, '%'))"
    return s_strip(s_join(f"list_transform({kept}, lambda l: {s_uncomment('l')})"))


def s_drop(x: str, *patterns: str) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return x


def s_any(x: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


def s_contains_any(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


def s_detect(x: str, rules) -> str:
    parts = ", ".join(f"case when {s_any(x, p)} then '{n}' end" for n, p in rules.items())
    return f"list_sort(list_filter([{parts}], lambda e: e is not null))"


# --- filters, projections, joins ------------------------------------------------------------------------------------
@query("corpus_filter", "select file_id, source, code_length from corpus where status = 'success' and source in ('arxiv', 'tex') and code_length between 100 and 4000")
def _(spark, d):
    return R.filter_corpus(read_table(spark, d, "corpus"), "arxiv_tex", True).select("file_id", "source", "code_length")


@query("corpus_filter_computed", "select file_id, length(code)::bigint as n from corpus where length(code) between 100 and 4000")
def _(spark, d):
    return R.filter_corpus(read_table(spark, d, "corpus"), computed=True).select("file_id", F.length("code").cast("bigint").alias("n"))


_CAP, _NEW, _MEN = "coalesce(caption, '')", "coalesce(new_caption, '')", "coalesce(array_to_string(text_mentions, ' '), '')"
_VARIANT_SQL = {
    "caption": _CAP,
    "text_mentions": _MEN,
    "caption_text_mentions": s_strip(f"{_CAP} || ' ' || {_MEN}"),
    "new_caption": _NEW,
    "caption_or_new_caption": f"case when {s_blank('caption')} then {_NEW} else {_CAP} end",
    "new_caption_comparison": f"case when {s_blank('caption')} then '' else {_NEW} end",
}
for _name, _sql in _VARIANT_SQL.items():

    @query(f"variant_{_name}", f"select file_id, text from (select file_id, {_sql} as text from corpus) t where not {s_blank('text')}")
    def _(spark, d, v=_name):
        return R.with_texts(read_table(spark, d, "corpus"), v).select("file_id", "text")


@query("dual_emit", f"select file_id, text from (select file_id, {s_strip(_CAP)} as text from corpus union all select file_id, {s_strip(_NEW)} from corpus) t where text <> ''")
def _(spark, d):
    return R.with_texts(read_table(spark, d, "corpus"), "caption_and_new_caption").select("file_id", "text")


@query("source_validate", "select source, count(*)::bigint as n from corpus where source in ('arxiv', 'github', 'tex', 'synthetic', 'curated') group by source")
def _(spark, d):
    return read_table(spark, d, "corpus").where(F.col("source").isin(*R.parse_sources("arxiv_github_tex_synthetic_curated"))).groupBy("source").agg(F.count("*").alias("n"))


@query("first_match_left", "select c.file_id, k.new_caption as later from corpus c left join (select file_id, min(new_caption) as new_caption from captions where file_id is not null group by file_id) k on c.file_id = k.file_id")
def _(spark, d):
    late = read_table(spark, d, "captions").where("new_caption is not null").withColumnRenamed("new_caption", "later")
    return R.left_first(read_table(spark, d, "corpus").select("file_id"), "file_id", late, "file_id", ["later"], ["later"])


@query("semi_exists", "select file_id from corpus c where exists (select 1 from captions k where k.file_id = c.file_id)")
def _(spark, d):
    return read_table(spark, d, "corpus").select("file_id").join(read_table(spark, d, "captions").select("file_id").distinct(), "file_id", "left_semi")


@query("anti_captions", "select distinct file_id from captions k where file_id is not null and not exists (select 1 from corpus c where k.file_id = c.file_id)")
def _(spark, d):
    late = read_table(spark, d, "captions").where("file_id is not null").select("file_id").distinct()
    return R.not_in_reference(late, F.col("file_id"), read_table(spark, d, "corpus"), F.col("file_id"))


@query("anti_reference", "select file_id from corpus where code is null or sha256(code) not in (select sha256(code) from eval_gt where code is not null)")
def _(spark, d):
    corpus = read_table(spark, d, "corpus").select("file_id", "code")
    return R.not_in_reference(corpus, T.code_hash("code"), read_table(spark, d, "eval_gt"), T.code_hash("code")).select("file_id")


@query("theta_anti_prefix", "select distinct archive_id from corpus c where archive_id is not null and not exists (select 1 from (select distinct left(archive_id, 8) as p from corpus where source = 'github' and archive_id is not null) g where starts_with(c.archive_id, g.p))")
def _(spark, d):
    corpus = read_table(spark, d, "corpus")
    done = corpus.where("source = 'github' and archive_id is not null").select(F.substring("archive_id", 1, 8).alias("p")).distinct()
    return R.without_prefixes(corpus.where("archive_id is not null").select("archive_id").distinct(), "archive_id", done, "p")


@query("theta_anti_substring", "select doc_id from documents t where text is not null and not exists (select 1 from (select distinct source as p from corpus where source is not null) g where contains(t.text, g.p))")
def _(spark, d):
    parts = read_table(spark, d, "corpus").select(F.col("source").alias("p")).distinct()
    return R.without_substrings(read_table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text", parts, "p").select("doc_id")


@query("needs_compile", "select file_id from corpus where status is distinct from 'success' and code_new is not null and code_new <> coalesce(code, '')")
def _(spark, d):
    return R.needs_compile(read_table(spark, d, "corpus")).select("file_id")


@query("union_by_name", "select file_id, new_caption, null::varchar as response from captions union all select file_id, null, response from repair_responses")
def _(spark, d):
    return R.union_by_name(read_table(spark, d, "captions"), read_table(spark, d, "repair_responses")).select("file_id", "new_caption", "response")


@query("distinct_pairs", "select distinct file_id, new_caption from captions")
def _(spark, d):
    return D.dedup_distinct(read_table(spark, d, "captions"), ["file_id", "new_caption"])


@query("dedup_exact", "select min(file_id) as file_id from corpus group by sha256(code)")
def _(spark, d):
    return D.dedup_exact(read_table(spark, d, "corpus").select("file_id", "code")).select("file_id")


@query("dedup_exact_scope", "select min(file_id) as file_id, archive_id from corpus where code is null or sha256(code) not in (select sha256(code) from eval_gt where code is not null) group by sha256(code), archive_id")
def _(spark, d):
    return D.dedup_exact(read_table(spark, d, "corpus").select("file_id", "code", "archive_id"), reference=read_table(spark, d, "eval_gt"), scope="archive_id").select("file_id", "archive_id")


@query("greedy_near_dedup")
def _(spark, d):
    captions = read_table(spark, d, "corpus").select("file_id", "caption").where(~T.is_blank("caption"))
    return D.greedy_near_dedup(captions, "file_id", "caption").select("file_id")


# --- order, samples, shards -----------------------------------------------------------------------------------------
@query("seeded_sample", "select file_id from corpus order by md5('42|' || file_id), file_id limit 100")
def _(spark, d):
    return O.sample(read_table(spark, d, "corpus").select("file_id"), "file_id", 42, n=100)


@query("seeded_fraction", "select doc_id from documents order by md5('7|' || doc_id::varchar), doc_id limit (select (count(*) * 0.25)::bigint from documents)")
def _(spark, d):
    return O.sample(read_table(spark, d, "documents").select("doc_id"), "doc_id", 7, fraction=0.25)


@query("shard_strided", "select file_id, ((row_number() over (order by file_id) - 1) % 10)::int as shard from corpus")
def _(spark, d):
    return O.sharded(read_table(spark, d, "corpus").select("file_id"), ["file_id"])


@query("shard_contiguous", "select file_id, (ntile(10) over (order by file_id) - 1)::int as shard from corpus")
def _(spark, d):
    return O.sharded(read_table(spark, d, "corpus").select("file_id"), ["file_id"], contiguous=True)


@query("chunked", "select file_id, ((row_number() over (order by file_id) - 1) // 512)::bigint as chunk from corpus")
def _(spark, d):
    return O.chunked(read_table(spark, d, "corpus").select("file_id"), ["file_id"], 512)


@query("first_k_per_source", "select source, file_id from (select source, file_id, row_number() over (partition by source order by file_id) as n from corpus) t where n <= 10")
def _(spark, d):
    return O.first_k(read_table(spark, d, "corpus").select("source", "file_id"), ["source"], ["file_id"], 10)


@query("numeric_suffix", r"select distinct archive_id, try_cast(regexp_extract(archive_id, '(\d+)$', 1) as int) as number from corpus where archive_id is not null")
def _(spark, d):
    return read_table(spark, d, "corpus").where("archive_id is not null").select("archive_id", O.numeric_suffix("archive_id").alias("number")).distinct()


@query("ngram_topk", r"select ngram, count(*)::bigint as n from (select unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as ngram from (select regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') as w from documents) t) u group by ngram order by n desc, ngram limit 500")
def _(spark, d):
    words = spread(read_table(spark, d, "documents").select("text")).select(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}]+"), 0).alias("w"))
    grams = words.select(F.explode(Q.joined_ngrams("w", 2)).alias("ngram"))
    return O.top_k(grams.groupBy("ngram").agg(F.count("*").alias("n")), [F.desc("n"), F.col("ngram")], 500)


# --- text -----------------------------------------------------------------------------------------------------------
over("clean_code", "corpus", f"select file_id, {s_clean('code')} as code from corpus where code is not null", lambda: ["file_id", T.clean_code("code").alias("code")], where="code is not null")
over("drop_comment_lines", "corpus", f"select file_id, {s_strip(s_join(f'''list_filter({s_lines('code')}, lambda l: not starts_with({s_lstrip('l')}, '%'))'''))} as code from corpus where code is not null", lambda: ["file_id", T.drop_comment_lines("code").alias("code")], where="code is not null")
over("strip_text", "corpus", f"select file_id, {s_strip('caption')} as caption, {s_blank('caption')} as blank from corpus", lambda: ["file_id", T.strip("caption").alias("caption"), T.is_blank("caption").alias("blank")])
over("collapse_space", "documents", f"select doc_id, {s_collapse('text')} as text from documents", lambda: ["doc_id", T.collapse_space("text").alias("text")])
over("truncate_500", "documents", "select doc_id, left(text, 500) as text from documents", lambda: ["doc_id", T.truncate("text").alias("text")])
over("first_lines", "corpus", f"select file_id, {s_join(s_lines('code') + '[1:5]')} as head from corpus where code is not null", lambda: ["file_id", T.first_lines("code", 5).alias("head")], where="code is not null")
over("last_lines", "corpus", f"select file_id, {s_join(s_lines('code') + '[-5:]')} as tail from corpus where code is not null", lambda: ["file_id", T.last_lines("code", 5).alias("tail")], where="code is not null")
over("normalise_text", "documents", r"select doc_id, regexp_replace(lower(text), '[^a-z0-9\s\x0b]', '', 'g') as text from documents", lambda: ["doc_id", T.normalise("text").alias("text")])
over("remove_empty_lines", "corpus", f"select file_id, {s_join(f'''list_filter({s_lines('code')}, lambda l: not {s_blank('l')})''')} as code from corpus where code is not null", lambda: ["file_id", T.remove_empty_lines("code").alias("code")], where="code is not null")
over("all_commented", "corpus", f"select file_id, len(list_filter({s_lines('code')}, lambda l: not ({s_blank('l')} or starts_with({s_lstrip('l')}, '%')))) = 0 as commented from corpus where code is not null", lambda: ["file_id", T.all_lines_start_with("code").alias("commented")], where="code is not null")
over("uncomment", "corpus", f"select file_id, {s_join(f'''list_transform({s_lines('code')}, lambda l: regexp_replace(l, '^{S_}*%', ''))''')} as code from corpus where code is not null", lambda: ["file_id", T.remove_line_prefix("code").alias("code")], where="code is not null")
over("log_excerpt", "corpus", f"""select file_id, case when coalesce(log, '') = '' then '' when p is not null then array_to_string(l[greatest(1, p - 3):p + 29], chr(10)) else array_to_string(l[-30:], chr(10)) end as excerpt
from (select file_id, log, l, list_position(list_transform(l, lambda x: starts_with(x, '! ')), true) as p from (select file_id, log, {s_lines("coalesce(log, '')")} as l from corpus) t) u""", lambda: ["file_id", T.log_excerpt("log").alias("excerpt")])
_FIRST, _LAST = "instr({0}, chr(92))", "(length({0}) - instr(reverse({0}), chr(92)) + 1)"


def s_code_of(x: str) -> str:
    last = _LAST.format(x)
    after = f"instr(substr({x}, {last}), chr(10))"
    return s_strip(f"case when {_FIRST.format(x)} = 0 then '' else substr({x}, {_FIRST.format(x)}, (case when {after} > 0 then {last} + {after} - 2 else length({x}) end) - {_FIRST.format(x)} + 1) end")


_ANSWER = r"regexp_replace(response, '(?s)<think>.*?</think>\s*', '', 'g')"
over("extract_code", "repair_responses", f"select file_id, {s_code_of('response')} as code from repair_responses where response is not null", lambda: ["file_id", T.extract_code("response").alias("code")], where="response is not null")
over("extract_repair", "repair_responses", f"select file_id, case when {s_code_of('a')} = '' then {s_strip('a')} else {s_code_of('a')} end as code from (select file_id, {_ANSWER} as a from repair_responses where response is not null) t", lambda: ["file_id", T.extract_repair("response").alias("code")], where="response is not null")
over("extract_answer", "repair_responses", rf"""select file_id, case when f = 0 then '' when e >= f then substr(response, f, e + 14 - f) else substr(response, f, {_LAST.format('response')} - f + 1) end as code
from (select file_id, response, instr(response, chr(92)) as f, instr(response, '\end{{document}}') as e from repair_responses where response is not null) t""", lambda: ["file_id", T.extract_answer("response").alias("code")], where="response is not null")
over("extract_document", "corpus", rf"select file_id, nullif(regexp_extract(code, '{T.STANDALONE}', 0), '') as document from corpus", lambda: ["file_id", T.extract_document("code").alias("document")])
over("hashes", "corpus", "select file_id, sha256(code) as sha256, sha1(code) as sha1, md5(code) as md5, to_base64(encode(caption)) as base64 from corpus", lambda: ["file_id", T.code_hash("code").alias("sha256"), F.sha1("code").alias("sha1"), F.md5("code").alias("md5"), T.base64_text("caption").alias("base64")])
over("insert_line", "corpus", rf"select file_id, array_to_string({s_lines('code')}[1:1] || ['\AtBeginDocument{{}}'] || {s_lines('code')}[2:], chr(10)) as code from corpus where code is not null", lambda: ["file_id", T.insert_after_first_line("code", r"\AtBeginDocument{}").alias("code")], where="code is not null")
over("description", "posts", f"select id, {s_strip('''concat_ws(chr(10) || chr(10), title, body)''')} as description from posts", lambda: ["id", T.description("title", "body").alias("description")])
over("paper_id", "documents", r"""select doc_id, case when not regexp_matches(x, '^[a-zA-Z-]*[\d.]+$') then null when regexp_matches(x, '^[\d.]+$') then x else regexp_replace(x, '^([a-zA-Z-]*)([\d.]+)$', '\1/\2') end as paper, split_part(x, 'v', 1) as unversioned
from (select doc_id, regexp_replace(origin, '^\w+:', case when doc_id % 2 = 0 then 'math' else '' end) as x from documents where origin is not null) t""",
     lambda: ["doc_id", T.paper_id(F.regexp_replace("origin", r"^\w+:", F.when(F.col("doc_id") % 2 == 0, F.lit("math")).otherwise(F.lit("")))).alias("paper"), T.strip_version(F.regexp_replace("origin", r"^\w+:", F.when(F.col("doc_id") % 2 == 0, F.lit("math")).otherwise(F.lit("")))).alias("unversioned")], where="origin is not null")
over("title_rules", "documents", r"""select doc_id, n as stem, replace(n, '-', ' ') as spaces, regexp_replace(n, '^.*-', '') as last_dash from (select doc_id, regexp_replace(regexp_replace(origin, '^.*/', ''), '\.[^.]*$', '') as n from documents where origin is not null) t""",
     lambda: ["doc_id", T.title_from_name("origin").alias("stem"), T.title_from_name("origin", "spaces").alias("spaces"), T.title_from_name("origin", "last_dash").alias("last_dash")], where="origin is not null")

# --- LaTeX ----------------------------------------------------------------------------------------------------------
over("has_picture", "documents", f"select doc_id, {s_contains_any('text', L.PICTURES)} as picture, {' or '.join(rf'''(contains(text, '\begin{{{e}}}') and contains(text, '\end{{{e}}}'))''' for e in L.CODE_ENVIRONMENTS)} as paired from documents where text is not null", lambda: ["doc_id", L.has_picture("text").alias("picture"), L.has_paired_environment("text").alias("paired")], where="text is not null")
over("uncompilable", "corpus", r"select file_id, regexp_matches(lower(code), '\\usetikzlibrary\{[^}]*animations[^}]*\}') or regexp_matches(lower(code), '\\usepgfmodule\{[^}]*animations[^}]*\}') or regexp_matches(code, '\\pgfmathprintnumber\s*\{[^}]+\}') as uncompilable from corpus where code is not null", lambda: ["file_id", L.is_uncompilable("code").alias("uncompilable")], where="code is not null")
over("remove_external", "documents", f"select doc_id, {s_drop('text', *L.EXTERNAL)} as text from documents", lambda: ["doc_id", L.remove_external("text").alias("text")])
over("replace_graphics", "documents", r"select doc_id, regexp_replace(text, '(\\includegraphics\*?(?:\[.*?\]){0,2})\{.+?\}', '\1{example-image}', 'g') as text from documents", lambda: ["doc_id", L.replace_graphics("text").alias("text")])
over("standard_class", "corpus", r"select file_id, regexp_replace(code, '\\documentclass(\[.*?\])?\{(article|report|book|scrartcl)\}', '\\documentclass[tikz]{standalone}', 'g') as code from corpus", lambda: ["file_id", L.standard_class("code").alias("code")])
over("required_packages", "corpus", f"select file_id, {s_detect('code', L.PACKAGES)} as packages, {s_detect('code', L.LIBRARIES)} as libraries from corpus where code is not null", lambda: ["file_id", L.required_packages("code").alias("packages"), L.required_libraries("code").alias("libraries")], where="code is not null")
over("build_preamble", "corpus", rf"""select file_id, '\documentclass[tikz]{{standalone}}' || coalesce(array_to_string(list_transform(p, lambda x: chr(10) || '\usepackage{{' || x || '}}'), ''), '') || case when len(l) > 0 then chr(10) || '\usetikzlibrary{{' || array_to_string(l, ', ') || '}}' else '' end as preamble
from (select file_id, list_sort(list_concat(['tikz'], {s_detect('code', L.PACKAGES)})) as p, {s_detect('code', L.LIBRARIES)} as l from corpus where code is not null) t""", lambda: ["file_id", L.build_preamble(L.required_packages("code"), L.required_libraries("code")).alias("preamble")], where="code is not null")
over("plot_preamble", "corpus", "select file_id, " + " || ".join([rf"'{L.PLOT_PREAMBLE[0]}'", "chr(10)", rf"'{L.PLOT_PREAMBLE[1]}'", *(f"case when {s_contains_any('code', w)} then chr(10) || '{line}' else '' end" for w, line in L.PLOT_LINES)]) + " as preamble from corpus where code is not null", lambda: ["file_id", L.plot_preamble("code").alias("preamble")], where="code is not null")
_FILTERED = rf"regexp_replace({s_drop('l', r'\\input\{[^}]*\}', r'\\includegraphics(?:\[[^\]]*\])?\{[^}]*\}', r'\\includepdf(?:\[[^\]]*\])?\{[^}]*\}')}, '\{{\s*\}}', '{{}}', 'g')"
over("filter_lines", "corpus", rf"select file_id, {s_join(rf'''list_filter(list_transform({s_lines('code')}, lambda l: {_FILTERED}), lambda x: not {s_blank('x')} and not starts_with({s_strip('x')}, '%') and not contains(x, '\maketitle') and not contains(x, '\tableofcontents'))''')} as code from corpus where code is not null", lambda: ["file_id", L.filter_lines("code").alias("code")], where="code is not null")
over("label_of", "documents", r"select doc_id, trim(regexp_extract(text, '\\label\{([^\}]+)\}', 1)) as label from documents where text is not null", lambda: ["doc_id", L.label_of("text").alias("label")], where="text is not null")
over("trim_environment", "corpus", rf"""select file_id, {s_strip(r'''case when strpos(reverse(split_part(reverse(c), chr(10), 1)), '\end{tikzpicture}') > 0 then left(c, length(c) - length(split_part(reverse(c), chr(10), 1)) + strpos(reverse(split_part(reverse(c), chr(10), 1)), '\end{tikzpicture}') + 16) else c end''')} as code
from (select file_id, case when strpos(code, '\begin{{tikzpicture}}') > 0 then substr(code, strpos(code, '\begin{{tikzpicture}}')) else code end as c from corpus where code is not null) t""", lambda: ["file_id", L.trim_to_environment("code", "tikzpicture").alias("code")], where="code is not null")
def s_first(x: str, mark: str, n: str) -> str:
    """``x`` with only its first ``n`` occurrences of a mark."""
    return f"(coalesce(array_to_string(string_split({x}, {mark})[1:({n}) + 1], {mark}), '') || coalesce(array_to_string(string_split({x}, {mark})[({n}) + 2:], ''), ''))"


def s_balance(column: str, opening: str, closing: str, source: str) -> str:
    """A table like ``source`` in whose ``column`` the surplus of the more frequent of two marks is cut from the right."""
    a, b = f"(len(string_split({column}, {opening})) - 1)", f"(len(string_split({column}, {closing})) - 1)"
    return f"(select file_id, case when {a} > {b} then {s_first(column, opening, b)} when {b} > {a} then {s_first(column, closing, a)} else {column} end as {column} from {source})"


# escaped signs are shielded by characters that no text holds
_CUT_DOLLAR = f"(select file_id, case when (len(string_split(c, '$')) - 1) % 2 = 1 then {s_first('c', chr(39) + '$' + chr(39), 'len(string_split(c, chr(36))) - 2')} else c end as c from (select file_id, replace(caption, chr(92) || '$', chr(1)) as c from corpus))"
_CUT_PARENS = s_balance("c", "chr(92) || '('", "chr(92) || ')'", f"(select file_id, replace(c, chr(1), chr(92) || '$') as c from {_CUT_DOLLAR})")
_CUT_BRACES = s_balance("c", "'{'", "'}'", f"(select file_id, replace(replace(c, chr(92) || '{{', chr(2)), chr(92) || '}}', chr(3)) as c from {_CUT_PARENS})")
_CLEANED = f"(select file_id, replace(replace(c, chr(2), chr(92) || '{{'), chr(3), chr(92) || '}}') as c from {_CUT_BRACES})"
over("clean_caption", "corpus", rf"""select file_id, {s_collapse(r"regexp_replace(c, '\\label\{[^}]*\}', '', 'g')")} as caption from {_CLEANED} t""", lambda: ["file_id", L.clean_caption("caption").alias("caption")])
over("balance_dollars", "corpus", r"""select file_id, case when len(regexp_extract_all(replace(caption, '\$', ''), '\$')) % 2 = 1 then regexp_replace(caption, '(?s)^(.*)\$', '\1') else caption end as caption from corpus where caption is not null and not contains(caption, '\$')""", lambda: ["file_id", L.balance_dollars("caption").alias("caption")], where=r"caption is not null and not contains(caption, '\\$')")
_HEAD = r"split_part(code, '\begin{document}', 1)"
_STATEMENTS = f"list_filter({s_lines(_HEAD)}, lambda l: not {s_blank('l')} and not starts_with({s_strip('l')}, '%') and not starts_with({s_strip('l')}, '\\new') and not starts_with({s_strip('l')}, '\\renew'))"
_IS_IMPORT = f"({s_contains_any('l', L.IMPORT_MARKS)} or (starts_with({s_strip('l')}, '\\usepackage') and {s_contains_any('l', L.IMPORT_PACKAGES)}))"
_PARTS_SQL = f"select file_id, {s_strip(s_join(f'list_filter({_STATEMENTS}, lambda l: {_IS_IMPORT})'))} as imports, {s_strip(s_join(f'list_filter({_STATEMENTS}, lambda l: not {_IS_IMPORT})'))} as macros from corpus where code is not null"
over("preamble_parts", "corpus", _PARTS_SQL, lambda: ["file_id", L.preamble_parts("code")["imports"].alias("imports"), L.preamble_parts("code")["macros"].alias("macros")], where="code is not null")
_LOADS = f"list_transform(list_filter({s_lines(_HEAD)}, lambda l: regexp_matches(l, '\\\\(?:usepackage|usetikzlibrary|newcommand|def|tikzset|tikzstyle)')), lambda l: {s_strip('l')})"
_PREFIX_SQL = f"""select file_id, case when len(f) > 0 then '\\documentclass[tikz]{{standalone}}' || chr(10) || array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), chr(10)) else '{L.DEFAULT_PREAMBLE}' end as prefix from (select file_id, {_LOADS} as f from corpus where code is not null) t"""
over("prefix_lines", "corpus", _PREFIX_SQL, lambda: ["file_id", L.prefix_lines("code").alias("prefix")], where="code is not null")
_OPENED = r"'\begin{document}' || chr(10)"
_AS_DOCUMENT = rf"""select file_id, case when c then '' else {"'" + L.DEFAULT_PREAMBLE.strip() + "'"} || chr(10) end || case when b then code when c and p > 0 then left(code, p - 1) || {_OPENED} || substr(code, p) when c then code || {_OPENED} else {_OPENED} || code end || case when e then '' else chr(10) || '\end{{document}}' end as document
from (select file_id, code, contains(code, '\begin{{document}}') as b, contains(code, '\end{{document}}') as e, regexp_matches(code, '\\document(class|style)') as c, strpos(code, '\begin{{') as p from corpus) t"""
over("as_document", "corpus", _AS_DOCUMENT, lambda: ["file_id", L.as_document("code").alias("document")])
over("page_documents", "corpus", None, lambda: ["file_id", F.size(L.page_documents("code")).cast("bigint").alias("n"), F.array_join(L.page_documents("code"), "\n").alias("documents")], where="code is not null")
_BARE = r"regexp_replace(code, '\\usepackage\{.*?tikz-?network.*?\}', '', 'g')"
_CLASSED = rf"case when contains(c, '\documentclass') then c else '\documentclass{{standalone}}' || chr(10) || c end"
_INJECT_SQL = rf"select file_id, {s_strip(rf"replace({_CLASSED}, '\documentclass{{standalone}}', '\documentclass{{standalone}}' || chr(10) || '\usepackage{{tikz-network}}')")} as code from (select file_id, {_BARE} as c from corpus) t"
over("inject_package", "corpus", _INJECT_SQL, lambda: ["file_id", L.inject_network_package("code").alias("code")])
over("macro_expand", "corpus", None, lambda: ["file_id", MX.expand_macros(L.preamble_parts("code")["macros"], F.col("code")).alias("expanded"), MX.used_macros(L.preamble_parts("code")["macros"], F.col("code")).alias("used")])

# --- extraction -----------------------------------------------------------------------------------------------------
_ENV_SQL = " union all ".join(rf"select doc_id, unnest(regexp_extract_all(text, '(?s)\\begin\{{{e}\}}.*?\\end\{{{e}\}}')) as code from documents" for e in L.PICTURES)


@query("figure_extract", f"select doc_id, code from ({_ENV_SQL}) t where length(code) <= 100000")
def _(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.explode(X.pictures("text")).alias("code"))


@query("figure_distinct", f"select distinct doc_id, code from ({_ENV_SQL}) t where length(code) <= 100000")
def _(spark, d):
    return X.distinct_pictures(read_table(spark, d, "documents"), "text", "doc_id").select("doc_id", "code")


@query("figure_captions", r"""select doc_id, caption, label from (select doc_id, regexp_extract(f, '\\caption\{([^}]*)\}', 1) as caption, regexp_extract(f, '\\label\{([^}]+)\}', 1) as label from (select doc_id, unnest(regexp_extract_all(text, '(?s)\\begin\{figure\}.*?\\end\{figure\}')) as f from documents) t where regexp_matches(f, '(?s)\\begin\{(tikzpicture|circuitikz|tikzcd)\}')) u""")
def _(spark, d):
    rows = read_table(spark, d, "documents").where(F.contains("text", F.lit("\\begin{figure}"))).select("doc_id", F.explode(X.figures("text")).alias("f"))
    return rows.select("doc_id", "f.caption", "f.label").where("label <> '' or caption <> ''")


_LABEL = r"regexp_extract(f, '\\label\{([^}]+)\}', 1)"


@query("legacy_figures", rf"""with f as (select doc_id, unnest(regexp_extract_all(text, '(?s)\\begin\{{figure\}}(.*?)\\end\{{figure\}}', 1)) as f from documents),
a as (select doc_id, f, regexp_extract(f, '(?s)[^\n]*?\\begin\{{tikzpicture\}}.*?\\end\{{tikzpicture\}}', 0) as code from f where len(string_split(f, '\begin{{tikzpicture}}')) = 2)
select doc_id, code, regexp_extract(f, '(?s)\\caption(?:\[[^\]]*\])?\s*\{{((?:[^{{}}\\]|\\.|\{{(?:[^{{}}\\]|\\.|\{{[^{{}}]*\}})*\}})*)\}}', 1) as caption, {s_strip(_LABEL)} as label from a where code <> '' and length(code) <= 100000
union all select doc_id, unnest(regexp_extract_all(text, '(?s)[^\n]*?\\begin\{{tikzpicture\}}.*?\\end\{{tikzpicture\}}', 0)), '', '' from documents""")
def _(spark, d):
    return X.legacy_figures(read_table(spark, d, "documents"), "doc_id", "text").select("doc_id", "code", "caption", "label")


@query("figure_documents")
def _(spark, d):
    return figures_plan.extract_figures(spread(read_table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", balanced=True)


# regular expressions without looking ahead or back: the places to cut at are marked first
_HEADS = r"regexp_replace(text, '(\\(chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{|\\begin\{)', chr(1) || '\1', 'g')"
_PARAGRAPHS = f"list_filter(list_transform(string_split_regex({_HEADS}, '\\n[\\s\\x0b]*\\n|\\x01'), lambda p: {s_strip('p')}), lambda p: p <> '')"
over("paragraphs", "documents", f"select doc_id, unnest({_PARAGRAPHS}) as paragraph from documents", lambda: ["doc_id", F.explode(X.paragraphs("text")).alias("paragraph")])


def s_refs(x: str) -> str:
    return rf"list_transform(flatten(list_transform(regexp_extract_all({x}, '\\(?:ref|cref|autoref)\{{([^}}]*)\}}', 1), lambda r: string_split(r, ','))), lambda r: {s_strip('r')})"


_SENTENCES = rf"list_filter(string_split_regex(regexp_replace(p, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), '\x01'), lambda s: {s_strip('s')} <> '')"


@query("text_mentions", rf"""with d as (select doc_id, text, {_PARAGRAPHS} as ps from documents where contains(text, '\label{{')),
l as (select distinct doc_id, {s_strip('l')} as label from (select doc_id, unnest(regexp_extract_all(text, '\\label\{{([^}}]+)\}}', 1)) as l from d) t where {s_strip('l')} <> ''),
h as (select distinct doc_id, label, p from (select l.doc_id, label, unnest(list_filter(ps, lambda p: list_contains({s_refs('p')}, label))) as p from l join d on l.doc_id = d.doc_id) t),
m as (select doc_id, label, case when length(p) between 10 and 1000 then p when k > 0 then array_to_string(s[greatest(1, k - 1):k + 3], ' ') else p end as m
from (select doc_id, label, p, s, coalesce(list_position(list_transform(s, lambda x: list_contains({s_refs('x')}, label)), true), 0) as k from (select doc_id, label, p, {_SENTENCES} as s from h) t) u)
select l.doc_id, l.label, coalesce(list_sort(list(distinct m) filter (m is not null)), []) as mentions from l left join m on l.doc_id = m.doc_id and l.label = m.label group by all""")
def _(spark, d):
    rows = read_table(spark, d, "documents").where(F.contains("text", F.lit("\\label{"))).select("doc_id", F.explode(L.labels_of("text")).alias("label"), "text")
    return rows.select("doc_id", "label", X.text_mentions("text", "label").alias("mentions"))


@query("html_code", r"""select id, replace(replace(replace(replace(replace(replace(regexp_replace(c, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') as code from (select id, unnest(regexp_extract_all(body, '(?s)<pre[^>]*>\s*<code[^>]*>(.*?)</code>', 1)) as c from posts) t""")
def _(spark, d):
    return read_table(spark, d, "posts").select("id", F.explode(X.html_code_blocks("body")).alias("code"))


over("html_text", "posts", "select id, " + s_strip(r"""replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(body, '(?s)<pre[^>]*>.*?</pre>', '', 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')""") + " as text from posts", lambda: ["id", X.html_text("body").alias("text")])
over("page_title", "documents", r"""select doc_id, trim(split_part(regexp_extract(text, '(?s)<title>(.*?)</title>', 1), '–', 1)) as title from documents where contains(text, '</title>')""", lambda: ["doc_id", X.page_title("text").alias("title")], where="contains(text, '</title>')")
over("markdown_title", "documents", r"""select doc_id, nullif(trim(regexp_extract(text, '(?m)^# (.*)$', 1)), '') as title from documents where source = 'github'""", lambda: ["doc_id", X.markdown_title("text").alias("title")], where="source = 'github'")
_MATCHES = ", ".join(rf"regexp_extract(code, '(?s)\\begin\{{{e}\}}.*?\\end\{{{e}\}}', 0)" for e in L.PICTURES)
_PICTURE_SQL = f"coalesce(list_sort(list_transform(list_filter([{_MATCHES}], lambda x: x <> ''), lambda x: {{'p': strpos(code, x), 'x': x}}))[1].x, '')"
over("relevant_code", "eval_gt", f"select figure_id, {s_collapse(f"case when {_PICTURE_SQL} = '' then code else {_PICTURE_SQL} end")} as code from eval_gt", lambda: ["figure_id", L.relevant_code("code").alias("code")])


_BLOCKS = r"select id, unnest(list_transform(regexp_extract_all(body, '(?s)<pre[^>]*>\s*<code[^>]*>(.*?)</code>', 1), lambda x, i: {'n': i - 1, 'c': x})) as u from posts"
_UNESCAPED = r"""replace(replace(replace(replace(replace(replace(regexp_replace(u.c, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"""
_PAIRED = " or ".join(rf"(contains(code, '\begin{{{e}}}') and contains(code, '\end{{{e}}}'))" for e in L.CODE_ENVIRONMENTS)
_QA_PREAMBLE = rf"""'\documentclass[tikz]{{standalone}}' || coalesce(array_to_string(list_transform(p, lambda x: chr(10) || '\usepackage{{' || x || '}}'), ''), '') || case when len(l) > 0 then chr(10) || '\usetikzlibrary{{' || array_to_string(l, ', ') || '}}' else '' end"""
_QA_DOCUMENT = rf"""select file_id, case when contains(code, '\begin{{document}}') and contains(code, '\documentclass') then code else {_QA_PREAMBLE} || chr(10) || '\begin{{document}}' || chr(10) || {s_strip('code')} || chr(10) || '\end{{document}}' end as doc
from (select file_id, code, list_sort(list_concat(['tikz'], {s_detect('code', L.PACKAGES)})) as p, {s_detect('code', L.LIBRARIES)} as l from (select 'tex_' || id || '_' || u.n as file_id, {_UNESCAPED} as code from ({_BLOCKS}) t) t where {_PAIRED}) t"""
_QA_STANDARD = rf"select file_id, regexp_replace({s_clean('doc')}, '\\documentclass(\[.*?\])?\{{(article|report|book|scrartcl)\}}', '\\documentclass[tikz]{{standalone}}', 'g') as code from ({_QA_DOCUMENT}) t"


@query("qa_code_documents", rf"select file_id, {s_join(rf'''list_filter(list_transform({s_lines('code')}, lambda l: {_FILTERED}), lambda x: not {s_blank('x')} and not starts_with({s_strip('x')}, '%') and not contains(x, '\maketitle') and not contains(x, '\tableofcontents'))''')} as code from ({_QA_STANDARD}) t")
def _(spark, d):
    blocks = read_table(spark, d, "posts").select("id", F.posexplode(X.html_code_blocks("body")).alias("n", "code")).where(L.has_paired_environment("code"))
    document = F.when(F.contains("code", F.lit(L.BEGIN)) & F.contains("code", F.lit("\\documentclass")), F.col("code")).otherwise(F.concat(L.build_preamble(L.required_packages("code"), L.required_libraries("code")), F.lit("\n" + L.BEGIN + "\n"), T.strip("code"), F.lit("\n" + L.END)))
    return blocks.select(F.concat_ws("_", F.lit("tex"), F.col("id").cast("string"), F.col("n").cast("string")).alias("file_id"), L.filter_lines(L.standard_class(T.clean_code(document))).alias("code"))


# --- assembly, windows, reports -------------------------------------------------------------------------------------
_POSTS = "(select * from posts qualify row_number() over (partition by id order by creationdate nulls first, posttypeid nulls first, parentid nulls first, acceptedanswerid nulls first, answercount nulls first, score nulls first, title nulls first, tags nulls first, body nulls first) = 1)"


# the signs are set apart by a character that no text holds, escaped ones are shielded
_SHIELDED = r"replace(caption, '\$', chr(1))"
over("balance_all_dollars", "corpus", rf"""select file_id, replace(case when len(regexp_extract_all({_SHIELDED}, '\$')) % 2 = 1 then regexp_replace({_SHIELDED}, '(?s)^(.*)\$', '\1') else {_SHIELDED} end, chr(1), '\$') as caption from corpus where caption is not null""", lambda: ["file_id", L.balance_dollars("caption").alias("caption")], where="caption is not null")
for _env in ("circuitikz", "tikzcd"):
    over(f"trim_{_env}", "corpus", SQL["trim_environment"].replace("tikzpicture", _env).replace("+ 16", f"+ {len(_env) + 5}"), lambda e=_env: ["file_id", L.trim_to_environment("code", e).alias("code")], where="code is not null")
over("corpus_relevant_code", "corpus", f"select file_id, {s_collapse(f"case when {_PICTURE_SQL} = '' then code else {_PICTURE_SQL} end")} as code from corpus where code is not null", lambda: ["file_id", L.relevant_code("code").alias("code")], where="code is not null")


@query("assemble_turns", f"""with p as {_POSTS}, q as (select id as question_id, title, answercount, acceptedanswerid from p where posttypeid = 1 and answercount > 0 and body is not null),
a as (select q.question_id, q.title, q.answercount, p.id from p join q on p.parentid = q.question_id where p.posttypeid = 2 and p.body is not null and (coalesce(p.id = q.acceptedanswerid, false) or coalesce(p.score, 0) >= -10000))
select question_id, title, string_agg(id::varchar, ',' order by id) as answers, count(*)::bigint as n from a group by question_id, title, answercount having count(*) = answercount""")
def _(spark, d):
    rows = A.assemble(read_table(spark, d, "posts"))
    return rows.select("question_id", "title", F.array_join(F.transform("answers", lambda a: a["answer_id"].cast("string")), ",").alias("answers"), F.size("answers").cast("bigint").alias("n"))


over("post_tags", "posts", "select id, contains(tags, '<tikz-pgf>') and contains(tags, '<pgfplots>') as tagged from posts where tags is not null", lambda: ["id", A.has_tags("tags", ["tikz-pgf", "pgfplots"]).alias("tagged")], where="tags is not null")


@query("context_frame", "select id, array_to_string(list(title) over (partition by posttypeid, month(creationdate) order by id rows between 1 preceding and 3 following), ' ') as context from (select id, posttypeid, creationdate, title from posts where title is not null and creationdate is not null group by all) t qualify row_number() over (partition by id) = 1")
def _(spark, d):
    posts = read_table(spark, d, "posts").where("title is not null and creationdate is not null").select("id", "posttypeid", "creationdate", "title").distinct().withColumn("m", F.month("creationdate"))
    return A.context_frames(posts, ["posttypeid", "m"], "id", "title").select("id", "context")


@query("per_parent_titles", "select file_id, case when count(*) over (partition by archive_id) > 1 then archive_id || '_' || row_number() over (partition by archive_id order by file_id) else archive_id end as title from corpus where archive_id is not null")
def _(spark, d):
    return A.per_parent_titles(read_table(spark, d, "corpus").where("archive_id is not null").select("file_id", "archive_id"), "archive_id", "file_id", F.col("archive_id")).select("file_id", "title")


@query("last_before", "select file_id, last_value(case when status = 'error' then file_id end ignore nulls) over (partition by archive_id order by file_id rows between unbounded preceding and 1 preceding) as previous from corpus")
def _(spark, d):
    rows = read_table(spark, d, "corpus").select("file_id", "archive_id", "status")
    return A.with_last_before(rows, F.when(F.col("status") == "error", F.col("file_id")), ["archive_id"], "file_id", "previous").select("file_id", "previous")


@query("failure_budget", "select file_id from (select file_id, status, sum(case when status = 'error' then 1 else 0 end) over (partition by archive_id order by file_id) as f from corpus) t where f <= 3 and not coalesce(status = 'error', false)")
def _(spark, d):
    rows = read_table(spark, d, "corpus").select("file_id", "archive_id", (F.col("status") == "error").alias("failed"))
    return R.failure_budget(rows, "archive_id", "file_id", "failed").select("file_id")


@query("eval_report", """select count(*)::bigint as n, round(avg(s), 9) as score_mean, round(stddev_pop(s), 9) as score_std, round(avg(coalesce(ok, false)::int::double), 9) as compile_rate
from (select status = 'success' as ok, case when status = 'success' then coalesce(code_length::double / 4000, 0) else 0 end as s from corpus) t""")
def _(spark, d):
    rows = read_table(spark, d, "corpus").select((F.col("status") == "success").alias("ok"), (F.col("code_length").cast("double") / 4000).alias("score"))
    return A.report_with_rate(rows, ["score"], F.col("ok"), ~F.coalesce("ok", F.lit(False))).select("n", *(F.round(c, 9).alias(c) for c in ("score_mean", "score_std", "compile_rate")))


@query("licence_stats", "select source as license, count(distinct archive_id)::bigint as papers, count(*)::bigint as snippets from corpus group by source")
def _(spark, d):
    return A.licence_stats(read_table(spark, d, "corpus").withColumnRenamed("source", "license"), "license", "archive_id")


@query("corpus_profile", "select source, status, grouping_id(source, status)::bigint as level, count(*)::bigint as n, count(code)::bigint as n_code, sum(length(code))::bigint as chars from corpus group by cube (source, status)")
def _(spark, d):
    return A.corpus_profile(read_table(spark, d, "corpus"), "source", "status")


@query("bool_aggregates", "select archive_id, bool_or(contains(code, 'tikzcd')) as any_cd, bool_and(length(code) > 100) as all_long, count_if(status = 'success')::bigint as n_ok from corpus group by archive_id")
def _(spark, d):
    return read_table(spark, d, "corpus").groupBy("archive_id").agg(F.bool_or(F.contains("code", F.lit("tikzcd"))).alias("any_cd"), F.bool_and(F.length("code") > 100).alias("all_long"), F.count_if(F.col("status") == "success").alias("n_ok"))


_TRIMMED = "id, body, {0} from (select distinct * from posts) p where posttypeid = {1}"


@query("trimmed_questions", f"select {_TRIMMED.format('title, tags, answercount, acceptedanswerid, 0 as parsedanswers', 1)}")
def _(spark, d):
    return A.trimmed_posts(read_table(spark, d, "posts").distinct(), "question")


@query("trimmed_answers", f"select {_TRIMMED.format('score, creationdate, parentid', 2)}")
def _(spark, d):
    return A.trimmed_posts(read_table(spark, d, "posts").distinct(), "answer")


@query("projects_with_pictures", "select file_id, archive_id from corpus where archive_id in (select archive_id from corpus where contains(code, 'tikzcd') or contains(code, 'circuitikz'))")
def _(spark, d):
    return R.projects_with(read_table(spark, d, "corpus").select("file_id", "archive_id", "code"), "archive_id", "tikzcd", "circuitikz", text="code").select("file_id", "archive_id")


@query("failure_counts", "select archive_id, count(*)::bigint as n, count_if(status = 'error')::bigint as n_failed from corpus group by archive_id")
def _(spark, d):
    return R.failure_counts(read_table(spark, d, "corpus").select("archive_id", (F.col("status") == "error").alias("failed")), "archive_id", "failed")


@query("paper_records", rf"select text, n as arxiv_id, left(n, 4) as yymm, '{C.PAPER_URL}' || n as url, strftime(added_at, '%Y-%m-%dT%H:%M:%S') as stamp from (select text, added_at, regexp_replace(origin, '^\w+:', '') as n from documents where source = 'arxiv' and origin is not null and not {s_blank('text')}) t")
def _(spark, d):
    rows = read_table(spark, d, "documents").where("source = 'arxiv' and origin is not null").withColumn("name", F.regexp_replace("origin", r"^\w+:", ""))
    return C.paper_records(rows, "name", "text", "source", F.col("added_at")).select("text", "meta.arxiv_id", "meta.yymm", "meta.url", F.col("meta.timestamp").alias("stamp"))


@query("month_ranges", "select d::date as start_date, last_day(d)::date as end_date from (select unnest(generate_series(date '2024-01-01', date '2024-06-30', interval 1 month)) as d) t")
def _(spark, d):
    return month_ranges(spark, "2024-01-01", "2024-06-30")


# --- sequences, vectors ---------------------------------------------------------------------------------------------
_TOK = r"length(regexp_replace(regexp_replace({0}, '\\[A-Za-z@]+|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x0b]', chr(1), 'g'), '[^\x01]', '', 'g'))"
over("token_count", "corpus", f"select file_id, coalesce({_TOK.format('code')}, 0)::bigint as tokens from corpus", lambda: ["file_id", Q.pretoken_count("code").cast("bigint").alias("tokens")])
over("token_budget", "corpus", rf"select file_id, coalesce(ends_with({s_strip('code')}, '\end{{document}}') and coalesce({_TOK.format('caption')}, 0) <= 512 and coalesce({_TOK.format('code')}, 0) + coalesce({_TOK.format('caption')}, 0) < 2048, false) as training, coalesce({_TOK.format('caption')}, 0) <= 512 and coalesce({_TOK.format('code')}, 0) <= 2048 as reward from corpus", lambda: ["file_id", F.coalesce(Q.fits_training(F.col("code"), Q.pretoken_count("caption"), Q.pretoken_count("code") + Q.pretoken_count("caption")), F.lit(False)).alias("training"), Q.fits_reward(Q.pretoken_count("caption"), Q.pretoken_count("code")).alias("reward")])
over("chat_format", "corpus", "select file_id, '<|im_start|>user' || chr(10) || '" + Q.REQUEST.replace("\n", "' || chr(10) || '") + "' || caption || '" + Q.FORM.replace("\n", "' || chr(10) || '") + "' || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || code || '<|im_end|>' || chr(10) as chat from corpus where caption is not null and code is not null", lambda: ["file_id", Q.chat([("user", Q.request_text("caption")), ("assistant", F.col("code"))]).alias("chat")], where="caption is not null and code is not null")
over("label_mask", "corpus", "select file_id, array_to_string(list_transform(range(1, 13), lambda i: case when i <= length(source) then '-100' else (i * 7)::varchar end), ',') as labels from corpus where source is not null", lambda: ["file_id", F.array_join(Q.label_mask(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i * 7), F.length("source")), ",").alias("labels")], where="source is not null")
over("position_ids", "corpus", "select file_id, array_to_string(list_transform(range(1, 9), lambda i: case when i <= length(source) % 4 then '1' else (i - length(source) % 4 - 1)::varchar end), ',') as positions from corpus where source is not null", lambda: ["file_id", F.array_join(Q.position_ids(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when(i <= F.length("source") % 4, 0).otherwise(1))), ",").alias("positions")], where="source is not null")
_TOKENS = r"regexp_extract_all(coalesce(caption, '') || ' ' || coalesce(code, ''), '\\[A-Za-z@]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\v\x1c-\x1f\x{85}\p{Z}]')"
_PROMPT = r"len(regexp_extract_all(coalesce(caption, ''), '\\[A-Za-z@]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\v\x1c-\x1f\x{85}\p{Z}]'))"


def _token_ids():
    """Whole records as arrays of numbers: the tokens of caption and code, by their lengths."""
    tokens = F.regexp_extract_all(F.concat_ws(" ", F.coalesce("caption", F.lit("")), F.coalesce("code", F.lit(""))), F.lit(r"\\[A-Za-z@]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"), 0)
    return F.transform(tokens, F.length)


def _prompt_length():
    return F.size(F.regexp_extract_all(F.coalesce("caption", F.lit("")), F.lit(r"\\[A-Za-z@]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"), 0))


over("label_mask_tokens", "corpus", f"select file_id, len(t)::int as n, coalesce(list_sum(list_transform(range(1, len(t) + 1), lambda i: case when i <= p then -100 else len(t[i]) * (i % 7) end)), 0)::bigint as checksum from (select file_id, {_TOKENS} as t, {_PROMPT} as p from corpus) s",
     lambda: ["file_id", F.size(_token_ids()).alias("n"), F.aggregate(F.transform(Q.label_mask(_token_ids(), _prompt_length()), lambda x, i: F.when(x == Q.IGNORED, x).otherwise(x * ((i + 1) % 7))), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum")])
over("position_ids_tokens", "corpus", f"select file_id, list_transform(range(1, len(t) + 1), lambda i: case when i <= p then 1 else i - p - 1 end)::int[] as positions from (select file_id, {_TOKENS} as t, {_PROMPT} as p from corpus) s",
     lambda: ["file_id", Q.position_ids(F.transform(_token_ids(), lambda x, i: (i >= _prompt_length()).cast("int"))).alias("positions")])
over("image_prompt", "captions", "select file_id, repeat('<image>', 5) || new_caption || '</s>' as prompt from captions where new_caption is not null", lambda: ["file_id", Q.image_prompt("new_caption", "<image>", 5, eos="</s>").alias("prompt")], where="new_caption is not null")
over("resize_geometry", "part", """select p_partkey, w::int as width, h::int as height, floor((448 - w) / 2)::int as left_, floor((448 - h) / 2)::int as top_ from (select p_partkey, round_even(a * s, 0) as w, round_even(b * s, 0) as h from (select p_partkey, a, b, least(448.0::double / a, 448.0::double / b) as s from (select p_partkey, (p_size * 13 + 7)::double as a, (p_partkey % 700 + 40)::double as b from part) t) u) v""",
     lambda: ["p_partkey", *(M.padded_geometry((F.col("p_size") * 13 + 7).cast("double"), (F.col("p_partkey") % 700 + 40).cast("double"))[k].alias(n) for k, n in (("width", "width"), ("height", "height"), ("left", "left_"), ("top", "top_")))])
_PAIRED = "(select a.vec_id as a, b.vec_id as b, a.embedding as x, b.embedding as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def _neighbours(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a")


@query("cosine_pairs", f"select a, b, round(list_cosine_similarity(x::double[], y::double[]), 6) as cosine, round(greatest(0, least(1, (list_cosine_similarity(x::double[], y::double[]) + 1) / 2)), 6) as reward from {_PAIRED} t")
def _(spark, d):
    return _neighbours(spark, d).select("a", "b", F.round(M.cosine("x", "y"), 6).alias("cosine"), F.round(M.cosine_reward("x", "y"), 6).alias("reward"))


@query("cosine_topk", "select a, b, similarity from (select distinct least(q.vec_id, e.vec_id) as a, greatest(q.vec_id, e.vec_id) as b, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 5) as similarity from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0) t order by similarity desc, a, b limit 20")
def _(spark, d):
    return M.top_pairs(read_table(spark, d, "embeddings"), "vec_id", "embedding", 20, F.col("id") % 50 == 0)


@query("emd_patch")
def _(spark, d):
    return _neighbours(spark, d).select("a", "b", F.round(M.patch_similarity(M.bagged("x", 8), M.bagged("y", 8)), 6).alias("score"))


@query("pooled_patches", "select vec_id, round((embedding[1]::double + embedding[9] + embedding[17] + embedding[25] + embedding[33] + embedding[41] + embedding[49] + embedding[57]) / 8, 6) as first_mean, 2::bigint as n_joined from embeddings")
def _(spark, d):
    bags = read_table(spark, d, "embeddings").select("vec_id", M.bagged("embedding", 8).alias("p"))
    return bags.select("vec_id", F.round(M.mean_pool("p")[0], 6).alias("first_mean"), F.size(M.concat_patches("p", 3)).cast("bigint").alias("n_joined"))


def _repaired(spark, d):
    rows = curated_pairs.with_repairs(read_table(spark, d, "corpus").select("file_id", "code", "code_new"), read_table(spark, d, "repair_responses"))
    rows = rows.where("code is not null and code_new is not null").repartition(shuffle_partitions(spark), "file_id")
    return rows.select("file_id", Q.lexed("code").alias("reference"), Q.lexed("code_new").alias("hypothesis"))


@query("crystal_bleu")
def _(spark, d):
    trivial = M.trivial_ngrams(read_table(spark, d, "eval_gt").select(Q.lexed("code").alias("tokens")), "tokens")
    return M.crystal_bleu(_repaired(spark, d), "hypothesis", "reference", trivial)


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{Nd}}]+')"


def s_runs(t: str, n: int) -> str:
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i + {n} - 1], ' '))"


def s_all_runs(t: str) -> str:
    return f"flatten([{', '.join(s_runs(t, n) for n in (1, 2, 3, 4))}])"


def s_kept(t: str) -> str:
    return f"string_split(array_to_string(list_filter({s_all_runs(t)}, lambda g: not list_contains(shared, g)), ' '), ' ')"


def s_matched(n: int) -> str:
    side = lambda c: f"(select file_id, g, count(*) as c from (select file_id, unnest({s_runs(c, n)}) as g from k) t group by all)"
    return f"(select sum(least(a.c, b.c)) from {side('h')} a join {side('r')} b using (file_id, g))::double / (select sum(len(h) - {n - 1}) from k)"


@query("crystal_bleu_words", f"""with e as (select {_WORDS.format('new_caption')} as t from eval_gt), x as (select list(g) as shared from (select g from (select unnest({s_all_runs('t')}) as g from e) u group by g order by count(*) desc, g limit 100) v),
k as (select file_id, {s_kept('h')} as h, {s_kept('r')} as r from (select file_id, {_WORDS.format('new_caption')} as h, {_WORDS.format('caption')} as r from corpus where caption is not null and new_caption is not null) t, x where {s_kept('h')} <> [''] and {s_kept('r')} <> [''])
select count(*)::bigint as n_pairs, round(exp((ln({s_matched(1)}) + ln({s_matched(2)}) + ln({s_matched(3)}) + ln({s_matched(4)})) / 4) * case when sum(len(h)) < sum(len(r)) then exp(1 - sum(len(r)) / sum(len(h))) else 1 end, 9) as crystal_bleu from k""")
def _(spark, d):
    """M-01, A-09, A-13, D-09, O-04, X-24 on words instead of tokens of LaTeX, so that SQL can say the same."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{Nd}]+"), 0)
    trivial = M.trivial_ngrams(read_table(spark, d, "eval_gt").select(words("new_caption").alias("tokens")), "tokens", 100)
    rows = read_table(spark, d, "corpus").where("caption is not null and new_caption is not null").select(words("new_caption").alias("h"), words("caption").alias("r"))
    found = M.crystal_bleu(rows, "h", "r", trivial)
    return found.select("n_pairs", F.round("crystal_bleu", 9).alias("crystal_bleu"))


@query("tex_edit_distance")
def _(spark, d):
    rows = curated_pairs.with_repairs(read_table(spark, d, "corpus").select("file_id", "code", "code_new"), read_table(spark, d, "repair_responses")).where("code is not null and code_new is not null")
    rows = rows.repartition(shuffle_partitions(spark), "file_id")
    return rows.select("file_id", F.round(M.tex_edit_distance(Q.lexed(L.relevant_code("code_new"), True), Q.lexed(L.relevant_code("code"), True)), 6).alias("distance"))


@query("score_predictions")
def _(spark, d):
    predictions = read_table(spark, d, "eval_gt").select("figure_id", F.concat(F.lit("Sure:\n"), F.col("code")).alias("tikz_pred"), F.contains("code", F.lit("\\end{document}")).alias("compiled"))
    return evaluation.report(evaluation.score_predictions(read_table(spark, d, "eval_gt"), predictions))


_ANSWERED = rf"""select file_id, compiled, case when f = 0 then '' when e >= f then substr(response, f, e + 14 - f) else substr(response, f, {_LAST.format('response')} - f + 1) end as answer
from (select file_id, response, contains(response, '\end{{document}}') as compiled, instr(response, chr(92)) as f, instr(response, '\end{{document}}') as e from repair_responses where file_id is not null) t"""
_SIGNS = r"regexp_extract_all(pred, '\\[A-Za-z@]+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\v]')"


@query("score_repairs", f"""with p as (select file_id, compiled, {s_clean('answer')} as pred from ({_ANSWERED}) a), f as (select * from p qualify row_number() over (partition by file_id order by pred nulls first, compiled nulls first) = 1),
s as (select coalesce(compiled, false) as ok, case when coalesce(compiled, false) then coalesce(len({_SIGNS}), 0) else 0 end as tokens from corpus c left join f on c.file_id = f.file_id)
select count(*)::bigint as n, round(avg(tokens), 6) as tokens_mean, round(stddev_pop(tokens), 6) as tokens_std, round(avg(ok::int), 9) as compile_rate from s""")
def _(spark, d):
    """J-13, A-02, A-03, A-05, M-11: every corpus row as a reference, model answers as predictions; rows without one count as failures."""
    predictions = read_table(spark, d, "repair_responses").where("file_id is not null").select(F.col("file_id").alias("figure_id"), F.col("response").alias("tikz_pred"), F.contains("response", F.lit("\\end{document}")).alias("compiled"))
    truth = read_table(spark, d, "corpus").select(F.col("file_id").alias("figure_id"), "code", "new_caption")
    scored = evaluation.score_predictions(truth, predictions)
    return evaluation.report(scored).select("n", F.round("tokens_mean", 6).alias("tokens_mean"), F.round("tokens_std", 6).alias("tokens_std"), F.round("compile_rate", 9).alias("compile_rate"))


@query("compile_check")
def _(spark, d):
    return boundary.compile_codes(read_table(spark, d, "corpus"), "file_id", "code").select("file_id", "status", "log")


# --- plans ----------------------------------------------------------------------------------------------------------
_CAPTIONED = f"select c.file_id, c.source, c.code, c.caption, case when {s_blank('c.new_caption')} then k.n else c.new_caption end as new_caption from corpus c left join (select file_id, min(new_caption) as n from captions where not {s_blank('new_caption')} group by file_id) k on c.file_id = k.file_id where c.status = 'success' and c.code_length between 100 and 4000 and c.code is not null and sha256(c.code) not in (select sha256(code) from eval_gt where code is not null)"


@query("curated_pairs", f"""with r as (select * from ({_CAPTIONED}) t qualify row_number() over (partition by sha256(code) order by file_id) = 1),
p as (select file_id, source, {s_strip("coalesce(caption, '')")} as text, code as label from r union all select file_id, source, {s_strip("coalesce(new_caption, '')")}, code from r)
select file_id, source, text, label, ((row_number() over (order by file_id, text) - 1) % 10)::int as shard from p where text <> ''""")
def curated(spark, d):
    t = lambda n: read_table(spark, d, n)
    return curated_pairs.build_pairs(t("corpus"), captions=t("captions"), reference=t("eval_gt"), shards=10)


_REPAIR = f"select file_id, case when {s_code_of('a')} = '' then {s_strip('a')} else {s_code_of('a')} end as code from (select file_id, {_ANSWER} as a from repair_responses where response is not null and file_id is not null) t"


@query("repaired_code", f"select c.file_id, coalesce(r.code, c.code_new) as code_new from corpus c left join (select file_id, min(code) as code from ({_REPAIR}) q where starts_with(code, chr(92)) group by file_id) r on c.file_id = r.file_id")
def _(spark, d):
    return curated_pairs.with_repairs(read_table(spark, d, "corpus").select("file_id", "code_new"), read_table(spark, d, "repair_responses"))


# --- streams --------------------------------------------------------------------------------------------------------
def _stream(spark: SparkSession, d: str, table: str) -> DataFrame:
    """The table as a stream of files, whether it is a file or a folder."""
    path = f"{d}/{table}.parquet"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    reader = spark.readStream.schema(read_table(spark, d, table).schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(d)


def _ended(stream: DataFrame) -> DataFrame:
    base = f"{checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    return S.run_to_end(stream, f"{base}/out", f"{base}/state")


@query("stream_dedup", "select distinct user_id, event_type from events")
def _(spark, d):
    return _ended(S.dedup_stream(_stream(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"]))


@query("stream_assembly", SQL["assemble_turns"])
def _(spark, d):
    rows = _ended(S.assemble_stream(_stream(spark, d, "posts")))
    return rows.select("question_id", "title", F.array_join(F.transform("answers", lambda a: a["answer_id"].cast("string")), ",").alias("answers"), F.size("answers").cast("bigint").alias("n"))


@query("stream_window", "select date_trunc('day', ts)::timestamp as start, event_type, count(*)::bigint as n from events where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by all")
def _(spark, d):
    return _ended(S.windowed_counts(_stream(spark, d, "events"), "ts", ["event_type"])).select("start", "event_type", "n")


from inkmill import file_queries  # noqa: E402, F401  # adds its queries to the ones above
