"""The queries of the training-data operators, over the tables of a data folder, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm import format_duplicates, leakage, mixing, near_duplicates, packing, residue, truncation
from inkmill.session import spread
from inkmill.sources.tables import read_table


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A large table, whose scan is cut finer if it has fewer parts than there are cores."""
    return spread(read_table(spark, d, name))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.p1_found(_table(spark, d, "corpus"))


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Every corpus row counts here, however short."""
    groups = format_duplicates.copies(_table(spark, d, "corpus"), min_words=0)
    return format_duplicates.collapsed(groups).withColumnRenamed("rep", "file_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.p2_found(_table(spark, d, "corpus"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    corpus = _table(spark, d, "corpus")
    return truncation.truncation_report(corpus, truncation.truncated(corpus))


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.limits(truncation.lengths(_table(spark, d, "corpus"))).drop("q_value")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(_table(spark, d, "corpus"), read_table(spark, d, "eval_gt"))
    return found.select(F.col("item").alias("figure_id"), F.col("id").alias("file_id")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    test = read_table(spark, d, "eval_gt")
    return leakage.leak_report(leakage.leaks(_table(spark, d, "corpus"), test), test)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.p4_found(_table(spark, d, "corpus"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.NearDuplicates(_table(spark, d, "corpus")).classes().withColumnRenamed("id", "file_id")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives; p4_classes says which rows a class holds."""
    links = near_duplicates.NearDuplicates(_table(spark, d, "corpus")).links
    return links.select(F.col("rep_a").alias("class_a"), F.col("rep_b").alias("class_b"), "similarity")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.NearDuplicates(_table(spark, d, "corpus")).groups().withColumnRenamed("id", "file_id")


def p5_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing(_table(spark, d, "documents"), read_table(spark, d, "packing_specs"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p5_packing(spark, d))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p6_draws(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).draws()


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).usage()


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.p7_found(_table(spark, d, "documents"))


def p7_recurring(spark: SparkSession, d: str) -> DataFrame:
    """How many different messages recur in how many origins, of all documents."""
    found = residue.recurring(_table(spark, d, "documents")).where("skeleton is null")
    return found.groupBy("n_origins").agg(F.count("*").alias("n_messages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_collapsed, p2_found, p2_report, p2_limits, p3_found, p3_report, p4_found, p4_classes, p4_links, p4_groups, p5_packing, p5_report, p6_draws, p6_usage, p6_shares, p7_found, p7_recurring)}


_FOLD = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{Nd}}]', '', 'g')"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{Nd}}]+')"
_CANON = rf"""(select file_id, n, cap, array_to_string(list_transform(range(1, len(o) + 1), lambda i: {_FOLD.format("o[i]")} || coalesce(array_to_string(list_sort(list_transform(string_split(g[i], ','), lambda e: {_FOLD.format("e")})), ''), '')), '') as canon
from (select file_id, string_split_regex(code, '\[[^\[\]]*\]') as o, regexp_extract_all(code, '\[([^\[\]]*)\]', 1) as g, {_FOLD.format("caption")} as cap, len({_WORDS.format("code")}) as n
from (select file_id, coalesce(code, '') as code, coalesce(caption, '') as caption from corpus) a) b)"""


def _passages(table: str, key: str, column: str, span: int) -> str:
    return f"(select distinct {key}, array_to_string(w[i:i + {span - 1}], ' ') as passage from (select {key}, w, unnest(range(1, len(w) - {span - 2})) as i from (select {key}, {_WORDS.format(column)} as w from {table}) a where len(w) >= {span}) b)"


_SHARED = " union ".join(f"select e.figure_id, c.file_id from {_passages('eval_gt', 'figure_id', c, n)} e join {_passages('corpus', 'file_id', c, n)} c using (passage)" for c, n in (("code", 30), ("new_caption", 13)))


def _runs(column: str, span: int) -> str:
    """The longest shared passage of each item and row: windows that follow each other in both make one passage."""
    at = lambda table, key, name: f"(select {key}, i as {name}, array_to_string(w[i:i + {span - 1}], ' ') as passage from (select {key}, w, unnest(range(1, len(w) - {span - 2})) as i from (select {key}, {_WORDS.format(column)} as w from {table}) a where len(w) >= {span}) b)"
    met = f"select figure_id, file_id, i, i - j as diagonal, i - row_number() over (partition by figure_id, file_id, i - j order by i) as island from {at('eval_gt', 'figure_id', 'i')} e join {at('corpus', 'file_id', 'j')} c using (passage)"
    return f"select figure_id, file_id, '{column}' as field, max(n) as longest from (select figure_id, file_id, diagonal, island, count(*) + {span - 1} as n from ({met}) m group by all) r group by all"


_LEAK_REPORT = f"""with h as ({_runs('code', 30)} union all {_runs('new_caption', 13)})
select figure_id, count(distinct file_id)::bigint as n_rows, count(*) filter (field = 'code')::bigint as n_code, count(*) filter (field = 'new_caption')::bigint as n_caption, coalesce(max(longest), 0)::int as longest_words
from (select distinct figure_id from eval_gt where figure_id is not null) g left join h using (figure_id) group by figure_id"""
_UNHASHED = residue.UNHASHED.replace("'", "''")
_RECURRING = rf"""with m as (select coalesce('o' || origin, 'n' || doc_id) as o, unnest(string_split_regex(regexp_replace(regexp_replace(text, '{_UNHASHED}', '0', 'g'), '([.!?;])[ \t\r\n]', '\1' || chr(10), 'g'), '[\n\r<>]')) as m from documents where text is not null),
l as (select distinct o, regexp_replace(lower(m), '[^\p{{L}}]', '', 'g') as k from m)
select n_origins, count(*)::bigint as n_messages from (select k, count(*)::bigint as n_origins from l where length(k) >= 4 group by k) g where n_origins >= 4 group by n_origins"""
_SHINGLES = f"(select distinct file_id, array_to_string(w[i:i + 4], ' ') as s from (select file_id, w, unnest(range(1, len(w) - 3)) as i from (select file_id, {_WORDS.format('code')} as w from corpus) a where len(w) >= 40) b)"


# rows with one set of shingles are one class; classes are linked, and links followed
_CLASSES = f"""s as materialized {_SHINGLES}, g as (select file_id, count(*) as n, md5(string_agg(s, '|' order by s)) as h from s group by file_id), c as materialized (select file_id, n, min(file_id) over (partition by h) as class_id, count(*) over (partition by h) as copies from g),
r as (select s.file_id, s.s, c.n from s join c on s.file_id = c.file_id and c.file_id = c.class_id), l as materialized (select a, b, k / (x + y - k) as similarity from (select a.file_id as a, b.file_id as b, a.n as x, b.n as y, count(*) as k from r a join r b on a.s = b.s and a.file_id < b.file_id group by all) t where 10 * k >= 7 * (x + y - k)),
e as materialized (select a, b from l union all select b, a from l)"""


# the length hazards of problem 2: tested twice, the second time without the neighbours that are limits themselves
_MARK = r"(\s*(…|\x{FFFD}|\.{3,}|[\[(<{]\s*(\.{2,}|…|([\w ]{0,20}\b)?(truncated|clipped|snip(ped)?|cut( off)?|shortened|omitted|trimmed|continued|more)\b[\w ]{0,20})\s*[\])>}]))+\s*$"


def _tested(table: str, ends: str, exposure: str, own_ends: str, own_exposure: str) -> str:
    near = "over (partition by source order by length range between 50 preceding and 50 following)"
    rates = f"select *, (sum({ends}) {near} - {own_ends} + 0.5) / (sum({exposure}) {near} - {own_exposure} + 1.0) as near_hazard from {table}"
    tails = f"select *, case when ends > near_hazard * at_risk then exp(-(ends * ln(ends / (near_hazard * at_risk)) - ends + near_hazard * at_risk)) else 1.0 end as p from ({rates}) t1"
    ranks = f"select *, p * count(*) over (partition by source) / row_number() over (partition by source order by p, length) as up from ({tails}) t2"
    return f"(select *, least(1.0, min(up) over (partition by source order by p, length rows between current row and unbounded following)) <= 0.01 and ends >= 3 as found from ({ranks}) t3)"


_FIRST = _tested("e", "ends", "exposure", "ends", "at_risk")
_PLAIN = f"(select source, length, ends, at_risk, case when found then 0 else ends end as pe, exposure - case when found then at_risk else 0 end as px, case when found then 0 else ends end as oe, case when found then 0 else at_risk end as ox from {_FIRST} f1)"
_LIMITS = f"""with c as (select source, length(regexp_replace(code, '{_MARK}', '', 'i'))::int as length, count(*)::bigint as ends from corpus where regexp_matches(code, '\\S') group by all),
r as (select *, (sum(ends) over (partition by source order by length rows between current row and unbounded following))::bigint as at_risk, coalesce(lag(length) over (partition by source order by length), 0) as prev from c),
e as (select *, greatest(least(length - prev, 100), 1) * at_risk as exposure from r)
select source, length, ends, at_risk, ends / at_risk as hazard, near_hazard from {_tested(_PLAIN, "pe", "px", "oe", "ox")} f2 where found"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_limits": _LIMITS,
        "p1_found": f"select first as file_id_a, file_id as file_id_b from (select file_id, min(file_id) over (partition by canon, cap) as first from {_CANON} c where n >= 40) d where first <> file_id",
        "p1_collapsed": f"select min(file_id) as file_id, count(*)::bigint as copies from {_CANON} c group by canon, cap",
        "p3_found": _SHARED,
        "p3_report": _LEAK_REPORT,
        "p7_recurring": _RECURRING,
        "p4_classes": f"with {_CLASSES} select file_id, class_id, copies::bigint as copies, (select count(*) from e where e.a = c.class_id)::bigint as n_links from c",
        "p4_links": f"with {_CLASSES} select a as class_a, b as class_b, similarity from l",
        "p4_groups": f"with recursive {_CLASSES}, w as (select distinct class_id as a, class_id as b from c union select w.a, e.b from w join e on w.b = e.a) select file_id, m as group_id from c join (select a, min(b) as m from w group by a) t on c.class_id = t.a",
        "p4_found": f"with s as materialized {_SHINGLES}, n as (select file_id, count(*) as n from s group by file_id), p as (select a.file_id as file_id_a, b.file_id as file_id_b, count(*) as k from s a join s b on a.s = b.s and a.file_id < b.file_id group by all) select file_id_a, file_id_b from p join n x on x.file_id = file_id_a join n y on y.file_id = file_id_b where 10 * k >= 7 * (x.n + y.n - k)",
    }
