"""Filters, projections and joins of corpus records."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import is_blank, strip

# The sources of a corpus, and the columns an input text can be made of.
SOURCES = ("arxiv", "github", "tex", "synthetic", "curated")
VARIANTS = ("caption", "text_mentions", "caption_text_mentions", "new_caption", "caption_or_new_caption", "caption_and_new_caption", "new_caption_comparison")
#: Up to this many rows a table of patterns is broadcast for a join that has no key.
BROADCAST_ROWS = 100_000
#: The automata of a worker by the names that their sets of parts got.
AUTOMATA: dict = {}


def parse_sources(wanted: str, known: tuple[str, ...] = SOURCES) -> list[str]:
    """F-02, D-08: the names of ``a_b_c``; unknown ones raise."""
    names = wanted.split("_")
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown sources: {', '.join(unknown)}; known are {', '.join(known)}")
    return names


def filter_corpus(df: DataFrame, sources: str | None = None, compiled: bool = False, min_length: int | None = 100, max_length: int | None = 4000, computed: bool = False) -> DataFrame:
    """F-01..F-04: successful records (if ``compiled``), of the sources, whose code has a length within the bounds.

    The stored ``code_length`` counts (null as 0), so the bounds reach the scan; ``computed`` measures the code instead (null
    code as 0). Null status and source never match.
    """
    if compiled:
        df = df.where(F.col("status") == "success")
    if sources is not None:
        df = df.where(F.col("source").isin(*parse_sources(sources)))
    if computed:
        length = F.coalesce(F.length("code"), F.lit(0))
    else:
        length = F.col("code_length") if (min_length or 0) > 0 else F.coalesce("code_length", F.lit(0))
    if min_length is not None:
        df = df.where(length >= min_length)
    if max_length is not None:
        df = df.where(length <= max_length)
    return df


def input_text(variant: str) -> Column:
    """P-01: the input text of a record by one of the single-row variants; null counts as empty. The caption is taken as it
    stands, joined texts are stripped."""
    caption, new = F.coalesce("caption", F.lit("")), F.coalesce("new_caption", F.lit(""))
    mentions = F.coalesce(F.array_join("text_mentions", " "), F.lit(""))
    if variant == "caption":
        return caption
    if variant == "text_mentions":
        return mentions
    if variant == "caption_text_mentions":
        return strip(F.concat(caption, F.lit(" "), mentions))
    if variant == "new_caption":
        return new
    if variant == "caption_or_new_caption":
        return F.when(is_blank(caption), new).otherwise(caption)
    if variant == "new_caption_comparison":
        return F.when(is_blank(caption), F.lit("")).otherwise(new)
    raise ValueError(f"unknown variant: {variant}")


def with_texts(df: DataFrame, variant: str, name: str = "text") -> DataFrame:
    """P-01, P-02, F-05: a row for each input text that is not blank; ``caption_and_new_caption`` gives up to two, stripped."""
    if variant != "caption_and_new_caption":
        return df.withColumn(name, input_text(variant)).where(~is_blank(F.col(name)))
    texts = F.filter(F.array(strip(F.coalesce("caption", F.lit(""))), strip(F.coalesce("new_caption", F.lit("")))), lambda t: t != "")
    return df.withColumn(name, F.explode(texts))


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """W-06: of the rows with equal keys, the first in ``order``. Null keys are a key. Other columns pass through.

    Takes the minimum of a struct instead of a window: aggregated before the shuffle, so a hot key costs one row a task. Spark
    aggregates structs by sorting each task's rows by their keys: select the columns that are wanted before, as they travel with the row.
    ``order`` must be plain columns; ties are broken by the other columns, so that the result does not depend on the partitions.
    """
    ordered = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [c for c in df.columns if c not in keys]
    sortable = [c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    pick = F.min(F.struct(*(o.alias(f"__order{i}") for i, o in enumerate(ordered)), *(F.col(c) for c in sortable)))
    return df.groupBy(*keys).agg(pick.alias("__first")).select(*(F.col(k) if k in keys else F.col(f"__first.{k}") for k in df.columns))


def not_in_reference(df: DataFrame, key: Column, reference: DataFrame, reference_key: Column) -> DataFrame:
    """J-05, J-06, J-08: rows whose key is in none of the reference's rows. A null key is in no reference."""
    keys = reference.select(reference_key.alias("__key")).where("__key is not null").distinct()
    return df.withColumn("__mine", key).join(keys, F.col("__mine") == F.col("__key"), "left_anti").drop("__mine")


def without_prefixes(df: DataFrame, column: str, prefixes: DataFrame, prefix_column: str) -> DataFrame:
    """J-07: rows whose text starts with none of the prefixes, without a nested loop: each text is cut at the lengths that
    prefixes have, and the cuts meet the prefixes by hash. The few lengths are read to the driver."""
    known = prefixes.select(F.col(prefix_column).alias("__prefix")).where("__prefix is not null and __prefix <> ''").distinct()
    sizes = [r[0] for r in known.select(F.length("__prefix")).distinct().collect()]
    if not sizes:
        return df
    cuts = df.select(column).where(F.col(column).isNotNull()).distinct().select(column, F.explode(F.array(*(F.substring(column, 1, n) for n in sizes))).alias("__prefix"))
    hit = cuts.join(known, "__prefix", "left_semi").select(F.col(column).alias("__hit")).distinct()
    return df.join(hit, F.col(column) == F.col("__hit"), "left_anti")


def without_substrings(df: DataFrame, column: str, parts: DataFrame, part_column: str) -> DataFrame:
    """J-07, F-20: rows whose text contains none of the parts; a null text contains none. All parts are looked for at once, by one automaton
    for up to ``BROADCAST_ROWS`` parts (its size is counted before), so a text is read once whatever their number; more parts give more automata."""
    known = parts.select(F.col(part_column).alias("__part")).where("__part is not null and __part <> ''").distinct()
    blocks = max(1, -(-known.count() // BROADCAST_ROWS))
    for b in range(blocks):
        mine = [r[0] for r in known.where(F.pmod(F.xxhash64("__part"), F.lit(blocks)) == b).collect()]
        if mine:
            df = df.where(~_holds_any(df.sparkSession.sparkContext.broadcast(mine))(F.coalesce(column, F.lit(""))))
    return df


def _holds_any(parts):
    name = uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        if not (automaton := AUTOMATA.get(name)):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p in parts.value:
                automaton.add_word(p, 1)
            automaton.make_automaton()
            AUTOMATA[name] = automaton
        return pa.array([next(automaton.iter(t), None) is not None for t in texts.to_pylist()], pa.bool_())

    return run


def left_first(df: DataFrame, key: str, other: DataFrame, other_key: str, order: list[str], columns: list[str]) -> DataFrame:
    """J-03: each row with the first match of ``other``, nulls without one."""
    mine = other.select(F.col(other_key).alias("__key"), *order, *(c for c in columns if c not in order)).where("__key is not null")
    first = first_by(mine, ["__key"], list(order)).select("__key", *(F.col(c).alias(f"__r_{c}") for c in columns))
    return df.join(first, F.col(key) == F.col("__key"), "left").drop("__key").withColumnsRenamed({f"__r_{c}": c if c not in df.columns else f"{c}_right" for c in columns})


def needs_compile(df: DataFrame) -> DataFrame:
    """F-15: not successful, and there is new code that differs."""
    return df.where(~F.col("status").eqNullSafe(F.lit("success")) & F.col("code_new").isNotNull() & (F.col("code_new") != F.coalesce("code", F.lit(""))))


def merge_results(df: DataFrame, results: DataFrame, key: str = "file_id") -> DataFrame:
    """J-12: ``status_new`` and ``log_new`` from compile results (key, status, log), the old values where there are none."""
    found = first_by(results.select(F.col(key).alias("__key"), F.col("status").alias("__status"), F.col("log").alias("__log")), ["__key"], ["__status", "__log"])
    old = [c for c in ("status_new", "log_new") if c in df.columns]
    merged = df.join(found, F.col(key) == F.col("__key"), "left")
    values = {"status_new": F.coalesce("__status", *(["status_new"] if "status_new" in old else [])), "log_new": F.coalesce("__log", *(["log_new"] if "log_new" in old else []))}
    return merged.withColumns(values).drop("__key", "__status", "__log")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """D-05, D-06: all rows; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_less(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """D-07: all rows of the first frame, and those of the second whose key the first lacks."""
    return first.unionByName(not_in_reference(second, F.col(key), first, F.col(key)))


def with_values(df: DataFrame, *columns: str, filled: tuple[str, ...] = ()) -> DataFrame:
    """F-06, F-05: rows in which the columns have values, and those of ``filled`` are not blank."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    for c in filled:
        df = df.where(~is_blank(c))
    return df


def projects_with(df: DataFrame, project: str, *marks: str, text: str = "text") -> DataFrame:
    """F-07, F-08, F-09: all files of the projects of which some file contains one of the marks. Null projects have none."""
    hit = F.lit(False)
    for mark in marks:
        hit = hit | F.contains(F.col(text), F.lit(mark))
    return df.join(df.where(hit).select(project).distinct(), project, "left_semi")


def failure_counts(df: DataFrame, project: str, failed: str) -> DataFrame:
    """A-14: (project, n, n_failed)."""
    return df.groupBy(project).agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("n_failed"))


def failure_budget(df: DataFrame, project: str, path: str, failed: str, most: int = 3, keep_before: bool = True) -> DataFrame:
    """F-26, W-07: successful files of projects, in order of path, until more than ``most`` failed; what came before is kept, or
    nothing of such a project. The counts run over ranges of files, so a project may have any number of them."""
    from inkmill.operators.sampling import running

    failures = F.when(F.col(failed), 1).otherwise(0)
    if keep_before:
        seen = running(df, [project], [path], {"__failed": failures})
    else:
        totals = df.groupBy(F.col(project).alias("__project")).agg(F.sum(failures).alias("__failed"))
        seen = df.join(totals, F.col(project).eqNullSafe(F.col("__project"))).drop("__project")
    return seen.where((F.col("__failed") <= most) & ~F.coalesce(F.col(failed), F.lit(False))).drop("__failed")


def containing_spans(inner: DataFrame, outer: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """J-11: each inner span with the first outer span of the same ``key`` that contains it (``outer_start``, ``outer_end``, null
    without one). The key makes it an equi-join; the spans of one document are few."""
    o = outer.select(F.col(key).alias("__key"), F.col(start).alias("__start"), F.col(end).alias("__end"))
    inside = inner.join(o, (F.col(key) == F.col("__key")) & (F.col("__start") <= F.col(start)) & (F.col(end) <= F.col("__end")), "left")
    keys = inner.columns
    return inside.groupBy(*keys).agg(F.min(F.struct("__start", "__end")).alias("__o")).select(*keys, F.col("__o.__start").alias("outer_start"), F.col("__o.__end").alias("outer_end"))
