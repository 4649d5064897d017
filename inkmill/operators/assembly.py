"""Questions with their answers, and reports over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.operators.relational import first_by
from inkmill.operators.sampling import running

MIN_SCORE = -10_000


def has_tags(tags: Column | str, wanted: list[str]) -> Column:
    """F-10: all tags occur, each as ``<tag>``."""
    hit = F.lit(True)
    for t in wanted:
        hit = hit & F.contains(F.col(tags) if isinstance(tags, str) else tags, F.lit(f"<{t}>"))
    return hit


# The columns that are kept of each kind of post.
POST_COLUMNS = {"question": ("id", "body", "title", "tags", "answercount", "acceptedanswerid"), "answer": ("id", "body", "score", "creationdate", "parentid")}


def trimmed_posts(posts: DataFrame, kind: str) -> DataFrame:
    """P-03: the questions or answers with the columns that count for them, as far as they are there; a question gets ``parsedanswers`` 0."""
    if kind not in POST_COLUMNS:
        raise ValueError(f"unknown kind of post: {kind}; known are {', '.join(POST_COLUMNS)}")
    rows = posts.where(F.col("posttypeid") == (1 if kind == "question" else 2)).select(*(c for c in POST_COLUMNS[kind] if c in posts.columns))
    return rows.withColumn("parsedanswers", F.lit(0)) if kind == "question" else rows


def assemble(posts: DataFrame, tags: list[str] | None = None, min_score: int = MIN_SCORE) -> DataFrame:
    """R-01 in batch, J-04, A-06, A-07, F-10, F-11: each question with its answers, once all of them are there.

    A post that was delivered twice counts once. Answers are those of the question that were accepted or have at least ``min_score`` (null
    counts as 0), with a body; a question comes out if it has ``answercount`` > 0 of them. ``answers`` are sorted by id.
    Order of arrival does not matter. A question's answers are gathered in one row, as the result demands; the join and the
    count before it leave out the questions that are not complete.
    """
    once = first_by(posts.select("id", "posttypeid", "parentid", "acceptedanswerid", "answercount", "score", "creationdate", "title", "tags", "body"), ["id"], ["creationdate"])
    questions = once.where("posttypeid = 1 and answercount > 0 and body is not null")
    if tags:
        questions = questions.where(has_tags("tags", tags))
    questions = questions.select(F.col("id").alias("question_id"), "title", F.col("body").alias("question"), "answercount", "acceptedanswerid")
    answers = once.where("posttypeid = 2 and parentid is not null and body is not null").select(F.col("id").alias("answer_id"), "parentid", F.coalesce("score", F.lit(0)).alias("score"), F.col("body").alias("answer"))
    valid = (F.col("answer_id") == F.col("acceptedanswerid")) | (F.col("score") >= min_score)
    joined = answers.join(questions.select("question_id", "acceptedanswerid", "answercount"), F.col("parentid") == F.col("question_id")).where(F.coalesce(valid, F.col("score") >= min_score))
    complete = joined.groupBy("question_id").agg(F.count("*").alias("n"), F.first("answercount").alias("answercount")).where("n = answercount").select("question_id")
    listed = joined.join(complete, "question_id", "left_semi").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("answer_id", "score", "answer"))).alias("answers"))
    return questions.join(listed, "question_id").select("question_id", "title", "question", "answers")


def mean_report(df: DataFrame, scores: list[str], failed: Column | None = None, *more: Column) -> DataFrame:
    """A-02, A-03: for each score its mean and population deviation, null scores (and those of failed rows) counting as 0; and ``more`` aggregates."""
    value = lambda c: F.coalesce(F.when(failed, F.lit(0.0)).otherwise(F.col(c).cast("double")) if failed is not None else F.col(c).cast("double"), F.lit(0.0))
    return df.agg(F.count("*").alias("n"), *(e for c in scores for e in (F.avg(value(c)).alias(f"{c}_mean"), F.stddev_pop(value(c)).alias(f"{c}_std"))), *more)


def composite(clip: Column, dream: Column, edit: Column) -> Column:
    """A-04."""
    return (clip + dream + (1 - edit)) / 3


def report_with_rate(df: DataFrame, scores: list[str], ok: Column, failed: Column | None = None) -> DataFrame:
    """A-02, A-03, A-05: ``mean_report`` with the share of rows that hold as ``compile_rate``, in one pass."""
    return mean_report(df, scores, failed, compile_rate(ok).alias("compile_rate"))


def compile_rate(ok: Column) -> Column:
    """A-05: the share of rows that hold; null counts as a failure."""
    return F.avg(F.coalesce(ok, F.lit(False)).cast("double"))


def licence_stats(df: DataFrame, licence: str, paper: str) -> DataFrame:
    """A-10: papers and snippets by licence."""
    return df.groupBy(licence).agg(F.countDistinct(paper).alias("papers"), F.count("*").alias("snippets"))


def corpus_profile(df: DataFrame, *dimensions: str) -> DataFrame:
    """Extension: counts and lengths by all combinations of the dimensions (a cube); totals have nulls and their level."""
    return df.cube(*dimensions).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(F.col("code").isNotNull()).alias("n_code"), F.sum(F.length("code")).alias("chars"))


def context_frames(df: DataFrame, keys: list[str], order: str, text: str, before: int = 1, after: int = 3, name: str = "context") -> DataFrame:
    """W-03: each row's text with that of the rows around it, joined by a space; null texts are left out.

    Each text goes to the places that it is around of, so no key needs one task for all its rows.
    """
    placed = running(df, keys, [order], {"__place": F.lit(1)})
    near = placed.select(*keys, F.explode(F.sequence(F.col("__place") - after, F.col("__place") + before)).alias("__place"), F.struct(F.col("__place").alias("at"), F.col(text).alias("text")).alias("t"))
    frames = near.groupBy(*keys, "__place").agg(F.sort_array(F.collect_list("t")).alias("t"))
    frames = frames.select(*(F.col(k).alias(f"__f_{i}") for i, k in enumerate(keys)), F.col("__place").alias("__f_place"), F.array_join("t.text", " ").alias("__frame"))
    match = F.col("__place") == F.col("__f_place")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"__f_{i}"))
    return placed.join(frames, match).select(*df.columns, F.col("__frame").alias(name))


def with_last_before(df: DataFrame, value: Column, keys: list[str], order: str, name: str) -> DataFrame:
    """W-05: each row with the last value that is not null in the rows of its key before, without one task for a key."""
    return running(df, keys, [order], lasts={name: value})


def last_before(value: Column, keys: list[str], order: str) -> Column:
    """W-05: the last value that is not null in the rows before, as a window for keys of few rows (see ``with_last_before``)."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def per_parent_titles(df: DataFrame, parent: str, order: str, base: Column, name: str = "title") -> DataFrame:
    """P-09, W-02: ``base_1`` and so on where a parent has more than one row, else ``base``."""
    counts = df.groupBy(F.col(parent).alias("__parent")).agg(F.count("*").alias("__n"))
    placed = running(df, [parent], [order], {"__place": F.lit(1)}).join(counts, F.col(parent).eqNullSafe(F.col("__parent")))
    return placed.withColumn(name, F.when(F.col("__n") > 1, F.concat(base, F.lit("_"), F.col("__place").cast("string"))).otherwise(base)).drop("__place", "__n", "__parent")
