"""Predictions against references: scores by row and one row of means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.latex import relevant_code
from inkmill.functions.sequences import lexed, pretoken_count
from inkmill.functions.text import clean_code, extract_answer
from inkmill.operators.assembly import report_with_rate
from inkmill.operators.metrics import tex_edit_distance
from inkmill.operators.relational import left_first


def score_predictions(truth: DataFrame, predictions: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """(figure_id, description, tikz_pred, compiled, tex_edit_distance, tokens): each reference with its first prediction (a row of
    nulls and a distance of 1 without one). Later captions replace the reference's."""
    gt = truth.select("figure_id", "code", F.col("new_caption").alias("description"))
    if captions is not None:
        gt = left_first(gt, "figure_id", captions, "file_id", ["new_caption"], ["new_caption"]).withColumn("description", F.coalesce("new_caption", "description")).drop("new_caption")
    pred = predictions.select(F.col("figure_id").alias("__id"), clean_code(extract_answer("tikz_pred")).alias("tikz_pred"), F.col("compiled").cast("boolean").alias("compiled"))
    rows = left_first(gt, "figure_id", pred, "__id", ["tikz_pred", "compiled"], ["tikz_pred", "compiled"])
    distance = tex_edit_distance(lexed(relevant_code("tikz_pred"), True), lexed(relevant_code("code"), True))
    return rows.select("figure_id", "description", "tikz_pred", F.coalesce("compiled", F.lit(False)).alias("compiled"), F.when(F.col("tikz_pred").isNull(), F.lit(1.0)).otherwise(distance).alias("tex_edit_distance"), pretoken_count("tikz_pred").cast("bigint").alias("tokens"))


def report(scored: DataFrame) -> DataFrame:
    """One row: counts, the compile rate, means and deviations. Rows that did not compile count as 0 in scores of likeness."""
    return report_with_rate(scored.withColumn("closeness", 1 - F.col("tex_edit_distance")), ["closeness", "tokens"], F.col("compiled"), ~F.col("compiled"))
