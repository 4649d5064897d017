"""Record builders: papers, files of repositories, positional ids and run names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import is_blank, paper_id

PAPER_URL = "https://arxiv.org/abs/"


def paper_records(df: DataFrame, paper: str, text: str, source: Column | str, modified: Column | None = None, yymm: Column | None = None) -> DataFrame:
    """P-04, P-05, F-24, T-30: (text, meta) of papers; a name that is no paper id stays as it is; ``yymm`` is its first four characters
    unless given. Blank texts are left out; the time of change is written in ISO form, null without one."""
    name = F.coalesce(paper_id(paper), F.col(paper))
    stamp = F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss") if modified is not None else F.lit(None).cast("string")
    meta = F.named_struct(F.lit("timestamp"), stamp, F.lit("yymm"), yymm if yymm is not None else F.substring(name, 1, 4), F.lit("arxiv_id"), name, F.lit("url"), F.concat(F.lit(PAPER_URL), name), F.lit("source"), F.col(source) if isinstance(source, str) else source)
    return df.where(~is_blank(text)).select(F.col(text).alias("text"), meta.alias("meta"))


def repository_records(df: DataFrame) -> DataFrame:
    """Q-10: files of repositories (repo, path, content) in the form of papers."""
    meta = F.named_struct(F.lit("timestamp"), F.lit(None).cast("string"), F.lit("yymm"), F.lit(None).cast("string"), F.lit("arxiv_id"), F.lit(None).cast("string"), F.lit("url"), F.concat_ws("/", "repo", "path"), F.lit("source"), F.lit("github"))
    return df.where(~is_blank("content")).select(F.col("content").alias("text"), meta.alias("meta"))


def titled(df: DataFrame, first: str, second: str, keywords: str | None = None, name: str = "description") -> DataFrame:
    """P-07: ``first: second``, with the keywords in parentheses if there are any."""
    text = F.concat(F.coalesce(first, F.lit("")), F.lit(": "), F.coalesce(second, F.lit("")))
    if keywords:
        text = F.when(is_blank(keywords), text).otherwise(F.concat(text, F.lit(" (Keywords: "), F.col(keywords), F.lit(")")))
    return df.withColumn(name, text)


def positional_id(*parts: Column | str) -> Column:
    """P-10: parts joined by underscores, nulls left out."""
    return F.concat_ws("_", *(p if isinstance(p, Column) else F.col(p) for p in parts))


def with_code_after(df: DataFrame, code: Column, after: str = "query") -> DataFrame:
    """P-13, F-22: ``code`` as a column right after another one; a code that is there stays."""
    value = F.coalesce("code", code) if "code" in df.columns else code
    columns = [c for c in df.columns if c != "code"]
    at = columns.index(after) + 1
    return df.select(*columns[:at], value.alias("code"), *columns[at:])


def run_name(**settings) -> str:
    """P-11: the name of a run from its settings, in their order; None and False are left out."""
    return "_".join(f"{k}-{v}" if v is not True else k for k, v in settings.items() if v is not None and v is not False)
