"""The edge to compilers, models and encoders: registries of plain functions, with stubs that need nothing outside.

Effects run in ``mapInPandas`` on batches; what fails comes out as an error, never as a missing row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.session import materialise

Compiler = Callable[[str], tuple[str, str, bytes | None]]
Generator = Callable[[str], str]
Scorer = Callable[[DataFrame], DataFrame]


class Registry:
    """U-03, M-25: named functions; an unknown name raises."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, name: str, function: Callable) -> Callable:
        self.entries[name] = function
        return function

    def get(self, name: str) -> Callable:
        if name not in self.entries:
            raise ValueError(f"unknown {self.kind}: {name}; known are {', '.join(sorted(self.entries))}")
        return self.entries[name]


COMPILERS, GENERATORS, SCORERS = Registry("compiler"), Registry("generator"), Registry("scorer")


def check_structure(code: str) -> tuple[str, str, bytes | None]:
    """A stand-in for a compiler: the document and its environments and groups must close. Nothing drawn is ``empty``."""
    if not code or not code.strip():
        return "error", "! No code.", None
    plain = re.sub(r"(?<!\\)%[^\n]*", "", code)
    stack = []
    for m in re.finditer(r"\\(begin|end)\{([^}]*)\}", plain):
        if m[1] == "begin":
            stack.append(m[2])
        elif not stack or stack.pop() != m[2]:
            return "error", f"! LaTeX Error: \\end{{{m[2]}}} without its begin.", None
    if stack:
        return "error", f"! LaTeX Error: \\begin{{{stack[-1]}}} ended by end of file.", None
    bare = re.sub(r"\\[{}]", "", plain)
    if bare.count("{") != bare.count("}"):
        return "error", "! Missing } inserted.", None
    if "\\begin{document}" not in plain:
        return "error", "! LaTeX Error: Missing \\begin{document}.", None
    if not re.search(r"\\(draw|node|fill|filldraw|path|addplot|arrow|shade|matrix)\b|&", plain):
        return "empty", "", None
    return "success", "", None


COMPILERS.register("structure", check_structure)
GENERATORS.register("echo", lambda prompt: prompt)


def compile_codes(df: DataFrame, key: str, code: str, compiler: str | Compiler = "structure") -> DataFrame:
    """E-01, F-25, E-06: (key, status, log, png, error) of each record. Distinct codes are compiled once each. ``status`` is success,
    error or empty; if the compiler itself breaks it is error, with the reason in ``error``."""
    run = COMPILERS.get(compiler) if isinstance(compiler, str) else compiler
    keyed = df.select(key, F.col(code).alias("code"), F.sha1(F.coalesce(F.col(code), F.lit(""))).alias("sha"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for sha, text in zip(frame["sha"], frame["code"]):
                try:
                    rows.append((sha, *run(text or ""), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((sha, "error", "", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["sha", "status", "log", "png", "error"])

    once = keyed.groupBy("sha").agg(F.first("code").alias("code"))
    done = once.mapInPandas(batches, "sha string, status string, log string, png binary, error string")
    return keyed.select(key, "sha").join(done, "sha").drop("sha")


def generate(df: DataFrame, key: str, prompt: str, generator: str | Generator = "echo", retries: int = 3) -> DataFrame:
    """E-03, U-05: (key, response, error) of each prompt; a call that fails is tried again, and in the end gives a null response with
    its error."""
    call = GENERATORS.get(generator) if isinstance(generator, str) else generator

    def batches(frames):
        for frame in frames:
            out, errors = [], []
            for text in frame[prompt]:
                answer = error = None
                for _ in range(retries):
                    try:
                        answer, error = call(text), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                out.append(answer)
                errors.append(error)
            yield pd.DataFrame({key: frame[key], "response": out, "error": errors})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt).mapInPandas(batches, f"`{key}` {kind}, response string, error string")


def landed_files(df: DataFrame, address: str, name: str, folder: str, opener: str | None = None, retries: int = 3, pause: float = 0.0) -> DataFrame:
    """S-23, S-24, E-05: each address read as a stream and written below ``folder`` under its name; (address, path, bytes, error) of each.

    Addresses are opened by ``opener`` (``module:function``, which returns a readable file), else by the file system they name. What fails is
    tried again after pauses that double, and in the end leaves its error. A file that is there with its bytes is not read again; a file gets its name when it is whole.
    """
    import importlib
    import time
    import uuid

    from inkmill.sources.paths import move, open_input, open_output, size_of

    def fetch(source: str, target: str) -> int:
        open_it = getattr(importlib.import_module(opener.partition(":")[0]), opener.partition(":")[2]) if opener else open_input
        part, size = f"{folder}/_parts/{uuid.uuid4().hex}", 0
        with open_it(source) as data, open_output(part) as out:
            while block := data.read(1 << 20):
                out.write(block)
                size += len(block)
        move(part, target)
        return size

    def batches(frames):
        for frame in frames:
            rows = []
            for source, n in zip(frame[address], frame[name]):
                target, size, error = f"{folder}/{n}", None, None
                for turn in range(retries):
                    try:
                        size, error = size_of(target), None
                        size = fetch(source, target) if size is None else size
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * 2**turn)
                rows.append((source, target if error is None else None, size, error))
            yield pd.DataFrame(rows, columns=["address", "path", "bytes", "error"])

    return materialise(df.select(address, name).mapInPandas(batches, "address string, path string, bytes long, error string"))


def score_pairs(a: Column, b: Column, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> Column:
    """U-04: a scorer of batches of pairs."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return scorer(x, y)

    return run(a, b)


def reward(df: DataFrame, scores: DataFrame, key: str, score: str = "score") -> DataFrame:
    """M-10: every row with its score, 0 where there is none."""
    found = scores.groupBy(F.col(key).alias("__key")).agg(F.max(score).alias("__score"))
    return df.join(found, F.col(key) == F.col("__key"), "left").withColumn("reward", F.coalesce(F.col("__score").cast("double"), F.lit(0.0))).drop("__key", "__score")


def mapped(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """U-01, U-02: a function over batches, which may drop rows."""
    return df.mapInPandas(lambda frames: (function(f) for f in frames), schema)


def cached_apply(df: DataFrame, key: str, function: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """J-17, E-07, S-32, R-04: the results of ``function`` (which keeps ``key``), of which only those are computed that the table at
    ``path`` does not hold yet; these are added to it."""
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.parquet(path) if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target) else None
    keys = df.select(key).distinct()
    missing = df if known is None else df.join(known.select(key).distinct(), key, "left_anti")
    fresh = materialise(function(missing.dropDuplicates([key])))
    if not fresh.isEmpty():
        fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(keys, key, "left_semi") if known is not None or not fresh.isEmpty() else fresh


def resolve_inputs(files: DataFrame, project: str = "project", path: str = "path", text: str = "text", depth: int = 10) -> DataFrame:
    r"""E-02: ``\input`` and ``\include`` replaced by the files they name, within each project, to ``depth`` levels; files that are
    missing stay as commands. Files of one project are joined in one row, which a paper's size bounds."""
    pattern = re.compile(r"\\(?:input|include)\s*\{([^}]*)\}")

    def expand(name, table, level):
        return pattern.sub(lambda m: next((expand(k, table, level + 1) for k in (m[1].strip(), m[1].strip() + ".tex") if level < depth and k in table and k != name), m[0]), table[name])

    @F.udf("map<string,string>", useArrow=False)
    def run(names, texts):
        table = {n: t or "" for n, t in zip(names, texts)}
        return {n: expand(n, table, 0) for n in table}

    grouped = files.groupBy(project).agg(F.sort_array(F.collect_list(F.struct(F.col(path).alias("p"), F.col(text).alias("t")))).alias("files"))
    return grouped.select(project, F.explode(run(F.col("files.p"), F.col("files.t"))).alias(path, text))
