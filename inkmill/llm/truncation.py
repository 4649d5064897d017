r"""Text cut off by field limits or in mid-transfer.

Everything rests on *discrete hazards*: of the things that reach a state, the share that end in it.

*By length*: of the texts of a source that reach a length, the share that stops there. A field limit shows as a hazard far
above its neighbours'; each length is tested against the lengths within ``NEIGHBOURHOOD`` of it (Poisson tail, Chernoff
bound) under the Benjamini-Hochberg rule by source, twice: the second time the neighbours that are limits themselves are left out.

*By construct*, for cuts in mid-transfer, which come at any length: of the places (tokens) within a document or an environment, the share
at which the text stops with it open; of the groups, the share left open; and of the commands that have got so many arguments
(or free text), the share after which their block ends.
A construct whose hazard is significantly below ``STOPS`` (lower tail, step-up rule over all constructs) is one in which no text
stops of itself. The hazards are counted over all texts; ``prior`` adds what LaTeX and TikZ prescribe as so many observations,
so that a small table has it too; data that say otherwise outweigh it.

A text is truncated if it stops inside a construct in which no text stops of itself, or if its ending is only weakly incomplete (a mark,
a comment in mid-line) and its length is significant. ``kind`` tells cuts at a significant length from those in mid-transfer.
Without hazards nothing is found.

Comments end nothing and are left out; marks put where a text was cut (an ellipsis, "[truncated]") are taken off before its
length is measured. Hazards are computed from counts that each task has added up before, so a source or a construct that holds most
rows costs no more than others.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmill.session import materialise

NEIGHBOURHOOD = 50
FALSE_DISCOVERIES = 0.01
#: Fewer texts than this at one length are no field limit, however rare the length.
LEAST_ENDS = 3
#: The share of stops from which a construct counts as one that texts may end in.
STOPS = 0.05
#: As how many observations the prescribed constructs count.
PRIOR = 1000
#: Steps of the step-up rule over constructs: halves of p-values.
HALVINGS = 60
WHOLE, WEAK, CERTAIN = 0, 1, 2
#: The state of a command after free text, and the most arguments that are told apart (LaTeX allows nine).
FREE, MOST_ARGUMENTS = -1, 9

# Commands whose statement ends with a semicolon, and the groups that other commands must have.
STATEMENTS = ("draw", "fill", "filldraw", "path", "node", "coordinate", "shade", "shadedraw", "clip", "pattern", "matrix", "foreach", "addplot", "pic", "graph", "calendar", "useasboundingbox", "pgfplotsinvokeforeach")
GROUPS = {"tikzset": 1, "pgfplotsset": 1, "usetikzlibrary": 1, "usepgfplotslibrary": 1, "usepackage": 1, "RequirePackage": 1, "definecolor": 3, "colorlet": 2, "newcommand": 2, "renewcommand": 2, "providecommand": 2, "newenvironment": 3, "begin": 1, "end": 1, "addlegendentry": 1, "caption": 1, "label": 1, "input": 1, "ctikzset": 1, "tikzcdset": 1, "documentclass": 1, "pagestyle": 1, "setlength": 2, "newlength": 1, "ProvidesPackage": 1, "tdplotsetmaincoords": 2, "DeclareMathOperator": 2, "title": 1, "pgfmathsetmacro": 2}

MARK = re.compile(r"(?:\s*(?:\N{HORIZONTAL ELLIPSIS}|\N{REPLACEMENT CHARACTER}|\.{3,}|[\[(<{]\s*(?:\.{2,}|\N{HORIZONTAL ELLIPSIS}|(?:[\w ]{0,20}\b)?(?:truncated|clipped|snip(?:ped)?|cut(?: off)?|shortened|omitted|trimmed|continued|more)\b[\w ]{0,20})\s*[\])>}]))+\s*\Z", re.I)
MARK_ENDS = "\N{HORIZONTAL ELLIPSIS}\N{REPLACEMENT CHARACTER}.])>}"
COMMENT = re.compile(r"(?<!\\)((?:\\\\)*)%[^\n]*")
END_DOCUMENT = re.compile(r"\\end\s*\{\s*document\s*\}")
DOCUMENT = re.compile(r"\\documentclass|\\documentstyle|\\begin\s*\{\s*document\s*\}")
TOKEN = re.compile(r"\\(begin|end)\s*\{\s*([^{}\\\n]*?)\s*\}|\\([A-Za-z@]+)\*?|\\[^A-Za-z]|[{}\[\];]")
LAST_WORD = re.compile(r"(?<!\\)(?:\\\\)*\\([A-Za-z@]*)\Z")
#: A construct: (kind, name, step). Steps count the arguments of commands.
Construct = tuple[str, str, int]
WHOLE_DOCUMENT, GROUP = ("document", "document", 0), ("group", "{", 0)
#: Constructs that a task counts before it hands them on.
HELD_CONSTRUCTS = 200_000
WALKED = ("id", "source", "length", "other", "still", "kind", "name", "step", "visits", "stops")
WALKED_SCHEMA = "id string, source string, length int, other boolean, still array<struct<kind:string,name:string,step:int>>, kind string, name string, step int, visits long, stops long"
STILL = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("step", pa.int32())]))


def without_mark(text: str) -> str:
    """The text without marks of a cut at its end (and white space about these). A mark after a finished document stays harmless."""
    return MARK.sub("", text) if text.rstrip()[-1:] in MARK_ENDS else text


def _prescribed() -> dict[Construct, int]:
    """Constructs in which LaTeX and TikZ let no text stop, but for environments, of which each name counts."""
    steps = [(c, s) for c in STATEMENTS for s in (FREE, *range(MOST_ARGUMENTS + 1))] + [(c, s) for c, n in GROUPS.items() for s in range(n)]
    return {WHOLE_DOCUMENT: PRIOR, GROUP: PRIOR} | {("command", c, s): PRIOR for c, s in steps}


PRESCRIBED = _prescribed()
BEGINNINGS = frozenset(c[:n] for _, c, s in PRESCRIBED if s == 0 for n in range(len(c) + 1))


def prescribed(construct: Construct) -> bool:
    kind, name, _ = construct
    return kind == "environment" or construct in PRESCRIBED or (kind == "beginning" and name in BEGINNINGS)


def _finished(text: str) -> int:
    """The place after the first end of a document that is not commented out, or -1."""
    for m in END_DOCUMENT.finditer(text):
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if not COMMENT.search(line):
            return m.end()
    return -1


class Counts:
    """Visits and stops by construct."""

    def __init__(self):
        self.visits: dict[Construct, int] = {}
        self.stops: dict[Construct, int] = {}

    def stop(self, construct: Construct) -> None:
        self.stops[construct] = self.stops.get(construct, 0) + 1

    def visit(self, construct: Construct, n: int) -> None:
        self.visits[construct] = self.visits.get(construct, 0) + n


def walk(text: str, counts: Counts) -> tuple[list[Construct], bool]:
    """The constructs that are open where ``text`` stops, and whether there is any other sign of a cut. What the text passes through
    is added to ``counts``; a stop is laid to a command only if nothing around it is open."""
    end = _finished(text)
    bare = text[:end] if end >= 0 else without_mark(text)
    cut_mark = end < 0 and len(bare.rstrip()) < len(text.rstrip())
    code = COMMENT.sub(r"\1", bare).rstrip()
    if not code:
        return [], cut_mark
    visits = counts.visits
    stack: list[tuple[str, int, int, int]] = []  # name, depth, base outside, number of the token
    depth = base = bracket = last = groups = 0
    # the last command of the block, while it counts as open, and whether free text after it is to be looked for
    command, step, bound = None, 0, False
    i = -1
    for i, m in enumerate(TOKEN.finditer(code)):
        sign = m[0]
        if sign == "{":
            if bound and depth == base and not bracket and code[last : m.start()].strip():
                step, bound = FREE, False
                visits[key] = visits.get(key := ("command", command, FREE), 0) + 1
            depth += 1
            groups += 1
            last = m.end()
            continue
        if sign == "}":
            if depth > base:
                depth -= 1
                if depth == base and bound and not bracket:
                    step = min(step + 1, MOST_ARGUMENTS)
                    visits[key] = visits.get(key := ("command", command, step), 0) + 1
            last = m.end()
            continue
        plain = depth == base
        kind = m[1]
        if not plain and kind is None:
            last = m.end()
            continue
        at = m.start()
        if bound and plain and not bracket and code[last:at].strip():
            step, bound = FREE, False
            visits[key] = visits.get(key := ("command", command, FREE), 0) + 1
        last = m.end()
        if kind == "begin":
            stack.append((m[2], depth, base, i))
            base, command, bound, bracket = depth, None, False, 0
        elif kind == "end":
            name = m[2]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if command is not None and k == len(stack) - 1 and plain:
                        counts.stop(("command", command, step))
                    for lost, _, _, since in stack[k + 1 :]:
                        counts.visit(("environment", lost, 0), i - since)
                        counts.stop(("environment", lost, 0))
                    _, depth, base, since = stack[k]
                    counts.visit(("environment", name, 0), i - since)
                    del stack[k:]
                    break
            command, bound, bracket = None, False, 0
        elif (word := m[3]) is not None:
            if not bracket:
                if command is None or not code[code.rfind("\n", 0, at) + 1 : at].strip():
                    command, step, bound = word, 0, True
                    visits[key] = visits.get(key := ("command", word, 0), 0) + 1
                elif bound:
                    step, bound = FREE, False
                    visits[key] = visits.get(key := ("command", command, FREE), 0) + 1
        elif sign == ";":
            command, bound, bracket = None, False, 0
        elif sign == "[":
            bracket += 1
        elif sign == "]":
            bracket = max(0, bracket - 1)
        elif bound and not bracket:
            step, bound = FREE, False
            visits[key] = visits.get(key := ("command", command, FREE), 0) + 1
    if bound and depth == base and code[last:].strip():
        step = FREE
        counts.visit(("command", command, FREE), 1)
    if groups:
        counts.visit(GROUP, groups)
    document = end >= 0 or bool(DOCUMENT.search(code))
    if document:
        counts.visit(WHOLE_DOCUMENT, i + 1)
    if end >= 0:
        return [], False
    still: list[Construct] = [WHOLE_DOCUMENT] if document else []
    still += [("environment", name, 0) for name in dict.fromkeys(n for n, *_ in stack)]
    for lost, _, _, since in stack:
        counts.visit(("environment", lost, 0), i - since)
        counts.stop(("environment", lost, 0))
    if document:
        counts.stop(WHOLE_DOCUMENT)
    if depth > 0:
        counts.stop(GROUP)
        still.append(GROUP)
    around = bool(still)
    if command is not None and depth == base:
        still.append(("command", command, step))
        if not around:
            counts.stop(("command", command, step))
    if word := LAST_WORD.search(code):
        still.append(("beginning", word[1], 0))
    other = cut_mark or bool(COMMENT.search(bare.rsplit("\n", 1)[-1]))
    return still, other


def ending(text: str) -> int:
    """WHOLE, WEAK or CERTAIN by what LaTeX and TikZ prescribe: how surely something is still open where ``text`` stops."""
    still, other = walk(text, Counts())
    return CERTAIN if any(map(prescribed, still)) else WEAK if other else WHOLE


def _walk_rows(batches):
    """A row for each text that is not blank, and at the end a row for each construct that the task's texts passed through."""
    counts = Counts()
    for batch in batches:
        ids, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(i, s, len(without_mark(t)), *reversed(walk(t, counts))) for i, s, t in zip(ids, sources, batch.column(2).to_pylist()) if t is not None and t.strip()]
        if rows:
            ids, sources, length, other, still = zip(*rows)
            found = pa.array([[dict(zip(("kind", "name", "step"), c)) for c in x] for x in still], STILL)
            empty = [pa.nulls(len(rows), t) for t in (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sources, pa.string()), pa.array(length, pa.int32()), pa.array(other, pa.bool_()), found, *empty], names=WALKED)
        if len(counts.visits) > HELD_CONSTRUCTS:
            yield _count_rows(counts)
            counts = Counts()
    if counts.visits or counts.stops:
        yield _count_rows(counts)


def _count_rows(counts: Counts) -> pa.RecordBatch:
    keys = list(counts.visits.keys() | counts.stops.keys())
    empty = [pa.nulls(len(keys), t) for t in (pa.string(), pa.string(), pa.int32(), pa.bool_(), STILL)]
    values = [[found.get(k, 0) for k in keys] for found in (counts.visits, counts.stops)]
    columns = [pa.array(x, t) for x, t in zip((*zip(*keys), *values), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([*empty, *columns], names=WALKED)


def walked(df: DataFrame, id_col: str = "file_id", text_col: str = "code", source_col: str = "source") -> DataFrame:
    """What ``walk`` finds: rows of texts (``kind`` null; null and blank texts take no part) and rows of counted constructs."""
    text = df.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return text.mapInArrow(_walk_rows, WALKED_SCHEMA)


def prior(spark: SparkSession) -> DataFrame:
    """What LaTeX and TikZ prescribe, as ``PRIOR`` visits without a stop. Environments, of which each name counts, are not listed."""
    kinds, names, steps = zip(*PRESCRIBED)
    columns = [pa.array(kinds), pa.array(names), pa.array(steps, pa.int32()), pa.array(PRESCRIBED.values(), pa.int64()), pa.array([0] * len(PRESCRIBED), pa.int64())]
    return spark.createDataFrame(pa.table(columns, names=["kind", "name", "step", "visits", "stops"]))


def construct_hazards(counted: DataFrame, with_prior: bool = True) -> DataFrame:
    """(kind, name, step, visits, stops, hazard, p_value) of constructs, from rows (kind, name, step, visits, stops). ``p_value``: how
    likely so few stops are if the hazard were ``STOPS`` (Chernoff bound of the Poisson lower tail)."""
    if with_prior:
        counted = counted.unionByName(prior(counted.sparkSession))
    observed = counted.groupBy("kind", "name", "step").agg(F.sum("visits").alias("visits"), F.sum("stops").alias("stops"))
    if with_prior:
        observed = observed.withColumn("visits", F.col("visits") + F.when(F.col("kind") == "environment", PRIOR).otherwise(0))
    mean, stops = STOPS * F.col("visits"), F.col("stops")
    tail = F.when(stops == 0, F.exp(-mean)).when(stops < mean, F.exp(-(mean - stops + stops * F.log(stops / mean)))).otherwise(F.lit(1.0))
    return observed.where("visits > 0").withColumn("hazard", F.col("stops") / F.col("visits")).withColumn("p_value", tail)


def unended(tested: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(kind, name, step) of the constructs in which no text stops of itself, from ``construct_hazards``. The step-up rule of Benjamini and
    Hochberg, with p-values rounded up to powers of a half: counts of ``HALVINGS`` steps, which the driver reads, rank any number of
    constructs. The beginnings of commands that are not left without an argument belong to them, as kind ``beginning``."""
    rung = F.least(F.lit(HALVINGS), F.floor(-F.log2(F.greatest("p_value", F.lit(2.0**-HALVINGS))))).cast("int")
    tested = tested.withColumn("rung", rung)
    ladder = dict(tested.groupBy("rung").agg(F.count("*")).collect())
    so_low = {r: sum(n for q, n in ladder.items() if q >= r) for r in ladder}
    lowest = min((r for r in ladder if 0.5**r <= rate * so_low[r] / sum(ladder.values())), default=HALVINGS + 1)
    found = tested.where(F.col("rung") >= lowest).select("kind", "name", "step")
    started = found.where("kind = 'command' and step = 0").select(F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda n: F.substring("name", F.lit(1), n))).alias("name")).distinct()
    return found.unionByName(started.select(F.lit("beginning").alias("kind"), "name", F.lit(0).alias("step")))


def _chernoff(ends, mean):
    return F.when(ends > mean, F.exp(-(ends * F.log(ends / mean) - ends + mean))).otherwise(F.lit(1.0))


def _step_up(tested: DataFrame) -> DataFrame:
    """``tested`` with the ``q_value`` of each ``p_value`` within its source: the least of p * m / rank over this and all higher p."""
    order = Window.partitionBy("source").orderBy("p_value", "length")
    ranked = tested.withColumn("rank", F.row_number().over(order)).withColumn("tests", F.count("*").over(Window.partitionBy("source")))
    q = F.min(F.col("p_value") * F.col("tests") / F.col("rank")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return ranked.withColumn("q_value", F.least(q, F.lit(1.0))).drop("rank", "tests", "p_value")


def hazards(lengths: DataFrame, neighbourhood: int = NEIGHBOURHOOD, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(source, length, ends, at_risk, hazard, near_hazard, q_value) from rows of (source, length).

    ``near_hazard`` pools the other lengths within ``neighbourhood``, those at which no text ends included, but not those that are
    significant when all are pooled. A null source is a source of its own. ``q_value`` is the smallest rate of false discoveries at which
    the length is significant.
    """
    counts = lengths.groupBy("source", "length").agg(F.count("*").alias("ends"))
    by = Window.partitionBy("source").orderBy("length")
    near = by.rangeBetween(-neighbourhood, neighbourhood)
    at_risk = counts.withColumn("at_risk", F.sum("ends").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    gap = F.least(F.col("length") - F.coalesce(F.lag("length").over(by), F.lit(0)), F.lit(2 * neighbourhood))
    exposed = at_risk.withColumn("exposure", F.greatest(gap, F.lit(1)) * F.col("at_risk"))

    def tested(rows: DataFrame, ends, exposure, own_ends, own_exposure) -> DataFrame:
        rows = rows.withColumn("near_ends", F.sum(ends).over(near) - own_ends).withColumn("near_exposure", F.sum(exposure).over(near) - own_exposure)
        rows = rows.withColumn("near_hazard", (F.col("near_ends") + 0.5) / (F.col("near_exposure") + 1.0))
        return _step_up(rows.withColumn("p_value", _chernoff(F.col("ends"), F.col("near_hazard") * F.col("at_risk"))))

    first = tested(exposed, F.col("ends"), F.col("exposure"), F.col("ends"), F.col("at_risk"))
    limit = (F.col("q_value") <= rate) & (F.col("ends") >= LEAST_ENDS)
    # a limit leaves the pool with its own ends and exposure; the lengths up to it stay exposed
    plain = first.withColumn("plain_ends", F.when(limit, 0).otherwise(F.col("ends"))).withColumn("plain_exposure", F.col("exposure") - F.when(limit, F.col("at_risk")).otherwise(0))
    own = [F.when(limit, 0).otherwise(F.col(c)) for c in ("ends", "at_risk")]
    second = tested(plain.withColumn("own_ends", own[0]).withColumn("own_exposure", own[1]), F.col("plain_ends"), F.col("plain_exposure"), F.col("own_ends"), F.col("own_exposure"))
    return second.select("source", "length", "ends", "at_risk", (F.col("ends") / F.col("at_risk")).alias("hazard"), "near_hazard", "q_value")


def limits(found: DataFrame, neighbourhood: int = NEIGHBOURHOOD, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """The lengths at which significantly many texts of a source end, from rows with (source, length)."""
    return hazards(found.select("source", "length"), neighbourhood, rate).where((F.col("q_value") <= rate) & (F.col("ends") >= LEAST_ENDS))


def lengths(df: DataFrame, text_col: str = "code", source_col: str = "source") -> DataFrame:
    """(source, length) of the texts that are not blank, without marks of a cut."""
    return walked(df, source_col, text_col, source_col).where("kind is null").select("source", "length")


def truncated(df: DataFrame, id_col: str = "file_id", text_col: str = "code", source_col: str = "source", neighbourhood: int = NEIGHBOURHOOD, rate: float = FALSE_DISCOVERIES, with_prior: bool = True) -> DataFrame:
    """(id, source, length, kind) of the rows whose text was cut off; kind is ``limit`` or ``transfer``.

    Null and blank texts are no cases. Repeated rows come out as often as they go in. Rows with a null source share one group.
    Other columns are not read; an empty table gives an empty result. ``with_prior=False`` goes by the table alone.
    """
    found = materialise(walked(df, id_col, text_col, source_col))
    texts = found.where("kind is null").select("id", "source", "length", "other", "still")
    closed = unended(construct_hazards(found.where("kind is not null").select("kind", "name", "step", "visits", "stops"), with_prior), rate)
    cuts = limits(texts, neighbourhood, rate).select(F.col("source").alias("cut_source"), F.col("length").alias("cut_length"))
    numbered = texts.where(F.col("other") | (F.size("still") > 0)).withColumn("row", F.monotonically_increasing_id())
    certain = numbered.select("row", F.explode("still").alias("c")).select("row", "c.*").join(closed, ["kind", "name", "step"], "left_semi").select("row").distinct().withColumn("certain", F.lit(True))
    joined = numbered.join(certain, "row", "left").join(cuts, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("length") == F.col("cut_length")), "left")
    at_limit = F.col("cut_length").isNotNull()
    return joined.where(F.col("certain") | (F.col("other") & at_limit)).select("id", "source", "length", F.when(at_limit, "limit").otherwise("transfer").alias("kind"))


def truncation_report(df: DataFrame, cut: DataFrame, text_col: str = "code", source_col: str = "source") -> DataFrame:
    """By source: rows, rows with a text, truncated rows (at a limit and in mid-transfer), and their share of the rows with a text."""
    filled = F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?U)\s+", "")) > 0
    all_rows = df.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n_rows"), F.count_if(filled).alias("n_filled"))
    cut_rows = cut.groupBy(F.col("source").alias("cut_source")).agg(F.count("*").alias("n_truncated"), F.count_if(F.col("kind") == "limit").alias("n_limit"))
    both = all_rows.join(cut_rows, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    zero = F.lit(0).cast("bigint")
    n = F.coalesce("n_truncated", zero)
    return both.select("source", "n_rows", "n_filled", n.alias("n_truncated"), F.coalesce("n_limit", zero).alias("n_limit"), F.when(F.col("n_filled") > 0, n / F.col("n_filled")).alias("share"))


def p2_found(df: DataFrame) -> DataFrame:
    return truncated(df).select(F.col("id").alias("file_id"))
