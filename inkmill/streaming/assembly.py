"""R-01..R-07: question assembly, deduplication and windows as streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "question_id long, title string, question string, answers array<struct<answer_id:long,score:int,answer:string>>"
STATE = "title string, question string, expected int, accepted long, emitted boolean, answers string"


def _assemble(min_score: int, timeout_ms: int):
    import json

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        title, question, expected, accepted, emitted, packed = state.get if state.exists else (None, None, None, None, False, "{}")
        answers = json.loads(packed)
        for frame in frames:
            for r in frame.itertuples():
                if r.posttypeid == 1 and pd.notna(r.answercount) and r.answercount > 0 and r.body is not None:
                    title, question, expected = r.title, r.body, int(r.answercount)
                    accepted = int(r.acceptedanswerid) if pd.notna(r.acceptedanswerid) else None
                elif r.posttypeid == 2 and r.body is not None:
                    answers[str(int(r.id))] = [int(r.score) if pd.notna(r.score) else 0, r.body]
        good = {int(k): v for k, v in answers.items() if v[0] >= min_score or int(k) == accepted}
        if expected is not None and not emitted and len(good) == expected:
            emitted = True
            yield pd.DataFrame({"question_id": [key[0]], "title": [title], "question": [question], "answers": [[{"answer_id": k, "score": good[k][0], "answer": good[k][1]} for k in sorted(good)]]})
            answers, question = {}, None  # only that it came out is kept
        state.update((title, question, expected, accepted, emitted, json.dumps(answers)))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)

    return run


def assemble_stream(posts: DataFrame, min_score: int = -10_000, timeout_ms: int = 0) -> DataFrame:
    """R-01: a question comes out once its declared number of answers is there, in whatever order posts arrive; posts that
    are delivered twice count once. With ``timeout_ms`` a question that gets nothing new for so long is dropped from the state."""
    keyed = posts.withColumn("question_id", F.when(F.col("posttypeid") == 1, F.col("id")).otherwise(F.col("parentid"))).where("question_id is not null")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return keyed.groupBy("question_id").applyInPandasWithState(_assemble(min_score, timeout_ms), OUT, STATE, "append", timeout)


def dedup_stream(events: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """R-05: the first of each key, for ever or (with an event time) for as long as rows may be late."""
    if time is None:
        return events.dropDuplicates(keys)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 day", delay: str = "1 hour", value: str | None = None) -> DataFrame:
    """Extension: counts (and sums) by event time."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    aggregates = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return timed.groupBy(F.window(time, width), *keys).agg(*aggregates).select(F.col("window.start").alias("start"), *keys, *[a for a in ("n", "total") if a == "n" or value])


def append_batches(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None):
    """K-05, R-03, R-04, R-06, R-07: each batch goes to a folder of its number, so one that runs again replaces itself. Runs until what is
    there is read, or for ever, a batch ``every`` so long."""

    def write(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there, through the stream into a Parquet table."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
