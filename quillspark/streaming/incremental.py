"""Incremental runs with Structured Streaming: file sources, checkpoints, stateful conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drain(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "id") -> None:
    """Process files that no earlier run saw and append their results, once an id (STM01, STM02, SNK02).

    Every batch leaves out ids that the sink holds, so a batch that runs again
    after a failure writes nothing twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        fresh = batch.dropDuplicates([key])
        if there:
            fresh = fresh.join(spark.read.parquet(sink).select(key), key, "left_anti")
        work(fresh).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def talk(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a conversation: turns so far, assistant turns so far, whether it stopped (STM05).

    A conversation stops at its first empty text; later turns are ignored.
    """
    turns, replies, stopped = state.get if state.exists else (0, 0, False)
    for turn, role, text in sorted((t, r, x) for pdf in rows for t, r, x in zip(pdf["turn"], pdf["role"], pdf["text"])):
        if stopped:
            break
        if not text:
            stopped = True
            continue
        turns, replies = turns + 1, replies + (role == "assistant")
    state.update((turns, replies, stopped))
    yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "replies": [replies], "kept": [replies > 0]})


def conversation_states(stream: DataFrame) -> DataFrame:
    """Per batch and conversation its state after the batch."""
    return stream.groupBy("conv_id").applyInPandasWithState(
        talk, "conv_id long, turns long, replies long, kept boolean", "turns long, replies long, stopped boolean", "update", GroupStateTimeout.NoTimeout
    )


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window with a watermark (a Spark built-in, for streams and tables alike)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def replay(events: DataFrame, key: str, order: str, field: str, value: str) -> DataFrame:
    """State of a mutation log: the last value of each field of each key (STM08)."""
    return events.groupBy(key, field).agg(F.max_by(value, order).alias(value))


def replay_fold(pages: DataFrame, done: DataFrame, key: str, order: str, step: Callable[[object, dict], object], first: object, kind: str) -> DataFrame:
    """(key, order, state) of the pages not done yet: a fold over a key's pages in order, in which done pages bring their stored state (STM06).

    ``done`` has key, order and state; ``step(state, page)`` gives the state after a page.  A key's pages must fit one task.
    """

    def fold(rows: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        known, state, out = dict(zip(stored[order], stored["state"])), first, []
        for page in rows.sort_values(order).to_dict("records"):
            if page[order] in known:
                state = known[page[order]]
                continue
            state = step(state, page)
            out.append((page[key], page[order], state))
        return pd.DataFrame(out, columns=[key, order, "state"])

    schema = f"{key} {pages.schema[key].dataType.simpleString()}, {order} {pages.schema[order].dataType.simpleString()}, state {kind}"
    return pages.groupBy(key).cogroup(done.groupBy(key)).applyInPandas(fold, schema)
