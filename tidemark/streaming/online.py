"""Streaming variants: sessions, windows of the last lines of a node, online templates, payload sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.templates import TemplateMiner


def gap_sessions(stream: DataFrame, *, time: str, key: str, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """W-02: key, session_start, session_end, n of sessions by gaps in event time (whole seconds over gap_seconds end one); rows later
    than `late` are dropped, and a session comes out when the watermark has passed it."""
    w = F.session_window(time, f"{gap_seconds * 1000 + 999} milliseconds")
    return stream.withWatermark(time, late).groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def last_line_windows(stream: DataFrame, *, key: str, order_by: str, value: str, length: int, idle: str = "1 day") -> DataFrame:
    """W-10: key, last, window: each line of a key with the length - 1 lines before it, as they come. The state of a key holds those lines
    only, and goes after it has been idle that long (processing time)."""
    kind = stream.schema[value].dataType
    out = T.StructType([stream.schema[key], T.StructField("last", stream.schema[order_by].dataType), T.StructField("window", T.ArrayType(kind))])
    held = T.StructType([T.StructField("values", T.ArrayType(kind))])
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        values = list(state.get[0]) if state.exists else []
        rows = []
        f = pd.concat(list(frames)).sort_values(order_by, kind="stable")
        for o, v in zip(f[order_by], f[value], strict=True):
            values = [*values, v][-length:]
            if len(values) == length:
                rows.append((k[0], o, list(values)))
        state.update((values[-(length - 1) :] if length > 1 else [],))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame(rows, columns=[key, "last", "window"])

    return stream.groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.ProcessingTimeTimeout)


def daily_dayparts(stream: DataFrame, *, time: str, value: str, tz: str = "Europe/Berlin", late: str = "1 hour") -> DataFrame:
    """A-05: date, daypart and median by local day, out when the watermark has passed the day."""
    local = F.from_utc_timestamp(F.col(time), tz)
    rows = stream.withColumn("_local", local).withWatermark("_local", late)
    part = F.when(F.hour("_local").between(8, 17), "working").otherwise("night")
    return rows.groupBy(F.window("_local", "1 day").alias("_w"), part.alias("daypart")).agg(F.percentile(value, 0.5).alias("median")).select(F.to_date("_w.start").alias("date"), "daypart", "median")


def online_templates(stream: DataFrame, miner: TemplateMiner, *, message: str, order_by: str, sink, similarity: float | None = None):
    """L-14: a query that for each micro-batch fits the messages without a template and hands the batch with template_id to
    sink(frame, batch_id)."""

    def batch(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            miner.fit_online(df, message, order_by, similarity)
            sink(miner.predict(df, message), batch_id)
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch)


def payloads(documents: DataFrame, key: str, document: str = "document") -> DataFrame:
    """S-19, M-11: key and value as Kafka sinks take them: writeStream.format("kafka") does the rest."""
    return documents.select(F.col(key).cast("string").alias("key"), F.col(document).cast("string").alias("value"))
