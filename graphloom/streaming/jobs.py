"""Structured Streaming jobs: rewards of arriving responses, windows over events, latest rows per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.functions import rewards as rw


def reward_batches(stream: DataFrame, labels: DataFrame, sink: Callable[[DataFrame, int], None], rules: rw.Rules = rw.NC_STAGE1, link: bool = False, checkpoint: str | None = None):
    """Scores responses (idx, response) as they arrive with the same expression as the batch query; sink gets each scored batch."""

    def score(batch: DataFrame, epoch: int) -> None:
        j = batch.join(labels.select("idx", "gold"), "idx", "left")
        sink(j.select("idx", F.round(rw.total(F.col("response"), F.col("gold"), rules, link), 6).alias("reward")), epoch)

    w = stream.writeStream.foreachBatch(score).trigger(availableNow=True)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Count and sum of values per window and type; rows later than the watermark are dropped in a stream, none in a batch."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def joined(left: DataFrame, right: DataFrame, a: str, b: str, within: str, late: str) -> DataFrame:
    """Stream-stream join: events of two streams (a_user, a_ts, a_id; the same with b) of one user, b at most `within` after a. Watermarks bound
    what is kept of both."""
    x, y = left.withWatermark(f"{a}_ts", late), right.withWatermark(f"{b}_ts", late)
    cond = (F.col(f"{a}_user") == F.col(f"{b}_user")) & (F.col(f"{b}_ts") >= F.col(f"{a}_ts")) & (F.col(f"{b}_ts") <= F.col(f"{a}_ts") + F.expr(f"interval {within}"))
    return x.join(y, cond).select(f"{a}_id", f"{b}_id")


def replay_buffer(stream: DataFrame, key: str, value: str, limit: int) -> DataFrame:
    """Per key the last `limit` values as they arrive: bounded state, one row per key and batch with the count and sum held."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[Any] = list(state.get[0]) if state.exists else []
        for b in batches:
            held += b.sort_values(["ts", "event_id"])[value].tolist()
        held = held[-limit:] if limit > 0 else held
        state.update((held,))
        yield pd.DataFrame({"key": [k[0]], "held": [len(held)], "total": [float(sum(held))]})

    return stream.groupBy(key).applyInPandasWithState(step, "key long, held int, total double", "held array<double>", "update", GroupStateTimeout.NoTimeout)
