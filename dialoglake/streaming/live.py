"""Cleaning recognised text as it arrives: the batch rule of ``operators.cleaning`` with its memory kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dialoglake.functions.text import is_short_unit_repeated, normalize_for_repeat, strip

OUT = "media_id string, seq long, start double, end double, text string, reason string"


def mark_hallucinations_live(rows: DataFrame, phrases: DataFrame, idle_minutes: int | None = None) -> DataFrame:
    """A stream of media_id, seq, start, end, text -> OUT, in append mode.

    Each recording keeps the last accepted text; rows of one batch are taken in order of seq. With ``idle_minutes``
    a recording that says nothing for so long is forgotten (Spark then also runs batches without data).
    """
    known = phrases.select(normalize_for_repeat(F.col("phrase")).alias("norm")).distinct().withColumn("known", F.lit(True))
    said = F.coalesce("text", F.lit(""))
    seen = rows.withColumn("norm", normalize_for_repeat(said)).join(known, "norm", "left")
    reason = F.when(strip(said) == "", "blank").when(F.col("norm") == "", "empty").when(F.col("known"), "phrase").when(is_short_unit_repeated(F.col("norm")), "repeat")
    ready = seen.select("media_id", F.col("seq").cast("long").alias("seq"), "start", "end", "text", "norm", reason.alias("reason"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        held = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for norm, reason in zip(held["norm"], held["reason"], strict=True):
            if reason == "empty" or (reason is not None and reason == reason):
                out.append(None if reason == "empty" else reason)
            else:
                out.append("duplicate" if norm == last else None)
                last = norm
        if last is not None:
            state.update((last,))
            if idle_minutes is not None:
                state.setTimeoutDuration(idle_minutes * 60_000)
        yield held.assign(reason=pd.array(out, "object"))[["media_id", "seq", "start", "end", "text", "reason"]]

    return ready.groupBy("media_id").applyInPandasWithState(step, OUT, "last string", "append", GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)
