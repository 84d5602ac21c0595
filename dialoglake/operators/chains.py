"""The heaviest chain of candidates, over blocks of script positions.

Candidates of a recording are taken by script position, block after block. What a block hands on to the next is a frontier:
of all chains so far the steps (time, weight) at which waiting longer allows a heavier one, the candidates whose script range
isn't over yet, and the best end of a chain. A task holds one block of a recording and its frontier; blocks of all
recordings with the same number run side by side. Each candidate notes the one before it, and a pass back over the blocks
collects the chain.
"""

from __future__ import annotations

import heapq
import pickle
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.functions.ranks import number_in_ranges

#: Script positions of one block.
BLOCK = 10_000
NONE = -1


@dataclass
class Frontier:
    times: list[float] = field(default_factory=list)
    keys: list[tuple[float, int]] = field(default_factory=list)  # weight and minus the row's number, rising with the times
    waiting: list[tuple[int, int, float, float]] = field(default_factory=list)  # script end, number, time, weight
    best: tuple[float, int] = (float("-inf"), NONE)

    def enter(self, time: float, key: tuple[float, int]) -> None:
        at = bisect_right(self.times, time)
        if at and self.keys[at - 1] >= key:
            return
        first = last = bisect_left(self.times, time)
        while last < len(self.keys) and self.keys[last] <= key:
            last += 1
        self.times[first:last], self.keys[first:last] = [time], [key]

    def follow(self, rows) -> list[int]:
        """``rows`` (number, script start, script end, earlier time, later time, weight) in order -> the number before each."""
        out = []
        for number, start, end, low, high, weight in rows:
            while self.waiting and self.waiting[0][0] < start:
                _, n, time, total = heapq.heappop(self.waiting)
                self.enter(time, (total, -n))
            at, back = bisect_right(self.times, low), NONE
            if at and self.keys[at - 1][0] > 0:
                weight, back = self.keys[at - 1][0] + weight, -self.keys[at - 1][1]
            out.append(back)
            heapq.heappush(self.waiting, (end, number, high, weight))
            if weight > self.best[0]:
                self.best = (weight, number)
        return out


def _kept(df: DataFrame) -> DataFrame:
    """Where blocks follow one another, each starts from a checkpoint; without a shared folder from a cache."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def _whole(frame: pd.DataFrame) -> pd.DataFrame:
    """The chain of a recording that is one block."""
    frame = frame.sort_values(["script_start", "stt_start", "similarity", "script_ngram_id", "rank"], ascending=[True, True, False, True, True], kind="stable").reset_index(drop=True)
    times, frontier, at, chosen = frame[["start_time", "end_time"]], Frontier(), NONE, []
    rows = (frame.index.tolist(), frame["script_start"].tolist(), frame["script_end"].tolist(), times.min(axis=1).tolist(), times.max(axis=1).tolist(), frame["weighted_similarity"].tolist())
    back = frontier.follow(zip(*rows, strict=True))
    at = frontier.best[1]
    while at != NONE:
        chosen.append(at)
        at = back[at]
    return frame.iloc[chosen[::-1]].assign(chain_no=range(len(chosen)))


def weighted_chain(candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """The heaviest chain of each recording, in order: the chosen candidates with ``chain_no``.

    Each script range begins after the one before ends, and each time range not before it ends. Of equal weights the first
    candidate wins, by script start, recognised start, similarity (falling), n-gram and rank; only a positive weight is followed.
    """
    spark, kind = candidates.sparkSession, candidates.schema["media_id"].dataType.simpleString()
    order = [F.col("script_start"), F.col("stt_start"), F.desc("similarity"), F.col("script_ngram_id"), F.col("rank")]
    part, candidates = F.floor(F.col("script_start") / block), candidates.cache()
    if (candidates.agg(F.max(part)).first()[0] or 0) == 0:  # no recording has a second block to hand on to
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", chain_no long"
        return candidates.groupBy("media_id").applyInPandas(_whole, schema)
    placed = number_in_ranges(candidates, part, order, "_no").withColumn("_block", part).cache()
    low, high = F.least("start_time", "end_time"), F.greatest("start_time", "end_time")
    slim = placed.select("media_id", "_block", "_no", "script_start", "script_end", low.alias("low"), high.alias("high"), F.col("weighted_similarity").cast("double").alias("w"))
    blocks = (slim.agg(F.max("_block")).first()[0] or 0) + 1
    kept = _kept if blocks > 1 else DataFrame.cache

    def forward(key: tuple, rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        frontier = pickle.loads(state["state"].iloc[0]) if len(state) else Frontier()
        rows = rows.sort_values("_no")
        back = frontier.follow(zip(*(rows[c].tolist() for c in ("_no", "script_start", "script_end", "low", "high", "w")), strict=True))
        return pd.DataFrame({"media_id": [key[0]] * (len(back) + 1), "no": [*rows["_no"].tolist(), NONE], "back": [*back, frontier.best[1]], "state": [None] * len(back) + [pickle.dumps(frontier)]})

    def backward(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        before, at, found = dict(zip(rows["no"].tolist(), rows["back"].tolist(), strict=True)), int(wanted["no"].iloc[0]) if len(wanted) else NONE, []
        while at in before:
            found.append(at)
            at = before[at]
        return pd.DataFrame({"media_id": [key[0]] * (len(found) + 1), "no": [*found, at], "chosen": [True] * len(found) + [False]})

    state, steps = spark.createDataFrame([], f"media_id {kind}, state binary"), []
    for b in range(blocks):
        met = slim.where(F.col("_block") == b).groupBy("media_id").cogroup(state.groupBy("media_id"))
        steps.append(kept(met.applyInPandas(forward, f"media_id {kind}, no long, back long, state binary")))
        state = steps[-1].where("state is not null").select(F.col("media_id").alias("media_id"), "state")
    wanted, chosen = steps[-1].where("state is not null").select(F.col("media_id").alias("media_id"), F.col("back").alias("no")), None
    for step in reversed(steps):
        met = step.where("state is null").select("media_id", "no", "back").groupBy("media_id").cogroup(wanted.groupBy("media_id"))
        found = kept(met.applyInPandas(backward, f"media_id {kind}, no long, chosen boolean"))
        wanted, here = found.where("not chosen").select(F.col("media_id").alias("media_id"), "no"), found.where("chosen").select(F.col("media_id").alias("media_id"), F.col("no").alias("_no"))
        chosen = here if chosen is None else chosen.unionByName(here)
    met = placed.join(chosen, ["media_id", "_no"])
    numbered = number_in_ranges(met, F.col("_block"), [F.col("_no")], "chain_no")
    return numbered.select(*candidates.columns, (F.col("chain_no") - 1).cast("long").alias("chain_no"))
