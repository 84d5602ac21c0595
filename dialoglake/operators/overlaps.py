"""How long turns of each cluster overlap each segment, without a row for each pair.

What a cluster's turns cover up to a time is a sum over their beginnings and ends before it, and the overlap of a segment is what
they cover up to its end less what they cover up to its beginning. So a stretch of a recording costs its rows times the number of its
clusters, however many turns lie on each other. Segments stand in the stretch in which they begin, turns in all that they reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Microseconds of a stretch, how long a segment may be, and how long a turn may be.
STRETCH, REACH, TURN = 1_800_000_000, 600_000_000, 3_600_000_000
#: Rows that are taken together at least, pairs of segment and cluster at once at most, and what stands for no place in the order of turns.
ROWS, PAIRS, LAST = 1 << 18, 1 << 21, np.iinfo("i8").max


def micros(seconds: str) -> Column:
    return F.round(F.col(seconds) * 1_000_000).cast("long")


def fits(longest: int) -> Column:
    """Whether a row with ``start`` before ``end`` has whole microseconds and isn't too long."""

    def whole(c: str) -> Column:
        return F.abs(F.col(c) * 1_000_000 - F.round(F.col(c) * 1_000_000)) < 1e-3

    # Beyond some 30,000 years doubles hold no microseconds.
    return F.coalesce((F.abs("start") < 1e9) & (F.abs("end") < 1e9) & whole("start") & whole("end") & (F.col("end") - F.col("start") <= longest / 1e6), F.lit(False))


def overlaps(segments: DataFrame, turns: DataFrame, best: bool) -> DataFrame:
    """Rows that ``fits`` -> media_id, seq, cluster_id, us, first: of every overlapping cluster, or the ``best`` one alone, the microseconds and the first turn."""
    part = F.floor(F.col("lo") / STRETCH)
    s = segments.select("media_id", micros("start").alias("lo"), micros("end").alias("hi"), "seq", F.lit(None).cast("long").alias("first"), F.lit(None).cast(turns.schema["cluster_id"].dataType).alias("cluster_id")).withColumn("part", part)
    t = turns.select("media_id", micros("start").alias("lo"), micros("end").alias("hi"), F.lit(None).cast(segments.schema["seq"].dataType).alias("seq"), F.coalesce(F.col("track_seq").cast("long"), F.lit(LAST)).alias("first"), "cluster_id")
    reached = F.sequence(F.floor((F.col("lo") - REACH) / STRETCH), F.floor((F.col("hi") - 1) / STRETCH))
    both = s.where("hi > lo and media_id is not null and seq is not null").unionByName(t.where("hi > lo and media_id is not null").withColumn("part", F.explode(reached)))
    dealt = both.repartition("media_id", "part").sortWithinPartitions("part", "media_id")

    def run(batches):
        for table in whole_stretches(batches):
            yield from found(table, best)

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((segments, "media_id"), (segments, "seq"), (turns, "cluster_id")))
    return dealt.select("media_id", "part", "seq", "cluster_id", "lo", "hi", "first").mapInArrow(run, f"{kinds}, us long, first long")


def stretch_numbers(table: pa.Table) -> np.ndarray:
    """Rows' stretches, numbered as they follow."""
    media, part = (np.asarray(x) for x in (table["media_id"].combine_chunks().dictionary_encode().indices, table["part"]))
    return np.cumsum(np.concatenate([[0], (media[1:] != media[:-1]) | (part[1:] != part[:-1])]))


def whole_stretches(batches) -> Iterator[pa.Table]:
    """Sorted batches as tables of ``ROWS`` rows or more that hold whole stretches."""
    held, rows, enough = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= enough:
            table = pa.Table.from_batches(held)
            number = stretch_numbers(table)
            cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield table.slice(0, cut)
                held, rows = table.slice(cut).to_batches(), len(table) - cut
            enough = max(ROWS, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def found(table: pa.Table, best: bool) -> Iterator[pa.RecordBatch]:
    lo, hi, first = (np.asarray(table[c].fill_null(0)) for c in ("lo", "hi", "first"))
    # Times count from the beginning of the stretch, so that keys of stretch and time stay small.
    origin = np.asarray(table["part"]) * STRETCH
    lo, hi, number = lo - origin, hi - origin, stretch_numbers(table)
    is_turn = ~np.asarray(table["seq"].is_valid())
    seg, turn = np.flatnonzero(~is_turn), np.flatnonzero(is_turn)
    if not len(seg) or not len(turn):
        return
    clusters = table["cluster_id"].combine_chunks().take(pa.array(turn)).dictionary_encode()
    # Numbered in their order, null first.
    rank = np.zeros(len(clusters.dictionary) + 1, "i8")
    rank[np.asarray(pc.sort_indices(clusters.dictionary)).astype("i8")] = np.arange(1, len(rank))
    cluster = rank[np.asarray(clusters.indices.fill_null(len(clusters.dictionary)))]
    # A group is a stretch's cluster; ``group`` tells each turn's.
    groups, group = np.unique(number[turn] * len(rank) + cluster, return_inverse=True)
    of = groups // len(rank)
    begin, end = np.searchsorted(of, number[seg]), np.searchsorted(of, number[seg], "right")
    covered = Covered(group, np.clip(lo[turn], 0, None), np.minimum(hi[turn], STRETCH + REACH), first[turn], len(groups))
    upto = np.cumsum(end - begin)
    a = 0
    while a < len(seg):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        n = end[a:b] - begin[a:b]
        row = np.repeat(np.arange(a, b), n)
        g = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[row]
        us = covered.upto(g, hi[seg[row]]) - covered.upto(g, lo[seg[row]])
        row, g, us = (x[us > 0] for x in (row, g, us))
        if best and len(row):
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            most = us == np.repeat(np.maximum.reduceat(us, starts), np.diff(np.append(starts, len(row))))
            row, g, us = row[most], g[most], us[most]
        early = np.full(len(row), LAST)
        ask = np.ones(len(row), bool)
        if best and len(row):
            ask[:] = False
            ask[1:] |= row[1:] == row[:-1]
            ask[:-1] |= row[1:] == row[:-1]
        early[ask] = covered.first_of(g[ask], lo[seg[row[ask]]], hi[seg[row[ask]]])
        if best and len(row):
            order = np.lexsort((groups[g], -early, row))  # of turns of one place in the order the last cluster
            order = order[np.append(row[order][1:] != row[order][:-1], True)]
            row, g, us, early = row[order], g[order], us[order], early[order]
        if len(row):
            at, code = pa.array(seg[row]), groups[g] % len(rank)
            place = np.append(0, np.argsort(rank[:-1]))
            names = clusters.dictionary.take(pa.array(place[code], mask=code == 0))
            yield pa.RecordBatch.from_arrays([table["media_id"].combine_chunks().take(at), table["seq"].combine_chunks().take(at), names, pa.array(us), pa.array(early, mask=early == LAST)], names=["media_id", "seq", "cluster_id", "us", "first"])
        a = b


class Covered:
    """Turns in groups: what a group covers up to a time, and which of its turns that meet a span is the first."""

    SPAN = STRETCH + REACH + 1

    def __init__(self, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, groups: int) -> None:
        order = np.lexsort((lo, group))
        self.lo, self.hi, self.first = (group * self.SPAN + lo)[order], hi[order], first[order]
        self.start = np.searchsorted(group[order], np.arange(groups))
        self.ends = np.sort(group * self.SPAN + hi)
        self.sums = [np.concatenate([[0], np.cumsum(x % self.SPAN)]) for x in (self.lo, self.ends)]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def upto(self, group: np.ndarray, time: np.ndarray) -> np.ndarray:
        key, start = group * self.SPAN + time, self.start[group]
        a, b = np.searchsorted(self.lo, key, "right"), np.searchsorted(self.ends, key, "right")
        return time * (a - b) - (self.sums[0][a] - self.sums[0][start]) + (self.sums[1][b] - self.sums[1][start])

    def level(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of 2**n turns as they begin: their ends sorted in each run, keyed by run, and the first turn among those that end there or later."""
        while len(self.levels) <= n:
            size = 1 << len(self.levels)
            runs = -(-len(self.hi) // size)
            hi, first = np.full(runs * size, self.SPAN - 1), np.full(runs * size, LAST)
            hi[: len(self.hi)], first[: len(self.first)] = self.hi, self.first
            order = hi.reshape(runs, size).argsort(1, kind="stable") + np.arange(runs)[:, None] * size
            least = np.minimum.accumulate(first[order][:, ::-1], axis=1)[:, ::-1]
            self.levels.append(((hi[order] + np.arange(runs)[:, None] * self.SPAN).ravel(), least.ravel()))
        return self.levels[n]

    def first_of(self, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Turns that begin before ``hi`` are a range, cut into runs of growing length; in each those that end after ``lo`` are a tail."""
        found = np.full(len(group), LAST)
        left, right = self.start[group].copy(), np.searchsorted(self.lo, group * self.SPAN + hi)
        live, n = np.flatnonzero(left < right), 0
        while len(live):
            ends, least = self.level(n)

            def look(at: np.ndarray, run: np.ndarray) -> None:
                place = np.searchsorted(ends, run * self.SPAN + lo[at], "right")
                inside = place < np.minimum((run + 1) << n, len(least))  # noqa: B023
                found[at[inside]] = np.minimum(found[at[inside]], least[place[inside]])  # noqa: B023

            odd = live[left[live] & 1 == 1]
            look(odd, left[odd])
            left[odd] += 1
            odd = live[right[live] & 1 == 1]
            right[odd] -= 1
            look(odd, right[odd])
            left[live] >>= 1
            right[live] >>= 1
            live, n = live[left[live] < right[live]], n + 1
        return found
