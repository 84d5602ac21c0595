"""Figures of many overlapping windows without a table of their members.

A recording is cut into stretches of time. A window belongs to the stretch in which it starts; an entry goes to every
stretch with a window that could hold it, one or two for ordinary entries. In a stretch windows are taken by their ends and
entries come in by theirs. Sums over what has come in and starts late enough are suffix sums of a Fenwick tree over the
entries' order: counts and seconds directly, changes as a weight on the first of each two named neighbours, distinct
speakers as a weight on each speaker's latest entry. So work and rows grow with entries plus windows, not with their product.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dialoglake.operators.stats import first_speaker, is_speech

EPS = 1e-6
#: Length of a stretch, as a multiple of the longest window.
STRETCH = 4
#: What is summed: utterances, entries of two or more speakers, seconds of speech, changes, distinct speakers.
SUMS = 5


class SuffixSums:
    """A Fenwick tree with several columns: add at a place, sum from a place to the end."""

    def __init__(self, size: int, columns: int = SUMS):
        self.size, self.trees = size, [[0.0] * (size + 1) for _ in range(columns)]

    def add(self, place: int, column: int, value: float) -> None:
        tree, i = self.trees[column], self.size - place
        while i <= self.size:
            tree[i] += value
            i += i & -i

    def since(self, place: int) -> list[float]:
        out = []
        for tree in self.trees:
            i, total = self.size - place, 0.0
            while i > 0:
                total += tree[i]
                i -= i & -i
            out.append(total)
        return out


def direct(entries: list[tuple], low: float, high: float) -> list[float]:
    """The sums of one window, entry by entry."""
    inside = [e for e in entries if e[1] >= low and e[2] <= high]
    named = [e[3] for e in inside if e[3]]
    return [len(inside), sum(len(e[4]) >= 2 for e in inside), sum(max(0.0, e[2] - e[1]) for e in inside), sum(a != b for a, b in zip(named, named[1:])), len({s for e in inside for s in e[4]})]


def sweep(entries: list[tuple], windows: list[tuple[float, float]]) -> list[list[float]]:
    """``entries`` (number, start, end, name, speakers), in order; ``windows`` (least start, most end) -> the sums of each."""
    starts = [e[1] for e in entries]
    if any(a > b for a, b in zip(starts, starts[1:])):  # numbered against time
        return [direct(entries, *w) for w in windows]
    sums, named, latest = SuffixSums(len(entries)), [], {}
    coming = sorted(range(len(entries)), key=lambda p: entries[p][2])
    out, n = [[0.0] * SUMS] * len(windows), 0
    for w in sorted(range(len(windows)), key=lambda w: windows[w][1]):
        low, high = windows[w]
        while n < len(coming) and entries[p := coming[n]][2] <= high:
            _, start, end, name, speakers = entries[p]
            sums.add(p, 0, 1)
            if len(speakers) >= 2:
                sums.add(p, 1, 1)
            if end > start:
                sums.add(p, 2, end - start)
            if name:
                at = bisect_left(named, p)
                left = named[at - 1] if at else None
                right = named[at] if at < len(named) else None
                if left is not None:
                    before = right is not None and entries[left][3] != entries[right][3]
                    sums.add(left, 3, (entries[left][3] != name) - before)
                if right is not None and entries[right][3] != name:
                    sums.add(p, 3, 1)
                insort(named, p)
            for speaker in set(speakers):
                known = latest.get(speaker)
                if known is None or known < p:
                    latest[speaker] = p
                    sums.add(p, 4, 1)
                    if known is not None:
                        sums.add(known, 4, -1)
            n += 1
        out[w] = sums.since(bisect_left(starts, low))
    return out


OUT = pa.schema([("window_no", pa.int64()), ("n", pa.int64()), ("two", pa.int64()), ("seconds", pa.float64()), ("changes", pa.int64()), ("speakers", pa.int64())])


def _stretches(kind: pa.DataType):
    """Rows in order of recording and stretch, entries before windows; a stretch is held until its last row has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (media, _), group in groupby(rows, key=itemgetter(0, 1)):
            entries, windows = [], []
            for _, _, is_window, no, start, end, name, speakers in group:
                if is_window:
                    windows.append((no, start - EPS, end + EPS))
                else:
                    entries.append((no, start, end, name, speakers))
            if windows:
                found = sweep(entries, [w[1:] for w in windows])
                columns = [[w[0] for w in windows], *([f[i] if i == 2 else round(f[i]) for f in found] for i in range(SUMS))]
                yield pa.RecordBatch.from_arrays([pa.array([media] * len(windows), kind), *(pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True))], ["media_id", *OUT.names])

    return run


def window_sums(windows: DataFrame, entries: DataFrame, longest: float) -> DataFrame:
    """``windows`` (media_id, window_no, start, end), none longer than ``longest`` -> media_id, window_no, n, two, seconds, changes, speakers of the speech inside.

    An entry is inside if it starts and ends there, with ``EPS`` to spare; sounds and entries without times count nowhere.
    """
    step = STRETCH * longest
    timed = "start is not null and end is not null"
    speech = entries.where(is_speech()).where(timed)
    reach = F.sequence(F.floor((F.col("end") - (longest + 2 * EPS)) / step), F.floor((F.col("start") + EPS) / step))
    # An entry longer than any window lies in none.
    fits = speech.where(F.col("end") - (longest + 2 * EPS) <= F.col("start") + EPS)
    none = F.lit(None)
    a = fits.select("media_id", F.explode(reach).alias("stretch"), F.lit(False).alias("is_window"), F.col("entry_no").cast("long").alias("no"), "start", "end", first_speaker().alias("name"), F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"))
    b = windows.where(timed).select("media_id", F.floor(F.col("start") / step).alias("stretch"), F.lit(True).alias("is_window"), F.col("window_no").cast("long").alias("no"), "start", "end", none.cast("string").alias("name"), none.cast("array<string>").alias("speakers"))
    key = ["media_id", "stretch"]
    dealt = a.unionByName(b).repartition(*key).sortWithinPartitions(*key, "is_window", "no")
    kind = windows.schema["media_id"].dataType
    return dealt.mapInArrow(_stretches(to_arrow_type(kind)), f"media_id {kind.simpleString()}, window_no long, n long, two long, seconds double, changes long, speakers long")
