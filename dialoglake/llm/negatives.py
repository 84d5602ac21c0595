"""Hard negatives by an inverted multi-index: near vectors of another class, in a window below each positive's score.

Vectors are cut into two halves, each with a codebook of its own, fitted on a bounded sample; a pair of codes is a cell.
Every row is indexed: rows sort by cell into shards of bounded size, and a shard holds its rows cell by cell. In a shard an
anchor's score with a code's members, in one half, is at most the product with the centre plus the half's length times the
code's radius. The bounds of both halves are sorted, and a heap walks the pairs by falling sum (multi-sequence), so cells
come by falling bound on the whole score. The walk ends when no cell still to come can reach what is held: exact results,
whatever the codebooks. Anchors meet shards as tiles; lists are merged up a tree.

Two walks: the first finds each anchor's nearest rows of its own class, its positives. Each positive's score sets a window,
and the second fills all windows of an anchor at once with the best rows of other classes; cells whose best score lies
under every window, or whose least score lies above every one, are passed over.

Defined results: rows with a null id or label, a null vector or a null or non-finite component take no part; vectors of
unequal length are not compared; rows that share an anchor's id are none of its positives or negatives; rows that repeat an
anchor's id are anchors each; repeated rows are candidates each; ties go to the smaller id; an anchor without positives or
a window without rows gives no row. Scores are whole and must stay below 2**53 in size, which is checked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import settle, tasks

#: Rows that codebooks are fitted on at most, codes of a half, rounds of fitting.
SAMPLE, CODES, ROUNDS = 4096, 16, 8
#: Bytes of vectors in one shard and in one block of anchors, lists merged at a time, rows scored together.
SHARD_BYTES, ANCHOR_BYTES, FAN, AT_ONCE = 2**23, 2**19, 16, 512
#: Shards and blocks that meet in one task, about: 32 MB of each.
SHARDS_A_GROUP, BLOCKS_A_GROUP = 4, 64
EXACT = 2.0**53


def codebook(half: np.ndarray, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced distinct rows: the same sample gives the same centres."""
    if not half.size:
        return np.zeros((1, half.shape[1]))
    distinct = np.unique(half, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)].astype("f8")
    for _ in range(rounds):
        at = nearest(half, centres)
        for c in range(len(centres)):
            if (own := at == c).any():
                centres[c] = half[own].mean(axis=0)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (half @ centres.T)).argmin(axis=1)


class Shard:
    """Rows in order of cell, with what bounds their scores."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        cut = len(books[0][0])
        codes = [nearest(h, b) if h.shape[1] else np.zeros(len(h), int) for h, b in zip((vectors[:, :cut], vectors[:, cut:]), books, strict=True)]
        order = np.lexsort((ids, codes[1], codes[0]))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.size, self.cut, self.books = np.abs(vectors).max(initial=0), cut, books
        codes = [c[order] for c in codes]
        key = codes[0] * len(books[1]) + codes[1]
        cells, first = np.unique(key, return_index=True)
        self.cells = {(int(c) // len(books[1]), int(c) % len(books[1])): (int(a), int(b)) for c, a, b in zip(cells, first, np.append(first[1:], len(key)), strict=True)}
        self.codes, self.radii = [], []
        for half, own, book in zip((self.vectors[:, :cut], self.vectors[:, cut:]), codes, books, strict=True):
            used = np.unique(own)
            far = np.sqrt(((half - book[own]) ** 2).sum(axis=1))
            self.codes.append(used)
            self.radii.append(np.array([far[own == c].max() for c in used]))

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(most, least, from, to) of the cells that hold rows, by falling bound."""
        bounds = []
        for half, codes, radii, book in zip((anchor[: self.cut], anchor[self.cut :]), self.codes, self.radii, self.books, strict=True):
            middle, spread = book[codes] @ half, radii * np.sqrt(half @ half)
            slack = 1e-9 * (1 + np.abs(middle) + spread)  # what doubles may have rounded away
            order = np.argsort(-(middle + spread), kind="stable")
            bounds.append(((middle + spread + slack)[order].tolist(), (middle - spread - slack)[order].tolist(), codes[order].tolist()))
        (up, low, left), (up2, low2, right) = bounds
        if not up or not up2:
            return
        # The standard order of pairs: (i, 0) follows (i - 1, 0), and (i, j) follows (i, j - 1).
        heap = [(-(up[0] + up2[0]), 0, 0)]
        while heap:
            most, i, j = heapq.heappop(heap)
            if j + 1 < len(up2):
                heapq.heappush(heap, (-(up[i] + up2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(up):
                heapq.heappush(heap, (-(up[i + 1] + up2[0]), i + 1, 0))
            if (found := self.cells.get((left[i], right[j]))) is not None:
                yield -most, low[i] + low2[j], *found

    def scores(self, anchor: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the rows in ``ranges``."""
        at = np.concatenate([np.arange(a, b) for a, b in ranges])
        if self.size * np.abs(anchor).max(initial=0) * max(1, len(anchor)) >= EXACT:
            raise ValueError("scores beyond 2**53 aren't exact")
        return at, self.vectors[at] @ anchor

    def positives(self, ident: int, label: int, anchor: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of the anchor's label."""
        held: list[tuple[float, int]] = []
        for most, ranges in self._batches(anchor, lambda most, least: True):
            if len(held) == k and most < held[-1][0]:
                break
            at, scores = self.scores(anchor, ranges)
            own = (self.labels[at] == label) & (self.ids[at] != ident)
            held = best(held, scores[own], self.ids[at[own]], k)
        return [(int(s), i) for s, i in held]

    def negatives(self, ident: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (least and most score, both in it) the k best (score, id) of other labels."""
        held: list[list[tuple[float, int]]] = [[] for _ in windows]
        open_ = {w for w, (low, high) in enumerate(windows) if low <= high}
        for most, ranges in self._batches(anchor, lambda most, least: any(windows[w][0] <= most and least <= windows[w][1] for w in open_)):
            open_ -= {w for w in open_ if most < windows[w][0] or len(held[w]) == k and most < held[w][-1][0]}  # certified
            if not open_:
                break
            at, scores = self.scores(anchor, ranges)
            other = (self.labels[at] != label) & (self.ids[at] != ident)
            for w in open_:
                fit = other & (scores >= windows[w][0]) & (scores <= windows[w][1])
                held[w] = best(held[w], scores[fit], self.ids[at[fit]], k)
        return [[(int(s), i) for s, i in h] for h in held]

    def _batches(self, anchor: np.ndarray, wanted) -> Iterator[tuple[float, list[tuple[int, int]]]]:
        """Wanted cells by falling bound, gathered until some rows are worth a product: the first one's bound, their ranges."""
        top, ranges, n = 0.0, [], 0
        for most, least, a, b in self.walk(anchor):
            if not wanted(most, least):
                continue
            top = most if not ranges else top
            ranges.append((a, b))
            n += b - a
            if n >= AT_ONCE:
                yield top, ranges
                ranges, n = [], 0
        if ranges:
            yield top, ranges


def best(held: list[tuple[float, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    if len(scores) > 4 * k:  # all that reach the k-th score, however many tie
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids = scores[near], ids[near]
    return sorted([*held, *zip(scores.tolist(), ids.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]


def usable(rows: DataFrame, vector: Column) -> DataFrame:
    """``rows`` (id, label) with ``vec``; those that can't take part go."""
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & whole)


def _packed(size: int, names: tuple[str, ...]):
    """Rows as they come -> blocks of vectors of one length, of at most ``size`` bytes but for a single longer row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            own = [b"".join(x) for x in zip(*((np.int64(i).tobytes(), np.int64(lab).tobytes(), v.tobytes()) for i, lab, v in rows), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.large_binary()) for x in own)], ["dim", *names])

        for batch in batches:
            ident, label, vec = batch.columns
            for i, lab, v in zip(ident.to_pylist(), label.to_pylist(), vec.to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, lab, np.array(v, "<f8")))
                if len(held[len(v)]) * max(64, 8 * len(v)) >= size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return run


def _opened(ids: bytes, labels: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(labels, "<i8"), np.frombuffer(vectors, "<f8").reshape(len(ids), dim)


HIT = pa.list_(pa.struct([("less", pa.int64()), ("id", pa.int64())]))
LISTS = pa.schema([("anchor", pa.int64()), ("block", pa.int64()), ("nth", pa.int32()), ("positive", pa.int32()), ("shard", pa.int64()), ("best", HIT)])
LISTED = "anchor long, block long, nth int, positive int, shard long, best array<struct<less:long,id:long>>"


def _search(books: dict[int, tuple[np.ndarray, np.ndarray]], look):
    """A group of shards and a group of blocks -> lists of hits; ``look`` gives (nth, positive, hits) of one block in one shard."""

    def run(key: tuple, blocks: pa.Table, shards: pa.Table) -> pa.Table:
        out, dim = [], key[0].as_py()
        asked = [(x, _opened(x["a_ids"], x["a_labels"], x["a_vecs"], dim)) for x in blocks.to_pylist()]
        for n in range(shards.num_rows if asked else 0):
            x = {name: shards.column(name)[n].as_py() for name in ("shard", "ids", "labels", "vecs")}
            shard = Shard(*_opened(x["ids"], x["labels"], x["vecs"], dim), books[dim])
            for block, (ids, labels, vectors) in asked:
                out += [(int(ids[nth]), block["block"], nth, positive, x["shard"], [{"less": -s, "id": i} for s, i in hits]) for nth, positive, hits in look(shard, block, ids, labels, vectors) if hits]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(LISTS)], schema=LISTS)

    return run


def _look_for_positives(k: int):
    def look(shard: Shard, block: dict, ids, labels, vectors):
        for n, (i, lab, v) in enumerate(zip(ids.tolist(), labels.tolist(), vectors, strict=True)):
            yield n, 0, shard.positives(i, lab, v, k)

    return look


def _look_for_negatives(k: int, window: tuple[int, int, int]):
    unit, low, high = window

    def look(shard: Shard, block: dict, ids, labels, vectors):
        for n, positives in zip(block["nths"], block["positives"], strict=True):
            windows = [(-(low * p["less"] // unit), high * -p["less"] // unit) for p in positives]  # whole scores inside
            for p, hits in enumerate(shard.negatives(int(ids[n]), int(labels[n]), vectors[n], windows, k)):
                yield n, p, hits

    return look


def _merged(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """anchor, block, nth, positive, best: lists of all shards, ``FAN`` at a time up a tree."""
    lists, n = lists.withColumn("shard", F.pmod("shard", F.lit(shards))), shards
    while True:
        n = -(-n // FAN)
        both = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN)).groupBy("anchor", "block", "nth", "positive", "shard").agg(both.alias("best"))
        if n == 1:
            return lists.drop("shard")


def _books(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Codebooks of each length of vectors, fitted on the ``SAMPLE`` rows with the least hashes; only twice as many are looked at."""
    dims = {r[0]: r[1] for r in rows.groupBy(F.size("vec")).count().collect()}
    share = min(1.0, 2 * SAMPLE / max(1, sum(dims.values())))
    mark = F.xxhash64("id", "vec")
    low = rows.where(F.shiftrightunsigned(mark, 11) / F.lit(float(2**53)) < share)
    picked = low.orderBy(mark, "id").limit(SAMPLE).select("vec").collect()
    out = {}
    for dim in dims:
        own = [r[0] for r in picked if len(r[0]) == dim]
        sample = np.array(own, "f8").reshape(len(own), dim)
        out[dim] = (codebook(sample[:, : dim // 2]), codebook(sample[:, dim // 2 :]))
    return out


def _cell(books: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, label, vec = batch.columns
            cells = np.zeros(len(ident), "i8")
            sizes = np.array([len(v) for v in vec.to_pylist()])
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                vectors = np.array([vec[int(i)].as_py() for i in own], "f8").reshape(len(own), dim)
                a, b = books[int(dim)]
                codes = [nearest(h, c) if h.shape[1] else 0 for h, c in ((vectors[:, : dim // 2], a), (vectors[:, dim // 2 :], b))]
                cells[own] = codes[0] * len(b) + codes[1]
            yield pa.RecordBatch.from_arrays([ident, label, vec, pa.array(cells)], ["id", "label", "vec", "cell"])

    return run


def hard_negatives(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (100, 50, 95)) -> DataFrame:
    """Both inputs: id long, label long, vec array<double> of whole numbers. ``window`` = (u, a, b): a*p <= u*n <= b*p for a positive's score p and a negative's n.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    anchors, rows = (df.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<double>").alias("vec")) for df in (anchors, rows))
    anchors, rows = (usable(df, F.col("vec")) for df in (anchors, rows))
    rows = settle(rows)
    books = _books(rows)
    schema = "id long, label long, vec array<double>"
    coded = rows.mapInArrow(_cell(books), f"{schema}, cell long")
    order = [F.size("vec"), F.col("cell"), F.col("id"), F.xxhash64("vec")]
    near = settle(coded.withColumn("row", F.monotonically_increasing_id()))
    laid = near.repartitionByRange(tasks(near), *order, "row").sortWithinPartitions(*order, "row").select("id", "label", "vec")
    shards = settle(laid.mapInArrow(_packed(SHARD_BYTES, ("ids", "labels", "vecs")), "dim int, ids binary, labels binary, vecs binary").withColumn("shard", F.monotonically_increasing_id()))
    names = ("a_ids", "a_labels", "a_vecs")
    asked = settle(anchors.mapInArrow(_packed(ANCHOR_BYTES, names), "dim int, a_ids binary, a_labels binary, a_vecs binary").withColumn("block", F.monotonically_increasing_id()))
    n, m = max(1, shards.count()), max(1, asked.count())
    groups = -(-n // SHARDS_A_GROUP)
    blocks = max(-(-m // BLOCKS_A_GROUP), min(m, -(-tasks(rows) // groups)))
    key = ["dim", "bg", "sg"]

    def deal(df: DataFrame, name: str, own: str, count: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(name), F.lit(count))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    def searched(block_rows: DataFrame, look) -> DataFrame:
        # The stated anchors meet all rows in blocks: groups of blocks and groups of shards are dealt out.
        met = deal(block_rows, "block", "bg", blocks, "sg", groups).groupBy(*key).cogroup(deal(shards, "shard", "sg", groups, "bg", blocks).groupBy(*key))
        return met.applyInArrow(_search(books, look), LISTED)

    own = settle(_merged(searched(asked, _look_for_positives(positives)), n, positives).select("block", "nth", "best"))
    listed = own.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("nth", "best"))).alias("l")).select("block", F.col("l.nth").alias("nths"), F.col("l.best").alias("positives"))
    found = _merged(searched(asked.join(listed, "block"), _look_for_negatives(negatives, window)), n, negatives)
    met = found.join(own.select("block", "nth", F.col("best").alias("own")), ["block", "nth"])
    each = met.select("anchor", F.element_at("own", F.col("positive") + 1).alias("p"), F.posexplode("best").alias("at", "hit"))
    return each.select(
        F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("negative_id"), (-F.col("p.less")).alias("positive_score"), (-F.col("hit.less")).alias("negative_score")
    )
