"""The nearest registered voices of each cluster, in a registry of many, without measuring all of them.

Unit vectors obey the triangle inequality, and cosine distance is half the square of the straight one. The registry is cut
into blocks of voices that are alike seen from a few pivots; of each block only the least and greatest distance to every
pivot is looked at, which bounds how near its voices can be. A cluster is first measured against its likeliest block; its
k-th best name there tells which other blocks can hold a nearer one, and only those are measured. Results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.functions.vectors import l2_normalize
from dialoglake.sources.storage import kept

#: Bytes of a block's vectors, clusters that a tile holds, blocks whose bounds travel together, most pivots, the voices they are chosen from, and bins of the distance to a pivot.
TILE_BYTES, CLUSTERS, BOUNDS, PIVOTS, SAMPLE, BINS = 4 << 20, 4096, 1024, 64, 4096, 64
#: Voices that one matrix product takes, and pairs that are measured exactly at once.
PRODUCT, PAIRS = 1024, 1 << 16
#: What rounding may add to a straight distance: a block is skipped only if it's farther than that.
SLACK = 1e-6

NEAR = "candidates array<struct<distance:double,reg_order:long,speaker:string>>"


def straight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def nearest_voices(clusters: DataFrame, registry: DataFrame, k: int = 1, tile_bytes: int = TILE_BYTES, places: int = 12) -> DataFrame:
    """clusters (media_id, cluster_id, embedding) against registry (speaker, reg_order, embedding): the k nearest names.

    -> media_id, cluster_id, candidates: array of (distance, reg_order, speaker), nearest first, a name once with the nearest
    of its voices. Distances are rounded to ``places`` places; of equals the voice registered first comes first. Fewer than k names
    give them all. A null vector or one of length zero takes no part on either side; a cluster without one has no row.
    """
    voices = registry.select("speaker", F.col("reg_order").cast("long").alias("reg_order"), l2_normalize(F.col("embedding")).alias("v")).where("v is not null")
    asked = clusters.select("media_id", "cluster_id", l2_normalize(F.col("embedding")).alias("v")).where("v is not null")
    n, dim = voices.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block = max(1, tile_bytes // (8 * dim))
    if n <= block:
        one = voices.withColumn("block", F.lit(0)).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("reg_order", "speaker", "v"))).alias("voices"))
        whole = seen_from(asked, np.zeros((1, dim)), ["media_id", "cluster_id"]).drop("far")
        return merged(measured(whole.withColumn("block", F.lit(0)), one, k, places), k)
    pivots = pivots_of(voices, n, block)
    packed = kept(packed_voices(voices, pivots, block))
    bounds = kept(packed_bounds(packed, pivots))
    each = min(BOUNDS, 1 << max(1, TILE_BYTES // tile_bytes).bit_length() - 1)
    seen = seen_from(asked, pivots, ["media_id", "cluster_id"])
    likely = likeliest(pairs_of(seen.withColumn("bar", F.lit(None).cast("double")).withColumn("done", F.lit(-1)), bounds))
    first = kept(merged(measured(likely, packed, k, places), k, F.min("block").alias("done")))
    more = blocks_to_search(seen, first, bounds, k, places, each)
    return merged(measured(more, shards_of(packed, each), k, places).unionByName(first.withColumnRenamed("done", "block")), k)


def pivots_of(voices: DataFrame, n: int, block: int) -> np.ndarray:
    """At most ``PIVOTS`` voices far from each other: of the ``SAMPLE`` with the least hashes each is the one farthest from those before it.

    Only how much is skipped depends on them.
    """
    rows = voices.orderBy(F.xxhash64("speaker", "reg_order", "v"), "reg_order").limit(SAMPLE).select("v").collect()
    sample = np.array([row["v"] for row in rows])
    chosen, gap = [0], straight(sample, sample[:1])[:, 0]
    while len(chosen) < min(PIVOTS, len(sample), max(8, 4 * n // block)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, straight(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def seen_from(rows: DataFrame, pivots: np.ndarray, keys: list[str]) -> DataFrame:
    """keys with ``v`` and ``far``, the straight distance of it to every pivot, both as bytes of doubles."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def run(frames):
        for frame in frames:
            if len(frame):
                v = np.stack(frame["v"].to_list())
                yield frame[keys].assign(v=[x.tobytes() for x in v], far=[x.tobytes() for x in straight(v, pivots)])

    return rows.select(*keys, "v").mapInPandas(run, f"{kinds}, v binary, far binary")


def packed_voices(voices: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """block, voices: those that share the nearest pivot and lie about as far from it, ``block`` of them or fewer as hashes fall.

    Voices are counted by pivot and bin of distance, a table of at most ``PIVOTS`` times ``BINS`` + 1 rows. Neighbouring bins
    are taken together while they fit, and a fuller bin is dealt over several blocks by hash, so equal voices spread too.
    """

    def run(frames):
        for frame in frames:
            if len(frame):
                far = straight(np.stack(frame["v"].to_list()), pivots)
                at = far.argmin(1)
                yield frame.assign(pivot=at.astype("i4"), bin=(far[np.arange(len(at)), at] * (BINS / 2)).astype("i4"))

    placed = voices.mapInPandas(run, "speaker string, reg_order long, v array<double>, pivot int, bin int")
    cells, last, room, first, number = [], None, 0, 0, 0
    for pivot, place, count in sorted(placed.groupBy("pivot", "bin").count().collect()):
        if pivot != last or count > room:
            parts = 1 if count <= block else -(-4 * count // (3 * block))
            last, first, number, room = pivot, number, number + parts, block if parts == 1 else 0
        else:
            parts = 1
        room -= count
        cells.append((pivot, place, first, parts))
    table = voices.sparkSession.createDataFrame(cells, "pivot int, bin int, first int, parts int")
    dealt = placed.join(F.broadcast(table), ["pivot", "bin"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("speaker", "reg_order", "v"), F.col("parts"))).cast("int"))
    return dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("reg_order", "speaker", "v"))).alias("voices"))


def packed_bounds(packed: DataFrame, pivots: np.ndarray) -> DataFrame:
    """part, bounds: of every block its number and least and greatest distance to each pivot, ``BOUNDS`` blocks a row."""

    def run(frames):
        for frame in frames:
            far = [straight(np.stack(list(vs)), pivots) for vs in frame["vs"]]
            yield pd.DataFrame({"block": frame["block"], "lo": [x.min(0) for x in far], "hi": [x.max(0) for x in far]})

    each = packed.select("block", F.col("voices.v").alias("vs")).mapInPandas(run, "block int, lo array<double>, hi array<double>")
    return each.groupBy(F.floor(F.col("block") / BOUNDS).alias("part")).agg(F.collect_list(F.struct("block", "lo", "hi")).alias("bounds"))


def shards_of(packed: DataFrame, each: int) -> DataFrame:
    """``each`` neighbouring blocks as one: block, voices, and of the blocks in it their sizes and places there."""
    rows = packed.groupBy(F.floor(F.col("block") / each).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "voices"))).alias("b"))
    return rows.select("block", F.flatten("b.voices").alias("voices"), F.transform("b", lambda x: F.size(x["voices"])).alias("sizes"), F.transform("b", lambda x: x["block"] % each).alias("places"))


def pairs_of(seen: DataFrame, bounds: DataFrame, each: int = 1) -> DataFrame:
    """Clusters (media_id, cluster_id, v, far, bar, done) and the blocks to measure: media_id, cluster_id, block, v, bar, wanted, off.

    Without a ``bar`` a cluster gets of every row of bounds the block whose middle looks most like it, ``off`` tells how far
    off; with one it gets every block, other than ``done``, that may hold a voice within that straight distance. Then ``block``
    numbers shards of ``each`` blocks, and bits of ``wanted`` tell which of a shard's blocks these are.
    """
    kind = seen.schema["media_id"].dataType.simpleString()
    groups = max(1, -(-seen.count() // BOUNDS))
    mine = seen.groupBy(F.pmod(F.xxhash64("media_id", "cluster_id"), F.lit(groups)).alias("mine")).agg(F.collect_list(F.struct("media_id", "cluster_id", "v", "far", "bar", "done")).alias("clusters"))
    parts, every = bounds.count(), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # Both sides are dealt by group and part, so that few parts don't make few tasks.
    met = mine.withColumn("part", every(parts)).join(bounds.withColumn("mine", every(groups)), ["mine", "part"])

    def run(frames):
        for frame in frames:
            for them, blocks in zip(frame["clusters"], frame["bounds"], strict=True):
                lo, hi, no = (np.array([b[c] for b in blocks]) for c in ("lo", "hi", "block"))
                far = np.frombuffer(b"".join(x["far"] for x in them)).reshape(len(them), -1)
                free = np.array([x["bar"] is None for x in them])
                for part in (free, ~free):
                    at = np.flatnonzero(part)
                    if not len(at):
                        continue
                    if free[at[0]]:
                        off = np.zeros((len(at), len(no)))
                        for p in range(lo.shape[1]):
                            off += (far[at, p, None] - (lo[None, :, p] + hi[None, :, p]) / 2) ** 2
                        best = off.argmin(1)
                        found = [(at, no[best], [None] * len(at), off[np.arange(len(at)), best])]
                    else:
                        found = wanted_blocks(at, far[at].astype("f4"), lo.astype("f4"), hi.astype("f4"), no, np.array([them[i]["bar"] for i in at]), np.array([them[i]["done"] for i in at]), each)
                    for rows, block, wanted, off in found:
                        yield pd.DataFrame({"media_id": [them[i]["media_id"] for i in rows], "cluster_id": [them[i]["cluster_id"] for i in rows], "block": block, "v": [them[i]["v"] for i in rows], "bar": [them[i]["bar"] for i in rows], "wanted": wanted, "off": off})

    return met.select("clusters", "bounds").mapInPandas(run, f"media_id {kind}, cluster_id string, block int, v binary, bar double, wanted binary, off double")


def wanted_blocks(at: np.ndarray, far: np.ndarray, lo: np.ndarray, hi: np.ndarray, no: np.ndarray, bar: np.ndarray, done: np.ndarray, each: int) -> Iterator[tuple]:
    """For every shard the clusters, numbered as in ``at``, that want a block of it, its number, and which they want."""
    gap, side = np.zeros((len(at), len(no)), "f4"), np.empty((len(at), len(no)), "f4")
    for p in range(lo.shape[1]):
        for a, b in ((far[:, p, None], hi[None, :, p]), (lo[None, :, p], far[:, p, None])):
            np.maximum(gap, np.subtract(a, b, out=side), out=gap)
    wanted = (gap <= bar[:, None] + SLACK) & (done[:, None] != no[None, :])
    for shard in np.unique(no // each):
        mask = np.zeros((len(at), each), bool)
        inside = no // each == shard
        mask[:, no[inside] % each] = wanted[:, inside]
        rows = np.flatnonzero(mask.any(1))
        if len(rows):
            yield at[rows], np.full(len(rows), shard, "i4"), [x.tobytes() for x in np.packbits(mask[rows], axis=1)], 0.0


def likeliest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("media_id", "cluster_id").agg(F.min(F.struct("off", "block", "v", "bar", "wanted")).alias("m")).select("media_id", "cluster_id", "m.block", "m.v", "m.bar", "m.wanted")


def blocks_to_search(seen: DataFrame, first: DataFrame, bounds: DataFrame, k: int, places: int = 12, each: int = 1) -> DataFrame:
    """media_id, cluster_id, block (a shard), wanted: what can't be skipped once each cluster has its best names of one block (``first``)."""
    # Short of k names nothing is ruled out: no two unit vectors are farther apart than 2. What rounds to the same distance isn't either.
    last = F.try_element_at("candidates", F.lit(k))["distance"]
    bar = first.select("media_id", "cluster_id", "done", F.when(last.isNull(), 2.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 * (last + 10.0**-places)))).alias("bar"))
    return pairs_of(seen.join(bar, ["media_id", "cluster_id"]), bounds, each).drop("off")


def measured(asked: DataFrame, packed: DataFrame, k: int, places: int = 12) -> DataFrame:
    """Clusters (media_id, cluster_id, v, block; bar, wanted) with the k nearest names of that block: tiles of at most about ``CLUSTERS`` clusters and one block.

    A cluster with a ``bar`` needs nothing beyond that straight distance, one with ``wanted`` only those of the block's parts.
    """
    kind = asked.schema["media_id"].dataType.simpleString()
    for name, of in (("bar", "double"), ("wanted", "binary")):
        asked = asked if name in asked.columns else asked.withColumn(name, F.lit(None).cast(of))
    if "sizes" not in packed.columns:
        packed = packed.withColumn("sizes", F.array(F.size("voices"))).withColumn("places", F.array(F.lit(0)))
    counts = asked.groupBy("block").agg(F.ceil(F.count("*") / CLUSTERS).alias("_tiles"))
    tile = F.pmod(F.xxhash64("media_id", "cluster_id"), F.col("_tiles")).alias("tile")
    dealt = packed.join(counts, "block").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1))).drop("_tiles")
    tiles = asked.join(counts, "block").groupBy("block", tile).agg(F.collect_list(F.struct("media_id", "cluster_id", "v", "bar", "wanted")).alias("clusters")).join(dealt, ["block", "tile"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                them, voices, sizes, places_ = (batch.column(c)[i].values for c in ("clusters", "voices", "sizes", "places"))
                v = np.frombuffer(b"".join(them.field("v").to_pylist())).reshape(len(them), -1)
                r = voices.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(voices), -1)
                bars = them.field("bar").fill_null(2.0).to_numpy(zero_copy_only=False)
                sizes = sizes.to_numpy(zero_copy_only=False)
                masks = them.field("wanted").to_pylist()
                wanted = np.ones((len(them), len(sizes)), bool)
                if given := [x for x in masks if x is not None]:
                    bits = np.unpackbits(np.frombuffer(b"".join(given), "u1").reshape(len(given), -1), axis=1)
                    wanted[[x is not None for x in masks]] = bits[:, places_.to_numpy(zero_copy_only=False)].astype(bool)
                names, orders = voices.field("speaker"), voices.field("reg_order")
                coded = names.dictionary_encode()
                ranks = np.empty(len(coded.dictionary) + 1, "i8")
                ranks[np.append(pc.sort_indices(coded.dictionary).to_numpy().astype("i8"), len(coded.dictionary))] = np.arange(len(ranks))
                coded = ranks[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]
                # No two unit vectors are farther apart than 2, so such a bar is none.
                best = Nearest(v, r, orders.to_numpy(zero_copy_only=False), coded, np.where(bars < 2, bars**2 / 2, np.inf), k, places)
                best.search(wanted, sizes)
                row, rank = np.nonzero(best.voice >= 0)
                voice = best.voice[row, rank]
                offsets = np.concatenate([[0], np.cumsum((best.voice >= 0).sum(1))]).astype("i4")
                near = pa.StructArray.from_arrays([pa.array(best.distance[row, rank]), orders.take(pa.array(voice)), names.take(pa.array(voice))], names=["distance", "reg_order", "speaker"])
                block = pa.array(np.full(len(them), batch.column("block")[i].as_py(), "i4"))
                yield pa.RecordBatch.from_arrays([them.field("media_id"), them.field("cluster_id"), block, pa.ListArray.from_arrays(pa.array(offsets), near)], names=["media_id", "cluster_id", "block", "candidates"])

    return tiles.select("block", "clusters", "voices", "sizes", "places").mapInArrow(run, f"media_id {kind}, cluster_id string, block int, {NEAR}")


class Nearest:
    """The k nearest names of every cluster among voices that come in parts: ``distance`` (rounded) and ``voice``, -1 where there are fewer.

    Products in single precision with a bound on their error tell which pairs can count; only those are measured in double.
    """

    def __init__(self, v: np.ndarray, voices: np.ndarray, orders: np.ndarray, names: np.ndarray, bars: np.ndarray, k: int, places: int) -> None:
        self.v, self.voices, self.orders, self.names, self.bars, self.k, self.places = v, voices, orders, names, np.array(bars, "f8"), k, places
        self.v32, self.voices32 = v.astype("f4"), voices.astype("f4")
        self.error = (v.shape[1] + 8) * 2.0**-23
        self.distance, self.voice = np.full((len(v), k), np.inf), np.full((len(v), k), -1)

    def search(self, wanted: np.ndarray, sizes: np.ndarray) -> None:
        """``wanted``: which of the parts, ``sizes`` of them one after another, each cluster needs. Parts are taken together where most clusters need them."""
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            start = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, start + PRODUCT, "right")))
            rows = np.flatnonzero(wanted[:, first:last].any(1))
            if len(rows) and wanted[rows, first:last].mean() >= 0.5:
                self.look(rows, start, ends[last - 1])
            elif len(rows):
                for part in range(first, last):
                    self.look(np.flatnonzero(wanted[:, part]), ends[part] - sizes[part], ends[part])
            first = last

    def look(self, rows: np.ndarray, start: int, end: int) -> None:
        for a in range(start, end, PRODUCT):
            b = min(end, a + PRODUCT)
            if not len(rows):
                return
            near = self.v32[rows] @ self.voices32[a:b].T
            least = 1 - self.bars[rows] - self.error
            if len(open_ := np.flatnonzero(np.isinf(self.bars[rows]))):
                # So many voices hold k names, if there are as many names.
                m = self.k * int(np.bincount(self.names[a:b]).max())
                if m < b - a:
                    least[open_] = np.partition(near[open_], b - a - m, axis=1)[:, b - a - m] - 2 * self.error - 10.0**-self.places
            row, voice = np.nonzero(near >= np.nextafter(least.astype("f4"), np.float32(-np.inf))[:, None])
            for at in range(0, len(row), PAIRS):
                self.take(rows[row[at : at + PAIRS]], voice[at : at + PAIRS] + a)

    def take(self, row: np.ndarray, voice: np.ndarray) -> None:
        """Measure these pairs and keep what is among the k nearest names."""
        distance = np.round(1 - np.einsum("ij,ij->i", self.v[row], self.voices[voice]), self.places) + 0.0
        touched = np.unique(row)
        old, rank = np.nonzero(self.voice[touched] >= 0)
        row, voice, distance = np.concatenate([row, touched[old]]), np.concatenate([voice, self.voice[touched][old, rank]]), np.concatenate([distance, self.distance[touched][old, rank]])
        order = np.lexsort((self.names[voice], self.orders[voice], distance, row))
        row, voice, distance = row[order], voice[order], distance[order]
        once = np.sort(np.unique(row * (int(self.names.max()) + 1) + self.names[voice], return_index=True)[1])  # of a name the nearest voice
        row, voice, distance = row[once], voice[once], distance[once]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, voice, distance, rank = (x[rank < self.k] for x in (row, voice, distance, rank))
        self.voice[touched], self.distance[touched] = -1, np.inf
        self.voice[row, rank], self.distance[row, rank] = voice, distance
        self.bars[touched] = np.minimum(self.bars[touched], self.distance[touched, self.k - 1] + 10.0**-self.places)


def merged(found: DataFrame, k: int, *more) -> DataFrame:
    """Lists of several blocks to one: sorted, of a name the nearest, k of them."""
    lists = found.groupBy("media_id", "cluster_id").agg(F.array_sort(F.flatten(F.collect_list("candidates"))).alias("c"), *more)
    names = F.col("c.speaker")
    once = F.slice(F.filter("c", lambda x, i: F.array_position(names, x["speaker"]) == i + 1), 1, k)
    return lists.withColumn("candidates", once).drop("c")
