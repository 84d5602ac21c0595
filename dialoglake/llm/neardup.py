"""Near-duplicates by the similarity of their word shingles: SimHash fingerprints and MinHash bands for candidates, the shingles themselves to confirm.

A text is its set of hashes of ``SHINGLE`` consecutive words. Texts with equal sets are one node. Nodes whose fingerprints
(majority bits of the set) differ in at most ``RADIUS`` bits are found by the covering masks of ``simhash.links``; texts at 0.8
may differ in more bits, so bands find these: each of ``BANDS`` bands joins ``ROWS`` least hashes under as many permutations; two sets of similarity s share a band with odds of
1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8. In a bucket each node, sorted by its number of shingles, asks the ``NEXT`` before it
and the bucket's first, so candidates grow with the buckets and not with their squares. A candidate is a link if the
shingles (32-bit hashes) have a Jaccard similarity of ``similarity`` or more; classes are what links connect. Where a bucket
still holds several classes, every node outside its largest one is then compared with every node of the other classes, in
tiles of bounded size, so no two nodes that share a bucket and are alike stay apart.

Defined results: a null or empty text has no shingles and all such texts are one class; fewer words than a shingle give one
shingle of all words; null ids come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import one_row_each, settle, tasks, text_key
from dialoglake.llm.components import components
from dialoglake.llm.simhash import links, majority

SHINGLE, BANDS, ROWS, NEXT, SEED, RADIUS = 5, 20, 5, 2, 42, 3
#: Most shingles and most nodes on either side of a tile, and bits of the sketch that bounds how alike two sets can be.
TILE_SHINGLES, TILE_NODES, SKETCH = 2**20, 4096, 4096
_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 2**63, BANDS * ROWS, "u8") * np.uint64(2) + np.uint64(1)
MIX = _draw.integers(0, 2**63, (BANDS, ROWS), "u8") * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or b"").lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)][: len(words)], "u8")
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))), "u8"))


def bands(found: np.ndarray) -> np.ndarray:
    """One bucket number for each band."""
    least = np.full(BANDS * ROWS, 2**64 - 1, "u8")
    for a in range(0, len(found), 1024):
        least = np.minimum(least, (found[a : a + 1024, None] * FACTORS).min(axis=0))
    mixed = ((least >> np.uint64(20)).reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype="u8")
    return (mixed ^ (mixed >> np.uint64(29))).view("i8")


def similar(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, text = batch.columns
        for a in range(0, len(text), 256):
            found = [shingles(t) for t in text[a : a + 256].cast(pa.large_binary()).to_pylist()]
            node = pa.array(np.array([xxhash.xxh3_64_intdigest(f.tobytes()) for f in found], "u8").view("i8"))
            n = pa.array([len(f) for f in found], pa.int32())
            rows = pa.array([bands(f).tolist() for f in found], pa.list_(pa.int64()))
            fp = pa.array(np.array([majority(f) for f in found], "u8").view("i8"))
            yield pa.RecordBatch.from_arrays([k[a : a + 256] for k in keys] + [node, n, rows, fp], [*batch.schema.names[:-1], "node", "n", "bands", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, text = batch.columns
        for a in range(0, len(text), 256):
            found = [np.unique(shingles(t).astype("u4")).tobytes() for t in text[a : a + 256].cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([node[a : a + 256], pa.array(found, pa.binary())], ["node", "held"])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, shingles and node -> pairs to look at."""
    at, first, before = None, None, []
    for batch in batches:
        a, b = [], []
        for *key, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != at:
                at, first, before = key, node, [node]
                continue
            for other in {first, *before}:
                a.append(min(node, other))
                b.append(max(node, other))
            before = [*before[1 - NEXT :], node]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def fingerprint_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that connect all whose fingerprints are equal or within the radius."""
    prints = settle(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    equal = nodes.join(prints, "fp").where("node <> least").select("least", "node")
    near = links(prints, radius)
    for c in ("a", "b"):
        near = near.join(prints.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")), c)
    met = equal.toDF("a", "b").unionByName(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _confirm(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            good = pa.array([similar(np.frombuffer(p.as_buffer(), "u4"), np.frombuffer(q.as_buffer(), "u4")) >= similarity for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], ["a", "b"])

    return run


def parity(held: np.ndarray) -> np.ndarray:
    """A bit for each remainder of the hashes, set if an odd number has it: two sets differ in at least as many members as bits."""
    return np.packbits((np.bincount(held % SKETCH, minlength=SKETCH) & 1).astype("u1")).view("u8")


def _compare(similarity: float):
    """Rows sorted by tile, nodes outside the main class first -> links between classes, each needed once in a tile."""
    apart = (1 - similarity) / (1 + similarity) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, strays, sketches, sizes, classes, joined = None, [], None, None, None, {}

        def top(root: int) -> int:
            while root in joined:
                root = joined[root]
            return root

        for batch in batches:
            out = []
            for *tile, outside, root, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != at:
                    at, strays, sketches, joined = tile, [], None, {}
                own = np.frombuffer(held, "u4")
                if outside:
                    strays.append((root, own))
                    continue
                if not strays:
                    continue
                if sketches is None:
                    sketches = np.stack([parity(x) for _, x in strays])
                    sizes = np.array([len(x) for _, x in strays])
                    classes = np.array([r for r, _ in strays])
                root = top(root)
                most = apart * (sizes + len(own))
                near = np.flatnonzero((classes != root) & (np.abs(sizes - len(own)) <= most))
                near = near[np.bitwise_count(sketches[near] ^ parity(own)).sum(axis=1) <= most[near]]
                for i in near.tolist():
                    if classes[i] != root and similar(strays[i][1], own) >= similarity:
                        other = int(classes[i])
                        out.append((min(root, other), max(root, other)))
                        joined[other] = root
                        classes[classes == other] = root
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def still_apart(nodes: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between classes that share a bucket and that the first candidates left apart.

    ``nodes``: node, n, bands; ``sets``: node, held; ``roots``: node, root. Buckets of up to ``NEXT`` + 2 nodes were compared
    whole. In a larger one with several classes the nodes outside the largest class meet all others, which is linear in
    the bucket for one class and a few strays; both sides are dealt into tiles, so no task holds a bucket.
    """
    key = ["band", "bucket"]
    placed = nodes.where("n > 0").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"), F.posexplode("bands").alias("band", "bucket"))
    mixed = placed.groupBy(*key).agg(F.count("*").alias("all"), F.min("root").alias("low"), F.max("root").alias("high")).where((F.col("all") > NEXT + 2) & (F.col("low") < F.col("high")))
    members = settle(placed.join(settle(mixed.select(*key)), key, "left_semi"))
    per = members.groupBy(*key, "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    largest = F.struct("c", "root")
    main = per.groupBy(*key).agg(F.max_by("root", largest).alias("main"), F.sum("c").alias("all_c"), F.sum("s").alias("all_s"), F.max("c").alias("main_c"), F.max_by("s", largest).alias("main_s"))

    def tiles(n, s):
        return F.ceil(F.greatest(n / TILE_NODES, s / TILE_SHINGLES)).cast("int")

    main = settle(main.select(*key, "main", tiles(F.col("all_c") - F.col("main_c"), F.col("all_s") - F.col("main_s")).alias("down"), tiles(F.col("all_c"), F.col("all_s")).alias("across")))
    met = members.join(main, key).withColumn("deal", F.xxhash64("node"))

    def side(outside: bool, own: str, other: str) -> DataFrame:
        at = {own: F.pmod("deal", F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
        rows = met.where("root <> main") if outside else met
        return rows.select(*key, at["down"].alias("row"), at["across"].alias("column"), F.lit(outside).alias("outside"), "root", "node")

    tile = [*key, "row", "column"]
    rows = side(True, "down", "across").unionByName(side(False, "across", "down")).join(sets, "node")
    dealt = rows.repartition(tasks(nodes), *tile).sortWithinPartitions(*tile, F.col("outside").desc(), "node").select(*tile, "outside", "root", "held")
    return settle(dealt.mapInArrow(_compare(similarity), "a long, b long").distinct())


def joined_classes(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links between classes."""
    above = settle(components(more))
    lower = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    # A class of one node isn't among the roots yet.
    return lower.unionByName(above.join(roots, "node", "left_anti").select("node", "root"))


def keep_one(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each class by id (null last), all columns as they were; of equal rows one."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain, ident, text = docs.toDF(*names), names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    key = text_key(*[F.col(n) for n in names])
    placed = plain.select(F.col(ident).isNull().alias("without"), F.col(ident).alias("id"), key["a"].alias("key_a"), key["b"].alias("key_b"), F.col(text).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = settle(placed.mapInArrow(_nodes, f"without boolean, id {kind}, key_a long, key_b long, node long, n int, bands array<long>, fp long"))
    place = F.struct("without", "id", "key_a", "key_b")
    nodes = settle(rows.groupBy("node").agg(F.min(place).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    # A band's number is part of its bucket; empty sets are one node and ask nobody.
    buckets = nodes.where("n > 0").select("n", "node", F.posexplode("bands").alias("band", "bucket")).select("band", "bucket", "n", "node")
    asked = buckets.repartition("band", "bucket").sortWithinPartitions("band", "bucket", "n", "node").select("band", "bucket", "node")
    printed = fingerprint_pairs(nodes.where("n > 0").select("node", "fp"))
    pairs = settle(asked.mapInArrow(_ask, "a long, b long").unionByName(printed).distinct())
    sizes = nodes.select("node", "least")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sizes, "node").select("node", "least.key_a", "least.key_b")
    texts = placed.select("key_a", "key_b", "_text").join(wanted, ["key_a", "key_b"]).select("node", "_text")
    sets = settle(texts.mapInArrow(_sets, "node long, held binary").dropDuplicates(["node"]))
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
    roots = components(settle(met.select("a", "b", "x", "y").mapInArrow(_confirm(similarity), "a long, b long")))
    more = still_apart(nodes, sets, roots, similarity)
    if not more.isEmpty():
        roots = joined_classes(roots, more)
    classes = sizes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    kept = classes.select("least.key_a", "least.key_b")
    copies = rows.groupBy("key_a", "key_b").agg(F.count("*").alias("rows"))
    return one_row_each(plain, names, settle(copies.join(kept, ["key_a", "key_b"]))).toDF(*docs.columns)
