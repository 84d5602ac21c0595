"""SimHash near-duplicates, found by covering locality-sensitive hashing.

A fingerprint holds 64 majority bits over the hashes of a text's word shingles. For radius r every bit position gets a
nonzero vector of r + 1 bits, and each nonzero vector v gives the mask of all positions whose product with v is odd. Up
to r differing positions never span all r + 1 dimensions, so some v is orthogonal to all of them: under its mask the two
fingerprints agree. 2^(r+1) - 1 tables therefore hold every pair within the radius in a common bucket, for certain.

Equal fingerprints count once. A bucket of at most ``BUCKET`` fingerprints is compared inside one task, which returns only
links that join parts not joined before; a larger one is never gathered but hashed again by new masks over the bits not yet
fixed, with the same guarantee, until no large one is left. No cap is set and no bucket's pairs are written out.

Defined results: a null or empty text has fingerprint zero and is linked like any other; fewer words than a shingle give
one shingle of all words; repeated rows get the same class; a class of null ids only has a null id.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import join_unique, settle, tasks
from dialoglake.llm.components import components

BITS, SEED = 64, 42
#: Fingerprints that one task compares with one another.
BUCKET = 2048


def majority(hashed: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, "i8")
    for a in range(0, len(hashed), 8192):
        counts += np.unpackbits(hashed[a : a + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i4")
    return int(np.packbits(counts * 2 > len(hashed), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))), "<u8", len(words) - shingle + 1)
    return majority(hashed)


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, text = batch.columns
            for a in range(0, len(text), 256):
                found = np.array([fingerprint(t or b"", shingle) for t in text[a : a + 256].cast(pa.large_binary()).to_pylist()], "u8").view("i8")
                yield pa.RecordBatch.from_arrays([c[a : a + 256] for c in rest] + [pa.array(found)], [*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (long, the 64 bits as they are)."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return kept.mapInArrow(_fingerprints(shingle), f"id {kept.schema['id'].dataType.simpleString()}, fp long")


@cache
def masks(radius: int, level: int) -> tuple[int, ...]:
    """The masks of one level, as signed longs. Positions share the nonzero vectors out evenly, anew on each level."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    random.Random(level).shuffle(vectors)
    out = []
    for v in range(1, 2 ** (radius + 1)):
        m = sum(1 << i for i, x in enumerate(vectors) if bin(x & v).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return tuple(out)


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join all values joined by any: at most one fewer than the values."""
    root = list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1
        for j in near.tolist():
            if (a := find(i)) != (b := find(j)):
                root[b] = a
                out.append((i, j))
    return out


def _link(radius: int):
    """Reads rows sorted by bucket; gives the links of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        held: list[np.ndarray] = []
        out: list[tuple[int, int]] = []

        def close() -> None:
            values = np.unique(np.concatenate(held)) if held else np.zeros(0, "i8")
            out.extend((int(values[i]), int(values[j])) for i, j in forest(values.view("u8"), radius))
            held.clear()

        def ready() -> pa.RecordBatch:
            rows = out.copy()
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            fixed, value, fp = (np.asarray(c) for c in batch.columns)
            change = np.flatnonzero((fixed[1:] != fixed[:-1]) | (value[1:] != value[:-1])) + 1
            starts = [0, *change.tolist(), len(fp)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if (key := (int(fixed[a]), int(value[a]))) != at:
                    close()
                    at = key
                held.append(fp[a:b])
            if len(out) > 50_000:
                yield ready()
        close()
        yield ready()

    return run


def links(values: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct values ``fp`` that connect all pairs within the radius.

    Buckets are counted with partial sums first. Those of one value have no links, those of up to ``bucket`` values are
    gathered and compared, and the members of larger ones are dealt by the next level's masks and never gathered.
    """
    level, found, rows, key = 0, None, values.select("fp", F.lit(0).cast("long").alias("fixed")), ["fixed", "value"]
    while True:
        fresh = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(radius, level)]))
        keyed = rows.withColumn("mask", fresh).select(F.col("fixed").bitwiseOR(F.col("mask")).alias("fixed"), "fp")
        keyed = keyed.select("fixed", F.col("fixed").bitwiseAND(F.col("fp")).alias("value"), "fp")
        if level:
            keyed = keyed.distinct()  # two ways may fix the same bits
        sizes = settle(keyed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
        small = keyed.join(sizes.where(F.col("n") <= bucket).select(*key), key, "left_semi").select(*key, "fp")
        sorted_ = small.repartition(tasks(values), *key).sortWithinPartitions(*key, "fp")
        new = settle(sorted_.mapInArrow(_link(radius), "a long, b long"))
        found = new if found is None else found.unionByName(new)
        large = sizes.where(F.col("n") > bucket).select(*key)
        if large.isEmpty():
            return found.distinct()
        rows = settle(keyed.join(large, key, "left_semi").select("fp", "fixed"))
        level += 1


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, fp and component_id, the smallest id that links lead to."""
    prints = settle(fingerprints(docs, shingle, id_col, text_col))
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    labels = components(links(distinct, radius))
    least = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    inside = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(least.join(inside, "root").select("fp", "rows", "component_id"))
    limit = max(1, prints.count() // 1000)
    return join_unique(prints, named, ["fp"], "rows", limit).select("id", "fp", "component_id")
