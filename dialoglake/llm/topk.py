"""Exact top-k search: tiled matrix products, partial selection in each tile, tree merging.

Query rows and candidate rows are packed, where they lie, into blocks of at most ``block`` vectors. Every query block
meets every candidate block as one tile: a matrix product and the k best of each query. Lists are then merged ``FAN`` at
a time, level by level, so that no task ever holds more than ``FAN`` lists of a query.

Defined results: a vector that is null or holds a null or non-finite component takes no part, nor does a row with a null
id; vectors of unequal length are not compared; a query's own id is left out; repeated rows are candidates each; rows that
repeat a query's id add to one list; ties go to the smaller id. Scores are exact, and limited to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import settle

FAN = 16
#: Blocks that meet in one task are at most about this many times each other.
SHARDS_A_GROUP, QUERIES_A_GROUP = 8, 8
EXACT = 2.0**53


def _packer(block: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def out(dim: int) -> pd.DataFrame:
            rows = held.pop(dim)
            return pd.DataFrame({"dim": [dim], "ids": [np.array([i for i, _ in rows], "<i8").tobytes()], "vecs": [np.concatenate([v for _, v in rows]).astype("<f8").tobytes()]})

        for frame in frames:
            for i, v in zip(frame["id"], frame["vec"], strict=True):
                held.setdefault(len(v), []).append((i, np.asarray(v, "f8")))
                if len(held[len(v)]) >= block:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return pack


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where they can't round, else in Python's integers."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)))
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < EXACT:
        return q @ c.T
    big = np.vectorize(int, otypes=[object])
    return big(q) @ big(c).T


def _tile_top(k: int):
    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, shard, qi, qv, ci, cv in zip(*(frame[c] for c in ("dim", "shard", "q_ids", "q_vecs", "ids", "vecs")), strict=True):
                qi, ci = np.frombuffer(qi, "<i8"), np.frombuffer(ci, "<i8")
                order = np.argsort(ci, kind="stable")  # then a stable selection settles ties by id
                ci, cv = ci[order], np.frombuffer(cv, "<f8").reshape(len(ci), dim)[order]
                ids, lists = [], []
                for a in range(0, len(qi), 256):
                    part = qi[a : a + 256]
                    scores = _product(np.frombuffer(qv, "<f8").reshape(len(qi), dim)[a : a + 256], cv)
                    for i, row in zip(part, scores, strict=True):
                        near = np.flatnonzero(ci != i)
                        if len(near) > 4 * k and row.dtype != object:  # all that reach the k-th score, however many tie
                            others = row[near]
                            near = near[others >= np.partition(others, len(others) - k)[len(others) - k]]
                        best = near[np.argsort(-row[near], kind="stable")[:k]]
                        ids.append(i)
                        lists.append([{"less": min(2**63 - 1, max(-(2**63) + 1, -int(row[j]))), "id": int(ci[j])} for j in best])
                yield pd.DataFrame({"query_id": np.array(ids, "i8"), "shard": np.full(len(ids), shard, "i8"), "best": lists})

    return top


def _usable(df: DataFrame) -> DataFrame:
    """Rows that can take part; ids as longs, so that none passes through a float."""
    whole = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & whole)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """The ``k`` best candidates of each query by inner product. Both inputs: id long, vec array<double> of whole numbers.

    Returns query_id, rank (from 1), vec_id, score.
    """
    pack = _packer(block)
    queries, candidates = (_usable(df) for df in (queries, candidates))
    held = "dim int, ids binary, vecs binary"
    shards = settle(candidates.mapInPandas(pack, held).withColumn("shard", F.monotonically_increasing_id()))
    asked = settle(queries.mapInPandas(pack, held).withColumnsRenamed({"ids": "q_ids", "vecs": "q_vecs"}))
    # The stated query set meets all rows in blocks: groups of query blocks and groups of shards are dealt out as tiles.
    n, m = max(1, shards.count()), max(1, asked.count())
    shard_groups, query_groups = -(-n // SHARDS_A_GROUP), -(-m // QUERIES_A_GROUP)

    def deal(df: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
        return df.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    tiles = deal(asked, "qg", query_groups, "sg", shard_groups).join(deal(shards, "sg", shard_groups, "qg", query_groups), ["dim", "qg", "sg"])
    lists = tiles.mapInPandas(_tile_top(k), "query_id long, shard long, best array<struct<less:long,id:long>>")
    lists = lists.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(n)))
    while True:
        n = -(-n // FAN)
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
        lists = lists.withColumn("shard", (F.col("shard") / FAN).cast("long")).groupBy("query_id", "shard").agg(merged.alias("best"))
        if n == 1:
            break
    return lists.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.less")).alias("score")
    )


def whole_parts(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as doubles; null where the vector can't take part."""
    up = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("double"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~odd, up)
