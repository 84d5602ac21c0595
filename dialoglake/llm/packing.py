"""Packing documents into sequences by the linear grouping scheme.

Documents become token pieces of at most ``capacity`` tokens. Pieces are dealt into shards of about ``SHARD`` pieces, each
packed in one task: large lengths are cut, longest first, into ``GROUPS`` groups of equal cardinality and rounded up to
their group's longest; a linear programme over those few sizes, by column generation, yields configurations and how often
to use each; actual pieces take the places of the rounded ones, the last place of a sequence going to the longest piece
that still fits; whatever is left, above all the small pieces, goes by best fit, longest first. A shard wastes a few
sequences, so the whole wastes about one in ten thousand.

Defined results: a null or empty text is the end token alone; an empty table gives no rows; repeated rows are packed each;
only a document longer than the capacity is cut, and no token is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import settle
from dialoglake.llm.tokens import word_tokens

SHARD, GROUPS, SMALL_SHARE = 131_072, 64, 8
EDGE = 1e-9


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = word_tokens(path).encode, 4 * capacity
        for batch in batches:
            ids, texts = batch.columns
            for a in range(0, len(texts), 64):
                rows: tuple[list[int], ...] = ([], [], [], [], [])
                for i, text in enumerate(texts[a : a + 64].to_pylist()):
                    held = encode(text or "") + end
                    for n, at in enumerate(range(0, len(held), step)):
                        part = held[at : at + step]
                        for column, value in zip(rows, (i, n, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [ids[a : a + 64].take(pa.array(rows[0])), pa.array(rows[1], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[2:]]],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32: the token pieces of every document, without their tokens."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(_pieces(tokenizer, capacity, end_id), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) and whole numbers of uses, from the column-generation optimum rounded down."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    basis, inverse = list(range(k)), np.diag(1.0 / np.diag(columns))
    columns = [columns[:, i] for i in range(k)]
    use = inverse @ demand
    for _ in range(40 * k):
        price = inverse.sum(axis=0)
        value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):  # the dearest configuration, by an unbounded knapsack
            value[c] = value[c - 1]
            fits = sizes <= c
            gain = np.where(fits, value[c - np.minimum(sizes, c)] + price, -1.0)
            if gain[i := int(gain.argmax())] > value[c] + EDGE:
                value[c], last[c] = gain[i], i
        if value[capacity] <= 1 + 1e-6:
            break
        new, c = np.zeros(k), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                new[last[c]] += 1
                c -= int(sizes[last[c]])
        turn = inverse @ new
        ratio = np.where(turn > EDGE, use / np.maximum(turn, EDGE), np.inf)
        out = int(ratio.argmin())
        inverse[out] /= turn[out]
        use[out] = ratio[out]
        for i in range(k):
            if i != out and turn[i]:
                inverse[i] -= turn[i] * inverse[out]
                use[i] = max(0.0, use[i] - turn[i] * use[out])
        basis[out] = len(columns)
        columns.append(new)
    return [(columns[b].astype(int), int(u + EDGE)) for b, u in zip(basis, use, strict=True) if u + EDGE >= 1]


class _Stock:
    """Numbers filed under whole keys, with the next filled key found by bit operations."""

    def __init__(self) -> None:
        self.at: dict[int, list[int]] = {}
        self.filled = 0

    def add(self, key: int, item: int) -> None:
        if not (row := self.at.setdefault(key, [])):
            self.filled |= 1 << key
        row.append(item)

    def take(self, key: int) -> int:
        row = self.at[key]
        item = row.pop()
        if not row:
            self.filled ^= 1 << key
        return item

    def most(self, key: int) -> int:
        """The largest filled key up to ``key``, or -1."""
        return (self.filled & ((1 << (key + 1)) - 1)).bit_length() - 1

    def least(self, key: int) -> int:
        """The smallest filled key from ``key`` on, or -1."""
        above = self.filled >> key
        return key + (above & -above).bit_length() - 1 if above else -1


def pack(lengths: np.ndarray, capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    sequence, offset = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    stock, room = _Stock(), []
    for i in np.argsort(lengths, kind="stable").tolist():
        stock.add(int(lengths[i]), i)

    def put(item: int, at: int) -> None:
        sequence[item], offset[item] = at, capacity - room[at]
        room[at] -= int(lengths[item])

    while stock.at.get(capacity):
        room.append(capacity)
        put(stock.take(capacity), len(room) - 1)
    large = np.sort(lengths[(lengths > capacity // SMALL_SHARE) & (lengths < capacity)])[::-1]
    groups = min(groups, len(large) // 64)
    if groups >= 4:
        tops = large[np.arange(groups) * len(large) // groups]
        counts = np.diff(np.append(np.arange(groups) * len(large) // groups, len(large)))
        sizes = np.unique(tops)
        demand = np.array([counts[tops == s].sum() for s in sizes], float)
        for shape, uses in configurations(sizes, demand, capacity):
            places = [int(s) for s, n in zip(sizes[::-1], shape[::-1], strict=True) for _ in range(n)]
            for _ in range(uses):
                room.append(capacity)
                at = len(room) - 1
                for n, size in enumerate(places, 1):
                    if (fit := stock.most(room[at] if n == len(places) else size)) > 0:
                        put(stock.take(fit), at)
    spaces = _Stock()
    for at, left in enumerate(room):
        if left:
            spaces.add(left, at)
    while (longest := stock.most(capacity)) > 0:
        item = stock.take(longest)
        if (space := spaces.least(longest)) > 0:
            at = spaces.take(space)
        else:
            room.append(capacity)
            at = len(room) - 1
        put(item, at)
        if room[at]:
            spaces.add(room[at], at)
    return sequence, offset


def _pack_shard(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = pack(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=frame["shard"].to_numpy() * 2**32 + sequence, offset=offset)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are read once and never shuffled: only the pieces' short rows are written, counted and dealt into shards.
    """
    found = settle(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    shards = max(1, -(-found.count() // SHARD))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    kind = found.schema["id"].dataType.simpleString()
    packed = dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long, shard long, sequence_id long, offset long")
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
