"""Importance resampling towards a target: hashed n-gram features by prefix CRCs, log-ratio weights, Gumbel top-k.

A batch of texts becomes one run of bytes in which words are parted by single separators. It is scanned once, many
stretches side by side, and the running CRC register is kept at every byte. A CRC is linear over GF(2): what a register
held before a window moves through the window by a power of one matrix, so the CRC of any run of words follows from the
registers at its two ends, by shifting the first over the window's length and cancelling it. Windows that cross from one
stretch into the next take in what the stretches before have added, by the same shift.

Each feature's bucket is kept (two bytes or four) beside its document, so texts are read once. Buckets of documents and of
target texts are counted, a bucket's gain is the logarithm of its smoothed odds, a document's weight the mean gain of its
features. A Gumbel draw that depends on the id alone is added; the highest scores among long enough documents are drawn,
ranked by a sort in ranges with a count for each range.

Defined results: a null or empty text has no features and weight 0; a null id draws like an empty one and comes last among
ties; repeated rows are features and candidates each; without target texts all gains come from the smoothing alone; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoglake.llm.common import settle, tasks

POLYNOMIAL, ONES, SPACE = 0xEDB88320, np.uint32(0xFFFFFFFF), 32
#: Stretches scanned side by side, and bytes that are scanned at once but for a single longer text.
STRETCHES, BYTES_AT_ONCE = 4096, 2**23


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype="u4")
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype("u4")
    return table


BYTE = _byte_table()


BITS = (np.uint32(1) << np.arange(32, dtype="u4")).astype("u4")


def _by_bytes(columns: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), given by its columns, as tables of its effect on each byte of a register: (4, 256)."""
    values, tables = np.arange(256, dtype="u4"), np.zeros((4, 256), "u4")
    for byte in range(4):
        for bit in range(8):
            tables[byte] ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[8 * byte + bit], np.uint32(0))
    return tables


def _shift_tables() -> list[np.ndarray]:
    """For each k the tables of 2**k zero bytes."""
    columns = (BYTE[BITS & np.uint32(255)] ^ (BITS >> np.uint32(8))).astype("u4")  # one zero byte
    out = []
    for _ in range(48):
        out.append(_by_bytes(columns))
        columns = _zeros(columns, out[-1])
    return out


def _zeros(register: np.ndarray, tables: np.ndarray) -> np.ndarray:
    a, b, c, d = tables
    return a[register & np.uint32(255)] ^ b[register >> np.uint32(8) & np.uint32(255)] ^ c[register >> np.uint32(16) & np.uint32(255)] ^ d[register >> np.uint32(24)]


SHIFTS = _shift_tables()


def shifted(register: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes."""
    out, lengths = register.copy(), np.asarray(lengths)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> k & 1)
        out[at] = _zeros(out[at], SHIFTS[k])
    return out


class Registers:
    """The CRC register, started at zero, at every byte of a run."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.length = max(1, -(-n // STRETCHES))
        count = max(1, -(-n // self.length))
        padded = np.zeros(self.length * count, "u1")
        padded[:n] = data
        laid = np.ascontiguousarray(padded.reshape(count, self.length).T)
        self.local = np.zeros((self.length + 1, count), "u4")  # after so many bytes of each stretch
        now = self.local[0]
        for i in range(self.length):
            self.local[i + 1] = now = BYTE[(now ^ laid[i]) & np.uint32(255)] ^ (now >> np.uint32(8))
        # What a stretch inherits: the registers at its predecessors' ends, shifted on.
        self.before = np.zeros(count, "u4")
        tables = _by_bytes(shifted(BITS, np.full(32, self.length))).tolist()
        held = 0
        for i, end in enumerate(self.local[-1][:-1].tolist()):
            held = tables[0][held & 255] ^ tables[1][held >> 8 & 255] ^ tables[2][held >> 16 & 255] ^ tables[3][held >> 24] ^ end
            self.before[i + 1] = held

    def crcs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """CRC-32 of the bytes start to end, of many windows."""
        a, i = np.divmod(start, self.length)
        b, j = np.divmod(end, self.length)
        first, last = self.local[i, np.minimum(a, len(self.before) - 1)], self.local[j, np.minimum(b, len(self.before) - 1)]
        # A window that ends with the run's last stretch.
        past = np.flatnonzero(b >= len(self.before))
        last[past] = self.local[self.length, len(self.before) - 1]
        b, j = b.copy(), j.copy()
        b[past], j[past] = len(self.before) - 1, self.length
        crossing = np.flatnonzero(a != b)
        first[crossing] ^= shifted(self.before[a[crossing]], i[crossing])
        last[crossing] ^= shifted(self.before[b[crossing]], j[crossing])
        return last ^ shifted(first ^ ONES, end - start) ^ ONES


#: Lower case of A-Z; every byte that is no letter, digit or part of a longer character parts words.
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def features(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes and their ends -> words of each text, features of each text, buckets of all features in order.

    Features come text by text, and in each text by length and place.
    """
    low = LOWER[data[offsets[0] : offsets[-1]]]
    word = IN_WORD[low]
    cuts = offsets - offsets[0]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(word))]
    begins[inner] = word[inner]  # a word never runs on into the next text
    starts = np.flatnonzero(begins)
    number = np.cumsum(begins)
    sizes = np.bincount(number[word] - 1, minlength=len(starts))
    counts = np.diff(np.searchsorted(starts, cuts))
    # One separator between words: each word's bytes move to their place in the run.
    at = np.cumsum(sizes + 1) - sizes - 1
    run = np.full(int((sizes + 1).sum()), SPACE, "u1")
    if len(starts):
        run[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(starts)), sizes)] = low[word]
    registers, text = Registers(run), np.repeat(np.arange(len(counts)), counts)
    found, owner = [], []
    for n in range(1, most + 1):
        first = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, "i8")
        found.append(registers.crcs(at[first], (at + sizes)[first + n - 1]) % np.uint32(buckets))
        owner.append(text[first])
    flat, owner = np.concatenate(found), np.concatenate(owner)
    if most > 1:
        flat = flat[np.argsort(owner, kind="stable")]
    return counts, np.bincount(owner, minlength=len(counts)), flat


def _cut(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BYTES_AT_ONCE, "right")) - 1)
        yield a, b
        a = b


def _hashed(most: int, buckets: int):
    kind = "<u2" if buckets <= 2**16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, texts = batch.columns
            texts = texts.cast(pa.large_binary()).fill_null(b"")
            _, ends, data = texts.buffers()
            offsets = np.frombuffer(ends, "i8", len(texts) + 1, texts.offset * 8)
            data = np.frombuffer(data, "u1") if data is not None and data.size else np.zeros(0, "u1")
            for a, b in _cut(offsets):
                words, sizes, flat = features(data, offsets[a : b + 1], most, buckets)
                held = flat.astype(kind)
                stops = np.concatenate([[0], np.cumsum(sizes)])
                rows = pa.array([held[s:e].tobytes() for s, e in zip(stops[:-1], stops[1:], strict=True)], pa.large_binary())
                yield pa.RecordBatch.from_arrays([ident[a:b], pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), rows], ["id", "words", "n_features", "held"])

    return run


def _counted(buckets: int):
    kind = "<u2" if buckets <= 2**16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, "i8")
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    return run


def hashed_features(texts: DataFrame, most: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """id, words, n_features and held (the buckets as bytes) of each text."""
    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_hashed(most, buckets), f"id {kind}, words long, n_features long, held binary")


def bucket_counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has. Tasks send a row for each bucket at most, and as many come to the driver."""
    out = np.zeros(buckets, "i8")
    for bucket, n in hashed.select("held").mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's odds under the target, smoothed by one."""
    s, t = source.astype("f8"), target.astype("f8")
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype("i8")


def _weighed(gain: np.ndarray, buckets: int):
    kind = "<u2" if buckets <= 2**16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, words, sizes, held = batch.columns
            sums = [int(gain[np.frombuffer(h, kind)].sum()) for h in held.to_pylist()]
            weight = [s // n if n else 0 for s, n in zip(sums, sizes.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ident, words, sizes, pa.array(weight, pa.int64())], ["id", "words", "n_features", "weight"])

    return run


def gumbel(seed: int, ident: Column) -> Column:
    """Thousandths of a Gumbel draw that follows from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1 along ``order``: a sort in ranges, a count for each range, no task with all rows."""
    laid = settle(rows.repartitionByRange(tasks(rows), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    # One number for each range of the sort comes to the driver.
    counts = sorted(tuple(r) for r in laid.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for number, n in counts:
        before.append((number, total))
        total += n
    known = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    met = laid.join(F.broadcast(known), part == F.col("_part"))
    return met.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, most: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Every document's id, words, n_features, weight, score and rank, null where it wasn't drawn.

    Features are runs of 1 to ``most`` words. Of the N documents with ``least_words`` words, floor(share * N) are drawn.
    """
    held = settle(hashed_features(docs, most, buckets, id_col, text_col))
    asked = hashed_features(target.select(F.lit(0).alias("_n"), F.col(target_col).alias("_t")), most, buckets, "_n", "_t")
    gain = gains(bucket_counts(held, buckets), bucket_counts(asked, buckets))
    kind = docs.schema[id_col].dataType.simpleString()
    weighed = held.mapInArrow(_weighed(gain, buckets), f"id {kind}, words long, n_features long, weight long")
    scored = settle(weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col("id"))))
    able = F.col("words") >= least_words
    draws = scored.where(able).count() * share[0] // share[1]
    in_order = ranked(scored.where(able).withColumn("_row", F.monotonically_increasing_id()), [F.desc("score"), F.asc_nulls_last("id"), F.col("_row")]).drop("_row")
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return in_order.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")).cast("long")).unionByName(rest)
