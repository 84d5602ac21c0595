"""Token ids in binary files: one shared frequency table, independent interleaved blocks, checkpoints and checksums.

Documents are tokenised where they lie, and the ids, with an end id after each document, are written as a table. Their counts
give the frequency table. Then ids are sorted by document in ranges, and each range becomes one file of blocks, coded as
``rans`` says. A file ends with its documents (id, number of ids) and the places of its blocks. Its name belongs to one
attempt of one task; the list of files is a table that Spark commits, so files of lost or repeated attempts are never read.

A reader takes some blocks of one file at a time. A document belongs to the range of blocks in which it begins; decoding
starts at the checkpoint before the range's first document and goes on until its last one ends. Every block's bytes and
the ids of every checkpoint are held against their CRC-32.

    file:  RANSIDS1 | scale, lanes, mark, table's CRC | blocks | documents (Arrow) | places of blocks | tail | RANSEND1
    block: ids, words, checkpoints, CRC of what follows | for each checkpoint its place in the words and its ids' CRC | states | words

Defined results: a null or empty text is the end id alone; null ids come last; rows that repeat an id stand in the order of
their ids' hashes; repeated rows are written each; an empty table gives no file and no rows.

Files are opened by ``pyarrow.fs``, which knows local and shared folders, HDFS and object stores.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dialoglake.llm import rans
from dialoglake.llm.common import settle, tasks
from dialoglake.llm.tokens import word_tokens

HEAD, TAIL, TABLE = b"RANSIDS1", b"RANSEND1", b"RANSTAB1"
#: Ids that one file holds at most, but for a single longer document; blocks coded together; blocks that a reader's row stands for.
FILE_IDS, TOGETHER, READ_BLOCKS = 2**26, 16, 32
TABLE_NAME, FILES = "table.rans", "files"


class DamagedFile(ValueError):
    """A checksum, a length or a mark doesn't fit."""


def place(folder: str) -> tuple[fs.FileSystem, str]:
    at, path = fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1) if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))
    return at, path.rstrip("/")


def _narrow(ids: bytes) -> bytes:
    """32-bit ids as 16-bit ones where all fit: half the bytes to write and to shuffle."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max(initial=0) < 2**16 else ids


def _wide(held: bytes, n: int) -> np.ndarray:
    return np.frombuffer(held, "<u2" if len(held) == 2 * n else "<u4")


def _ids(tokenizer: str, end_id: int):
    end, names = np.array([end_id], "<u4").tobytes(), ["id", "n", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and at a task's end one without ids whose ``counts`` tell how often the task has met each id."""
        encode = word_tokens(tokenizer).encode_all
        total, kind = np.zeros(0, "i8"), None
        for batch in batches:
            ident, texts = batch.columns
            kind = ident.type
            for a in range(0, len(texts), 64):
                held = [ids + end for ids in encode([t or "" for t in texts[a : a + 64].to_pylist()])]
                found = np.bincount(np.frombuffer(b"".join(held), "<u4"))
                if len(found) > len(total):
                    found, total = total, found
                total[: len(found)] += found
                n = pa.array([len(h) // 4 for h in held], pa.int64())
                yield pa.RecordBatch.from_arrays([ident[a : a + 64], n, pa.array(list(map(_narrow, held)), pa.large_binary()), pa.nulls(len(held), pa.large_binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.large_binary()), pa.array([total.astype("<i8").tobytes()], pa.large_binary())], names)

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts as tasks wrote them -> one row for each id that they have met."""
    total = np.zeros(0, "i8")
    for batch in batches:
        for held in batch.column(0).to_pylist():
            found = np.frombuffer(held, "<i8").copy()
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["token", "n"])


class _Writer:
    """One file: blocks as ids come in, then documents and places."""

    def __init__(self, folder: str, table: rans.Table, table_crc: int, part: int):
        self.files, root = place(folder)
        self.name = f"part-{part:06d}-{uuid.uuid4().hex}.rans"
        self.path, self.table = f"{root}/{self.name}", table
        self.out = self.files.open_output_stream(self.path)
        self.places: list[tuple[int, int]] = []  # where each block starts and how many ids it has
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.out.write(HEAD + struct.pack("<4I", rans.SCALE, rans.LANES, rans.MARK, table_crc))

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= TOGETHER * rans.BLOCK:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // rans.BLOCK * rans.BLOCK
            for a in range(0, whole, TOGETHER * rans.BLOCK):
                self._blocks(flat[a : min(whole, a + TOGETHER * rans.BLOCK)].reshape(-1, rans.BLOCK))
            self.waiting, self.n_waiting = [flat[whole:]], len(flat) - whole

    def _blocks(self, ids: np.ndarray) -> None:
        n = ids.shape[1]
        rounds = -(-n // rans.LANES)
        full = np.full((len(ids), rounds * rans.LANES), self.table.filler, ids.dtype)
        full[:, :n] = ids
        for row, (states, at, words) in zip(ids, rans.encode(full.reshape(len(ids), rounds, rans.LANES), self.table), strict=True):
            crcs = [zlib.crc32(row[a : a + rans.SEGMENT].tobytes()) for a in range(0, n, rans.SEGMENT)]
            body = np.stack([at, np.array(crcs, "u4")], axis=1).astype("<u4").tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
            self.places.append((self.out.tell(), n))
            self.out.write(struct.pack("<4I", n, len(words), len(at), zlib.crc32(body)) + body)
            self.n_ids += n

    def close(self, documents: pa.Table) -> int:
        """Ends the file; -> its size."""
        rest = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        whole = len(rest) // rans.BLOCK * rans.BLOCK
        if whole:
            self._blocks(rest[:whole].reshape(-1, rans.BLOCK))
        if len(rest) > whole:
            self._blocks(rest[whole:][None])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(documents)
        index = sink.getvalue().to_pybytes() + np.array(self.places, "<u8").tobytes()
        tail = struct.pack("<4QI", self.out.tell(), len(index), len(self.places), self.n_ids, zlib.crc32(index))
        self.out.write(index + tail + TAIL)
        size = self.out.tell()
        self.out.close()
        return size

    def drop(self) -> None:
        self.out.close()
        self.files.delete_file(self.path)


_TAIL_SIZE = struct.calcsize("<4QI") + len(TAIL)


def _encode(folder: str, freq: bytes, table_crc: int, kind: pa.DataType):
    names = ["part", "nth", "name", "n_docs", "n_ids", "n_blocks", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, files = rans.Table(np.frombuffer(freq, "<u4")), TaskContext.get().partitionId(), 0
        writer, docs, sizes = None, [], []

        def done() -> pa.RecordBatch:
            size = writer.close(pa.table({"id": pa.array(docs, kind), "n": pa.array(sizes, pa.int64())}))
            row = [part, files, writer.name, len(docs), writer.n_ids, len(writer.places), size]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

        try:
            for batch in batches:
                for ident, n, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if writer is not None and writer.n_ids + writer.n_waiting + n > FILE_IDS:
                        yield done()
                        writer, docs, sizes, files = None, [], [], files + 1
                    if writer is None:
                        writer = _Writer(folder, table, table_crc, part)
                    writer.add(_wide(held, n).astype("<u4"))
                    docs.append(ident)
                    sizes.append(n)
            if writer is not None:
                yield done()
                writer = None
        except BaseException:
            if writer is not None:
                writer.drop()
            raise

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files into ``folder``, which driver and executors share; -> the list of files: part, nth, name, n_docs, n_ids, n_blocks, bytes."""
    kind = docs.schema[id_col].dataType
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    written = settle(read.mapInArrow(_ids(tokenizer, end_id), f"id {kind.simpleString()}, n long, ids binary, counts binary"))
    held = written.where("n is not null").select("id", "n", "ids")
    # At most one row for each id of the vocabulary comes to the driver. Ids were counted where they were made, so they aren't read for it.
    met = written.where("counts is not null").select("counts").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r[0] for r in met), default=-1) + 1, "i8")
    for token, n in met:
        counts[token] = n
    freq = rans.frequencies(counts).astype("<u4").tobytes()
    at, root = place(folder)
    at.create_dir(root, recursive=True)
    with at.open_output_stream(f"{root}/{TABLE_NAME}") as out:
        out.write(TABLE + struct.pack("<2I", len(counts), zlib.crc32(freq)) + freq)
    keys = [F.col("id").isNull(), F.col("id"), F.xxhash64("ids"), F.col("row")]
    sorted_ = held.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(tasks(held), *keys).sortWithinPartitions(*keys).select("id", "n", "ids")
    files = sorted_.mapInArrow(_encode(folder, freq, zlib.crc32(freq), to_arrow_type(kind)), "part long, nth long, name string, n_docs long, n_ids long, n_blocks long, bytes long")
    files.write.parquet(f"{folder.rstrip('/')}/{FILES}")
    return token_files(docs.sparkSession, folder)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part long, nth long, name string, n_docs long, n_ids long, n_blocks long, bytes long").parquet(f"{folder.rstrip('/')}/{FILES}")


@lru_cache(maxsize=2)
def _table(folder: str) -> tuple[rans.Table, int]:
    at, root = place(folder)
    with at.open_input_file(f"{root}/{TABLE_NAME}") as f:
        held = f.read()
    size, crc = struct.unpack_from("<2I", held, 8)
    freq = held[16:]
    if held[:8] != TABLE or len(freq) != 4 * size or zlib.crc32(freq) != crc:
        raise DamagedFile(f"{folder}/{TABLE_NAME}")
    return rans.Table(np.frombuffer(freq, "<u4")), crc


class TokenFile:
    """A file opened for reading: its documents, and the ids from any one of them on."""

    def __init__(self, folder: str, name: str):
        self.table, crc = _table(folder)
        self.name = name
        at, root = place(folder)
        self.file = at.open_input_file(f"{root}/{name}")
        size = self.file.size()
        head, tail = self.file.read_at(24, 0), self.file.read_at(_TAIL_SIZE, max(0, size - _TAIL_SIZE))
        if head[:8] != HEAD or tail[-8:] != TAIL or struct.unpack("<4I", head[8:]) != (rans.SCALE, rans.LANES, rans.MARK, crc):
            raise DamagedFile(name)
        start, length, n_blocks, self.n_ids, check = struct.unpack("<4QI", tail[:-8])
        index = self.file.read_at(length, start)
        if len(index) != length or zlib.crc32(index) != check:
            raise DamagedFile(name)
        cut = length - 16 * n_blocks
        documents = pa.ipc.open_stream(pa.py_buffer(index[:cut])).read_all()
        self.ids = documents.column("id").combine_chunks()
        self.ends = np.cumsum(documents.column("n").to_numpy())
        places = np.frombuffer(index[cut:], "<u8").reshape(-1, 2).astype("i8")
        self.starts = np.append(places[:, 0], start)  # one more: where the last block ends
        self.firsts = np.concatenate([[0], np.cumsum(places[:, 1])])

    def decoded(self, first: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        """Ids first to end: (number of the piece's first id, piece) in order, cut where checkpoints stand."""
        b = int(np.searchsorted(self.firsts, first, "right")) - 1
        while b < len(self.firsts) - 1 and self.firsts[b] < end:
            stop = min(b + TOGETHER, int(np.searchsorted(self.firsts, end, "left")))
            held = self.file.read_at(int(self.starts[stop] - self.starts[b]), int(self.starts[b]))
            found = []  # (first id, ids, states, place in the words, crc)
            words, n_words = [], 0
            for block in range(b, stop):
                a = int(self.starts[block] - self.starts[b])
                n, length, marks, check = struct.unpack_from("<4I", held, a)
                body = memoryview(held)[a + 16 : a + 16 + 8 * marks + 8 * marks * rans.LANES + 4 * length]
                if zlib.crc32(body) != check:
                    raise DamagedFile(f"{self.name}, block {block}")
                at = np.frombuffer(body, "<u4", 2 * marks).reshape(marks, 2)
                states = np.frombuffer(body, "<u8", marks * rans.LANES, 8 * marks).reshape(marks, rans.LANES)
                for m in range(marks):
                    low = int(self.firsts[block]) + m * rans.SEGMENT
                    size = min(rans.SEGMENT, n - m * rans.SEGMENT)
                    if low < end and low + size > first:
                        found.append((low, size, states[m], int(at[m, 0]) + n_words, int(at[m, 1])))
                words.append(np.frombuffer(body, "<u4", length, 8 * marks * (1 + rans.LANES)))
                n_words += length
            stream = np.concatenate(words)
            for rounds, group in _runs(found):
                ids = rans.decode(np.stack([s for _, _, s, _, _ in group]), np.array([p for *_, p, _ in group]), stream, rounds, self.table)
                for (low, size, *_, check), row in zip(group, ids.reshape(len(group), -1), strict=True):
                    if zlib.crc32(row[:size].tobytes()) != check:
                        raise DamagedFile(f"{self.name}, ids from {low}")
                    yield low, row[:size]
            b = stop

    def documents(self, first: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
        """Documents number first to end -> (first id's number, ids)."""
        starts = np.concatenate([[0], self.ends])
        at, held, n, base = first, [], 0, None
        for low, piece in self.decoded(int(starts[first]), int(starts[end])) if end > first else ():
            base = low if base is None else base
            held.append(piece)
            n += len(piece)
            if base + n >= starts[at + 1]:
                flat = np.concatenate(held)
                while at < end and starts[at + 1] <= base + n:
                    yield int(starts[at]), flat[starts[at] - base : starts[at + 1] - base]
                    at += 1
                base, held = int(starts[at]), [flat[starts[at] - base :]]
                n = len(held[0])


def _runs(found: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """Neighbours with as many rounds, to be decoded at once."""
    group: list[tuple] = []
    for x in found:
        if group and -(-group[0][1] // rans.LANES) != -(-x[1] // rans.LANES):
            yield -(-group[0][1] // rans.LANES), group
            group = []
        group.append(x)
    if group:
        yield -(-group[0][1] // rans.LANES), group


def _read(folder: str, whole: bool):
    names = ["id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if whole else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, low, high, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = TokenFile(folder, name)
                with file.file:
                    # Documents that begin in these blocks.
                    starts = np.concatenate([[0], file.ends[:-1]])
                    first, end = (int(np.searchsorted(starts, file.firsts[min(b, len(file.firsts) - 1)])) for b in (low, high))
                    rows: tuple[list, ...] = ([], [], [], [])
                    at, size = first, 0

                    def out() -> pa.RecordBatch:
                        columns = [file.ids[at - len(rows[0]) : at], *(pa.array(r, pa.int64()) for r in rows[:3])]
                        return pa.RecordBatch.from_arrays(columns + [pa.array(rows[3], pa.large_binary())] * whole, names)

                    for start, ids in file.documents(first, end):
                        held = ids.astype("<u4", copy=False).tobytes()
                        for r, x in zip(rows, (before + start, len(ids), zlib.crc32(held), held if whole else None), strict=True):
                            r.append(x)
                        at, size = at + 1, size + len(held)
                        if len(rows[0]) >= 4096 or whole and size >= 2**24:
                            yield out()
                            rows, size = ([], [], [], []), 0
                    if rows[0]:
                        yield out()

    return run


def read_token_files(spark: SparkSession, folder: str, id_type: str = "long", whole: bool = False) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids_crc32 and, if ``whole``, ids (little-endian unsigned 32-bit) of every document."""
    listed = token_files(spark, folder)
    # One row for each file, so one task is enough for their running sum.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = listed.withColumn("before", before)
    blocks = placed.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1, F.lit(READ_BLOCKS).cast("long"))))
    asked = blocks.select("name", "low", (F.col("low") + READ_BLOCKS).alias("high"), "before")
    schema = f"id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * whole
    return asked.repartition(tasks(listed), "name", "low").mapInArrow(_read(folder, whole), schema)
