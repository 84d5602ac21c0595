"""Blocks of subtitle files, read in splits: one large file is many tasks' work.

A data source for ``read``. Files are cut into ranges of bytes; a block belongs to the range in which its first line starts.
A reader steps back to the line before its range, to see whether that one parts blocks, and reads on past the end of its
range until its last block ends. Lines end with a line feed, a carriage return or both; a byte order mark goes.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dialoglake.sources.storage import place

SPLIT_BYTES, STEP = 2**25, 2**16
BOM = b"\xef\xbb\xbf"
SPACE, LINE_END = b" \t\n\x0b\x0c\r", re.compile(rb"\r\n|\r|\n")


def lines_from(file, at: int, step: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes without the end) of each line from ``at``, where one starts."""
    size, held, base = file.size(), b"", at
    while True:
        more = file.read_at(min(step, size - base - len(held)), base + len(held)) if base + len(held) < size else b""
        held += more
        ended = base + len(held) >= size
        # A carriage return at the very end may be half of a line's end.
        usable, done = held if ended or not held.endswith(b"\r") else held[:-1], 0
        for end in LINE_END.finditer(usable):
            yield base + done, held[done : end.start()]
            done = end.end()
        base, held = base + done, held[done:]
        if ended:
            if held:
                yield base, held
            return


def line_before(file, start: int, step: int) -> int:
    """Where the line begins that holds the byte before ``start``."""
    last = start - 1
    if last > 0 and file.read_at(2, last - 1) == b"\r\n":
        last -= 1
    while last > 0:
        low = max(0, last - step)
        held = file.read_at(last - low, low)
        if (at := max(held.rfind(b"\n"), held.rfind(b"\r"))) >= 0:
            return low + at + 1
        last = low
    return 0


def blocks_of(file, start: int, end: int, spaces: bool, step: int = STEP) -> Iterator[str]:
    """The blocks whose first line starts in ``start`` to ``end``. ``spaces``: a line of white space parts blocks like an empty one."""
    parted, block = start == 0, None
    for at, line in lines_from(file, line_before(file, start, step) if start else 0, step):
        if at == 0:
            line = line.removeprefix(BOM)
        blank = not (line.strip(SPACE) if spaces else line)
        if block is not None:
            if not blank:
                block.append(line)
                continue
            yield b"\n".join(block).decode("utf-8", "replace")
            block = None
        elif at >= end:
            return
        elif not blank and parted and at >= start:
            block = [line]
        parted = blank
    if block is not None:
        yield b"\n".join(block).decode("utf-8", "replace")


@dataclass
class Ranges(InputPartition):
    ranges: list[tuple[str, int, int, int]]  # file, number of the split, first byte, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.spaces = options["path"], options.get("spaces", "true").lower() == "true"
        self.size = int(options.get("splitBytes", SPLIT_BYTES))

    def _files(self) -> list[fs.FileInfo]:
        at, root = place(self.path)
        folder, pattern = (posixpath.dirname(root), posixpath.basename(root)) if "*" in posixpath.basename(root) else (root, "*")
        info = at.get_file_info(folder)
        if info.type == fs.FileType.File:
            return [info]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return sorted((i for i in at.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern) and not i.base_name.startswith((".", "_"))), key=lambda i: i.path)

    def partitions(self) -> list[Ranges]:
        out, size = [Ranges([])], 0
        for info in self._files():
            for n, start in enumerate(range(0, info.size, self.size)):
                end = min(info.size, start + self.size)
                if size and size + end - start > self.size:
                    out, size = [*out, Ranges([])], 0
                out[-1].ranges.append((info.path, n, start, end))
                size += end - start
        return out

    def read(self, partition: Ranges) -> Iterator[tuple[str, int, int, str]]:
        at, _ = place(self.path)
        for path, split, start, end in partition.ranges:
            media = posixpath.basename(path)
            media = media[: media.rfind(".")] if media.rfind(".") > 0 else media
            with at.open_input_file(path) as file:
                for nth, block in enumerate(blocks_of(file, start, end, self.spaces)):
                    yield media, split, nth, block


class SubtitleBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "subtitle_blocks"

    def schema(self) -> str:
        return "media_id string, split int, nth int, block string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_blocks(spark: SparkSession, path: str, spaces: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """media_id (the file's name), split, nth (in the split) and block of the files in ``path``: a file, a folder or a folder's pattern."""
    spark.dataSource.register(SubtitleBlocks)
    return spark.read.format("subtitle_blocks").options(path=path if ":/" in path else os.path.abspath(path), spaces=str(spaces).lower(), splitBytes=str(split_bytes)).load()
