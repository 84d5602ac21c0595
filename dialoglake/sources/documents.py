"""One named file for each recording, written by tasks and published by the driver.

A data source for ``write`` and ``read``: rows are (media_id, document). A task writes its files into a staging folder of its own below
the target; what it returns is that folder's name alone. The commit first looks whether two tasks hold a file of one name,
or the target holds it already and isn't to be overwritten, and only then moves files to their places; so a failed or lost
attempt, or an aborted job, leaves none. Names are ``<media_id>.<ending>``; an id that can't name a file is an error.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from dialoglake.sources.storage import place

STAGING, MOVERS, TRIES = "_staging", 16, 10
UNFIT = frozenset('/\\:*?"<>|\0')
BOM = "\ufeff"


@dataclass
class Written(WriterCommitMessage):
    folder: str | None


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.target, self.ending, self.overwrite = options["path"], options.get("ending", "txt"), overwrite
        self.mark = BOM if options.get("bom", "false").lower() == "true" else ""
        self.staging = f"{STAGING}-{uuid.uuid4().hex}"
        at, root = place(self.target)
        at.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator: Iterator) -> Written:
        at, root = place(self.target)
        folder, seen = None, set()
        for row in iterator:
            name = row["media_id"]
            if not name or name != name.strip() or name.startswith((".", "_")) or UNFIT.intersection(name):
                raise ValueError(f"{name!r} can't name a file")
            if name in seen:
                raise ValueError(f"two documents for {name!r}")
            seen.add(name)
            if folder is None:
                folder = uuid.uuid4().hex  # of this attempt alone
                at.create_dir(f"{root}/{self.staging}/{folder}", recursive=False)  # fails once the job has been given up
            with at.open_output_stream(f"{root}/{self.staging}/{folder}/{name}.{self.ending}") as out:
                out.write((self.mark + (row["document"] or "")).encode())
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        at, root = place(self.target)
        held: dict[str, str] = {}
        for folder in (m.folder for m in messages if m is not None and m.folder):
            for info in at.get_file_info(fs.FileSelector(f"{root}/{self.staging}/{folder}")):
                if held.setdefault(info.base_name, info.path) != info.path:
                    self._fail(f"two documents for {info.base_name!r}")
        at.create_dir(root, recursive=True)
        there = {i.base_name for i in at.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.base_name.endswith(f".{self.ending}")}
        if not self.overwrite and (twice := there & held.keys()):
            self._fail(f"{len(twice)} files are there already, one of them {min(twice)!r}")
        with ThreadPoolExecutor(MOVERS) as movers:
            list(movers.map(lambda x: at.move(x[1], f"{root}/{x[0]}"), held.items()))
            if self.overwrite:
                list(movers.map(lambda name: at.delete_file(f"{root}/{name}"), there - held.keys()))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _fail(self, why: str) -> None:
        self._clear()
        raise ValueError(why)

    def _clear(self) -> None:
        at, root = place(self.target)
        for left in reversed(range(TRIES)):  # tasks of a job given up may still be writing
            try:
                if at.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
                    at.delete_dir(f"{root}/{self.staging}")
                return
            except OSError:
                if not left:
                    raise
                time.sleep(0.2)


#: Bytes of files that one task reads, about.
READ_BYTES = 2**25


@dataclass
class Some(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.target, self.ending = options["path"], f".{options.get('ending', 'txt')}"

    def partitions(self) -> list[Some]:
        at, root = place(self.target)
        out, size = [Some([])], 0
        for info in at.get_file_info(fs.FileSelector(root)):
            if info.type == fs.FileType.File and info.base_name.endswith(self.ending):
                if size >= READ_BYTES:
                    out, size = [*out, Some([])], 0
                out[-1].names.append(info.base_name)
                size += (info.size or 0) + 2**12
        return out

    def read(self, partition: Some) -> Iterator[tuple[str, str]]:
        at, root = place(self.target)
        for name in partition.names:
            with at.open_input_stream(f"{root}/{name}") as f:
                yield name.removesuffix(self.ending), f.read().decode().removeprefix(BOM)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "media_id string, document string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def write_documents(documents: DataFrame, path: str, ending: str, overwrite: bool = False, bom: bool = False) -> None:
    """``documents`` (media_id, document): a file ``<media_id>.<ending>`` each in ``path``, which driver and executors share.

    With ``overwrite`` files of that ending whose recording isn't among the documents go, otherwise a file already there is an error.
    A null document is an empty file.
    """
    documents.sparkSession.dataSource.register(DocumentFiles)
    rows = documents.select(F.col("media_id").cast("string").alias("media_id"), F.col("document").cast("string").alias("document"))
    options = {"path": path if ":/" in path else os.path.abspath(path), "ending": ending, "bom": str(bom).lower()}
    rows.write.format("documents").options(**options).mode("overwrite" if overwrite else "append").save()
