"""One file a document: ``df.write.format("lectern_artefacts")`` over rows of name and content.

Tasks write under a staging folder of their own attempt. Only the attempts that
Spark reports as done are moved to their names, after the last task; so a task
that runs twice leaves one file, and a job that fails leaves what was there
before. A move is one rename for each file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .pages import resolved


@dataclass
class Done(WriterCommitMessage):
    """The folder of a finished attempt, and how many files are in it."""

    folder: str
    count: int


def checked(name: str | None) -> str:
    """A relative name that stays below the target."""
    if not name or name.startswith("/") or "\\" in name or any(p in ("", ".", "..") for p in name.split("/")) or name.split("/")[0].startswith("_staging-"):
        raise ValueError(f"{name!r} does not name a file below the target")
    return name


class ArtefactWriter(DataSourceWriter):
    def __init__(self, path: str, movers: int):
        self.path, self.movers, self.job = path, movers, uuid.uuid4().hex

    @property
    def _place(self) -> tuple[files.FileSystem, str, str]:
        store, root = resolved(self.path)
        return store, root.rstrip("/"), f"{root.rstrip('/')}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Done:
        store, _, staging = self._place
        context = TaskContext.get()
        folder = f"{staging}/{context.partitionId()}-{context.taskAttemptId()}" if context else f"{staging}/{uuid.uuid4().hex}"
        seen: set[str] = set()
        for row in iterator:
            name, content = checked(row[0]), row[1]
            if name in seen:
                raise ValueError(f"two rows are named {name}")
            seen.add(name)
            at = f"{folder}/{name}"
            store.create_dir(os.path.dirname(at), recursive=True)
            with store.open_output_stream(at) as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Done(folder, len(seen))

    def commit(self, messages: list[Done | None]) -> None:
        store, root, staging = self._place
        moves = []
        for done in messages:
            if done is None or not done.count:
                continue
            found = [f.path for f in store.get_file_info(files.FileSelector(done.folder, recursive=True)) if f.type == files.FileType.File]
            if len(found) != done.count:
                raise RuntimeError(f"{done.folder} holds {len(found)} files of {done.count}")
            moves += [(f, f"{root}/{f[f.index(done.folder) + len(done.folder) + 1 :]}") for f in found]
        for folder in {os.path.dirname(to) for _, to in moves}:
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(self.movers) as pool:
            list(pool.map(lambda m: store.move(*m), moves))
        self._clear(store, staging)

    def abort(self, messages: list[Done | None]) -> None:
        store, _, staging = self._place
        self._clear(store, staging)

    @staticmethod
    def _clear(store: files.FileSystem, staging: str) -> None:
        if store.get_file_info(staging).type == files.FileType.Directory:
            store.delete_dir(staging)


class Artefacts(DataSource):
    """Options: path; movers, how many files are moved at a time (16). Rows: name string, content string or binary."""

    @classmethod
    def name(cls) -> str:
        return "lectern_artefacts"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if "path" not in self.options:
            raise ValueError("lectern_artefacts needs a path")
        return ArtefactWriter(self.options["path"], int(self.options.get("movers", 16)))


def write_artefacts(rows: DataFrame, path: str, name: Column | str = "name", content: Column | str = "content") -> None:
    """Writes each row's ``content`` (text or bytes) as the file ``name`` below ``path``. Names that repeat stop the job."""
    rows.sparkSession.dataSource.register(Artefacts)
    named = rows.select((F.col(name) if isinstance(name, str) else name).alias("name"), (F.col(content) if isinstance(content, str) else content).alias("content"))
    # equal names meet in a task, which refuses them
    named.repartition("name").write.format(Artefacts.name()).mode("append").save(path)


def write_report_files(reports: DataFrame, path: str, name: Column, pretty: bool = True) -> None:
    """A report beside each document: ``<name>.report.json`` below ``path``, in UTF-8."""
    text = F.to_json(F.struct("*"), {"pretty": "true"} if pretty else {})
    write_artefacts(reports, path, F.concat(name, F.lit(".report.json")), text)
