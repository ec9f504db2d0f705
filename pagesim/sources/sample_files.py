"""``sample_files``: folders of ``.dom`` files with ``.meta.json`` beside them, as a Spark data source.

Reading lists names and sizes once, where the plan is made, and deals the files to partitions by
their bytes and number; every file is opened in the task that reads it, empty ones included.
Writing makes each task put its files under a folder of its own below ``_temporary``; the commit
moves them into place and writes one manifest, an abort removes them. So a failed or repeated task
leaves nothing behind.

Paths go through Arrow's file systems: local and shared folders (``file:`` or no scheme), and the
stores Arrow knows. A store that only Spark reads is read by ``engine="spark"`` of the readers."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..session import qualified

NAME = "sample_files"
DOM, META, MANIFEST = ".dom", ".meta.json", "_manifest"
READ_SCHEMA = "folder string, stem string, path string, dom binary, has_meta boolean, url string, ts bigint, size bigint, label string"
WRITE_COLUMNS = ("folder", "stem", "dom", "url", "ts", "size", "label")
FILES_PER_PARTITION, BYTES_PER_PARTITION = 2000, 32 << 20
BATCH_FILES, BATCH_BYTES = 500, 8 << 20


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return fs.LocalFileSystem(), path


@dataclass
class Files(InputPartition):
    """(folder, stem, path, size, whether there is metadata) of the files one task reads."""

    root: str
    files: list[tuple[str, str, str, int, bool]]


class SampleFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.folders = [f for f in options.get("folders", "").split(",") if f] or [""]

    def partitions(self) -> list[InputPartition]:
        system, root = _system(self.root)
        found = []
        for folder in self.folders:
            at = posixpath.join(root, folder) if folder else root
            infos = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
            metas = {i.path[: -len(META)] for i in infos if i.is_file and i.path.endswith(META)}
            found += [(folder, posixpath.basename(i.path)[: -len(DOM)], i.path, i.size, i.path[: -len(DOM)] in metas)
                      for i in infos if i.is_file and i.path.endswith(DOM)]
        parts, now, size = [], [], 0
        for file in sorted(found):
            if now and (len(now) >= FILES_PER_PARTITION or size + file[3] > BYTES_PER_PARTITION):
                parts.append(Files(self.root, now))
                now, size = [], 0
            now.append(file)
            size += file[3]
        return [*parts, *([Files(self.root, now)] if now else [])] or [Files(self.root, [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(partition.root)
        schema = pa.schema([("folder", pa.string()), ("stem", pa.string()), ("path", pa.string()), ("dom", pa.binary()), ("has_meta", pa.bool_()),
                            ("url", pa.string()), ("ts", pa.int64()), ("size", pa.int64()), ("label", pa.string())])
        rows, held = [], 0
        for folder, stem, path, size, has_meta in partition.files:
            meta = self._meta(system, path[: -len(DOM)] + META) if has_meta else None
            rows.append({"folder": folder, "stem": stem, "path": path, "dom": self._content(system, path),
                         "has_meta": meta is not None, **(meta or {})})
            held += size
            if len(rows) >= BATCH_FILES or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    @staticmethod
    def _content(system: fs.FileSystem, path: str) -> bytes:
        with system.open_input_stream(path) as f:
            return f.read()

    def _meta(self, system: fs.FileSystem, path: str) -> dict | None:
        """None for a file that is no JSON object, as for a missing one; values of another type become null."""
        try:
            meta = json.loads(self._content(system, path))
        except ValueError:
            return None
        if not isinstance(meta, dict):
            return None
        kinds = {"url": str, "ts": int, "size": int, "label": str}
        return {k: meta[k] if isinstance(meta.get(k), kind) and not isinstance(meta.get(k), bool) else None for k, kind in kinds.items()}


@dataclass
class Written(WriterCommitMessage):
    """Where a task left its files, and their manifest lines (folder, stem, label)."""

    temporary: str
    files: list[tuple[str, str, str | None]]


class SampleFilesWriter(DataSourceWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        missing = [c for c in ("stem", "dom") if c not in schema.names]
        if missing:
            raise ValueError(f"sample files need the columns {missing}")
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def _temporary(self, root: str) -> str:
        return posixpath.join(root, "_temporary", self.job)

    def write(self, rows) -> WriterCommitMessage:
        system, root = _system(self.root)
        context = TaskContext.get()
        task = f"{context.partitionId()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        here, files, made = posixpath.join(self._temporary(root), task), [], set()
        for row in rows:
            row = row.asDict()
            folder = row.get("folder") or ""
            at = posixpath.join(here, folder)
            if at not in made:
                system.create_dir(at)
                made.add(at)
            with system.open_output_stream(posixpath.join(at, row["stem"] + DOM)) as f:
                f.write(bytes(row["dom"] or b""))
            meta = {c: row.get(c) for c in ("url", "ts", "size", "label")}
            if any(v is not None for v in meta.values()):
                with system.open_output_stream(posixpath.join(at, row["stem"] + META)) as f:
                    f.write(json.dumps(meta).encode())
                files.append((folder, row["stem"], meta["label"]))
            else:
                files.append((folder, row["stem"], None))
        return Written(here, files)

    def commit(self, messages: list[Written | None]) -> None:
        """Move every task's files into place; the manifest's names tell the job, so appending jobs add to it."""
        system, root = _system(self.root)
        if self.overwrite:
            self._clear(system, root)
        made, lines = set(), 0
        for message in messages:
            if message is None or not message.files:
                continue
            for folder in sorted({f for f, _, _ in message.files}):
                at = posixpath.join(root, folder)
                if at not in made:
                    system.create_dir(at)
                    made.add(at)
            for info in system.get_file_info(fs.FileSelector(message.temporary, recursive=True)):
                if info.is_file:
                    system.move(info.path, posixpath.join(root, posixpath.relpath(info.path, message.temporary)))
            # one manifest file for each task
            system.create_dir(posixpath.join(root, MANIFEST))
            with system.open_output_stream(posixpath.join(root, MANIFEST, f"{self.job}-{lines}.json")) as f:
                for folder, stem, label in sorted(message.files, key=lambda x: x[:2]):
                    name = posixpath.join(folder, stem)
                    f.write((json.dumps({"dom": name + DOM, "meta": name + META, "label": label or "unknown"}) + "\n").encode())
            lines += 1
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what is left of this job's tasks."""
        system, root = _system(self.root)
        at = self._temporary(root)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)
        above = posixpath.join(root, "_temporary")
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)

    @staticmethod
    def _clear(system: fs.FileSystem, root: str) -> None:
        """Remove the samples and manifests that were there; files of other kinds stay."""
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            inside = posixpath.relpath(info.path, root)
            if info.is_file and not inside.startswith("_temporary/") and (
                    info.path.endswith((DOM, META)) or inside.startswith(MANIFEST + "/")):
                system.delete_file(info.path)


class SampleFiles(DataSource):
    """``spark.read.format("sample_files").option("path", root).option("folders", "phishing,legit")``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SampleFilesReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SampleFilesWriter(self.options, schema, overwrite)


def read_sample_files(spark: SparkSession, root: str, folders: list[str] | None = None) -> DataFrame:
    """One row for each ``.dom`` file of ``root`` or its ``folders``; a missing folder has none."""
    spark.dataSource.register(SampleFiles)
    reader = spark.read.format(NAME).option("path", qualified(spark, root))
    return (reader.option("folders", ",".join(folders)) if folders else reader).load()


def write_sample_files(samples: DataFrame, root: str, mode: str = "append") -> None:
    """K1/K2/K6 as files: ``<folder>/<stem>.dom`` with its metadata beside it, and ``_manifest``.

    ``samples(stem, dom)`` and, if there, folder, url, ts, size and label. A sample whose metadata
    are all missing gets none. Stems must be unique within a folder."""
    spark = samples.sparkSession
    spark.dataSource.register(SampleFiles)
    columns = [c for c in WRITE_COLUMNS if c in samples.columns]
    samples.select(*columns).write.format(NAME).option("path", qualified(spark, root)).mode(mode).save()


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """K6: (dom, meta, label) of all samples written under ``root``."""
    return spark.read.schema("dom string, meta string, label string").json(f"{root}/{MANIFEST}")
