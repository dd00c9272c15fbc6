"""Reports as files that appear as a whole or not at all: a Python data source, to write and to read.

A report is a header and lines in order. Each task writes its range of lines to a file of its own, under a
name that no other attempt has; the driver then writes one manifest that lists the files of the tasks that
counted, in order, with their numbers of lines. A reader goes by the manifest alone, so that a write that
failed or was ended leaves nothing to see, and a report that is written anew replaces the old one at once.
Paths may be of any store that Arrow reaches: local, HDFS, S3.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME, MANIFEST, SCHEMA = "quillmill_report", "manifest.json", "pos long, line string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path)


def _manifest(path: str) -> dict | None:
    store, root = _store(path)
    if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    lines: int


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.header = options["path"], json.loads(options.get("header", "[]"))
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Part:
        """One task's lines, the first column of its rows, in their order; a line break in a line becomes a space."""
        context = TaskContext.get()
        store, root = _store(self.path)
        file = f"run-{self.run}/part-{context.partitionId():05}-{context.taskAttemptId()}.txt"
        store.create_dir(f"{root}/run-{self.run}")
        n = 0
        with store.open_output_stream(f"{root}/{file}") as out:
            for row in iterator:
                out.write((" ".join((row[0] or "").splitlines()) + "\n").encode())
                n += 1
        return Part(context.partitionId(), file, n)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _store(self.path)
        before = _manifest(self.path)
        parts = [{"file": m.file, "lines": m.lines} for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition)]
        store.create_dir(root)
        with store.open_output_stream(f"{root}/{MANIFEST}.{self.run}") as out:
            out.write(json.dumps({"run": self.run, "header": self.header, "parts": parts}).encode())
        store.move(f"{root}/{MANIFEST}.{self.run}", f"{root}/{MANIFEST}")
        if before is not None:
            self._clear(store, f"{root}/run-{before['run']}")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = _store(self.path)
        self._clear(store, f"{root}/run-{self.run}")

    @staticmethod
    def _clear(store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


@dataclass
class Piece(InputPartition):
    """A file and the place of its first line in the report, or the header's lines."""

    first: int
    file: str | None
    lines: list[str]


class ReportReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[Piece]:
        manifest = _manifest(self.path)
        if manifest is None:
            raise FileNotFoundError(f"there is no whole report in {self.path}")
        out, at = [Piece(0, None, manifest["header"])], len(manifest["header"])
        for p in manifest["parts"]:
            out.append(Piece(at, p["file"], []))
            at += p["lines"]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        if partition.file is None:
            yield from enumerate(partition.lines)
            return
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as f:
            for n, line in enumerate(io.BufferedReader(f), partition.first):
                yield n, line.decode().removesuffix("\n")


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options)

    def reader(self, schema) -> ReportReader:
        return ReportReader(self.options)


def write_report(report: DataFrame, header: list[str], path: str, parts: int | None = None) -> None:
    """The report (entity, sentiment, count) by entity downwards and sentiment, as lines below the header; ranges of lines are written by as many tasks as parts, or as a shuffle has."""
    report.sparkSession.dataSource.register(ReportSource)
    order = [F.desc("entity"), F.col("sentiment")]
    ranged = (report.repartitionByRange(parts, *order) if parts else report.repartitionByRange(*order)).sortWithinPartitions(*order)
    lines = ranged.select(F.concat_ws("|", "entity", "sentiment", F.col("count").cast("string")).alias("line"))
    lines.write.format(NAME).mode("overwrite").option("path", path).option("header", json.dumps(header)).save()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """pos (from 0) and line of a report that was written whole."""
    spark.dataSource.register(ReportSource)
    return spark.read.format(NAME).option("path", path).load()
