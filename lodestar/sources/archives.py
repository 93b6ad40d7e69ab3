"""Named texts in ZIP archives or folders, as a data source (SRC-04): ``spark.read.format("named_texts")``.

Each member of an archive, and each file, is a partition of its own: the driver reads the archives' directories only, and
a task streams its member, record by record. Paths go through Arrow's file systems, so archives lie in a store that
those reach, or in a mounted folder.
"""

from __future__ import annotations

import io
import itertools
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RECORDS = "archive string, member string, position long, record string"
#: Characters that are decoded at once, and records of a batch.
PART, BATCH = 1 << 20, 1000
BLANK = re.compile(r"[ \t\r\n]*")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    system, inside = fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)
    return system, inside.rstrip("/")


def elements(text: io.TextIOBase, part: int = PART) -> Iterator[str]:
    """The elements of a JSON array, each as the text that it is; another JSON value is one element.

    Only the part that holds the next element is in memory. A text that ends within an element is an error."""
    decode = json.JSONDecoder().raw_decode
    held, at, size, closed = text.read(part), 0, part, False

    def more() -> bool:
        nonlocal held, at, size
        got = text.read(size)
        if got:
            held, at, size = held[at:] + got, 0, size * 2  # so that a long element is decoded a few times only
        return bool(got)

    def blank() -> None:
        nonlocal at
        at = BLANK.match(held, at).end()
        while at == len(held) and more():
            at = BLANK.match(held, at).end()

    blank()
    if at == len(held):
        return
    array = held[at] == "["
    at += array
    while not closed:
        blank()
        if array and held[at : at + 1] == "]":
            return
        while True:
            try:
                end = decode(held, at)[1]
                after = BLANK.match(held, end).end()
                if held[after : after + 1] in (",", "]") or not more():  # else a number may go on
                    break
            except json.JSONDecodeError:
                if not more():
                    raise
        size = part
        yield held[at:end]
        at = after
        closed = not array or held[at : at + 1] != ","
        at += 1
    if array and held[at - 1 : at] != "]":
        raise ValueError("a JSON array without its end")


@dataclass
class Member(InputPartition):
    path: str
    #: None where the path is itself a text.
    name: str | None

    def __post_init__(self) -> None:
        self.value = self.path  # what Spark logs


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.prefixes = tuple(p.strip().lower() for p in options.get("prefixes", "").split(","))
        self.suffix = options.get("suffix", ".json").lower()

    def wanted(self, name: str) -> bool:
        base = name.rpartition("/")[2].lower()
        return base.startswith(self.prefixes) and base.endswith(self.suffix)

    def partitions(self) -> list[InputPartition]:
        system, folder = opened(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File:
                continue
            if info.path.lower().endswith(".zip"):
                with zipfile.ZipFile(system.open_input_file(info.path)) as archive:
                    found += [Member(info.path, name) for name in archive.namelist() if self.wanted(name)]
            elif self.wanted(info.path):
                found.append(Member(info.path, None))
        return sorted(found, key=lambda m: (m.path, m.name or "")) or [Member("", None)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as file:
            raw = file if partition.name is None else zipfile.ZipFile(file).open(partition.name)
            records: list[str] = []
            start = 0
            for record in elements(io.TextIOWrapper(raw, "utf-8-sig")):
                records.append(record)
                if len(records) == BATCH:
                    yield self.batch(partition, start, records)
                    start, records = start + BATCH, []
            if records:
                yield self.batch(partition, start, records)

    def batch(self, partition: Member, start: int, records: list[str]) -> pa.RecordBatch:
        n = len(records)
        name = partition.name or partition.path.rpartition("/")[2]
        columns = [pa.array([partition.path] * n), pa.array([name] * n), pa.array(range(start, start + n), pa.int64()), pa.array(records, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["archive", "member", "position", "record"])


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class TextWriter(DataSourceWriter):
    """One archive for each partition, or each row as a file; files get their names when the whole write commits."""

    def __init__(self, options: dict[str, str]):
        self.path, self.packed, self.run = options["path"], options.get("packed", "true") == "true", uuid.uuid4().hex[:12]

    def write(self, iterator) -> Written:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        task, paths = uuid.uuid4().hex[:12], []
        if not self.packed:
            for row in iterator:
                paths.append(f"{folder}/{row['name']}")
                with system.open_output_stream(f"{paths[-1]}.{self.run}") as out:
                    out.write(row["text"].encode())
            return Written(paths)
        first = next(iterator, None)
        if first is not None:
            paths.append(f"{folder}/{task}.zip")
            with system.open_output_stream(f"{paths[0]}.{self.run}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                for row in itertools.chain([first], iterator):
                    archive.writestr(row["name"], row["text"])
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for message in messages:
            for path in message.paths if message else ():
                system.move(f"{path}.{self.run}", path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for message in messages:
            for path in message.paths if message else ():
                system.delete_file(f"{path}.{self.run}")


class NamedTexts(DataSource):
    """Options: ``path`` (a folder); reading: ``prefixes`` (of names, separated by commas, whatever their case), ``suffix``;
    writing: ``packed``."""

    @classmethod
    def name(cls) -> str:
        return "named_texts"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return MemberReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TextWriter(self.options)


def archived_records(spark: SparkSession, path: str, prefixes: tuple[str, ...] = ("",), suffix: str = ".json") -> DataFrame:
    """Records of the JSON files in the archives and folders below ``path`` whose names begin so (SRC-04): archive, member,
    position and the record as text, for ``from_json``."""
    spark.dataSource.register(NamedTexts)
    return spark.read.format("named_texts").options(path=path, prefixes=",".join(prefixes), suffix=suffix).load()


def write_archives(texts: DataFrame, path: str, packed: bool = True) -> None:
    """``name`` and ``text`` of each row as a member of its partition's archive, or as a file."""
    texts.sparkSession.dataSource.register(NamedTexts)
    texts.select("name", "text").write.format("named_texts").options(path=path, packed=str(packed).lower()).mode("append").save()
