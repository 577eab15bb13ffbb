"""Folders of text files, one a document: a Spark data source whose tasks name, write, list and read the files."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: A batch of files is handed to Spark when it holds this many bytes or files.
BATCH_BYTES, BATCH_FILES = 16 << 20, 2000


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "/", path)).rstrip("/") or "/")


def language_of(name: str, known: list[str]) -> str:
    """The first known code that stands in a file name as ``_code_`` or ``_code.``, else "unknown"."""
    return next((code for code in known if f"_{code}_" in name or f"_{code}." in name), "unknown")


@dataclass
class Entries(InputPartition):
    """What one task reads: (path, is a folder), each from the first level of the root."""

    value: list[tuple[str, bool]]


class TextFiles(DataSource):
    """``spark.read.format("text_files").load(root)`` gives (path, file_name, source_language, text), and writing takes (file_name, content).

    Reading: only the root's first level is listed by the driver; its folders are dealt to at most ``partitions`` tasks, which list and read them. A file is opened
    only if its name ends in ``suffix``, isn't hidden or in ``excluded`` and is of one of ``languages`` (JSON lists; codes are looked for among ``known``). Bytes that aren't
    UTF-8 become U+FFFD.

    Writing: a file goes to one of ``buckets`` folders by a hash of its name. It is written under a hidden name and then moved, so that a reader sees
    whole files only and a task that runs twice leaves the same files. A null name writes nothing, a null content an empty file; a name that isn't one raises an error.
    """

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "path string, file_name string, source_language string, text string"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("text_files only appends; clear the folder first")
        return Writer(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.most = int(options.get("partitions", "64"))
        self.suffix = options.get("suffix", ".md")
        self.excluded, self.languages, self.known = (json.loads(options.get(name, "null")) for name in ("excluded", "languages", "known"))

    def partitions(self) -> list[Entries]:
        where, root = located(self.root)
        found = sorted((i.path, i.type == fs.FileType.Directory) for i in where.get_file_info(fs.FileSelector(root)))
        n = max(1, min(self.most, len(found)))
        return [Entries(found[i::n]) for i in range(n)]

    def wanted(self, name: str) -> bool:
        if not name.endswith(self.suffix) or name.startswith((".", "_")) or name in (self.excluded or ()):
            return False
        return self.languages is None or language_of(name, self.known or []) in self.languages

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        where, root = located(self.root)
        rows, held = [], 0
        for path, is_folder in partition.value:
            files = where.get_file_info(fs.FileSelector(path, recursive=True)) if is_folder else [where.get_file_info(path)]
            for file in files:
                if file.type != fs.FileType.File or not self.wanted(file.base_name):
                    continue
                with where.open_input_file(file.path) as stream:
                    text = stream.read()
                rows.append((self.root + file.path[len(root) :], file.base_name, language_of(file.base_name, self.known or []), text.decode("utf-8", "replace")))
                held += len(text)
                if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple[str, str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "file_name", "source_language", "text"])


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.buckets = options["path"].rstrip("/"), int(options.get("buckets", "64"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, root = located(self.root)
        made: set[str] = set()
        for batch in iterator:
            for name, content in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file_name", "content"))):
                if name is None:
                    continue
                if "/" in name or "\0" in name or name.startswith(".") or not name:
                    raise ValueError(f"not a file name: {name!r}")
                folder = f"{root}/{zlib.crc32(name.encode()) % self.buckets:04x}"
                if folder not in made:
                    where.create_dir(folder)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as stream:
                    stream.write((content or "").encode())
                where.move(part, f"{folder}/{name}")
        return WriterCommitMessage()
