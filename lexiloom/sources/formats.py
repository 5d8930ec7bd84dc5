"""Corpus formats as data sources of Spark: spark.read.format("slashed_corpus") and format("inline_corpus"), after register.

A row is a document: doc_id, text, its annotations, and the reason if it could not be read, which never ends the job. Files
are listed once and dealt into partitions by size; each is read by the task that needs it, from any file system that
Arrow can open. A schema given to the reader prunes columns: annotations are not made if rows are not asked for.

Options: path, a folder; suffix, of the files' names (.txt or .xml by default); id, "name" for documents that are called as
their files are, "folder" where they lie in folders column=value, as a writer that parts by a column leaves them, or "record"
where a file holds many, each a line of JSON with doc_id and text; such files are cut into ranges of bytes, too.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexiloom.sources.corpora import ROWS, inline_article

SCHEMA = f"doc_id string, text string, rows {ROWS}, reason string"
#: Bytes of files in a partition, about.
PARTITION_BYTES = 4 << 20


def slashed_document(text: str, with_rows: bool = True) -> tuple[str | None, list[dict] | None, str | None]:
    """Text, annotations and reason of a file with a sentence to a line and word/tag items; an item without a tag is the reason."""
    lines, rows, at = [], [], 0
    for number, line in enumerate(filter(str.strip, text.split("\n")), 1):
        words, start = [], at
        for item in line.split():
            word, slash, tag = item.partition("/")
            if not slash or not word:
                return None, None, f"ValueError: line {number} holds {item[:40]!r}, which is no word/tag"
            if with_rows:
                rows.append({"kind": "token", "start": at, "end": at + len(word), "pos": tag.split("/")[0].upper(), "spans": None, "label": None})
            words.append(word)
            at += len(word) + 1
        lines.append(" ".join(words))
        if with_rows:
            rows.append({"kind": "sentence", "start": start, "end": at - 1, "pos": None, "spans": None, "label": None})
    return "\n".join(lines), rows if with_rows else None, None


class Files(InputPartition):
    """Files by name with the first byte and the one after the last."""

    def __init__(self, names: list[tuple[str, int, int]]):
        super().__init__(names)


class CorpusReader(DataSourceReader):
    def __init__(self, read, names: list[str], path: str, suffix: str, by_folder: bool, by_record: bool = False):
        self.read_document, self.names, self.path, self.suffix, self.by_folder, self.by_record = read, names, path, suffix, by_folder, by_record

    def doc_id(self, path: str) -> str:
        *_, folder, name = path.split("/")
        return unquote(folder.partition("=")[2]) if self.by_folder else name.removesuffix(self.suffix)

    def partitions(self) -> list[Files]:
        system, root = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        found = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        parts: list[list[tuple[str, int, int]]] = []
        held = PARTITION_BYTES
        for info in sorted((f for f in found if f.is_file and f.path.endswith(self.suffix)), key=lambda f: f.path):
            step = PARTITION_BYTES if self.by_record else max(1, info.size)
            for start in range(0, max(1, info.size), step):
                if held >= PARTITION_BYTES:
                    parts.append([])
                    held = 0
                end = min(info.size, start + step)
                parts[-1].append((info.path, start, end))
                held += end - start
        return [Files(p) for p in parts]

    def documents(self, system: pyarrow.fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[str | None, str | None, str | None]]:
        """(doc_id, text, reason) of a file, or of the records that begin in a range of its bytes."""
        if not self.by_record:
            with system.open_input_stream(path) as file:
                yield self.doc_id(path), file.read().decode("utf-8"), None
            return
        with system.open_input_file(path) as opened, io.BufferedReader(opened, 1 << 20) as file:
            if start:  # a record that begins before belongs to the range before
                file.seek(start - 1)
                start += len(file.readline()) - 1
            while start < end and (line := file.readline()):
                start += len(line)
                try:
                    record = json.loads(line)
                    yield record["doc_id"], record["text"], None
                except (ValueError, KeyError, TypeError) as bad:
                    yield None, None, f"{type(bad).__name__}: {bad}"

    def row(self, doc_id: str | None, text: str | None, reason: str | None) -> tuple:
        row = {"doc_id": doc_id, "text": None, "rows": None, "reason": reason}
        if reason is None:
            row["text"], row["rows"], row["reason"] = self.read_document(text or "", "rows" in self.names)
        if row["rows"] is not None:  # structs are tuples in the order of their fields
            row["rows"] = [(r["kind"], r["start"], r["end"], r["pos"], [(s["start"], s["end"]) for s in r["spans"]] if r["spans"] else None, r["label"]) for r in row["rows"]]
        return tuple(row[n] for n in self.names)

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        for path, start, end in partition.value:
            try:
                for found in self.documents(system, path, start, end):
                    yield self.row(*found)
            except (OSError, UnicodeDecodeError) as bad:
                yield self.row(None if self.by_record else self.doc_id(path), None, f"{type(bad).__name__}: {bad}")


class SlashedSource(DataSource):
    """Files with a sentence to a line and word/tag items."""

    suffix = ".txt"

    @classmethod
    def name(cls) -> str:
        return "slashed_corpus"

    def schema(self) -> str:
        return SCHEMA

    @staticmethod
    def document(text: str, with_rows: bool):
        return slashed_document(text, with_rows)

    def reader(self, schema) -> CorpusReader:
        unknown = set(schema.names) - {"doc_id", "text", "rows", "reason"}
        if unknown:
            raise ValueError(f"a corpus has no columns {sorted(unknown)}")
        by = self.options.get("id", "name")
        return CorpusReader(self.document, list(schema.names), self.options["path"], self.options.get("suffix", self.suffix), by == "folder", by == "record")


class InlineSource(SlashedSource):
    """XML articles whose sentences hold words and nested concepts."""

    suffix = ".xml"

    @classmethod
    def name(cls) -> str:
        return "inline_corpus"

    @staticmethod
    def document(text: str, with_rows: bool):
        body, rows, reason = inline_article(text)
        return body, rows if with_rows else None, reason


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session by their names."""
    for source in (SlashedSource, InlineSource):
        spark.dataSource.register(source)
