"""A data source for source trees: files are chosen by name and planned by size while they are
listed, and a file is read on only if its head holds no NUL byte."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes looked at to tell a binary file.
HEAD_BYTES = 8192
#: Listed bytes of a partition; a larger file makes a partition of its own.
PART_BYTES = 128 << 20
#: A text must fit into one row.
MOST_BYTES = (1 << 31) - (1 << 20)
#: Text bytes of a batch.
BATCH_BYTES = 8 << 20


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(0)
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.wanted = re.compile(options["names"], re.IGNORECASE | re.ASCII)
        self.skipped = {name for name in options.get("skipped", "").split("\n") if name}
        self.part_bytes = int(options.get("partBytes", PART_BYTES))
        self.most_bytes = int(options.get("mostBytes", MOST_BYTES))

    def _listed(self) -> Iterator[tuple[str, int]]:
        """Path below the root and size of each wanted file; skipped folders are not entered."""
        store, top = fs.FileSystem.from_uri(self.root)
        top = top.rstrip("/")
        info = store.get_file_info(top)
        if info.type != fs.FileType.Directory:
            raise FileNotFoundError(self.root)
        waiting = [top]
        while waiting:
            for entry in store.get_file_info(fs.FileSelector(waiting.pop())):
                if entry.type == fs.FileType.Directory:
                    if entry.base_name not in self.skipped:
                        waiting.append(entry.path)
                elif entry.type == fs.FileType.File and self.wanted.search(entry.base_name):
                    yield entry.path[len(top) + 1 :], entry.size or 0

    def partitions(self) -> list[Files]:
        out, held, size = [], [], 0
        for path, length in sorted(self._listed()):
            if held and size + length > self.part_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append((path, length))
            size += length
        return [*out, Files(held)] if held else out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(self.root)
        paths, texts, size = [], [], 0
        for path, _ in partition.files:
            text = self._text(store, f"{top.rstrip('/')}/{path}")
            if text is None:
                continue
            paths.append(path)
            texts.append(text)
            size += len(text)
            if size >= BATCH_BYTES:
                yield self._batch(paths, texts)
                paths, texts, size = [], [], 0
        yield self._batch(paths, texts)

    def _text(self, store: fs.FileSystem, path: str) -> str | None:
        """The file's text, undecodable bytes replaced; none for a binary file."""
        with store.open_input_file(path) as file:
            head = file.read(HEAD_BYTES)
            if b"\0" in head:
                return None
            if file.size() > self.most_bytes:
                raise ValueError(f"{path} is a text of {file.size()} bytes, too long for a row")
            return (head + file.read()).decode("utf-8", "replace")

    @staticmethod
    def _batch(paths: list[str], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "text"])


class SourceTree(DataSource):
    """``path, text`` of the files below ``root`` whose names match ``names``.

    Options: ``root`` (a URI), ``names`` (a pattern for file names), ``skipped`` (folder
    names, one a line), ``partBytes``, ``mostBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def can_open(root: str) -> bool:
    """Whether tasks can open the store by themselves; some stores only Spark's readers reach."""
    try:
        fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, OSError):
        return False
    return True
