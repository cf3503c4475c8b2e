"""Files beside tables: range reads, writing and deleting by path, in tasks. Local paths, or any store that pyarrow knows."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

Opener = Callable[[str], BinaryIO]


def _local(path: str) -> str | None:
    found = urlparse(path)
    return unquote(found.path) if found.scheme == "file" else path if not found.scheme else None


def open_path(path: str) -> BinaryIO:
    """A file to read from any place in it."""
    if (local := _local(path)) is not None:
        return open(local, "rb")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class Ranged:
    """Slices of an open file as if it were bytes: only what is asked for is read."""

    def __init__(self, file: BinaryIO):
        self.file, self.size, self.read = file, file.seek(0, 2), 0
        self.size = file.tell()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.size)
        self.file.seek(a)
        out = self.file.read(max(b - a, 0))
        self.read += len(out)
        return out


def _put(folder: str, name: str, content: bytes) -> str:
    if (local := _local(folder)) is not None:
        os.makedirs(local, exist_ok=True)
        path = os.path.join(local, name)
        with open(f"{path}.part-{os.getpid()}", "wb") as f:
            f.write(content)
        os.replace(f.name, path)
        return path
    store, inner = fs.FileSystem.from_uri(folder)
    store.create_dir(inner)
    with store.open_output_stream(f"{inner}/{name}") as f:
        f.write(content)
    return f"{folder}/{name}"


def write_files(files: DataFrame, folder: str, name: str = "new_name", content: str = "content") -> DataFrame:
    """(name, path, n_bytes): each row's content as a file of the folder, written by the tasks. Lazy: files are written when
    rows are asked for; a task that runs again writes the same files again. Names must be plain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, c in zip(batch.column(name).to_pylist(), batch.column(content)):
                if not n or "/" in n or n in (".", ".."):
                    raise ValueError(f"not a file name: {n!r}")
                data = c.as_py()
                rows.append((n, _put(folder, n, data), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[], [], []], (pa.string(), pa.string(), pa.int64()))], ["name", "path", "n_bytes"])

    return files.select(name, content).mapInArrow(run, "name string, path string, n_bytes long")


def delete_files(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, deleted): deletes files by path, lazily and in tasks; those that are gone already count as not deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, done = batch.column(column).to_pylist(), []
            for path in names:
                try:
                    if (local := _local(path)) is not None:
                        os.remove(local)
                    else:
                        store, inner = fs.FileSystem.from_uri(path)
                        store.delete_file(inner)
                    done.append(True)
                except FileNotFoundError:
                    done.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(done, pa.bool_())], ["path", "deleted"])

    return paths.select(column).mapInArrow(run, "path string, deleted boolean")
