"""CBOR files as a Spark data source: nested items come as JSON text (for `parse_json` to make variants of) and are written from it.

A byte string is the object {"$bytes": base64}; other keys that begin with "$" have one more "$" in front. Numbers that
JSON lacks are {"$float": "nan"}, "inf" or "-inf". A file that can't be read as one item gives a row with an error
instead of an item. Options: `path` (a file or folder, by any file system that Arrow knows), `suffix` of the files in a
folder, `files_per_task`.
"""

from __future__ import annotations

import base64
import json
import math
import struct
import uuid
from collections.abc import Iterator
from functools import singledispatch
from typing import Any

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, item string, error string"
#: nested items within one another
DEPTH = 200


def _head(kind: int, n: int) -> bytes:
    """The kind in the top three bits, a small count below them, a larger one in the next 1, 2, 4 or 8 bytes."""
    if n < 24:
        return bytes([kind << 5 | n])
    width = next(w for w in range(4) if n < 1 << (8 << w))
    return bytes([kind << 5 | 24 + width]) + n.to_bytes(1 << width, "big")


@singledispatch
def encoded(value: Any) -> bytes:
    """One item; maps are in order of their keys, and a number with a fraction takes four bytes where these are exact."""
    raise TypeError(f"{type(value).__name__} is no CBOR item")


@encoded.register(type(None))
def _(value: None) -> bytes:
    return b"\xf6"


@encoded.register
def _(value: bool) -> bytes:
    return bytes([0xF4 + value])


@encoded.register
def _(value: int) -> bytes:
    return _head(0, value) if value >= 0 else _head(1, ~value)


@encoded.register
def _(value: float) -> bytes:
    try:
        four = struct.pack(">f", value)
    except OverflowError:
        four = None
    if four and (math.isnan(value) or struct.unpack(">f", four)[0] == value):
        return b"\xfa" + four
    return b"\xfb" + struct.pack(">d", value)


@encoded.register
def _(value: bytes) -> bytes:
    return _head(2, len(value)) + value


@encoded.register
def _(value: str) -> bytes:
    raw = value.encode()
    return _head(3, len(raw)) + raw


@encoded.register
def _(value: list) -> bytes:
    return _head(4, len(value)) + b"".join(map(encoded, value))


@encoded.register
def _(value: dict) -> bytes:
    return _head(5, len(value)) + b"".join(encoded(str(k)) + encoded(value[k]) for k in sorted(value))


class _Cursor:
    """Reads items one after the other; what ends early, is nested too deep or of unknown length is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.kinds = [lambda n, d: n, lambda n, d: ~n, lambda n, d: self.take(n), lambda n, d: self.take(n).decode(), self._list, self._map, lambda n, d: self.item(d)]

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError(f"{n} bytes at {self.at} overrun the data")
        self.at += n
        return self.data[self.at - n : self.at]

    def item(self, depth: int = 0) -> Any:
        if depth > DEPTH:
            raise ValueError("items are nested too deep")
        kind, info = divmod(self.take(1)[0], 32)
        if kind == 7:
            return self._simple(info)
        if info > 27:
            raise ValueError("an item of unknown length")
        n = info if info < 24 else int.from_bytes(self.take(1 << info - 24), "big")
        return self.kinds[kind](n, depth + 1)

    def _simple(self, info: int) -> Any:
        known = {20: False, 21: True, 22: None, 23: None}
        if info in known:
            return known[info]
        form = {25: ">e", 26: ">f", 27: ">d"}.get(info)
        if form is None:
            raise ValueError(f"simple value {info} isn't known")
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def _list(self, n: int, depth: int) -> list:
        if n > len(self.data) - self.at:
            raise ValueError("a list is longer than the data")
        return [self.item(depth) for _ in range(n)]

    def _map(self, n: int, depth: int) -> dict:
        if n > len(self.data) - self.at:
            raise ValueError("a map is longer than the data")
        return {self._key(depth): self.item(depth) for _ in range(n)}

    def _key(self, depth: int) -> str:
        key = self.item(depth)
        if not isinstance(key, str):
            raise ValueError("a key isn't text")
        return key


def decoded(data: bytes) -> Any:
    cursor = _Cursor(data)
    value = cursor.item()
    if cursor.at != len(data):
        raise ValueError(f"{len(data) - cursor.at} bytes behind the item")
    return value


def _plain(value: Any) -> Any:
    if isinstance(value, bytes):
        return {"$bytes": base64.b64encode(value).decode()}
    if isinstance(value, float) and not math.isfinite(value):
        return {"$float": repr(value)}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {("$" + k if k.startswith("$") else k): _plain(v) for k, v in value.items()}
    return value


def _whole(value: Any) -> Any:
    if isinstance(value, list):
        return [_whole(v) for v in value]
    if isinstance(value, dict):
        if len(value) == 1 and "$bytes" in value:
            return base64.b64decode(value["$bytes"], validate=True)
        if len(value) == 1 and "$float" in value:
            return float(value["$float"])
        return {(k[1:] if k.startswith("$") else k): _whole(v) for k, v in value.items()}
    return value


def as_json(data: bytes) -> str:
    return json.dumps(_plain(decoded(data)), ensure_ascii=False, sort_keys=True)


def from_json(text: str) -> bytes:
    return encoded(_whole(json.loads(text)))


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.many = options["path"], options.get("suffix", ""), int(options.get("files_per_task", 64))

    def partitions(self) -> list[_Part]:
        system, path = _opened(self.path)
        root = system.get_file_info(path)
        if root.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [path] if root.type == fs.FileType.File else sorted(i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(self.suffix) and not i.base_name.startswith(("_", ".")))
        return [_Part(found[i : i + self.many]) for i in range(0, len(found), self.many)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        for path in partition.paths:
            try:
                with system.open_input_stream(path) as f:
                    yield path, as_json(f.read()), None
            except (ValueError, RecursionError) as e:
                yield path, None, f"{type(e).__name__}: {e}"


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


class _Writer(DataSourceWriter):
    """A file a row (path within the folder, item). Tasks write under other names; the commit gives the files theirs."""

    def __init__(self, options: dict, schema: StructType):
        if not {"path", "item"} <= set(schema.fieldNames()):
            raise ValueError("rows to write need path and item")
        self.folder = options["path"].rstrip("/")

    def write(self, rows: Iterator) -> _Written:
        system, folder = _opened(self.folder)
        made = []
        for row in rows:
            name = row["path"].lstrip("/")
            if not name or ".." in name.split("/"):
                raise ValueError(f"{row['path']!r} is no path within the folder")
            target, part = f"{folder}/{name}", f"{folder}/_part-{uuid.uuid4().hex}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(part) as f:
                f.write(from_json(row["item"]))
            made.append((part, target))
        return _Written(made)

    def commit(self, messages: list) -> None:
        system, _ = _opened(self.folder)
        for part, target in (p for m in messages if m for p in m.paths):
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            system.move(part, target)

    def abort(self, messages: list) -> None:
        system, _ = _opened(self.folder)
        for part, _ in (p for m in messages if m for p in m.paths):
            system.delete_file(part)


class CborSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cbor"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CborSource)
