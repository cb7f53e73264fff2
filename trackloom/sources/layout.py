"""The project file's binary script layout, as one table of fields that both writes and reads."""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np

# A size takes 1, 2 or 4 bytes, told by its two top bits; below each limit its width and those bits.
SIZES = [(1 << 7, 1, 0x00), (1 << 14, 2, 0x80), (1 << 30, 4, 0xC0)]


class Field(NamedTuple):
    """Bytes of a value, and the value that begins at a place with where it ends."""

    write: Callable[[Any], bytes]
    read: Callable[[bytes, int], tuple[Any, int]]


def size_bytes(n: int) -> bytes:
    """A size: its high bytes first, but for the last two of four, which stand low byte first."""
    for limit, width, mark in SIZES:
        if n < limit:
            raw = bytearray(n.to_bytes(width, "big"))
            raw[0] |= mark
            return bytes(raw[:2] + raw[2:][::-1])
    raise ValueError(f"size {n} is too large")


def read_size(data: bytes, at: int) -> tuple[int, int]:
    top = _cut(data, at, 1)[0] >> 6
    limit, width, _ = SIZES[max(0, top - 1)]
    raw = _cut(data, at, width)
    return int.from_bytes(raw[:2] + raw[2:][::-1], "big") & (limit - 1), at + width


def _cut(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ValueError(f"{n} bytes at {at} overrun the data")
    return data[at : at + n]


def number(kind: str) -> Field:
    form = struct.Struct(f"<{kind}")
    return Field(form.pack, lambda data, at: (form.unpack(_cut(data, at, form.size))[0], at + form.size))


def record(*fields: Field) -> Field:
    def read(data: bytes, at: int) -> tuple[tuple, int]:
        values = []
        for field in fields:
            value, at = field.read(data, at)
            values.append(value)
        return tuple(values), at

    return Field(lambda values: b"".join(f.write(v) for f, v in zip(fields, values, strict=True)), read)


def listed(of: Field) -> Field:
    def read(data: bytes, at: int) -> tuple[list, int]:
        count, at = SIZE.read(data, at)
        values = []
        for _ in range(count):
            value, at = of.read(data, at)
            values.append(value)
        return values, at

    return Field(lambda values: SIZE.write(len(values)) + b"".join(map(of.write, values)), read)


def block(of: Field) -> Field:
    """A length that counts itself, then the content, which may end before it but not behind."""

    def write(value: Any) -> bytes:
        body = of.write(value)
        return LENGTH.write(len(body) + 4) + body

    def read(data: bytes, at: int) -> tuple[Any, int]:
        size, start = LENGTH.read(data, at)
        body = _cut(data, at, size)
        return of.read(body, start - at)[0], at + size

    return Field(write, read)


def _raw_block(data: bytes, at: int) -> tuple[bytes, int]:
    size = LENGTH.read(data, at)[0]
    if size < 4:
        raise ValueError("a block is shorter than its length")
    return _cut(data, at, size), at + size


def _numbered(data: bytes, at: int) -> tuple[int, int]:
    value, at = SIZE.read(data, at)
    if not value:
        raise ValueError("a script's number is 0")
    return value, at


LENGTH, SIZE = number("I"), Field(size_bytes, read_size)
TEXT = Field(lambda text: SIZE.write(len(raw := text.encode())) + raw, lambda data, at: (lambda n, start: (_cut(data, start, n).decode(), start + n))(*SIZE.read(data, at)))
#: seconds, position, and two bytes that are 0
ACTION = block(record(number("f"), number("h"), number("B"), number("B")))
#: actions, relative path, title, whether it is enabled
SCRIPT = block(record(listed(ACTION), TEXT, TEXT, number("B")))
#: scripts as they are, numbered from 1
PROJECT = block(listed(record(Field(size_bytes, _numbered), Field(bytes, _raw_block))))


def encode_script(rows: list[tuple[float, int]], path: str = "", title: str = "") -> bytes:
    return SCRIPT.write(([(t, p, 0, 0) for t, p in rows], path, title, 1))


def decode_script(data: bytes) -> tuple[list[tuple[float, int]], str, str]:
    """Actions, path and title; a script that ends early or overruns is an error."""
    actions, path, title, _ = SCRIPT.read(data, 0)[0]
    return [(t, p) for t, p, _, _ in actions], path, title


#: ACTION as numbers: its length, seconds, position, and two bytes that are 0
ACTIONS = np.dtype([("size", "<u4"), ("s", "<f4"), ("pos", "<i2"), ("zero", "<u2")])


def encode_actions(seconds: np.ndarray, pos: np.ndarray, path: str = "", title: str = "") -> bytes:
    """encode_script of whole columns; positions fit two bytes."""
    rows = np.zeros(len(seconds), ACTIONS)
    rows["size"], rows["s"], rows["pos"] = ACTIONS.itemsize, seconds, pos
    tail = record(TEXT, TEXT, number("B")).write((path, title, 1))
    head = SIZE.write(len(rows))
    return b"".join([LENGTH.write(4 + len(head) + rows.nbytes + len(tail)), head, rows.data, tail])


def decode_actions(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Seconds and positions of decode_script as columns; a script whose actions are not all of the usual length is read one by one."""
    size, start = LENGTH.read(data, 0)
    _cut(data, 0, size)
    count, at = SIZE.read(data, start)
    end = at + count * ACTIONS.itemsize
    if end <= size:
        rows = np.frombuffer(data, ACTIONS, count, at)
        if (rows["size"] == ACTIONS.itemsize).all():
            record(TEXT, TEXT, number("B")).read(data[end:size], 0)
            return rows["s"], rows["pos"]
    rows = decode_script(data)[0]
    return np.array([t for t, _ in rows], np.float32), np.array([p for _, p in rows], np.int16)


def encode_project(scripts: list[bytes]) -> bytes:
    return PROJECT.write(list(enumerate(scripts, 1))) if scripts else b""


def decode_project(data: bytes) -> list[bytes]:
    return [raw for _, raw in PROJECT.read(data, 0)[0]] if data else []
