"""Protobuf wire format: the few message shapes of the interchange index, read and written without generated code."""

from __future__ import annotations

from collections.abc import Iterator


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a varint is too long")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) pairs; length-delimited values as bytes, fixed ones as bytes too."""
    at = 0
    while at < len(raw):
        tag, at = read_varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = read_varint(raw, at)
        else:
            size, at = read_varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
            if len(value) != size:
                raise ValueError("the message is cut off")
        yield tag >> 3, value


def number(field: int, value: int) -> bytes:
    return varint(field << 3) + varint(value) if value else b""


def block(field: int, value: bytes | str) -> bytes:
    raw = value.encode() if isinstance(value, str) else value
    return varint(field << 3 | 2) + varint(len(raw)) + raw


def packed(field: int, values: list[int]) -> bytes:
    return block(field, b"".join(map(varint, values)))


def unpacked(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = read_varint(value, at)
        out.append(n)
    return out
