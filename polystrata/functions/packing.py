"""MessagePack and CBOR of JSON values, in Arrow batches."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_msgpack(v) -> bytes:
    """MessagePack of a JSON value; numbers take the shortest form that holds them, floats are double."""
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        if 0 <= v < 128:
            return bytes([v])
        if -32 <= v < 0:
            return struct.pack("b", v)
        for code, kind, lo, hi in ((0xCC, "B", 0, 1 << 8), (0xCD, "H", 0, 1 << 16), (0xCE, "I", 0, 1 << 32), (0xCF, "Q", 0, 1 << 64), (0xD0, "b", -(1 << 7), 0), (0xD1, "h", -(1 << 15), 0), (0xD2, "i", -(1 << 31), 0), (0xD3, "q", -(1 << 63), 0)):
            if lo <= v < hi:
                return bytes([code]) + struct.pack(">" + kind, v)
        raise ValueError(f"too large: {v}")
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode()
        return _sized(len(raw), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(v, list):
        return _sized(len(v), 0x90, 16, (None, 0xDC, 0xDD)) + b"".join(map(to_msgpack, v))
    return _sized(len(v), 0x80, 16, (None, 0xDE, 0xDF)) + b"".join(to_msgpack(k) + to_msgpack(x) for k, x in v.items())


def _sized(n: int, short: int, most: int, codes: tuple) -> bytes:
    if n < most:
        return bytes([short | n])
    for code, kind, top in zip(codes, "BHI", (1 << 8, 1 << 16, 1 << 32)):
        if code is not None and n < top:
            return bytes([code]) + struct.pack(">" + kind, n)
    raise ValueError(f"too long: {n}")


def from_msgpack(b: bytes):
    v, end = _msgpack(b, 0)
    if end != len(b):
        raise ValueError("bytes are left over")
    return v


def _msgpack(b: bytes, i: int):
    c = b[i]
    i += 1
    many = None
    if c < 0x80:
        return c, i
    if c >= 0xE0:
        return c - 256, i
    if c < 0xA0:
        kind, many = ("map", c & 15) if c < 0x90 else ("list", c & 15)
    elif c < 0xC0:
        kind, many = "str", c & 31
    elif c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], i
    elif c in _NUMBERS:
        f = _NUMBERS[c]
        return struct.unpack_from(f, b, i)[0], i + struct.calcsize(f)
    else:
        kind, f = _LONG[c]
        many = struct.unpack_from(f, b, i)[0]
        i += struct.calcsize(f)
    if kind == "str":
        return b[i : i + many].decode(), i + many
    out: list = []
    for _ in range(many * (2 if kind == "map" else 1)):
        x, i = _msgpack(b, i)
        out.append(x)
    return (out if kind == "list" else dict(zip(out[0::2], out[1::2]))), i


_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LONG = {0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}


def to_cbor(v) -> bytes:
    """CBOR (RFC 8949) of a JSON value, in definite lengths."""
    if v is None or isinstance(v, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[v]
    if isinstance(v, int):
        return _head(0, v) if v >= 0 else _head(1, -1 - v)
    if isinstance(v, float):
        return b"\xfb" + struct.pack(">d", v)
    if isinstance(v, str):
        raw = v.encode()
        return _head(3, len(raw)) + raw
    if isinstance(v, list):
        return _head(4, len(v)) + b"".join(map(to_cbor, v))
    return _head(5, len(v)) + b"".join(to_cbor(k) + to_cbor(x) for k, x in v.items())


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, kind, top in ((24, "B", 1 << 8), (25, "H", 1 << 16), (26, "I", 1 << 32), (27, "Q", 1 << 64)):
        if n < top:
            return bytes([major << 5 | code]) + struct.pack(">" + kind, n)
    raise ValueError(f"too large: {n}")


def from_cbor(b: bytes):
    v, end = _cbor(b, 0)
    if end != len(b):
        raise ValueError("bytes are left over")
    return v


def _cbor(b: bytes, i: int):
    major, n = b[i] >> 5, b[i] & 31
    i += 1
    if major == 7:
        if n in (20, 21, 22):
            return {20: False, 21: True, 22: None}[n], i
        return struct.unpack_from(">d", b, i)[0], i + 8
    if n >= 24:
        f = ">" + "BHIQ"[n - 24]
        n, i = struct.unpack_from(f, b, i)[0], i + struct.calcsize(f)
    if major < 2:
        return (n if major == 0 else -1 - n), i
    if major == 3:
        return b[i : i + n].decode(), i + n
    out: list = []
    for _ in range(n * (major - 3)):
        x, i = _cbor(b, i)
        out.append(x)
    return (out if major == 4 else dict(zip(out[0::2], out[1::2]))), i


_KINDS = {"msgpack": (to_msgpack, from_msgpack), "cbor": (to_cbor, from_cbor)}


def packed(c: Column, kind: str) -> Column:
    """A JSON text in MessagePack or CBOR; null where it doesn't parse."""
    to = _KINDS[kind][0]

    @F.pandas_udf("binary")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series([_or_none(lambda t: to(json.loads(t)), t) for t in p], dtype=object)

    return run(c)


def unpacked(c: Column, kind: str) -> Column:
    """The JSON text of MessagePack or CBOR; null where the bytes are none."""
    back = _KINDS[kind][1]

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series([_or_none(lambda b: json.dumps(back(bytes(b)), ensure_ascii=False), b) for b in p], dtype=object)

    return run(c)


def _or_none(f, x):
    try:
        return None if x is None else f(x)
    except (ValueError, IndexError, KeyError, struct.error):
        return None
