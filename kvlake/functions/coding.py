"""Byte-level coding of the raw file formats: integers, checksums, hashes, text escapes."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place); ValueError if it is cut off or over 64 bits."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def prefixed(data: bytes) -> bytes:
    return varint(len(data)) + data


def read_prefixed(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = read_varint(data, at)
    if at + n > len(data):
        raise ValueError("bad length-prefixed bytes")
    return data[at : at + n], at + n


def fixed64(n: int) -> bytes:
    return struct.pack("<Q", n)


def internal_key(key: bytes, seq: int, op: int) -> bytes:
    return key + fixed64(seq << 8 | op)


def split_internal_key(data: bytes) -> tuple[bytes, int, int]:
    """(key, seq, op); ValueError if too short or of an unknown operation."""
    if len(data) < 8 or data[-8] > 1:
        raise ValueError("bad internal key")
    (tail,) = struct.unpack("<Q", data[-8:])
    return data[:-8], tail >> 8, tail & 0xFF


def _crc_tables() -> np.ndarray:
    """Tables for eight bytes a step, from the reflected Castagnoli polynomial."""
    t = np.zeros((8, 256), np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        t[0, i] = c
    for k in range(1, 8):
        t[k] = (t[k - 1] >> np.uint32(8)) ^ t[0][t[k - 1] & np.uint32(0xFF)]
    return t


_CRC = _crc_tables().tolist()


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C, or its continuation from the value of what came before."""
    a, b, c, d, e, f, g, h = _CRC[::-1]
    crc ^= 0xFFFFFFFF
    whole = len(data) & ~7
    for lo, hi in struct.iter_unpack("<II", data[:whole]):
        lo ^= crc
        crc = a[lo & 255] ^ b[lo >> 8 & 255] ^ c[lo >> 16 & 255] ^ d[lo >> 24] ^ e[hi & 255] ^ f[hi >> 8 & 255] ^ g[hi >> 16 & 255] ^ h[hi >> 24]
    for x in data[whole:]:
        crc = crc >> 8 ^ h[(crc ^ x) & 255]
    return crc ^ 0xFFFFFFFF


_MASK_DELTA = 0xA282EAD8


def mask(crc: int) -> int:
    """Checksums are stored rotated and shifted, so that a checksum of checksums stays safe."""
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def unmask(stored: int) -> int:
    rot = (stored - _MASK_DELTA) & 0xFFFFFFFF
    return (rot >> 17 | rot << 15) & 0xFFFFFFFF


_BLOOM_SEED, _M = 0xBC9F1D34, 0xC6A4A793


def hash32(data: bytes, seed: int = _BLOOM_SEED) -> int:
    """The 32-bit multiplicative hash behind the filters."""
    h = (seed ^ len(data) * _M) & 0xFFFFFFFF
    whole = len(data) & ~3
    for (w,) in struct.iter_unpack("<I", data[:whole]):
        h = (h + w) * _M & 0xFFFFFFFF
        h ^= h >> 16
    if rest := data[whole:]:
        h = (h + int.from_bytes(rest, "little")) * _M & 0xFFFFFFFF
        h ^= h >> 24
    return h


def escape(data: bytes) -> str:
    r"""Printable ASCII as it is, other bytes as \xNN."""
    return "".join(chr(b) if 32 <= b < 127 else f"\\x{b:02x}" for b in data)


def hash32_column(key: Column, seed: int = _BLOOM_SEED) -> Column:
    """hash32 of a binary column as a bigint."""

    @F.arrow_udf("long")
    def hash32_of(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hash32(x, seed) for x in column.to_pylist()], pa.int64())

    return hash32_of(key)


def crc32c_column(data: Column) -> Column:
    """crc32c of a binary column as a bigint."""

    @F.arrow_udf("long")
    def crc32c_of(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else crc32c(x) for x in column.to_pylist()], pa.int64())

    return crc32c_of(data)


def escape_column(data: Column) -> Column:
    r"""``escape`` in built-in functions: hex pairs of unprintable bytes become \xNN."""
    pairs = F.filter(F.split(F.hex(data), "(?<=\\G..)"), lambda h: h != "")
    code = F.transform(pairs, lambda h: F.struct(h.alias("h"), F.conv(h, 16, 10).cast("int").alias("n")))
    return F.array_join(F.transform(code, lambda p: F.when(p["n"].between(32, 126), F.char(p["n"])).otherwise(F.concat(F.lit("\\x"), F.lower(p["h"])))), "")


class Random:
    """The minimal-standard generator x -> 16807 x mod 2^31 - 1."""

    def __init__(self, seed: int):
        self.state = seed & 0x7FFFFFFF
        if self.state in (0, 0x7FFFFFFF):
            self.state = 1

    def next(self) -> int:
        self.state = self.state * 16807 % 0x7FFFFFFF
        return self.state

    def uniform(self, n: int) -> int:
        return self.next() % n

    def one_in(self, n: int) -> bool:
        return self.next() % n == 0

    def skewed(self, max_log: int) -> int:
        return self.uniform(1 << self.uniform(max_log + 1))
