"""Keys: order-preserving encodings of typed columns, user-defined orders, and range bounds.

A user-defined order is a function from the key column to a sort-key column made of built-in
expressions: rows are grouped, compared and ranged by the sort key while the key itself is kept, so
keys that the order holds equal are one key. Its counterpart on single keys does the same for the few
keys of file metadata, on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Order:
    """A named order: ``column`` maps a key column to its sort key, ``value`` one key to something that compares alike."""

    name: str
    column: Callable[[Column], Column]
    value: Callable[[bytes], object] = bytes

    def __call__(self, key: Column) -> Column:
        return self.column(key)


def padded(number: Column, width: int = 16) -> Column:
    """Zero-padded decimal text: text order is number order for naturals of at most ``width`` digits."""
    return F.format_string(f"%0{width}d", number)


def big_endian(number: Column) -> Column:
    """Eight bytes whose unsigned order is the order of signed longs."""
    flipped = number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def _backwards(key: Column) -> Column:
    return F.encode(F.reverse(F.decode(key.cast("binary"), "ISO-8859-1")), "ISO-8859-1")


def _bracketed(key: Column) -> Column:
    inner = F.regexp_extract(key.cast("string"), r"^\[(.*)\]$", 1)
    hexed = F.conv(F.regexp_extract(inner, "^0x([0-9a-fA-F]+)$", 1), 16, 10).cast("long")
    return F.when(inner.startswith("0x"), hexed).otherwise(F.try_to_number(inner, F.lit("9999999999999999999")).cast("long"))


def _bracketed_value(key: bytes) -> tuple:
    m = re.fullmatch(rb"\[(?:0x([0-9a-fA-F]+)|([0-9]+))\]", key)
    return (0, 0) if m is None else (1, int(m[1], 16) if m[1] else int(m[2]))


#: Unsigned lexicographic order of the bytes, the default.
bytewise = Order("bytewise", lambda key: key)
#: The order of keys read backwards.
reverse_bytewise = Order("reverse_bytewise", _backwards, lambda key: bytes(key)[::-1])
#: Numbers in brackets, decimal or 0x hexadecimal: [10] and [0xa] are the same key. Other keys are one key before all.
bracketed_number = Order("bracketed_number", _bracketed, _bracketed_value)

ORDERS: dict[str, Order] = {o.name: o for o in (bytewise, reverse_bytewise, bracketed_number)}


def register_order(order: Order) -> Order:
    """Make an order known by its name, so that stores can be opened with it. A name keeps its meaning."""
    if ORDERS.setdefault(order.name, order) is not order:
        raise ValueError(f"an order is called {order.name} already")
    return order


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above every key with this prefix; None if there is none."""
    bare = prefix.rstrip(b"\xff")
    return bare[:-1] + bytes([bare[-1] + 1]) if bare else None


def shortest_separator(start: bytes, limit: bytes) -> bytes:
    """A short key in [start, limit): start itself where nothing shorter fits."""
    same = next((i for i, (a, b) in enumerate(zip(start, limit)) if a != b), min(len(start), len(limit)))
    if same < min(len(start), len(limit)) and start[same] < 0xFF and start[same] + 1 < limit[same]:
        return start[:same] + bytes([start[same] + 1])
    return start


def short_successor(key: bytes) -> bytes:
    """A short key not below ``key``; the key itself if it is all 0xff."""
    at = next((i for i, b in enumerate(key) if b != 0xFF), None)
    return key if at is None else key[:at] + bytes([key[at] + 1])


def pack_sequence(seq: Column, op: Column) -> Column:
    """Sequence number and operation in one long."""
    return F.shiftleft(seq, 8).bitwiseOR(op.cast("long"))


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))
