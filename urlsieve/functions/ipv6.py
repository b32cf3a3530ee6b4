"""IPv6 literals as 128-bit numbers, and the special ranges that they fall into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlsieve.functions.url import let

_BYTE = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: An IPv4 address at the end of a literal.
DOTTED = rf":({_BYTE}(?:\.{_BYTE}){{3}})$"
#: Special prefixes as first address (upper and lower 64 bits), length, and whether addresses in it are internal (not
#: global, or multicast).  The longest prefix of an address counts; the list is that of Python 3.13.
SPECIAL = (
    (0x0000000000000000, 1, 128, True),  # ::1
    (0x0000000000000000, 0, 128, True),  # ::
    (0x0064FF9B00010000, 0, 48, True),  # 64:ff9b:1::
    (0x0100000000000000, 0, 64, True),  # 100::
    (0x2001000000000000, 0, 23, True),  # 2001::
    (0x2001000100000000, 1, 128, False),  # 2001:1::1
    (0x2001000100000000, 2, 128, False),  # 2001:1::2
    (0x2001000300000000, 0, 32, False),  # 2001:3::
    (0x2001000401120000, 0, 48, False),  # 2001:4:112::
    (0x2001002000000000, 0, 28, False),  # 2001:20::
    (0x2001003000000000, 0, 28, False),  # 2001:30::
    (0x20010DB800000000, 0, 32, True),  # 2001:db8::
    (0x2002000000000000, 0, 16, True),  # 2002::
    (0xFC00000000000000, 0, 7, True),  # fc00::
    (0xFE80000000000000, 0, 10, True),  # fe80::
    (0xFF00000000000000, 0, 8, True),  # ff00::
)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def number(literal: Column) -> Column:
    """``struct(high, low)``: the address as two signed longs, null where ``literal`` is no IPv6 address.  Takes ``::`` for one group
    of zeros or more, leading zeros, upper case, an IPv4 address at the end, and a zone after ``%``."""

    def hexed(t: Column, dotted: Column) -> Column:
        pair = lambda p, i: F.lower(F.hex(F.element_at(p, i).cast("int") * 256 + F.element_at(p, i + 1).cast("int")))
        four = let(F.split(dotted, r"\."), lambda p: F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(dotted)), pair(p, 1), F.lit(":"), pair(p, 3)))
        return F.when(dotted != "", four).otherwise(t)

    def groups(t: Column) -> Column:
        cut = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":", -1))
        filled = lambda a, b: F.when(F.size(a) + F.size(b) < 8, F.concat(a, F.array_repeat(F.lit("0"), 8 - F.size(a) - F.size(b)), b))
        return let(F.split(t, "::", -1), lambda p: F.when(F.size(p) == 1, F.split(t, ":", -1)).when(F.size(p) == 2, let(F.struct(cut(p[0]).alias("a"), cut(p[1]).alias("b")), lambda s: filled(s["a"], s["b"]))))

    def joined(g: Column) -> Column:
        ok = (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-fA-F]{1,4}$"))
        half = lambda at: F.aggregate(F.slice(g, at, 4), F.lit(0).cast("bigint"), lambda n, x: F.shiftleft(n, 16).bitwiseOR(F.conv(x, 16, 10).cast("bigint")))
        return F.when(ok, F.struct(half(1).alias("high"), half(5).alias("low")))

    bare = F.regexp_replace(literal, "%[^%]+$", "")
    return F.when(literal.contains(":"), let(bare, lambda t: let(hexed(t, F.regexp_extract(t, DOTTED, 1)), lambda s: let(groups(s), joined))))


def mapped(n: Column) -> Column:
    """The IPv4 address that is mapped into an address of :func:`number`, as a number; null for others."""
    return F.when((n["high"] == 0) & (F.shiftrightunsigned(n["low"], 32) == 0xFFFF), n["low"].bitwiseAND(0xFFFFFFFF))


def is_special(n: Column) -> Column:
    """Is an address of :func:`number` internal by its longest special prefix?"""

    def inside(high: int, low: int, bits: int) -> Column:
        mask = lambda k: _signed(((1 << 64) - 1 << 64 - k) & (1 << 64) - 1)
        upper = n["high"].bitwiseAND(F.lit(mask(min(bits, 64)))) == _signed(high)
        return upper & (n["low"].bitwiseAND(F.lit(mask(bits - 64))) == _signed(low)) if bits > 64 else upper

    found = [F.when(inside(high, low, bits), F.lit(internal)) for high, low, bits, internal in sorted(SPECIAL, key=lambda s: -s[2])]
    return F.coalesce(*found, F.lit(False))
