"""Integers, rationals and text in binary columns, both byte orders, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every rational of the gain map metadata has this denominator (fixed value).
DENOMINATOR = 1_000_000


def col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def raw(b: bytes) -> Column:
    return F.lit(bytearray(b))


def text(s: Column) -> Column:
    return F.encode(col(s), "UTF-8")


def _swapped(b: Column, n: int) -> Column:
    return F.concat(*[F.substring(b, i, 1) for i in range(n, 0, -1)])


def put(v, n: int, little: bool = False) -> Column:
    """The n low bytes of an integer; negative numbers in two's complement."""
    b = F.unhex(F.lpad(F.hex(col(v).cast("long").bitwiseAND(F.lit((1 << 8 * n) - 1))), 2 * n, "0"))
    return _swapped(b, n) if little and n > 1 else b


def u8(v) -> Column:
    return put(v, 1)


def u16(v, little: bool = False) -> Column:
    return put(v, 2, little)


def u32(v, little: bool = False) -> Column:
    return put(v, 4, little)


def read(b: Column, at, n: int, little: Column | bool = False) -> Column:
    """Unsigned integer of n bytes at a position counted from 0; null where the bytes are not all there."""
    piece = F.substring(b, col(at).cast("int") + 1, F.lit(n))
    piece = F.when(F.length(piece) == n, piece)
    value = lambda p: F.conv(F.hex(p), 16, 10).cast("long")
    if isinstance(little, bool):
        return value(_swapped(piece, n) if little else piece)
    return F.when(little, value(_swapped(piece, n))).otherwise(value(piece))


def read_signed(b: Column, at, n: int, little: Column | bool = False) -> Column:
    v = read(b, at, n, little)
    return F.when(v >= 1 << 8 * n - 1, v - (1 << 8 * n)).otherwise(v)


def _scaled(v, low: int, high: int) -> Column:
    return F.round(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col(v).cast("double") * DENOMINATOR))).cast("long")


def rational(v) -> Column:
    """Unsigned rational, saturated."""
    return F.concat(u32(_scaled(v, 0, 4294967295)), u32(DENOMINATOR))


def srational(v) -> Column:
    """Signed rational, saturated."""
    return F.concat(u32(_scaled(v, -2147483648, 2147483647)), u32(DENOMINATOR))


def read_rational(b: Column, at, signed: bool = True) -> Column:
    """Value of a rational; 0 where its denominator is 0."""
    at = col(at)
    n, d = (read_signed if signed else read)(b, at, 4), read(b, at + 4, 4)
    return F.when(d == 0, 0.0).otherwise(n / F.nullif(d, F.lit(0)))


def s15fixed16(v) -> Column:
    return u32(F.round(col(v).cast("double") * 65536).cast("long"))


def starts(b: Column, prefix: bytes) -> Column:
    return F.substring(b, 1, len(prefix)) == raw(prefix)


def digest8(b: Column) -> Column:
    """First eight hex digits of the md5 of a body."""
    return F.substring(F.md5(b), 1, 8)
