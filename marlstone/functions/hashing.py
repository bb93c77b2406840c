"""FNV-1a with 64 bits, on the driver and as a column expression that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a's published parameters.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
_LOW = 0xFFFFFFFF
_SMALL = PRIME & _LOW  # the prime is 2^40 + this
_SIGN = -(1 << 63)


def fnv1a64(data: bytes | str, state: int = OFFSET) -> int:
    """The hash of the bytes, or of what led to ``state`` and then the bytes."""
    h = state
    for b in data.encode() if isinstance(data, str) else data:
        h = ((h ^ b) * PRIME) % (1 << 64)
    return h


def signed(h: int) -> int:
    """The BIGINT with the same bits."""
    return h - (1 << 64) if h >> 63 else h


def fnv1a64_column(column: Column, state: int = OFFSET) -> Column:
    """The hash's bits as BIGINT, null for null or empty input.

    The state is two 32-bit halves, as a 64-bit product would overflow in ANSI mode: with x = low ^ byte the new low
    half is x * 435 mod 2^32, and the high one gets the carry, its own product and x shifted by the prime's bit 40.
    """
    data = column.cast("binary")
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1))), lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("long"))
    start = F.struct(F.lit(state >> 32).cast("long").alias("hi"), F.lit(state & _LOW).cast("long").alias("lo"))

    def step(a: Column, code: Column) -> Column:
        x = a["lo"].bitwiseXOR(code)
        return F.struct(
            (a["hi"] * _SMALL + F.shiftright(x * _SMALL, 32) + x * (1 << 8)).bitwiseAND(F.lit(_LOW)).alias("hi"),
            (x * _SMALL).bitwiseAND(F.lit(_LOW)).alias("lo"))

    return F.when(F.octet_length(data) > 0, F.aggregate(codes, start, step, lambda a: F.shiftleft(a["hi"], 32).bitwiseOR(a["lo"])))


def unsigned_order(h: Column) -> Column:
    """A BIGINT that sorts as the hash's unsigned value does."""
    return h.bitwiseXOR(F.lit(_SIGN))
