"""Bloom filters: sizing, exact membership parity, and building one from a column without collecting the keys."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.hashing import fnv1a64, fnv1a64_column, signed
from marlstone.model import CorruptRecord, InvalidOptions

#: The second hash runs over this salt (little-endian) and then the key.
SALT = 0x9E3779B97F4A7C15
#: The second hash's state after the salt.
SALTED = fnv1a64(SALT.to_bytes(8, "little"))
#: Bits that a filter may have and still be sent to every task.
MOST_BITS = 1 << 28
#: Bytes of a filter that travel in one row.
PAGE = 4096


def size(expected: int, false_positive_rate: float) -> tuple[int, int]:
    """Bits m = ceil(-n ln p / ln2^2) and hashes k = round(m / n ln 2), from 1 to 64."""
    if expected < 1 or not 0 < false_positive_rate < 1:
        raise InvalidOptions("a filter needs keys and a rate between 0 and 1")
    bits = math.ceil(-expected * math.log(false_positive_rate) / math.log(2) ** 2)
    return bits, min(64, max(1, math.floor(bits / expected * math.log(2) + 0.5)))


def size_columns(expected: Column, rate: Column) -> tuple[Column, Column]:
    bits = F.ceil(-expected * F.ln(rate) / F.pow(F.ln(F.lit(2.0)), F.lit(2.0)))
    return bits, F.least(F.lit(64), F.greatest(F.lit(1), F.floor(bits / expected * F.ln(F.lit(2.0)) + 0.5)))


def hash_columns(key: Column) -> tuple[Column, Column]:
    """Both hashes of a key as BIGINT bits, made in the JVM; null for a null or empty key."""
    second = fnv1a64_column(key, SALTED)
    return fnv1a64_column(key), F.when(second == 0, F.lit(signed(SALT))).otherwise(second)


def places(first: np.ndarray, second: np.ndarray, bits: int | np.ndarray, hashes: int) -> np.ndarray:
    """(first + i second) mod 2^64 mod bits for i below ``hashes``: a row a key."""
    i = np.arange(hashes, dtype=np.uint64)
    with np.errstate(over="ignore"):
        at = first.view(np.uint64)[:, None] + i[None, :] * second.view(np.uint64)[:, None]
    return at % (np.asarray(bits).astype(np.uint64).reshape(-1, 1))


@dataclass
class Bloom:
    bits: int
    hashes: int
    data: bytearray
    added: int = 0

    @classmethod
    def sized(cls, expected: int, false_positive_rate: float) -> Bloom:
        bits, hashes = size(expected, false_positive_rate)
        return cls(bits, hashes, bytearray(-(-bits // 8)))

    def places(self, key: bytes) -> list[int]:
        first, second = fnv1a64(key), fnv1a64(key, SALTED) or SALT
        return [((first + i * second) % (1 << 64)) % self.bits for i in range(self.hashes)]

    def add(self, key: bytes) -> None:
        for p in self.places(key):
            self.data[p >> 3] |= 1 << (p & 7)
        self.added += 1

    def add_hashed(self, first: np.ndarray, second: np.ndarray) -> None:
        at = places(first, second, self.bits, self.hashes).ravel()
        np.bitwise_or.at(np.frombuffer(self.data, np.uint8), (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        self.added += len(first)

    def might_contain(self, key: bytes) -> bool:
        return all(self.data[p >> 3] >> (p & 7) & 1 for p in self.places(key))

    def have_hashed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = places(first, second, self.bits, self.hashes)
        held = np.frombuffer(self.data, np.uint8)[(at >> np.uint64(3)).astype(np.int64)]
        return ((held >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def to_bytes(self) -> bytes:
        body = struct.pack("<QIQ", self.bits, self.hashes, self.added) + bytes(self.data)
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Bloom:
        if len(raw) < 24 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise CorruptRecord("not a filter, or damaged")
        bits, hashes, added = struct.unpack("<QIQ", raw[:20])
        if not bits or not 1 <= hashes <= 64 or len(raw) != 24 + -(-bits // 8):
            raise CorruptRecord("a filter's fields disagree")
        return cls(bits, hashes, bytearray(raw[20:-4]), added)


def build(keys: DataFrame, column: str, expected: int, rate: float) -> Bloom:
    """A filter over all keys, hashed in the JVM. Tasks set bits of their own copy; copies meet in pages, never keys."""
    template = Bloom.sized(expected, rate)
    if template.bits > MOST_BITS:
        raise InvalidOptions("the filter is too large for one machine; build one a partition")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Bloom(template.bits, template.hashes, bytearray(len(template.data)))
        for b in batches:
            own.add_hashed(b["a"].to_numpy(np.int64), b["b"].to_numpy(np.int64))
        used = [i for i in range(0, len(own.data), PAGE) if any(own.data[i : i + PAGE])]
        yield pd.DataFrame({"at": used, "part": [bytes(own.data[i : i + PAGE]) for i in used], "n": [own.added if j == 0 else 0 for j in range(len(used))]})

    def merge(at: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        value = 0
        for p in rows["part"]:
            value |= int.from_bytes(p, "little")
        return pd.DataFrame({"at": [at[0]], "part": [value.to_bytes(len(rows["part"].iloc[0]), "little")], "n": [int(rows["n"].sum())]})

    first, second = hash_columns(F.col(column))
    filled = keys.select(first.alias("a"), second.alias("b")).filter("a is not null").mapInPandas(fill, "at long, part binary, n long")
    for r in filled.groupBy("at").applyInPandas(merge, "at long, part binary, n long").collect():
        template.data[r["at"] : r["at"] + len(r["part"])] = r["part"]
        template.added += r["n"]
    return template


def might_contain(bloom: Bloom) -> Callable[[str | Column], Column]:
    """A column function over binary or string keys; null and empty keys are never there."""
    raw = bloom.to_bytes()

    @F.pandas_udf("boolean")
    def test(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = Bloom.from_bytes(raw)
        for a, b in batches:
            yield pd.Series(own.have_hashed(a.to_numpy(np.int64), b.to_numpy(np.int64)))

    def column(key: str | Column) -> Column:
        first, second = hash_columns(F.col(key) if isinstance(key, str) else key)
        known = first.isNotNull()
        return known & test(F.coalesce(first, F.lit(0).cast("long")), F.coalesce(second, F.lit(0).cast("long")))

    return column


def covered(probe: bytes | str):
    """A column function (first, second, bits, hashes): the bits of a number tell which of ``probe``'s places a key sets.

    OR-ed over the keys of a filter, the number is 2^hashes - 1 just if the filter would answer that the probe may be there.
    """
    a, b = (np.array([signed(h)], np.int64) for h in (fnv1a64(probe), fnv1a64(probe, SALTED) or SALT))

    @F.pandas_udf("long")
    def mask(first: pd.Series, second: pd.Series, bits: pd.Series, hashes: pd.Series) -> pd.Series:
        out = np.zeros(len(first), np.int64)
        f, s, m, k = (x.to_numpy(np.int64) for x in (first, second, bits, hashes))
        for bits_, hashes_ in sorted(set(zip(m.tolist(), k.tolist(), strict=True))):
            mine = (m == bits_) & (k == hashes_)
            held, wanted = places(f[mine], s[mine], bits_, hashes_), places(a, b, bits_, hashes_)[0]
            found = (held[:, :, None] == wanted[None, None, :]).any(axis=1)
            out[mine] = (found.astype(np.uint64) << np.arange(hashes_, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
        return pd.Series(out)

    return mask
