"""Consistent-hash rings and routing by them as a broadcast equi-join."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.hashing import fnv1a64, fnv1a64_column, signed, unsigned_order
from marlstone.model import InvalidKey, InvalidOptions

#: Points of a node of weight 1.
VIRTUAL_NODES = 128
#: Points that a ring may have and still be broadcast; larger ones are joined by shuffle.
BROADCAST_POINTS = 1_000_000
#: The ring is cut at each multiple of 2^(64 - bits), so that routing is an equi-join on these bits.
BITS = 12


@dataclass(frozen=True)
class Ring:
    """Points (hash, owner) in unsigned order; a key belongs to the first point at or after its hash, around the end."""

    points: tuple[tuple[int, str], ...]

    def owner(self, key: bytes | str) -> str:
        if not key:
            raise InvalidKey("the empty key has no place on the ring")
        return self.points[bisect_left(self.points, (fnv1a64(key), "")) % len(self.points)][1]

    def without(self, *owners: str) -> Ring:
        return Ring(tuple(p for p in self.points if p[1] not in owners))


def shard_ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> Ring:
    """Owners are shard numbers as text. Point labels are a fixed format that decides every route."""
    if shards < 1:
        raise InvalidOptions("a ring needs a shard")
    points = [(fnv1a64(f"shard-{s:04d}#vnode-{v:04d}"), s, v) for s in range(shards) for v in range(virtual_nodes)]
    return Ring(tuple((h, str(s)) for h, s, _ in sorted(points)))


def node_ring(nodes: list[tuple[str, int]], virtual_nodes: int = VIRTUAL_NODES) -> Ring:
    """nodes: (id, weight); a weight below 1 counts as 1, and weights multiply the points. Input order doesn't matter."""
    ids = [n for n, _ in nodes]
    if not ids or not all(ids) or len(set(ids)) != len(ids):
        raise InvalidOptions("nodes need distinct ids that aren't empty")
    count = virtual_nodes if virtual_nodes > 0 else VIRTUAL_NODES
    return Ring(tuple(sorted((fnv1a64(f"{n}:{i}"), n) for n, w in nodes for i in range(count * max(1, w)))))


def segments(ring: Ring) -> list[tuple[int, int, int, str]]:
    """(bits, from, to, owner) with inclusive ends in unsigned order, cut at the bits."""
    out, width = [], 64 - BITS
    start = 0
    for h, owner in [*ring.points, ((1 << 64) - 1, ring.points[0][1])]:
        while start <= h:
            end = min(h, ((start >> width) + 1 << width) - 1)
            out.append((start >> width, start, end, owner))
            start = end + 1
    return out


def route(rows: DataFrame, key: Column, ring: Ring, out: str = "owner") -> DataFrame:
    """Adds the owner of ``key``; null for a null or empty key."""
    spark = rows.sparkSession
    shift = lambda x: signed(x ^ (1 << 63))
    table = spark.createDataFrame([(b, shift(a), shift(z), o) for b, a, z, o in segments(ring)], "_bits long, _from long, _to long, _owner string")
    if len(ring.points) <= BROADCAST_POINTS:
        table = F.broadcast(table)
    hashed = rows.withColumn("_hash", fnv1a64_column(key)).withColumn("_place", unsigned_order(F.col("_hash")))
    on = (F.shiftrightunsigned("_hash", 64 - BITS) == F.col("_bits")) & F.col("_place").between(F.col("_from"), F.col("_to"))
    return hashed.join(table, on, "left").select(*rows.columns, F.col("_owner").alias(out))
