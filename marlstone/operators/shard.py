"""Sharding by the ring: each key has one shard; reads by key go there, range scans meet all shards."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.ring import VIRTUAL_NODES, Ring, route, shard_ring
from marlstone.model import InvalidOptions, ShardMismatch, require_key
from marlstone.operators import kv
from marlstone.sources import files
from marlstone.sources.store import Store


def with_shard(log: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    routed = route(log, F.col("key"), shard_ring(shards, virtual_nodes), "_shard")
    return routed.withColumn("shard", F.col("_shard").cast("int")).drop("_shard")


def scan(log: DataFrame, start: bytes | str | None = None, end: bytes | str | None = None) -> DataFrame:
    """Over all shards. A key lives in one shard, so its newest operation is its newest anywhere."""
    return kv.scan(log, start, end)


def stats(log: DataFrame) -> DataFrame:
    """(shard, operations, live_keys, bytes), with a total where ``shard`` is null. log has a ``shard`` column."""
    latest = log.groupBy("shard", "key").agg(F.max_by(F.struct("value", "kind"), "seq").alias("n"), F.count(F.lit(1)).alias("operations"))
    alive = F.col("n.kind") == 1
    size = F.octet_length("key") + F.coalesce(F.octet_length("n.value"), F.lit(0))
    return latest.rollup("shard").agg(F.sum("operations").alias("operations"), F.sum(alive.cast("long")).alias("live_keys"), F.sum(F.when(alive, size).otherwise(0)).cast("long").alias("bytes"))


def validate_manifest(m: dict) -> dict:
    shards = m.get("shards", [])
    if [s.get("id") for s in shards] != list(range(len(shards))) or not shards:
        raise InvalidOptions("shard ids must run from 0")
    if len({s["name"] for s in shards}) != len(shards) or len({s["path"] for s in shards}) != len(shards):
        raise InvalidOptions("shard names and paths must be unique")
    if any(not re.fullmatch(r"[A-Za-z0-9_\-]+", s["path"]) for s in shards):
        raise InvalidOptions("shard paths must be plain names")
    return m


class ShardedStore:
    """A store for each shard below one folder. The number of shards is fixed when the folder is made."""

    def __init__(self, spark: SparkSession, path: str, shards: int = 0, virtual_nodes: int = VIRTUAL_NODES) -> None:
        text = files.read_text(spark, f"{path}/SHARDS.json")
        if text:
            m = validate_manifest(json.loads(text))
            if shards and shards != len(m["shards"]):
                raise ShardMismatch(f"{shards} shards asked for, the folder has {len(m['shards'])}")
        else:
            if shards < 1:
                raise InvalidOptions("a new folder needs a number of shards")
            m = validate_manifest({"virtual_nodes": virtual_nodes, "shards": [{"id": i, "name": f"s{i}", "path": f"s{i}"} for i in range(shards)]})
            files.write_text(spark, f"{path}/SHARDS.json", json.dumps(m))
        self.spark, self.ring = spark, shard_ring(len(m["shards"]), m["virtual_nodes"])
        self.stores = [Store(spark, f"{path}/{s['path']}") for s in m["shards"]]

    def shard_for(self, key: bytes) -> int:
        return int(self.ring.owner(key))

    def put(self, key: bytes, value: bytes) -> None:
        self.stores[self.shard_for(require_key(key))].put(key, value)

    def delete(self, key: bytes) -> None:
        self.stores[self.shard_for(require_key(key))].delete(key)

    def get(self, key: bytes) -> bytes | None:
        return self.stores[self.shard_for(require_key(key))].get(key)

    def write(self, rows: DataFrame) -> int:
        routed = route(rows, F.col("key"), self.ring, "_shard").persist()
        try:
            return sum(s.write(routed.filter(F.col("_shard") == str(i)).drop("_shard")) for i, s in enumerate(self.stores))
        finally:
            routed.unpersist()

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        out = self.stores[0].log()
        for s in self.stores[1:]:
            out = out.unionByName(s.log())
        return kv.scan(out, start, end)

    def flush(self) -> None:
        for s in self.stores:
            s.flush()

    def compact(self) -> None:
        for s in self.stores:
            s.compact()

    def stats(self) -> dict:
        each = [s.stats() for s in self.stores]
        return {"shards": each, "total": {k: sum(e[k] for e in each) for k in each[0]}}

    def close(self) -> None:
        for s in self.stores:
            s.close()


__all__ = ["Ring", "ShardedStore", "scan", "stats", "validate_manifest", "with_shard"]
