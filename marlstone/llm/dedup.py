"""Exact dedup over a minimal perfect hash of historical distinct digests.

The history is an index of shards (by digest prefix), each one a minimal perfect hash whose slots hold the full
digest, the winner's locator and the number of copies. Incoming rows are grouped to distinct digests first
(map-side, so that a text that fills a third of the table is one row a task), meet the shard of their prefix, and a
slot answers only if its stored digest is equal byte for byte. What the index doesn't know is grouped separately.

Defined results: null text counts as empty. Texts are equal if they are identical after each run of
``[\\x20\\x09-\\x0D]`` became one space. Null ids come after all others; if a group has null ids only, ``keep_id`` is
null. Of rows that repeat id and text exactly one is kept. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Distinct digests that a shard of the index holds on average.
SHARD_KEYS = 4096
#: Bits for each key that is still to be placed, at each level of the hash.
GAMMA = 2.0

INDEX_SCHEMA = "shard int, n_keys int, level_bits binary, level_sizes array<int>, digests binary, win_id binary, win_null binary, win_row binary, copies binary"
GROUP_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long, member boolean"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(common.text_or_empty(column), f"[{common.SPACE_CLASS}]+", " ")


def digest(column: str = "text") -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(column), 256))


def _spots(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """keys: n x 4 words of the digests. A digest is uniform, so its words serve as hash values."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] + np.uint64(level) * (keys[:, 1] | np.uint64(1))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(bits)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits end to end, and each key's slot (0 to n - 1, each once)."""
    left, sizes, levels, place = np.arange(len(keys)), [], [], np.zeros(len(keys), np.int64)
    start = 0
    while len(left):
        bits = max(1, int(GAMMA * len(left)))
        at = _spots(keys[left], len(sizes), bits)
        alone = np.bincount(at, minlength=bits) == 1
        fits = alone[at]
        place[left[fits]] = start + at[fits]
        sizes.append(bits)
        levels.append(alone)
        start += bits
        left = left[~fits]
        if len(sizes) > 512:
            raise ValueError("digests repeat within a shard")
    bitmap = np.concatenate(levels) if levels else np.zeros(0, bool)
    slot = np.cumsum(bitmap)[place] - 1 if len(keys) else place
    return sizes, bitmap, slot


def find_slots(keys: np.ndarray, sizes: list[int], bitmap: np.ndarray) -> np.ndarray:
    """The slot of each key, or -1 if no level has a bit for it. A slot still has to be checked byte for byte."""
    slot, left, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    ranks = np.cumsum(bitmap)
    for level, bits in enumerate(sizes):
        if not len(left):
            break
        at = start + _spots(keys[left], level, bits)
        hit = bitmap[at]
        slot[left[hit]] = ranks[at[hit]] - 1
        left = left[~hit]
        start += bits
    return slot


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), "<u8").reshape(-1, 4)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    keys = _words(rows["digest"])
    sizes, bitmap, slot = build_hash(keys)
    order = np.argsort(slot)
    ids = rows["win_id"]
    null = ids.isna().to_numpy()
    column = lambda s: np.ascontiguousarray(s.to_numpy(dtype=np.int64)[order]).tobytes()
    return pd.DataFrame(
        [{
            "shard": int(rows["shard"].iloc[0]), "n_keys": len(rows), "level_bits": np.packbits(bitmap).tobytes(), "level_sizes": sizes,
            "digests": np.ascontiguousarray(keys[order]).tobytes(), "win_id": column(ids.fillna(0)), "win_null": np.packbits(null[order]).tobytes(),
            "win_row": column(rows["win_row"]), "copies": column(rows["copies"]),
        }]
    )


def _shard_of(shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 29, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, win_id, win_row, copies) of rows (digest, doc_id, row): partly grouped before the shuffle."""
    winner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    return rows.groupBy("digest").agg(winner.alias("w"), F.count(F.lit(1)).alias("copies")).select("digest", F.col("w.id").alias("win_id"), F.col("w.row").alias("win_row"), "copies")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard: the perfect hash and its slots, over distinct digests (digest, win_id, win_row, copies)."""
    return history.withColumn("shard", _shard_of(shards)).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def _meet(incoming: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """All groups of a shard: every slot with what came in for it, then the incoming digests without a slot."""
    out = []
    n_in = len(incoming)
    slot = np.full(n_in, -1, np.int64)
    keys = _words(incoming["digest"]) if n_in else np.zeros((0, 4), "<u8")
    if len(index):
        x = index.iloc[0]
        n, sizes = int(x["n_keys"]), [int(s) for s in x["level_sizes"]]
        bitmap = np.unpackbits(np.frombuffer(x["level_bits"], np.uint8), count=sum(sizes)).astype(bool)
        held = np.frombuffer(x["digests"], "<u8").reshape(-1, 4)
        slot = find_slots(keys, sizes, bitmap)
        found = slot >= 0
        same = np.zeros(n_in, bool)
        same[found] = (held[slot[found]] == keys[found]).all(axis=1)
        slot[~same] = -1
        size = np.frombuffer(x["copies"], np.int64).copy()
        np.add.at(size, slot[slot >= 0], incoming["copies"].to_numpy(dtype=np.int64)[slot >= 0])
        raw = bytes(x["digests"])
        ids = pd.Series(np.frombuffer(x["win_id"], np.int64)).astype("Int64")
        ids[np.unpackbits(np.frombuffer(x["win_null"], np.uint8), count=n).astype(bool)] = pd.NA
        out.append(pd.DataFrame({"digest": [raw[i * 32 : i * 32 + 32] for i in range(n)], "keep_id": ids, "keep_row": np.frombuffer(x["win_row"], np.int64), "group_size": size, "member": True}))
    new = incoming[slot < 0]
    out.append(pd.DataFrame({"digest": new["digest"], "keep_id": new["win_id"].astype("Int64"), "keep_row": new["win_row"], "group_size": new["copies"], "member": False}))
    return pd.concat(out, ignore_index=True)


def groups(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each distinct text of both tables once (GROUP_SCHEMA). A historical winner stays the winner.

    history, incoming: (digest, doc_id, row), ``row`` naming a row uniquely over both.
    """
    spark = history.sparkSession
    known = common.settle(distinct_digests(history), "history-digests")
    shards = common.partitions_for(spark, known.count(), SHARD_KEYS, least=64)
    index = common.settle(build_index(known, shards), "history-index")
    probes = distinct_digests(incoming).withColumn("shard", _shard_of(shards))
    return probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_meet, GROUP_SCHEMA)


def exact_dedup(documents: DataFrame, history_to: int | None = None) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256, known.

    Ids up to ``history_to`` are the history, the rest comes in and is looked up; by default the middle of the
    ids' range divides them, as if the table had arrived in two loads. The smallest id of equal texts stays.
    """
    docs = common.require(documents, "doc_id", "text")
    rows = common.settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest")), "digests")
    if history_to is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        history_to = 0 if low is None else low + (high - low) // 2
    old = F.coalesce(F.col("doc_id") <= F.lit(history_to), F.lit(False))
    found = common.settle(groups(rows.filter(old), rows.filter(~old)), "digest-groups")
    # Both sides are tables, so a digest that a third of the rows share is split by the adaptive skew join.
    return rows.join(found.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("known"))


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of equal texts."""
    name = lambda d, i: F.concat_ws(":", d, F.coalesce(i.cast("string"), F.lit("null")))
    kept = exact_dedup(documents).filter("kept").select(name(F.col("text_sha256"), F.col("doc_id")).alias("k"))
    return common.keep_keyed(documents, name(F.lower(F.hex(digest())), F.col("doc_id").cast("long")), kept)
