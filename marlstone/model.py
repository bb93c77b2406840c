"""Schemas, operation kinds, errors and validators."""

from __future__ import annotations

import math

from pyspark.sql import types as T

PUT, DELETE = 1, 2

#: An operation log over byte keys, as files hold it. ``kind`` tells a tombstone, never a null value.
LOG = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType()), T.StructField("seq", T.LongType(), False), T.StructField("kind", T.ByteType(), False)])
#: A replication journal.
JOURNAL = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType()), T.StructField("timestamp", T.TimestampType())])
#: A step of a trace.
STEP = T.StructType([T.StructField("component", T.StringType()), T.StructField("step_type", T.StringType()), T.StructField("status", T.StringType()), T.StructField("duration_ns", T.LongType()), T.StructField("detail", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


class StoreError(Exception):
    """Any error of this package; ``code`` is stable."""

    code = "internal"


class InvalidKey(StoreError):
    code = "invalid_key"


class InvalidVector(StoreError):
    code = "invalid_vector"


class InvalidOptions(StoreError):
    code = "invalid_options"


class Closed(StoreError):
    code = "closed"


class CorruptRecord(StoreError):
    code = "corrupt_record"


class ShardMismatch(StoreError):
    code = "shard_mismatch"


class NotFollower(StoreError):
    code = "not_follower"


class NotLeader(StoreError):
    code = "not_leader"


class SequenceHole(StoreError):
    code = "sequence_hole"


class SyncInProgress(StoreError):
    code = "sync_in_progress"


class NodeQuiesced(StoreError):
    """The node takes no more writes: it was quiesced, or a quiesce was begun."""

    code = "node_quiesced"


class QuiesceFailedFenced(NodeQuiesced):
    """A quiesce was begun and not finished; the fence stays until it is repeated."""

    code = "quiesce_failed_fenced"


class UnknownNode(StoreError):
    code = "unknown_node"


class PromotionNotReady(InvalidOptions):
    code = "promotion_not_ready"


class PromotionSequenceMismatch(InvalidOptions):
    code = "promotion_sequence_mismatch"


class PromotionSourceMismatch(InvalidOptions):
    code = "promotion_source_mismatch"


class PromotionRecordInvalid(InvalidOptions):
    code = "promotion_record_invalid"


class AlreadyPromoted(InvalidOptions):
    code = "already_promoted"


class ReplicationGap(StoreError):
    """The journal no longer has what a follower needs next."""

    code = "replication_gap"

    def __init__(self, requested_after: int, first_available_seq: int, latest_seq: int) -> None:
        super().__init__(f"entries after {requested_after} asked for, the first available is {first_available_seq}, the latest {latest_seq}")
        self.requested_after, self.first_available_seq, self.latest_seq = requested_after, first_available_seq, latest_seq


def require_key(key: bytes | str) -> bytes | str:
    if not key:
        raise InvalidKey("a key needs at least one byte")
    return key


def require_id(name: str) -> str:
    if not name or "/" in name or any(ord(c) < 0x20 for c in name):
        raise InvalidVector(f"not a vector id: {name!r}")
    return name


def require_vector(vector: list[float], dimension: int, metric: str) -> list[float]:
    if len(vector) != dimension:
        raise InvalidVector(f"{len(vector)} components where {dimension} are expected")
    if not all(math.isfinite(x) for x in vector):
        raise InvalidVector("a component is not finite")
    if metric == "cosine" and not any(vector):
        raise InvalidVector("the zero vector has no direction")
    return vector
