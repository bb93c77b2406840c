"""Binary records of a write-ahead log and of a vector store, read into and written from DataFrames.

Both are little-endian. The offsets, the magic and the versions are fixed values of the formats.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.model import DELETE, PUT, CorruptRecord, InvalidVector

#: A frame's length and CRC; then its seq, type, key length and value length.
FRAME, BODY = struct.Struct("<II"), struct.Struct("<QBII")
MOST_BYTES = 64 << 20

#: A vector record: magic, version, dimension and metadata length; then CRC and magic again.
MAGIC, VERSION = 0x5348415244564543, 1
HEAD, FOOT = struct.Struct("<QHII"), struct.Struct("<IQ")


def encode_frame(seq: int, kind: int, key: bytes, value: bytes) -> bytes:
    body = BODY.pack(seq, kind, len(key), len(value)) + key + value
    return FRAME.pack(len(body), zlib.crc32(body)) + body


def decode_frames(raw: bytes, most_bytes: int = MOST_BYTES) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(seq, kind, key, value) in order. A frame that the file cuts off ends it; a whole one that is wrong is an error."""
    at = 0
    while at + FRAME.size <= len(raw):
        length, crc = FRAME.unpack_from(raw, at)
        if not BODY.size <= length <= most_bytes + BODY.size:
            raise CorruptRecord(f"a frame at {at} has {length} bytes")
        at += FRAME.size
        if at + length > len(raw):
            return
        body = raw[at : at + length]
        if zlib.crc32(body) != crc:
            raise CorruptRecord(f"the frame before {at} doesn't match its checksum")
        seq, kind, keys, values = BODY.unpack_from(body)
        if kind not in (PUT, DELETE) or not keys or BODY.size + keys + values != length:
            raise CorruptRecord(f"the frame before {at} has fields that disagree")
        yield seq, kind, body[BODY.size : BODY.size + keys], body[BODY.size + keys :]
        at += length


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value, seq, kind) of all log files below ``path``, a task for each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, raw in zip(files["path"], files["content"], strict=True):
                rows = [(name, k, v if kind == PUT else None, s, kind) for s, kind, k, v in decode_frames(bytes(raw))]
                yield pd.DataFrame(rows, columns=["file", "key", "value", "seq", "kind"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, key binary, value binary, seq bigint, kind tinyint")


def encode_vector(vector: list[float], metadata: bytes = b"") -> bytes:
    body = np.asarray(vector, "<f4").tobytes() + bytes(metadata)
    head = HEAD.pack(MAGIC, VERSION, len(vector), len(metadata))
    return head + body + FOOT.pack(zlib.crc32(head[8:] + body), MAGIC)


def decode_vector(raw: bytes, dimension: int) -> tuple[np.ndarray, bytes]:
    if len(raw) < HEAD.size + FOOT.size:
        raise CorruptRecord("a vector record is too short")
    magic, version, dim, meta = HEAD.unpack_from(raw)
    end = HEAD.size + 4 * dim + meta
    if magic != MAGIC or version != VERSION or dim != dimension or len(raw) != end + FOOT.size:
        raise CorruptRecord("a vector record's fields disagree")
    if FOOT.unpack_from(raw, end) != (zlib.crc32(raw[8:end]), MAGIC):
        raise CorruptRecord("a vector record doesn't match its checksum")
    return np.frombuffer(raw, "<f4", dim, HEAD.size), raw[HEAD.size + 4 * dim : end]


def encode_column(dimension: int):
    """A column function (vector, metadata): records over Arrow batches."""

    @F.pandas_udf("binary")
    def encode(vectors: pd.Series, metadata: pd.Series) -> pd.Series:
        out = []
        for v, m in zip(vectors, metadata, strict=True):
            if v is None or len(v) != dimension:
                raise InvalidVector("wrong dimension")
            out.append(encode_vector(v, b"" if m is None else bytes(m)))
        return pd.Series(out, dtype=object)

    return encode


def decode_column(dimension: int):
    """A column function: records to (vector, metadata)."""

    @F.pandas_udf("vector array<float>, metadata binary")
    def decode(raws: pd.Series) -> pd.DataFrame:
        rows = [decode_vector(bytes(r), dimension) for r in raws]
        return pd.DataFrame({"vector": [v for v, _ in rows], "metadata": [m for _, m in rows]})

    return decode
