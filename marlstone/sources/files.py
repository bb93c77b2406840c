"""Small pointer and state files on whatever file system Spark reads: written aside, then renamed into place."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
import zlib

from pyspark.sql import SparkSession

from marlstone.model import CorruptRecord, InvalidOptions


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    aside, fs = _fs(spark, f"{path}.tmp")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    finally:
        stream.close()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, where, rename)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    where, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def move(spark: SparkSession, old: str, new: str) -> None:
    """Moves a folder to a place that must be free."""
    source, fs = _fs(spark, old)
    target, _ = _fs(spark, new)
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        raise CorruptRecord(f"{new} is there already, or {old} can't be moved")


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """A JSON record with the CRC of its other fields."""
    body = json.dumps(record, sort_keys=True)
    write_text(spark, path, json.dumps(record | {"checksum": zlib.crc32(body.encode())}, sort_keys=True))


def read_record(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, path)
    if text is None:
        return None
    try:
        record = json.loads(text)
        checksum = record.pop("checksum")
    except (ValueError, KeyError, AttributeError) as e:
        raise CorruptRecord(f"{path} is no record") from e
    if zlib.crc32(json.dumps(record, sort_keys=True).encode()) != checksum:
        raise CorruptRecord(f"{path} doesn't match its checksum")
    return record


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file whole, for instance an imported record."""
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master may do with a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise InvalidOptions(f"spark.checkpoint.dir must name a shared folder on {master}")
    if master not in _own_roots:
        _own_roots[master] = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
    return _own_roots[master]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the driver ends."""
    path = f"{shared_root(spark)}/marlstone/{name}-{uuid.uuid4().hex}"
    atexit.register(_sweep, spark, path)
    return path


def _sweep(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, path)
