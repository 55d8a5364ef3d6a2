"""Files and folders of the cluster's own store (any Hadoop file system), from the driver."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(_path(spark, path), True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none where it doesn't exist."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in file_system(spark, path).listStatus(_path(spark, path)))


def read_bytes(spark: SparkSession, path: str, most: int) -> bytes:
    """At most the first `most` bytes of a file."""
    stream = file_system(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    out = file_system(spark, path).create(_path(spark, path))
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def rename(spark: SparkSession, old: str, new: str) -> None:
    if not file_system(spark, old).rename(_path(spark, old), _path(spark, new)):
        raise OSError(f"could not rename {old} to {new}")


def read_json(spark: SparkSession, path: str) -> dict | None:
    return json.loads(read_bytes(spark, path, 1 << 20)) if exists(spark, path) else None


def replace_json(spark: SparkSession, path: str, value: dict) -> None:
    """Put a small file in place of the old one in one step."""
    jvm = spark.sparkContext._jvm
    new = f"{path}.{uuid.uuid4().hex}"
    write_bytes(spark, new, json.dumps(value).encode())
    over = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(_path(spark, new), _path(spark, path), options)
