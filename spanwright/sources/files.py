"""The few file operations that Spark's readers and writers do not have, by Spark's own file systems: any path that Spark reads works.

They go through the session's JVM, so the session must be a classic one.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, in order; a missing one holds nothing."""
    fs, where = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def read(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small text file as a whole, or not at all; False if there is one already.

    The text is written aside and then renamed without replacing, which is one step where the file system has such a rename
    (HDFS; a local one looks first). So of several writers one wins, and what a lost writer leaves is a ``.tmp`` file.
    """
    fs, where = _at(spark, path)
    if fs.exists(where):
        return False
    fs.mkdirs(where.getParent())
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    no_options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    context = hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(where), no_options)
    except Exception as e:
        fs.delete(aside, False)
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def replace(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file over another one."""
    fs, where = _at(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(to)
    fs.mkdirs(target.getParent())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(where), fs.makeQualified(target), options)
