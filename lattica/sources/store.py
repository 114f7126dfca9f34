"""Files of any store, by Hadoop's file system."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def reach(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = reach(spark, path)
    return fs.exists(p)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern matches, in order, without hidden names."""
    fs, p = reach(spark, pattern)
    paths = [s.getPath() for s in fs.globStatus(p) or ()]
    return sorted(q.toString() for q in paths if q.getName()[0] not in "._")


def name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def folder(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0]


def delete(spark: SparkSession, path: str) -> None:
    fs, p = reach(spark, path)
    fs.delete(p, True)


def _written(spark: SparkSession, path: str, text: str):
    fs, temp = reach(spark, f"{folder(path)}/.{name(path)}-{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    sc = spark.sparkContext
    files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    return fs, files, temp, fs.makeQualified(reach(spark, path)[1])


def _rename(spark: SparkSession, files, temp, final, how: str) -> None:
    rename = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename")
    option = spark.sparkContext._gateway.new_array(rename, 1)
    option[0] = getattr(rename, how)
    files.rename(temp, final, option)


def replace(spark: SparkSession, path: str, text: str) -> None:
    """A file with this text under the path in one step: a reader sees the old text or the new one."""
    fs, files, temp, final = _written(spark, path, text)
    _rename(spark, files, fs.makeQualified(temp), final, "OVERWRITE")


def create(spark: SparkSession, path: str, text: str) -> bool:
    """The same if there is no such file yet; whether it was made. A rename that doesn't replace is one step in
    HDFS, so of two writers at once one gets False."""
    fs, files, temp, final = _written(spark, path, text)
    try:
        _rename(spark, files, fs.makeQualified(temp), final, "NONE")
        return True
    except Py4JJavaError as e:
        fs.delete(temp, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
