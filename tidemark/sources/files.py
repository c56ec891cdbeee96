"""Small files and folders on shared storage, through the file system that Spark itself uses."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a text file so that readers see all of it or what was there before: under another name, then renamed."""
    at, fs = _opened(spark, path)
    draft, _ = _opened(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(at), options)


def get_text(spark: SparkSession, path: str) -> str:
    at, fs = _opened(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names inside a folder; none where there is no such folder."""
    at, fs = _opened(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    at, fs = _opened(spark, path)
    return fs.getFileStatus(at).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _opened(spark, path)
    fs.delete(at, True)


def signature(spark: SparkSession, path: str) -> str:
    """Changes when a file at or below the path changes: names, sizes and times."""
    at, fs = _opened(spark, path)
    found, todo = [], [at]
    while todo:
        for s in fs.listStatus(todo.pop()):
            if s.isDirectory():
                todo.append(s.getPath())
            else:
                found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()
