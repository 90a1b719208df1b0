"""Small driver-side file operations through Hadoop's FileSystem, so that any store Spark can reach works."""
from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the file whole or not at all, and never over another one: False if the name is taken.

    A temporary sibling gets the final name by an operation that refuses an existing one: a hard link on a local disk,
    a rename without overwriting (one step of the name node) elsewhere."""
    fs, p = _fs(spark, path)
    p = fs.makeQualified(p)
    tmp = f".{p.getName()}.{uuid.uuid4().hex}"
    fs.mkdirs(p.getParent())
    if p.toUri().getScheme() == "file":
        target = p.toUri().getPath()
        sibling = os.path.join(os.path.dirname(target), tmp)
        with open(sibling, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(sibling, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(sibling)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    sibling = jvm.org.apache.hadoop.fs.Path(p.getParent(), tmp)
    out = fs.create(sibling, False)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(sibling, p, options)
        return True
    except Py4JJavaError as e:
        fs.delete(sibling, False)
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise


def rename(spark: SparkSession, path: str, to: str) -> bool:
    """False if it could not be moved."""
    fs, p = _fs(spark, path)
    return fs.rename(p, _fs(spark, to)[1])


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
