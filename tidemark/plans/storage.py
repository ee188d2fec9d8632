"""Where intermediate tables go, and how they are written once and read back."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            found = jdir.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold for a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: While a table is written: its shuffle files go when it is there, and what Python gets at a time is small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

#: The same for rows of thousands of numbers: the engine's reader else decodes 4,096 of them at once, which a task's memory doesn't hold.
WIDE = WRITING | {"spark.sql.parquet.columnarReaderBatchSize": "128"}


def materialize(df: DataFrame, name: str, held: dict[str, str] = WRITING) -> DataFrame:
    """Write df once to the shared folder and read it back: later steps neither recompute it nor lose it with an executor. `held`: settings that hold meanwhile."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, held):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Spark's own file system layer at a path, and the path as it takes it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = file_system(spark, path)
    return fs.exists(jpath)


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = file_system(spark, path)
    fs.delete(jpath, True)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, jpath = file_system(spark, path)
    return fs.getFileStatus(jpath).isFile()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, jpath = file_system(spark, path)
    stream = fs.open(jpath)
    try:
        return bytearray(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed, so a reader sees the whole or none of it."""
    fs, jpath = file_system(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part)
    stream.write(bytearray(text.encode()))
    stream.close()
    swap(spark, part.toString(), path)


def swap(spark: SparkSession, part: str, path: str) -> None:
    """Put a finished file or folder in place of what was there."""
    fs, new = file_system(spark, part)
    _, old = file_system(spark, path)
    fs.mkdirs(old.getParent())
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.old")
    had = fs.exists(old) and fs.rename(old, aside)
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"cannot put {part} at {path}")
    if had:
        fs.delete(aside, True)
