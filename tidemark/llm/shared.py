"""What several operators use: tables in the shared folder, and memory that goes back after a task."""

from __future__ import annotations

import ctypes
import gc
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.storage import WRITING, is_file, materialize, new_path, remove, settings


def small_batches(spark: SparkSession) -> None:
    """From now on texts come to Python in small batches, in what the caller runs later too. A smaller setting of the session's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = str(spark.conf.get(name)).lower()
    if own in ("-1", "64m", "67108864b", "67108864"):  # as the engine sets it
        spark.conf.set(name, WRITING[name])


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later step reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def trimmed(f):
    """A function over Arrow batches that gives memory back to the system when its task ends: workers outlive tasks."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def blob_partitions(df: DataFrame, total: int, each: int) -> int:
    """Partitions for `total` units of work at `each` per task, and at least what the session asks for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each), 1)


def crc32_bucket(col: str, n: int):
    """crc32 of a value's text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


__all__ = ["WRITING", "blob_partitions", "crc32_bucket", "discard", "is_file", "materialize", "new_path", "remove", "settings", "small_batches", "trimmed"]
