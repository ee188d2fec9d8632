"""Texts as vectors: hashed tf-idf of words and character runs, and its signed random projection.

A text's words and pairs of words fall into one half of 2 * BUCKETS buckets, its
character runs into the other; a bucket's weight is (1 + ln tf) times idf, and
each half has length 1. Document frequencies are counted by bucket, so what the
driver gets and tasks are sent is one number a bucket, whatever the vocabulary.

The projection sums a row of random signs for each bucket, times its weight: the
cosine of two projections is that of the tf-idf vectors with a deviation of about
1 / sqrt(dimensions).

Defined results: null, empty and wordless texts have no bucket; their projection
is all 0. Repeated rows count in document frequencies each. Only the named columns
are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import density
from tidemark.plans.storage import WIDE, materialize, settings
from tidemark.plans.views import view

QUERIES = {}
PARTS, BUCKETS, DIMENSIONS, SEED = ("word", "char"), 1 << 13, 256, 3
#: Texts that are projected at once.
AT_ONCE = 256
WORD = re.compile(r"\w+")


def query(f):
    QUERIES[f.__name__] = f
    return f


def char_grams(text: str) -> list[str]:
    """Runs of 3 to 5 characters in each word with a blank on either side; shorter words once, whole."""
    grams = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(3, min(5, len(padded)) + 1):
            grams += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return grams


def word_grams(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def terms(text: str | None) -> dict[str, Counter]:
    return {"word": Counter(word_grams(text or "")), "char": Counter(char_grams(text or ""))}


@lru_cache(1 << 18)
def bucket(part: str, term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) % BUCKETS + BUCKETS * PARTS.index(part)


def spaced(words: list[str]) -> np.ndarray:
    """Code points of the words with a blank between and around them."""
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"), np.uint32)


def runs(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """3 to 5, and where runs of that length start that char_grams() has: those with blanks at their ends alone."""
    inside = points != 32
    fits = np.ones(len(points), bool)
    for n in (3, 4, 5):
        fits = fits[: max(0, len(points) - n + 1)] & inside[n - 2 : max(n - 2, len(points) - 1)]
        yield n, np.flatnonzero(fits)


#: What crc32 does with a byte: of one byte's crc, without what its start and end add.
_TABLE = np.array([~zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFFFFFF for i in range(256)], np.int64).astype(np.uint32)


def _run_crcs(points: np.ndarray) -> np.ndarray:
    """crc32 of the UTF-8 of each of runs(): from every place a character further at a time, so that longer runs go on from shorter ones."""
    wide = np.flatnonzero(points >= 0x80)
    lead = points.copy()
    lead[wide] = np.select([(p := points[wide]) >= 0x10000, p >= 0x800], [0xF0 | p >> 18, 0xE0 | p >> 12], 0xC0 | p >> 6)
    tails = [(at := wide[points[wide] >= least], 0x80 | points[at] >> shift & 0x3F) for shift, least in ((12, 0x10000), (6, 0x800), (0, 0x80))] if len(wide) else []
    crc, starts, out = np.full(len(points), 0xFFFFFFFF, np.uint32), dict(runs(points)), []
    for i in range(5):
        crc = crc[: max(0, len(points) - i)]
        crc = _TABLE[(crc ^ lead[i:]) & 0xFF] ^ (crc >> 8)
        for at, byte in tails:
            there = at >= i
            own = at[there] - i
            crc[own] = _TABLE[(crc[own] ^ byte[there]) & 0xFF] ^ (crc[own] >> 8)
        if i >= 2:
            out.append(~crc[starts[i + 1]])
    return np.concatenate(out)


def bucket_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in ascending order, and how often each occurs: those of all terms()."""
    lowered = (text or "").lower()
    words = " ".join(WORD.findall(lowered)).encode("utf-8", "replace").split()
    crcs = list(map(zlib.crc32, words))
    crcs += map(zlib.crc32, [b" " + b for b in words[1:]], crcs[:-1])
    counts = np.bincount(np.concatenate([np.array(crcs, np.int64) % BUCKETS, (_run_crcs(spaced(lowered.split())) % BUCKETS).astype(np.int64) + BUCKETS]), minlength=len(PARTS) * BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at].astype(np.int32)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def parts_of(lists: pa.ListArray, kind: type) -> list[np.ndarray]:
    return np.split(lists.flatten().to_numpy(zero_copy_only=False).astype(kind), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py()) if len(lists) else []


def counted(rows: DataFrame, text_col: str = "content") -> DataFrame:
    """rows with `at` and `n` (buckets, and how often each occurs) instead of the text, written once."""

    @F.arrow_udf("struct<at: array<int>, n: array<int>>")
    def count(texts: pa.Array) -> pa.Array:
        found = [bucket_counts(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([_lists([a for a, _ in found], pa.int32()), _lists([n for _, n in found], pa.int32())], ["at", "n"])

    cores = rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)  # a table of few splits
    return materialize(dealt.withColumn("found", count(text_col)).drop(text_col).select("*", "found.*").drop("found"), "buckets", WIDE)


def frequencies(rows: DataFrame) -> np.ndarray:
    """How many rows have each bucket."""
    df = np.zeros(len(PARTS) * BUCKETS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum((np.bincount(batch.column(0).flatten(), minlength=len(df)) for batch in batches), np.zeros(len(df), np.int64))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["at", "n"])

    with settings(rows.sparkSession, WIDE):
        for r in rows.select("at").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a bucket
            df[r.at] = r.n
    return df


def idf_of(df: np.ndarray, rows: int, min_df: int = 1) -> np.ndarray:
    """idf of each bucket, 0 where fewer than min_df rows have it."""
    return np.where(df >= min_df, np.log((1.0 + rows) / (1.0 + df)) + 1.0, 0.0)


def weights(rows: DataFrame, min_df: int = 1) -> np.ndarray:
    return idf_of(frequencies(rows), rows.count(), min_df)


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that count and their weights; each half has length 1."""
    x = (1.0 + np.log(n)) * idf[at]
    keep = x > 0
    at, x = at[keep], x[keep]
    half = np.searchsorted(at, BUCKETS)
    for part in (x[:half], x[half:]):
        part /= np.sqrt((part * part).sum()) or 1.0
    return at, x


def sparse_vectors(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """rows of counted() with `features`, as a sparse vector of Spark's models: written in the vector's own layout, and read as one."""
    known, size = rows.sparkSession.sparkContext.broadcast(idf), len(idf)  # one number a bucket

    @F.arrow_udf("struct<type: tinyint, size: int, indices: array<int>, values: array<double>>")
    def vectors(at: pa.Array, n: pa.Array) -> pa.Array:
        found = [weigh(a, c, known.value) for a, c in zip(parts_of(at, np.int64), parts_of(n, float), strict=True)]
        m = len(found)
        return pa.StructArray.from_arrays([pa.array(np.zeros(m), pa.int8()), pa.array(np.full(m, size), pa.int32()), _lists([a for a, _ in found], pa.int32()), _lists([x for _, x in found], pa.float64())], ["type", "size", "indices", "values"])

    written = materialize(rows.withColumn("features", vectors("at", "n")).drop("at", "n"), "features", WIDE)
    schema = T.StructType([T.StructField("features", VectorUDT()) if f.name == "features" else f for f in written.schema])
    return rows.sparkSession.read.schema(schema).parquet(*{f.rsplit("/", 1)[0] for f in written.inputFiles()}) if written.inputFiles() else rows.sparkSession.createDataFrame([], schema)


@lru_cache(1)
def _signs(dimensions: int) -> np.ndarray:
    return (np.random.default_rng(SEED).integers(0, 2, (len(PARTS) * BUCKETS, dimensions), dtype=np.int8) * 2 - 1).astype(float)


_PACKED = np.dtype([("at", "<i2"), ("n", "<i4")])


def packed(rows: DataFrame, text_col: str = "content") -> DataFrame:
    """rows with `counts`, the bytes of what counted() gives as lists: thousands of numbers a row are written and read in one piece."""

    @F.arrow_udf("binary")
    def count(texts: pa.Array) -> pa.Array:
        def one(text: str | None) -> bytes:
            at, n = bucket_counts(text)
            both = np.empty(len(at), _PACKED)
            both["at"], both["n"] = at, n
            return both.tobytes()

        return pa.array([one(t.as_py()) for t in texts], pa.binary())

    cores = rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)  # a table of few splits
    return materialize(dealt.withColumn("counts", count(text_col)).drop(text_col), "buckets", WIDE)


def packed_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many rows of packed() have each bucket, and how many rows there are."""
    size = len(PARTS) * BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 1, np.int64)  # the last: rows
        for batch in batches:
            n[:-1] += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), _PACKED)["at"], minlength=size)
            n[-1] += len(batch)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["at", "n"])

    found = np.zeros(size + 1)
    with settings(rows.sparkSession, WIDE):
        for r in rows.select("counts").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a bucket
            found[r.at] = r.n
    return found[:-1], int(found[-1])


def embed(rows: DataFrame, text_col: str = "content", dimensions: int = DIMENSIONS) -> DataFrame:
    """rows with `embedding` (of length 1) instead of the text."""
    buckets = packed(rows, text_col)
    idf = rows.sparkSession.sparkContext.broadcast(idf_of(*packed_frequencies(buckets)))

    @F.arrow_udf("array<float>")
    def project(counts: pa.Array) -> pa.Array:
        out = np.zeros((len(counts), dimensions), np.float32)
        for lo in range(0, len(counts), AT_ONCE):
            some = [np.frombuffer(c.as_py(), _PACKED) for c in counts[lo : lo + AT_ONCE]]
            wide = np.zeros((len(some), len(idf.value)))
            for row, own in zip(wide, some, strict=True):
                a, x = weigh(own["at"].astype(np.int64), own["n"].astype(float), idf.value)
                row[a] = np.round(x * 2.0**40) / 2.0**40  # sums are exact in any order, so copies of a text have one vector
            v = wide @ _signs(dimensions)
            length = np.sqrt((v * v).sum(axis=1, keepdims=True))
            out[lo : lo + AT_ONCE] = v / np.where(length > 0, length, 1)
        return _lists(list(out), pa.float32())

    return materialize(buckets.withColumn("embedding", project("counts")).drop("counts"), "embedded", WIDE)  # written so that tasks get a little at a time


@query
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of length 1 for each text."""
    return embed(view(spark, sf_dir, "texts").select("review_id", "content"))


@query
def topics_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics found from texts alone: review_id, cluster by density of the texts' vectors; -1: none."""
    return density.density_clusters(embed_texts(spark, sf_dir), least=5)
