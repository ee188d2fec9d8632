"""Results of costly functions of texts, kept in a bucketed table by what they depend on.

The key is the digest of model, prefix, greatest length and text, each with its
length before it, so that no two settings share a key. The table is bucketed and
sorted by key: a look-up shuffles the texts asked for, never the cache. What is
lacking is computed once for each distinct text and appended; a run that fails
leaves the table as it was, and two that overlap may append a key twice, of which
the look-up takes one.

Defined results: null texts have no result; equal texts share one; empty text is
a text; an empty table asks for nothing. A place opened with other columns or
another number of buckets is refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.storage import exists, new_path, read_text, write_text
from tidemark.plans.views import duck
from tidemark.sources.files import ContractError

QUERIES, ORACLES = {}, {}


@dataclass(frozen=True)
class Settings:
    """What a result depends on beside the text."""

    model: str
    prefix: str = ""
    max_length: int | None = None

    def key(self, text: Column) -> Column:
        own = "".join(f"{len(v)}:{v}," for v in (self.model, self.prefix, str(self.max_length)))
        return F.sha2(F.concat(F.lit(own), text), 256)


class ResultCache:
    """A cache at a folder; columns are those of a result, as DDL."""

    def __init__(self, spark: SparkSession, home: str, columns: str, buckets: int = 200):
        self.spark, self.home = spark, home.rstrip("/")
        about, place = {"columns": columns, "buckets": buckets}, f"{self.home}/cache.json"
        if exists(spark, place):
            if (had := json.loads(read_text(spark, place))) != about:
                raise ContractError(f"{home} is a cache of {had}, not of {about}")
        else:
            write_text(spark, place, json.dumps(about))
        self.name, self.buckets = f"tidemark_cache_{hashlib.sha256(self.home.encode()).hexdigest()[:24]}", buckets
        # The catalog only says where the table is; a later session says it again.
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (key STRING, {columns}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{self.home}/rows'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def lacking(self, texts: DataFrame, text_col: str, settings: Settings) -> DataFrame:
        """key, text: the distinct texts that have no result under these settings."""
        asked = self._asked(texts, text_col, settings)
        return asked.join(self.rows().select(F.col("key").alias("__key")), F.col("key") == F.col("__key"), "left_anti")

    def results(self, texts: DataFrame, text_col: str, settings: Settings, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """key and result of the distinct texts; `compute` makes key and result columns of rows (key, text), for those lacking."""
        made = compute(self.lacking(texts, text_col, settings)).select(self.rows().columns)
        # One file a bucket and append; a key has one row of this append, as texts are distinct.
        made.repartition(self.buckets, "key").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.look_up(self._asked(texts, text_col, settings).select("key"))

    def look_up(self, keys: DataFrame) -> DataFrame:
        """The rows of some distinct keys, one each."""
        return self.rows().join(keys.select(F.col("key").alias("__key")), F.col("key") == F.col("__key"), "left_semi").dropDuplicates(["key"])

    def _asked(self, texts: DataFrame, text_col: str, settings: Settings) -> DataFrame:
        given = texts.select(F.col(text_col).alias("text")).where("text is not null").select(settings.key(F.col("text")).alias("key"), "text")
        return given.groupBy("key").agg(F.any_value("text").alias("text"))


def _lengths(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.sha2("text", 256).alias("h"), F.length("text").cast("long").alias("n"))


def embed_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer documents' results are kept first; then only what the cache lacks of all documents is computed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "n_chars")
    cache, own = ResultCache(spark, new_path(spark, "cache"), "h STRING, n BIGINT", 16), Settings("length", "query: ", 128)
    cache.results(docs.where("n_chars > 500"), "text", own, _lengths)
    return cache.results(docs, "text", own, _lengths).select("h", "n")


QUERIES["embed_cache_miss"] = embed_cache_miss
ORACLES["embed_cache_miss"] = duck("SELECT h.sha AS h, n FROM (SELECT sha256(text) AS sha, length(any_value(text)) AS n FROM {documents} WHERE text IS NOT NULL GROUP BY 1) AS h")
