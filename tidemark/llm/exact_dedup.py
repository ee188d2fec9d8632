"""Exact deduplication as a stateful stream.

Documents arrive as files; a streaming aggregation keyed by the text's digest
keeps, in RocksDB state that never expires, how many texts had the digest, the
identifier of the row that stays (the largest) and where its content lies
(file and row). Its state survives between calls: a later `ingest` reads only
files that are new. A digest alone decides nothing: all rows of a digest that
was hit are compared byte by byte with the content of the row that stays, and
texts that differ despite equal digests are told apart.

Defined results: null text counts as empty; empty texts are equal to each
other; rows with null id lose against any other; repeated rows are copies (of
rows equal in id and text, the one last in file order stays); an empty table
gives an empty result. Only the id and text columns are read, so other columns
and their names don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import is_file, materialize, new_path, settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A store is closed once its batch is committed: left open, each keeps files of its own, whatever it holds.
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}


def sha256(text):
    return F.sha2(text, 256)


class StreamingExactDedup:
    """Deduplicates all files ever seen under `path`; `home` holds checkpoint and decisions."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int = 1000, home: str | None = None):
        self.spark, self.path, self.id_col, self.text_col, self.digest, self.files_per_batch = spark, path, id_col, text_col, digest, files_per_batch
        self.home = home or new_path(spark, "exact-dedup")

    def _rows(self, source: DataFrame) -> DataFrame:
        """id, digest, locator and text of each row."""
        text = F.coalesce(F.col(self.text_col), F.lit(""))
        locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        return source.select(F.col(self.id_col).alias("id"), self.digest(text).alias("digest"), locator.alias("locator"), text.alias("content"))

    def ingest(self) -> None:
        """Take in all files that are new; returns when their state is committed."""
        schema = self.spark.read.parquet(self.path).select(self.id_col, self.text_col).schema
        where = self.path
        if is_file(self.spark, where):  # a stream takes a folder or a pattern
            where = f"{where[:-1]}[{where[-1]}]"
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(where)
        state = self._rows(stream).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "locator")).alias("keep"))
        decisions = f"{self.home}/decisions"

        def commit(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{decisions}/batch={batch}")  # a repeated batch writes the same

        with settings(self.spark, STATE):
            query = state.writeStream.outputMode("update").option("checkpointLocation", f"{self.home}/checkpoint").trigger(availableNow=True).foreachBatch(commit).start()
            query.awaitTermination()

    def state(self) -> DataFrame:
        """What the state holds: digest, n, keep (id, locator). Counts and ids only grow, so each digest's largest are its last."""
        changes = self.spark.read.schema("digest string, n long, keep struct<id: long, locator: struct<file: string, row: long>>").parquet(f"{self.home}/decisions/*")
        return changes.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"))

    def result(self) -> DataFrame:
        """One row per document: id, keep_id, group_size, kept, digest."""
        rows = self._rows(self.spark.read.parquet(self.path))
        state = materialize(self.state(), "exact-dedup-state")
        hits = rows.join(state.where("n > 1"), "digest")
        hits = materialize(hits, "exact-dedup-hits")  # text of groups only
        kept = hits.where(F.col("locator") == F.col("keep.locator")).select("digest", F.col("content").alias("keep_content"))
        # Whatever differs from the content at the locator is a group by itself, of the rows with its bytes.
        checked = hits.join(kept, "digest").withColumn("odd", F.when(F.col("content") != F.col("keep_content"), F.col("content")))
        odd = checked.where("odd is not null")
        mine = rows.drop("content")
        if odd.isEmpty():
            joined = mine.join(state, "digest")
        else:
            groups = checked.groupBy("digest", "odd").agg(F.count("*").alias("n"), F.max(F.struct("id", "locator")).alias("keep"))
            split = checked.select("digest", "locator", "odd").join(groups.withColumnRenamed("digest", "d").withColumnRenamed("odd", "o"), (F.col("digest") == F.col("d")) & F.col("odd").eqNullSafe(F.col("o")))
            split = split.select(F.col("locator").alias("at"), F.col("n").alias("own_n"), F.col("keep").alias("own_keep"))
            joined = mine.join(state, "digest").join(split, F.col("locator") == F.col("at"), "left")
            joined = joined.withColumn("n", F.coalesce("own_n", "n")).withColumn("keep", F.coalesce("own_keep", "keep"))
        return joined.select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("keep.locator")).alias("kept"), "digest")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dedup = StreamingExactDedup(spark, f"{sf_dir}/documents.parquet")
    dedup.ingest()
    return dedup.result().select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
