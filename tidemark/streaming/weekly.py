"""The weekly share as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.storage import is_file, new_path


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    if is_file(spark, path):
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a folder or a pattern
    return spark.readStream.schema(schema).parquet(path)


def stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by app and Monday week: equal to the batch aggregation once all input is read."""
    home = new_path(spark, "stream")
    events = _source(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    weekly = events.groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w"), F.concat(F.lit("app"), F.col("user_id") % 4).alias("app")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out")  # complete mode: each batch has everything

    weekly.writeStream.outputMode("complete").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    out = spark.read.parquet(f"{home}/out")
    return out.select("app", F.date_format("w.start", "yyyy-MM-dd").alias("week"), "n", "errors")


QUERIES = {"stream_weekly": stream_weekly}
ORACLES = {
    "stream_weekly": "SELECT 'app' || CAST(user_id % 4 AS STRING) AS app, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2",
}
