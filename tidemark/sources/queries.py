"""Queries that go through the sources and sinks: what is written and read back must be what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.storage import new_path
from tidemark.plans.views import duck, view
from tidemark.sources.files import ContractError, read_config, read_report, read_sheet, read_union, replace_table, write_report, write_sheet, write_workbook
from tidemark.sources.paged import Ingest, publish

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, duck(sql)
        return f

    return add


@query("SELECT review_id, app, ts FROM {reviews}")
def scan_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file an app, each put in place whole and then again, and all of them read as one table."""
    home, reviews = new_path(spark, "apps"), view(spark, sf_dir, "reviews")
    apps = [r.app for r in reviews.select("app").distinct().orderBy("app").collect()]  # the configured apps, a few
    for app in apps:
        replace_table(reviews.where(F.col("app") == app), f"{home}/{app}.parquet")
    replace_table(reviews.where(F.col("app") == apps[0]), f"{home}/{apps[0]}.parquet")
    return read_union(spark, [f"{home}/{app}.parquet" for app in apps], ["review_id", "app", "ts"])


_SHEET = "SELECT CAST(doc_id AS STRING) AS gold_id, nullif(trim(text), '') AS text, CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' END AS label, CASE WHEN toxic = 1 THEN 'toxic, \"quoted\"' END AS notes FROM {documents} d JOIN {labels} l USING (doc_id)"


@query(f"SELECT * FROM ({_SHEET}) AS s UNION ALL SELECT '-1', NULL, NULL, NULL")
def sheet_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label sheet written as delimited text, with padded labels in capitals, blank rows and texts with quotes and line ends, and read back."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    label = F.when(F.col("quality") == 1, " Positive ").when(F.col("quality") == 0, "NEGATIVE")
    rows = docs.join(labels, "doc_id").select(F.col("doc_id").cast("string").alias("gold_id"), "text", label.alias("label"), F.when(F.col("toxic") == 1, 'toxic, "quoted"').alias("notes"))
    blank = spark.createDataFrame([(None, "  ", None, " "), ("-1", None, " ", "")], rows.schema)
    path = new_path(spark, "sheet")
    write_sheet(rows.unionByName(blank), path)
    return read_sheet(spark, path, ["gold_id", "text", "label", "notes"])


@query("SELECT 'labels' AS sheet, CAST(doc_id AS STRING) AS id, CAST(quality AS STRING) AS value FROM {labels} UNION ALL SELECT 'items', CAST(item_id AS STRING), trim(text) FROM {benchmark}")
def sheet_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of two sheets, read back; a second export to its place is refused."""
    folder = new_path(spark, "workbook")
    sheets = {
        "labels": spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("value")),
        "items": spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("value")),
    }
    write_workbook(sheets, folder)
    try:
        write_workbook(sheets, folder)
        raise AssertionError("a workbook was overwritten")
    except ContractError:
        pass
    back = [read_sheet(spark, f"{folder}/{name}", ["id", "value"]).select(F.lit(name).alias("sheet"), "id", "value") for name in sheets]
    return back[0].unionByName(back[1])


@query("SELECT app, count(*) AS n, round(count_if(is_complaint) / count(*)::DOUBLE, 4) AS share FROM {reviews} WHERE score <= 2 GROUP BY app")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report of a few rows, made by a configuration, and read back."""
    home = new_path(spark, "report")
    write_report(spark, f"{home}/config.yaml", {"most_stars": 2, "columns": ["app", "n", "share"]})  # JSON is YAML
    config = read_config(spark, f"{home}/config.yaml", ("most_stars", "columns"))
    rows = view(spark, sf_dir, "reviews").where(F.col("score") <= config["most_stars"]).groupBy("app").agg(F.count("*").alias("n"), F.round(F.count_if("is_complaint").cast("double") / F.count("*"), 4).alias("share"))
    write_report(spark, f"{home}/report.json", {"rows": [r.asDict() for r in rows.collect()]})  # a row an app
    return spark.createDataFrame(read_report(spark, f"{home}/report.json")["rows"], "app string, n long, share double").select(*config["columns"])


@query("SELECT event_id, event_type FROM {events} WHERE ts >= TIMESTAMP '2024-01-08 00:00:00'")
def paged_ingest(spark: SparkSession, sf_dir: str, since: str = "2024-01-08") -> DataFrame:
    """Events in pages, newest first, until one is older than `since`; stopped after two pages and gone on with, once each."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    listing, home = new_path(spark, "listing"), new_path(spark, "ingest")
    publish(events, "event_id", "ts", -(-events.count() // 6) or 1, listing)
    if Ingest(spark, listing, home, since=since).run(max_pages=2) is None:
        Ingest(spark, listing, home, since=since).run()
    return Ingest(spark, listing, home, since=since).rows().select("event_id", "event_type")


@query("SELECT event_id, event_type FROM {events}")
def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of pages, newest first, with every fourth event listed twice; each is taken once."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    listing = new_path(spark, "listing")
    publish(events.unionAll(events.where("event_id % 4 = 0")), "event_id", "ts", -(-events.count() // 4) or 1, listing)
    ingest = Ingest(spark, listing, new_path(spark, "ingest"))
    if (stop := ingest.run()) != "exhausted":
        raise ContractError(stop)
    return ingest.rows().select("event_id", "event_type")


@query("SELECT event_id, event_type FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 700")
def paged_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 700 events, the last page cut: a row cap is the feature."""
    listing = new_path(spark, "listing")
    publish(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type"), "event_id", "ts", 300, listing)
    ingest = Ingest(spark, listing, new_path(spark, "ingest"), cap=700)
    if (stop := ingest.run()) not in ("cap", "exhausted"):
        raise AssertionError(stop)
    return ingest.rows().select("event_id", "event_type")
