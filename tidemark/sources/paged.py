"""A stream of pages, newest rows first, and an ingest that can stop and go on.

`publish` sorts a table into pages. `PageSource` is a Spark data source whose
offsets are the listing's tokens: a batch is one page, and the next offset names
the next page, so the engine's checkpoint knows where to go on. `Ingest` is a
streaming query over it: ids met before are dropped by the engine's keyed state,
rows older than `since` are skipped and end the run with their page, and `cap`
cuts the last page. Each batch is written as a part under its batch number and
committed by a small file; a batch that is done again after a stop overwrites its
own part, and parts without commit are ignored. A run with other parameters on
the same place is refused.

The state of ids doesn't expire: times run backwards here, so a watermark would
take all later pages for late.

Defined results: rows with null time are listed last and count as not older;
repeated ids are kept once, from the first page that has them; an empty table
gives no rows and stops as exhausted.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tidemark.operators.ordering import numbered
from tidemark.plans.storage import exists, read_text, settings, write_text
from tidemark.sources.files import ContractError

REASONS = ("since", "cap", "exhausted")


def with_retries(ask: Callable, tries: int = 5, base: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """Ask again after an error, waiting base, twice, four times as long, at most `most`; the last error is raised."""
    for k in range(tries):
        try:
            return ask()
        except Exception:
            if k + 1 == tries:
                raise
            sleep(min(base * 2**k, most))


def publish(table: DataFrame, id_col: str, time_col: str, page_size: int, home: str) -> None:
    """Write the table as pages by (time, id), descending, and how many there are."""
    rows = numbered(table, [F.desc_nulls_last(time_col), F.desc(id_col)], "__number").withColumn("__page", F.floor((F.col("__number") - 1) / page_size).cast("long"))
    pages = rows.agg(F.max("__page")).first()[0]
    # A page is sorted by one task, and is one file.
    rows.repartition("__page").sortWithinPartitions("__page", "__number").drop("__number").write.partitionBy("__page").parquet(f"{home}/pages")
    write_text(table.sparkSession, f"{home}/listing.json", json.dumps({"pages": 0 if pages is None else pages + 1, "page_size": page_size, "id": id_col, "time": time_col, "schema": table.schema.json()}))


class PageReader(SimpleDataSourceStreamReader):
    """One page a batch."""

    def __init__(self, schema: StructType, home: str, pages: int):
        self.names, self.home, self.pages = schema.names, home, pages
        self.zoned = {f.name: f.dataType.typeName() == "timestamp" for f in schema if f.dataType.typeName().startswith("timestamp")}

    def initialOffset(self) -> dict:
        return {"page": 0}

    def _page(self, page: int):
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        def column(batch, name: str) -> list:
            values = batch.column(name)
            return (values.cast(pa.timestamp("us", "UTC" if self.zoned[name] else None)) if name in self.zoned else values).to_pylist()

        fs, path = FileSystem.from_uri(f"{self.home}/pages/__page={page}")
        for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches(columns=self.names):
            yield from zip(*(column(batch, c) for c in self.names), strict=True)

    def read(self, start: dict):
        page = start["page"]
        if page >= self.pages:
            return iter([]), start
        rows = with_retries(lambda: list(self._page(page)))  # a page
        return iter(rows), {"page": page + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        for page in range(start["page"], end["page"]):
            yield from self._page(page)


class PageSource(DataSource):
    """Options: home, pages, and the schema as JSON."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["schemajson"]))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PageReader(schema, self.options["home"], int(self.options["pages"]))


@dataclass
class Ingest:
    """Takes pages into `home` until a limit; `run` may be called again and goes on."""

    spark: SparkSession
    listing: str
    home: str
    since: str | None = None
    cap: int | None = None
    #: Parts of the state of ids, each a store that every batch opens; fixed once a run has begun.
    state_parts: int = 8

    def __post_init__(self):
        self.of = json.loads(read_text(self.spark, f"{self.listing}/listing.json"))
        params, path = {"since": self.since, "cap": self.cap, "listing": self.listing}, f"{self.home}/params.json"
        if not exists(self.spark, path):
            write_text(self.spark, path, json.dumps(params))
        elif (begun := json.loads(read_text(self.spark, path))) != params:
            raise ContractError(f"{self.home} was begun with {begun}")

    def _commits(self) -> list[dict]:
        """What batches have committed, in order."""
        found, i = [], 0
        while exists(self.spark, path := f"{self.home}/commit-{i:06d}.json"):
            found.append(json.loads(read_text(self.spark, path)))
            i += 1
        return found

    def rows(self) -> DataFrame:
        """What is committed so far."""
        parts = [c["part"] for c in self._commits() if c["rows"]]
        schema = StructType.fromJson(json.loads(self.of["schema"]))
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _put(self, batch: DataFrame, i: int) -> bool:
        """Write a batch's rows as its part and commit it; true once there is a reason to stop."""
        before = json.loads(read_text(self.spark, f"{self.home}/commit-{i - 1:06d}.json")) if i else {"total": 0, "stop": None}
        if before["stop"]:
            return True
        at = F.col(self.of["time"])
        old = F.coalesce(at < F.lit(self.since).cast("timestamp"), F.lit(False)) if self.since is not None else F.lit(False)
        batch.persist()
        fresh = batch.where(~old)
        if self.cap is not None:
            fresh = fresh.orderBy(F.desc_nulls_last(at), F.desc(self.of["id"])).limit(self.cap - before["total"])  # of a page
        part = f"{self.home}/part-{i:06d}"
        fresh.write.mode("overwrite").parquet(part)
        n = self.spark.read.schema(batch.schema).parquet(part).count()
        total = before["total"] + n
        stop = "since" if not batch.where(old).isEmpty() else "cap" if self.cap is not None and total >= self.cap else None
        batch.unpersist()
        write_text(self.spark, f"{self.home}/commit-{i:06d}.json", json.dumps({"part": part, "rows": n, "total": total, "stop": stop}))
        return stop is not None

    def run(self, max_pages: int | None = None) -> str | None:
        """Take pages; returns why it stopped (since before cap before exhausted), or None if only max_pages did."""
        self.spark.dataSource.register(PageSource)
        source = self.spark.readStream.format("pages").options(home=self.listing, pages=self.of["pages"], schemajson=self.of["schema"]).load()
        halt, taken = threading.Event(), []

        def put(batch: DataFrame, i: int) -> None:
            if halt.is_set():
                raise RuntimeError("stopping")  # this page is taken by the next run
            done = self._put(batch, i)
            taken.append(i)
            if done or (max_pages is not None and len(taken) >= max_pages):
                halt.set()

        once = source.dropDuplicates([self.of["id"]])
        with settings(self.spark, {"spark.sql.shuffle.partitions": str(self.state_parts)}):  # the query keeps what it is started with
            query = once.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.home}/checkpoint").start()

        def drain() -> None:
            try:
                query.processAllAvailable()
            except Exception:
                if not halt.is_set():
                    raise

        worker = threading.Thread(target=drain, daemon=True)
        worker.start()
        while worker.is_alive() and not halt.is_set():
            worker.join(0.05)
        if query.exception() is not None and not halt.is_set():
            raise query.exception()
        query.stop()
        commits = self._commits()
        if commits and commits[-1]["stop"]:
            return commits[-1]["stop"]
        return None if halt.is_set() else "exhausted"
