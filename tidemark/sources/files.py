"""Files in and out: tables of several files, label sheets, reports, configurations, and sinks that replace whole tables or refuse to.

A sheet is delimited text with a header; a workbook is a folder of sheets, as
the engine writes no spreadsheets. Paths may be in any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.storage import exists, read_text, swap, write_text

SHEET = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""}


class ContractError(ValueError):
    """Data that break what a step relies on."""


# ---- sources


def read_union(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """The rows of several Parquet files, columns matched by name; only the columns asked for are scanned."""
    if not paths:
        raise ContractError("no files to read")
    tables = [spark.read.parquet(p) for p in paths]
    return reduce(DataFrame.unionByName, [t.select(*columns) if columns else t for t in tables])


def read_sheet(spark: SparkSession, path: str, columns: list[str], label_col: str = "label") -> DataFrame:
    """A sheet's rows as strings. Its header must have just these columns; blank rows go, blank cells are null, labels are trimmed and lower-cased."""
    first = spark.read.options(**SHEET).csv(path)
    if missing := [c for c in columns if c not in first.columns]:
        raise ContractError(f"{path} lacks {missing}")
    if more := [c for c in first.columns if c not in columns]:
        raise ContractError(f"{path} has {more} too")
    cells = [F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if c != label_col else F.nullif(F.lower(F.trim(F.col(c))), F.lit("")).alias(c) for c in columns]
    rows = first.select(*cells)
    return rows.where(F.coalesce(*columns).isNotNull())


def read_report(spark: SparkSession, path: str) -> dict:
    """A JSON report, as written by `write_report`."""
    return json.loads(read_text(spark, path))


def read_config(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> dict:
    """A YAML configuration; required keys must be there."""
    found = yaml.safe_load(read_text(spark, path)) or {}
    if missing := [k for k in required if k not in found]:
        raise ContractError(f"{path} lacks {missing}")
    return found


# ---- sinks


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write a Parquet table beside its place, then put it there; a failed write leaves what was there."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    df.write.parquet(part)
    swap(df.sparkSession, part, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_new(df: DataFrame, path: str) -> DataFrame:
    """Write a Parquet table where none is; labelled work is never overwritten."""
    if exists(df.sparkSession, path):
        raise ContractError(f"{path} is there already")
    return replace_table(df, path)


def write_sheet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Delimited text with a header, all cells as text."""
    if not overwrite and exists(df.sparkSession, path):
        raise ContractError(f"{path} is there already")
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("overwrite").options(**SHEET, quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)


def write_workbook(sheets: dict[str, DataFrame], folder: str) -> None:
    """A folder with a sheet for each name; refuses one that is there."""
    for name, df in sheets.items():
        write_sheet(df, f"{folder}/{name}")


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """A small JSON report, whole or not at all."""
    write_text(spark, path, json.dumps(report, indent=2, ensure_ascii=False, default=str))
