"""Paired bootstrap by app: all of `labeled`, 2,000 replicates.

The statistic reads only how many drawn rows of an app fall into each cell of
(label negative or not, predicted negative or not). Rows drawn with replacement
fall into cells as a multinomial draw, so each replicate draws the cells' counts
and no row is touched again: the work is replicates times apps, whatever the
table's size. Draws depend on seed, app and replicate only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.views import view

REPLICATES, SEED = 2000, 9
_CELLS = ("yp", "yn", "np", "nn")  # labelled, predicted


def cell_counts(labeled: DataFrame) -> DataFrame:
    y, p = F.col("gold") == "negative", F.col("pred_label") == "negative"
    return labeled.groupBy("app").agg(*[F.count_if(c).alias(name) for name, c in zip(_CELLS, (y & p, y & ~p, ~y & p, ~y & ~p), strict=True)])


def draw(app: str, rep: int, counts: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Cell counts of as many rows, drawn with replacement."""
    return np.random.default_rng([seed, zlib.crc32(app.encode()), rep]).multinomial(counts.sum(), counts / counts.sum())


def replicates(cells: DataFrame, n: int = REPLICATES) -> DataFrame:
    """(app, rep) with the drawn cells. Cells are a row an app: they are dealt to the replicates, not the other way."""

    def run(batches):
        for batch in batches:
            counts = batch[list(_CELLS)].to_numpy()
            drawn = np.array([draw(a, r, c) for a, r, c in zip(batch["app"], batch["rep"], counts, strict=True)]).reshape(-1, 4)
            yield pd.concat([batch[["app", "rep"]].reset_index(drop=True), pd.DataFrame(drawn, columns=list(_CELLS))], axis=1)

    # Exploding a row an app gives each its replicates without a join.
    wide = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition("app", "rep")
    return wide.mapInPandas(run, "app string, rep int, yp long, yn long, np long, nn long")


def _difference(df: DataFrame, *keys: str) -> DataFrame:
    """Recall less false alarm rate of each replicate."""
    s = df.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(c) for c in _CELLS])
    return s.select(*keys, (F.try_divide(F.col("yp"), F.col("yp") + F.col("yn")) - F.try_divide(F.col("np"), F.col("np") + F.col("nn"))).alias("diff"))


def _interval() -> list:
    return [F.percentile("diff", F.lit(q)).alias(name) for q, name in ((0.025, "lo"), (0.975, "hi"))]


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicates(cell_counts(view(spark, sf_dir, "labeled")))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difference(_reps(spark, sf_dir), "rep").agg(*_interval())


def boot_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of replicates in which the difference is above 0."""
    return _difference(_reps(spark, sf_dir), "rep").agg((F.count_if(F.col("diff") > 0).cast("double") / F.count("*")).alias("above"))


def bootstrap_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difference(_reps(spark, sf_dir), "rep", "app").groupBy("app").agg(*_interval())


def boot_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each app has the largest difference of a replicate (of equal ones the first by name)."""
    best = _difference(_reps(spark, sf_dir), "rep", "app").groupBy("rep").agg(F.min_by("app", F.struct(-F.col("diff"), F.col("app"))).alias("app"))
    return best.groupBy("app").agg((F.count("*").cast("double") / REPLICATES).alias("frequency"))


QUERIES = {f.__name__: f for f in (bootstrap_ci, boot_prob, bootstrap_app, boot_selected)}
