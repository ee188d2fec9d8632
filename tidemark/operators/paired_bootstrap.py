"""Stratified bootstrap that draws once for all options, so that their differences are paired.

Count statistics: a row's contributions to the sums of all options make one joint
cell, and rows of a stratum (app and label) drawn with replacement fall into its
cells as a multinomial draw. So a replicate draws a count for each cell, and
multiplies cells by contributions; no row is touched again.

Any weighted statistic: where contributions are real numbers, cells are as many as
rows. Each row then has a Poisson(1) weight in each replicate, told by a hash of
its id and the replicate, and tasks give sums by replicate of weights times
contributions. The number of rows drawn is then not fixed, which is no matter for
ratios.

Draws depend on the seed, the stratum or row, and the replicate only: a lost task
draws again what it drew before.

Defined results: null contributions count 0; a stratum without rows isn't there;
a statistic whose denominator is 0 in a replicate is null there and isn't counted
in intervals; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.checks import RULES, SCHEMES, TOLERANCE, WEIGHTS
from tidemark.plans.storage import materialize
from tidemark.plans.views import view

REPLICATES, SEED = 2000, 9
#: Replicates that one row of the draw table stands for.
BLOCK = 100
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def joint_cells(rows: DataFrame, strata: list[str], parts: dict[str, Column]) -> DataFrame:
    """stratum, cells: (contributions in the order of `parts`, rows) of each joint cell; counted on the map side first."""
    stratum = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in strata])
    given = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in parts.values()])
    counted = rows.select(stratum.alias("stratum"), given.alias("parts")).groupBy("stratum", "parts").agg(F.count("*").alias("n"))
    return counted.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("parts", "n"))).alias("cells"))  # distinct contributions, not rows


def drawn_sums(cells: DataFrame, names: list[str], n: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """rep and the sum of each contribution over all strata."""

    def draw(batches):
        for batch in batches:
            for stratum, found, block in zip(*(batch.column(c).to_pylist() for c in ("stratum", "cells", "block")), strict=True):
                parts, counts = np.array([c["parts"] for c in found]), np.array([c["n"] for c in found])
                reps = np.arange(block * BLOCK, min(n, (block + 1) * BLOCK))
                taken = np.array([np.random.default_rng([seed, zlib.crc32(stratum.encode()), int(r)]).multinomial(counts.sum(), counts / counts.sum()) for r in reps])
                yield pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int32()), **{name: pa.array(s) for name, s in zip(names, (taken @ parts).T, strict=True)}})

    blocks = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-n // BLOCK) - 1)))).repartition("stratum", "block")
    sums = blocks.mapInArrow(draw, "rep int, " + ", ".join(f"`{name}` double" for name in names))
    return sums.groupBy("rep").agg(*[F.sum(name).alias(name) for name in names])


def _poisson(ids: np.ndarray, reps: np.ndarray, seed: int) -> np.ndarray:
    """Rows by replicates: Poisson(1) numbers by inversion of hashed uniforms."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (reps.astype(np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 1)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(by)
    steps = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 18)]))
    return np.searchsorted(steps, (x >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right")


def poisson_sums(rows: DataFrame, key: str, by: str, parts: dict[str, Column], n: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """by, rep and the weighted sum of each contribution. Each batch of rows gives one sum for each replicate and group it has."""
    names = list(parts)

    def weigh(batches):
        reps = np.arange(n)
        for batch in batches:
            groups = np.array(batch.column(1).to_pylist(), dtype=object)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(names))])
            for group in sorted(set(groups)):
                own = np.flatnonzero(groups == group)
                sums = np.zeros((n, len(names)))
                for lo in range(0, len(own), 256):  # rows whose weights are held at once
                    some = own[lo : lo + 256]
                    sums += _poisson(ids[some], reps, seed).T @ x[some]
                yield pa.RecordBatch.from_pydict({by: pa.array([group] * n), "rep": pa.array(reps, pa.int32()), **{name: pa.array(s) for name, s in zip(names, sums.T, strict=True)}})

    given = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in parts.items()]
    narrow = rows.select(F.xxhash64(key).alias("id"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias(by), *given)
    sums = narrow.mapInArrow(weigh, f"{by} string, rep int, " + ", ".join(f"`{name}` double" for name in names))
    return sums.groupBy(by, "rep").agg(*[F.sum(name).alias(name) for name in names])


# ---- the twelve options of label scheme, complaint rule and weights


def option_parts() -> tuple[list[tuple[str, int]], dict[str, Column]]:
    """(option, place) and each option's contributions to F1: hit<i> (both), said<i> (labelled plus predicted)."""
    options, parts = [], {}
    y = F.col("gold") == "negative"
    for i, scheme in enumerate(SCHEMES):
        for j, rule in enumerate(RULES):
            for k, weights in enumerate(WEIGHTS):
                p = F.col("pred_label") == "negative"
                p = p | (F.col("score") == 3) if scheme == "3neg" else p
                p = p | (F.col("score") <= 2) if rule == "star+model" else p
                w = F.lit(1) if weights == "raw" else F.col("weight_units")
                w = F.when(F.col("score") != 3, w).otherwise(0) if scheme == "drop3" else w
                at = len(options)
                options.append((f"{scheme}/{rule}/{weights}", 100 * i + 10 * j + k))
                parts[f"hit{at}"] = w * (y & p).cast("int")
                parts[f"said{at}"] = w * (y.cast("int") + p.cast("int"))
    return options, parts


def option_replicates(labeled: DataFrame, n: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """rep, all: (place, option, f1) of every option, of one draw by app and label."""
    options, parts = option_parts()
    sums = drawn_sums(joint_cells(labeled, ["app", "gold"], parts), list(parts), n, seed)
    told = [F.struct(F.lit(place).alias("place"), F.lit(option).alias("option"), F.try_divide(2 * F.col(f"hit{i}"), F.col(f"said{i}")).alias("f1")) for i, (option, place) in enumerate(options)]
    return sums.select("rep", F.array(*told).alias("all"))


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return option_replicates(view(spark, sf_dir, "labeled"))


@query
def boot_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval of each option's F1."""
    each = _reps(spark, sf_dir).select(F.explode("all").alias("o")).select("o.*")
    return each.groupBy("option", "place").agg(*[F.percentile("f1", F.lit(q)).alias(name) for q, name in ((0.025, "lo"), (0.975, "hi"))])  # REPLICATES values a group


@query
def boot_options_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of replicates in which an option's F1 is above that of the simplest one, and the interval of their difference; pairs are of one draw."""
    reps = _reps(spark, sf_dir).select(F.array_min("all")["f1"].alias("base"), F.explode("all").alias("o"))
    diff = F.col("o.f1") - F.col("base")
    return reps.groupBy("o.option").agg(F.avg((diff > 0).cast("double")).alias("above"), F.percentile(diff, F.lit(0.025)).alias("lo"), F.percentile(diff, F.lit(0.975)).alias("hi"))


@query
def boot_options_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the selection rule takes each option: the simplest within the tolerance of the best."""
    reps = _reps(spark, sf_dir).withColumn("top", F.array_max(F.transform("all", lambda o: o["f1"])))
    taken = reps.select(F.array_min(F.filter("all", lambda o: o["f1"] >= F.col("top") - TOLERANCE - 1e-12))["option"].alias("option"))
    options, _ = option_parts()
    every = taken.sparkSession.createDataFrame([(o,) for o, _ in options], "option string")
    counts = taken.groupBy("option").agg(F.count("*").alias("n"))
    return every.join(counts, "option", "left").select("option", (F.coalesce("n", F.lit(0)).cast("double") / REPLICATES).alias("frequency"))


@query
def boot_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % interval by app of the value of wrongly predicted orders as a share of the value of all: a statistic of real weights."""
    orders = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), "o_totalprice")
    rows = view(spark, sf_dir, "labeled").select("review_id", "app", "gold", "pred_label").join(orders, "review_id")
    wrong = (F.col("gold") != F.col("pred_label")).cast("int")
    sums = poisson_sums(materialize(rows, "weighted"), "review_id", "app", {"wrong": F.col("o_totalprice") * wrong, "all": F.col("o_totalprice")})
    share = F.try_divide("wrong", "all")
    return sums.groupBy("app").agg(*[F.percentile(share, F.lit(q)).alias(name) for q, name in ((0.025, "lo"), (0.5, "mid"), (0.975, "hi"))])
