"""Vectors in few dimensions that keep neighbours: a fuzzy neighbour graph, laid out by sampled gradient steps.

Each point has NEAR neighbours (density.neighbours). A neighbour's membership falls
with its distance beyond the nearest one's, at a width that gives all of them
log2(NEAR) together; the two directions of a pair are joined as a probabilistic
or. The layout starts from the principal components. In each round points are
dealt to tiles, the leaves of another random tree, and a task moves its tile's
points: pairs attract by their weight, points drawn at random repel. Neighbours
outside the tile stand where the round found them; repelling points are drawn from
the tile and from a bounded sample of all (POOL). The next round's tiles are cut
elsewhere, so no border stays.

Defined results: copies of a vector are laid out once; null, empty and zero
vectors have a null result; with fewer than three points they lie at 0; an empty
table gives an empty result. Draws depend on the seed, the round and the tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import density
from tidemark.plans.storage import materialize
from tidemark.plans.views import view

QUERIES = {}
NEAR, DIMENSIONS, ROUNDS, STEPS, REPEL, POOL, SEED = 15, 5, 4, 60, 5, 2048, 11
#: The curve 1 / (1 + A d^(2B)) of a layout whose least distance is 0.
A, B = 1.93, 0.79
#: Largest move of a point along an axis in one step, times the rate.
CLIP = 4.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def memberships(d: np.ndarray) -> np.ndarray:
    """Rows of ascending distances to memberships; nan: no such neighbour."""
    beyond = np.maximum(d - d[:, :1], 0)
    target, lo, hi = np.log2(np.maximum((~np.isnan(d)).sum(axis=1), 2)), np.zeros(len(d)), np.full(len(d), np.inf)
    width = np.ones(len(d))
    for _ in range(64):
        total = np.nansum(np.exp(-beyond / width[:, None]), axis=1)
        wide = total > target
        hi, lo = np.where(wide, width, hi), np.where(wide, lo, width)
        width = np.where(np.isinf(hi), width * 2, (lo + hi) / 2)
    return np.exp(-beyond / np.maximum(width, 1e-12)[:, None])


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """a, b, w for each point a and each neighbour b of its own; w holds both directions."""

    @F.arrow_udf("array<double>")
    def member(distances: pa.Array) -> pa.Array:
        rows = distances.to_pylist()
        most = max(map(len, rows), default=0)
        if not most:
            return pa.array([[] for _ in rows], pa.list_(pa.float64()))
        d = np.array([r + [np.nan] * (most - len(r)) for r in rows], float)
        found = memberships(d)
        return pa.array([list(m[: len(r)]) for m, r in zip(found, rows, strict=True)], pa.list_(pa.float64()))

    own = near.withColumn("m", member(F.transform("near", lambda x: x["d"]))).select("point", F.explode(F.arrays_zip("near", "m")).alias("x"))
    one_way = own.select(F.col("point").alias("a"), F.col("x.near.other").alias("b"), F.col("x.m").alias("p"))
    back = one_way.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("p").alias("q"))
    return one_way.join(back, ["a", "b"], "left").select("a", "b", (F.col("p") + F.coalesce("q", F.lit(0.0)) * (1 - F.col("p"))).alias("w"))


def start(pts: DataFrame, dimensions: int) -> DataFrame:
    """point, y: the principal components, the largest at 10."""
    rows = pts.select("point", array_to_vector("v").alias("v"))
    size = pts.select(F.size("v").alias("n")).first()
    k = min(dimensions, size.n if size else dimensions)
    if pts.count() < 3:
        return pts.select("point", F.array(*[F.lit(0.0)] * dimensions).alias("y"))
    flat = PCA(k=k, inputCol="v", outputCol="r").fit(rows).transform(rows).select("point", vector_to_array("r").alias("y"))
    flat = materialize(flat.select("point", F.concat("y", F.array(*[F.lit(0.0)] * (dimensions - k)).cast("array<double>")).alias("y")), "components")
    middle = flat.select(F.posexplode("y").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("m"))
    centred = flat.crossJoin(F.broadcast(middle)).select("point", F.zip_with("y", F.col("m"), lambda x, m: x - m["m"]).alias("y"))  # one row
    far = centred.agg(F.max(F.array_max(F.transform("y", F.abs))).alias("far"))
    return centred.crossJoin(F.broadcast(far)).select("point", F.transform("y", lambda x: F.coalesce(F.round(F.try_divide(x * 10, F.col("far")), 6), F.lit(0.0))).alias("y"))  # rounded: sums may be added in any order


def move(ids: np.ndarray, y: np.ndarray, head: np.ndarray, tail: np.ndarray, w: np.ndarray, outside: np.ndarray, pool: np.ndarray, first: int, steps: int, total: int, rng) -> np.ndarray:
    """Positions of a tile's points after some steps. tail: a point of the tile, or n plus a row of `outside`."""
    n, y = len(ids), y.copy()
    inside, chance = tail < n, w / w.max() if len(w) else w
    everyone = len(pool) + n
    for step in range(first, first + steps):
        rate, go = 1.0 - step / total, rng.random(len(w)) < chance
        h, t = head[go], tail[go]
        there = np.concatenate([y, outside])[t] if len(outside) else y[t]
        delta = y[h] - there
        d2 = (delta * delta).sum(axis=1)
        pull = np.where(d2 > 0, -2 * A * B * np.maximum(d2, 1e-12) ** (B - 1) / (1 + A * d2**B), 0)[:, None] * delta
        pull = np.clip(pull, -CLIP, CLIP)
        change = np.zeros_like(y)
        np.add.at(change, h, pull)
        both = inside[go]
        np.add.at(change, t[both], -pull[both])
        apart = np.repeat(h, REPEL)
        other = rng.integers(0, everyone, len(apart))
        delta = y[apart] - np.concatenate([y, pool])[other]
        d2 = (delta * delta).sum(axis=1)
        push = np.clip((2 * B / ((0.001 + d2) * (1 + A * d2**B)))[:, None] * delta, -CLIP, CLIP)
        np.add.at(change, apart, np.where((d2 > 0)[:, None], push, 0))
        y += rate * np.clip(change, -CLIP, CLIP)
    return y


def _tile(r: int, known, steps: int, total: int):
    """Moves the points of a tile in round r."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["point"].to_numpy())
        table = table.take(pa.array(order))
        ids, near = table["point"].to_numpy(), table["near"].to_pylist()
        y = np.array(table["y"].to_pylist(), float)
        place = {p: i for i, p in enumerate(ids.tolist())}
        head, tail, w, outside = [], [], [], []
        for i, own in enumerate(near):
            for e in sorted(own or [], key=lambda e: e["b"]):
                head.append(i)
                w.append(e["w"])
                if e["b"] in place:
                    tail.append(place[e["b"]])
                else:
                    tail.append(len(ids) + len(outside))
                    outside.append(e["yb"])
        rng = np.random.default_rng([SEED, r, int(ids[0]) & 0xFFFFFFFF])
        moved = move(ids, y, np.array(head, int), np.array(tail, int), np.array(w, float), np.array(outside, float).reshape(-1, y.shape[1]), known.value, r * steps, steps, total, rng)
        return pa.table({"point": ids, "y": pa.array(list(moved), pa.list_(pa.float64()))})

    return run


def layout(pts: DataFrame, graph: DataFrame, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, steps: int = STEPS, leaf: int = density.LEAF) -> DataFrame:
    """point, y."""
    tiles = density.leaves(pts, rounds, leaf).select("point", "tree", "leaf")
    trees = tiles.agg(F.max("tree")).first()[0] or 0
    tiles, at = materialize(tiles, "tiles"), materialize(start(pts, dimensions), "positions")
    for r in range(rounds):
        pool = np.array([x.y for x in at.orderBy(F.xxhash64("point", F.lit(r))).limit(POOL).collect()], float).reshape(-1, dimensions)  # POOL rows at most
        known = pts.sparkSession.sparkContext.broadcast(pool)

        ends = graph.join(at.select(F.col("point").alias("b"), F.col("y").alias("yb")), "b").groupBy("a").agg(F.collect_list(F.struct("b", "w", "yb")).alias("near"))  # NEAR a point
        rows = tiles.where(F.col("tree") == min(r, trees)).join(at, "point").join(ends, F.col("point") == F.col("a"), "left").select("leaf", "point", "y", "near")
        at = materialize(rows.groupBy("leaf").applyInArrow(_tile(r, known, steps, rounds * steps), "point long, y array<double>"), "positions")
    return at


def reduce(rows: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """review_id, reduced of rows (review_id, embedding)."""
    pts = materialize(density.points(rows), "points")
    near = density.neighbours(density.leaves(pts), NEAR)
    at = layout(pts, materialize(fuzzy_graph(near), "graph"), dimensions)
    of = pts.join(at, "point").select("v", F.col("y").alias("reduced"))
    return density.points_of(rows).join(of, "v", "left").select("review_id", "reduced")


@query
def reduce_manifold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dimensions for each vector, in which neighbours stay neighbours."""
    return reduce(view(spark, sf_dir, "vectors").select("review_id", "embedding"))


@query
def cluster_manifold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by density of the vectors in five dimensions; noise is -1."""
    flat = materialize(reduce_manifold(spark, sf_dir).withColumnRenamed("reduced", "embedding"), "reduced")
    return density.density_clusters(flat, unit=False)
