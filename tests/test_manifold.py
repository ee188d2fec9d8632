"""The layout keeps neighbours better than principal components do, in one tile and in many."""

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import density, manifold
from tidemark.plans.storage import materialize

RNG = np.random.default_rng(6)


def trust(x, y, k=10):
    """Trustworthiness: how few false neighbours a layout has (1: none)."""
    n = len(x)
    dx, dy = (np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) for m in (x, y))
    np.fill_diagonal(dx, np.inf)
    np.fill_diagonal(dy, np.inf)
    rank = np.argsort(np.argsort(dx, axis=1), axis=1) + 1
    near = np.argsort(dy, axis=1)[:, :k]
    over = np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum()
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * over


def curve(n):
    """A winding closed line in 24 dimensions: near its neighbours, and near nothing else."""
    t = RNG.random(n)[:, None] * 2 * np.pi
    j = np.arange(1, 13)[None]
    x = np.concatenate([np.cos(j * t), np.sin(j * t)], axis=1)
    return (x + RNG.standard_normal((n, 24)) * 0.02).astype(np.float32)


def test_memberships():
    d = np.sort(RNG.random((30, 15)), axis=1)
    m = manifold.memberships(d)
    assert np.allclose(m.sum(axis=1), np.log2(15), atol=1e-6) and np.allclose(m[:, 0], 1) and (np.diff(m, axis=1) <= 0).all()
    assert np.isfinite(manifold.memberships(np.zeros((2, 5)))).all()


def test_layout_keeps_neighbours(spark):
    x = curve(400)
    rows = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float(f) for f in x[3]])], "review_id long, embedding array<float>")
    pts = materialize(density.points(rows), "points")
    u = {r.point: r.v for r in pts.collect()}
    ids = sorted(u)
    wanted = np.array([u[i] for i in ids])
    flat = PCA(k=5, inputCol="v", outputCol="r").fit(p := pts.select("point", array_to_vector("v").alias("v"))).transform(p)
    by_pca = {r.point: r.r for r in flat.select("point", vector_to_array("r").alias("r")).collect()}
    base = trust(wanted, np.array([by_pca[i] for i in ids]))
    graph = materialize(manifold.fuzzy_graph(density.neighbours(density.leaves(pts), manifold.NEAR)), "graph")
    assert graph.where("w <= 0 or w > 1.0000001").isEmpty()
    for leaf in (density.LEAF, 120):  # one tile, and several
        y = {r.point: r.y for r in manifold.layout(pts, graph, leaf=leaf).collect()}
        got = trust(wanted, np.array([y[i] for i in ids]))
        assert got > 0.95 and got > base, (leaf, got, base)
    found = {r.review_id: r.reduced for r in manifold.reduce(rows).collect()}
    assert len(found) == 403 and found[900] is None and found[901] is None and found[902] == found[3] and len(found[3]) == 5
    assert found == {r.review_id: r.reduced for r in manifold.reduce(rows.repartition(3)).collect()}  # the same draws again


def test_few_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "review_id long, embedding array<float>")
    assert {tuple(r.reduced) for r in manifold.reduce(rows).collect()} <= {tuple(y) for y in [r.reduced for r in manifold.reduce(rows).collect()]}
    assert manifold.reduce(rows.limit(0)).agg(F.count("*")).first()[0] == 0
