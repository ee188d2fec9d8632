"""Regressions that are fitted together, against Spark's one by one and plain sums."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import ml, softmax, text_vectors as V

RNG = random.Random(4)
WORDS = [[f"{w}{i}" for i in range(12)] for w in ("river", "été", "wolke")]


def rows(n):
    out = []
    for i in range(n):
        label = RNG.choice([0, 0, 1, 2])
        own = RNG.choices(WORDS[label], k=6) + RNG.choices(sum(WORDS, []), k=9) + [f"seen{i // 2}"]
        out.append((i, float(label), 1.0 + i % 2 / 2, RNG.choice([" ".join(own)] * 12 + [None, "", own[0] * 300])))
    return out


def test_fits_side_by_side_are_sparks(spark, monkeypatch):
    """Losses no worse than Spark's, the same held-out rows by label and prediction but for near ties, in as many passes as the slowest fit takes."""
    data = V.counted(spark.createDataFrame(rows(500), "review_id int, label double, weight double, content string"))
    train, held_out = data.where("review_id % 5 <> 0"), data.where("review_id % 5 = 0")
    points, fitted, asked = [(m, c) for m in (2, 3, 5, 2) for c in (0.25, 4.0)], [], []
    minimize, losses = softmax.minimize, softmax.losses
    monkeypatch.setattr(softmax, "minimize", lambda *a: fitted.append(minimize(*a)) or fitted[0])
    monkeypatch.setattr(softmax, "losses", lambda rdd, theta, *a: asked.append(len(theta)) or losses(rdd, theta, *a))
    cells = softmax.fit_grid(train, held_out, points)
    assert len(fitted[0]) == max(asked) == 6 and cells[:2] == cells[6:] and len(asked) < 60  # the same points are one fit
    weight = train.agg(F.sum("weight")).first()[0]
    for (m, c), theta, found in zip(points, fitted[0], cells):
        model = ml.fit(ml._features(train, idf := V.weights(train, m)), c)
        scored = model.transform(V.sparse_vectors(held_out, idf)).select("label", "prediction").collect()
        spark_theta = np.vstack([model.coefficientMatrix.toArray().T, model.interceptVector.toArray()])
        both = []
        for x in (theta, spark_theta):
            loss = losses(softmax.blocks(train, [idf]), x[None], np.array([idf]), np.array([0]))[0][0]
            both.append(loss / weight + 0.5 / (c * train.count()) * (x[:-1] ** 2).sum())
        assert both[0] <= both[1] * 1.005
        theirs, ours = Counter((r.label, r.prediction) for r in scored), Counter({(a, b): n for a, b, n in found})
        assert ours.total() == theirs.total() == held_out.count() and (ours - theirs).total() <= 2


def test_gradients_and_halves_of_odd_rows(spark, monkeypatch):
    """Loss by plain vectors, gradient by differences; several blocks, rows without buckets and with one repeated very often."""
    monkeypatch.setattr(softmax, "BLOCK", 7)
    data = V.counted(spark.createDataFrame(rows(40) + [(90, 1.0, 0.5, None), (91, 2.0, 2.0, "a " * 70_000)], "review_id int, label double, weight double, content string"))
    idfs, groups = np.array([V.weights(data, 1), V.weights(data, 3)]), np.array([0, 1, 1])
    theta = np.random.default_rng(1).normal(size=(3, softmax.SIZE + 1, 3))
    found = softmax.blocks(data, list(idfs))
    loss, slope = softmax.losses(found, theta, idfs, groups)
    for fit, group in enumerate(groups):
        wanted = 0.0
        for r in data.collect():
            at, x = V.weigh(np.array(r.at, np.int64), np.array(r.n, float), idfs[group])
            z = x @ theta[fit][at] + theta[fit][-1]
            wanted += r.weight * (np.log(np.exp(z).sum()) - z[int(r.label)])
        assert abs(loss[fit] - wanted) < 1e-4 * wanted
    way = np.sign(slope) * (np.abs(slope) > 1e-3) * 1e-3
    up, down = softmax.losses(found, theta + way, idfs, groups)[0], softmax.losses(found, theta - way, idfs, groups)[0]
    assert np.allclose((up - down) / 2, (slope * way).sum(axis=(1, 2)), rtol=2e-3)


def test_nothing_to_train_on(spark):
    data = V.counted(spark.createDataFrame(rows(9), "review_id int, label double, weight double, content string"))
    assert softmax.fit_grid(data.limit(0), data.limit(0), [(2, 1.0)]) == [[]]
    assert sum(n for *_, n in softmax.fit_grid(data.limit(0), data, [(2, 1.0)])[0]) == 9
    one = softmax.fit_grid(data.where("label = 2"), data, [(1, 1.0)])[0]
    assert {p for _, p, _ in one} == {2.0}


def test_least_points():
    """Of quadratics, one of them far from round and one that starts at its least."""
    rng = np.random.default_rng(5)
    scales, goals = np.array([np.ones(30), np.logspace(0, 3, 30), np.ones(30)])[:, :, None], rng.normal(size=(3, 30, 1))
    start = np.zeros((3, 30, 1))
    start[2] = goals[2]
    found = softmax.minimize(lambda which, at: ((scales[which] * (at - goals[which]) ** 2).sum(axis=(1, 2)) / 2 + 1e-3, scales[which] * (at - goals[which])), start, 1e-3)
    left, first = ((scales * (x - goals) ** 2).sum(axis=(1, 2)) for x in (found, start))
    assert (left <= 2 * softmax.TOL * first).all() and (found[2] == goals[2]).all()
