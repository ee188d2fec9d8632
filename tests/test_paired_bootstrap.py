"""Paired draws by cells and by Poisson weights, against drawing rows."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import paired_bootstrap as B
from tidemark.plans.views import view

SF = "/root/testdata/sf0.001"


def rows_drawn(spark, n, seed=4):
    """F1 of every option in n replicates that draw rows within (app, gold)."""
    options, parts = B.option_parts()
    rows = view(spark, SF, "labeled").select("app", "gold", *[c.cast("double").alias(name) for name, c in parts.items()]).toPandas()
    x = rows[list(parts)].to_numpy()
    strata = list(rows.groupby(["app", "gold"]).indices.values())
    rng, out = np.random.default_rng(seed), np.empty((n, len(options)))
    for r in range(n):
        s = x[np.concatenate([rng.choice(i, len(i)) for i in strata])].sum(0)
        out[r] = 2 * s[0::2] / s[1::2]
    return [o for o, _ in options], out


def test_options_against_rows(spark):
    names, drawn = rows_drawn(spark, 2000)
    spread = dict(zip(names, drawn.std(0)))
    lo, hi = (dict(zip(names, q)) for q in np.percentile(drawn, [2.5, 97.5], axis=0))
    found = {r.option: r for r in B.boot_options(spark, SF).collect()}
    assert found.keys() == set(names)
    for o in names:  # a quantile at 2.5 % of 2,000 draws is known to about 0.06 deviations
        assert abs(found[o].lo - lo[o]) < 0.3 * spread[o] and abs(found[o].hi - hi[o]) < 0.3 * spread[o]
    diff = drawn - drawn[:, :1]  # the first option is the simplest
    prob = {r.option: r for r in B.boot_options_prob(spark, SF).collect()}
    for i, o in enumerate(names):
        assert abs(prob[o].above - (diff[:, i] > 0).mean()) < 0.05
        assert abs(prob[o].lo - np.percentile(diff[:, i], 2.5)) < 0.3 * max(diff[:, i].std(), 1e-9)
    within = drawn >= drawn.max(axis=1, keepdims=True) - B.TOLERANCE - 1e-12
    often = np.bincount(within.argmax(axis=1), minlength=len(names)) / len(drawn)
    selected = {r.option: r.frequency for r in B.boot_options_selected(spark, SF).collect()}
    assert abs(sum(selected.values()) - 1) < 1e-9 and all(abs(selected[o] - f) < 0.06 for o, f in zip(names, often))


def test_one_draw_for_all(spark):
    """A contribution given twice has the same sum in every replicate, and totals of strata are kept."""
    rows = spark.createDataFrame([(f"s{i % 3}", float(i % 7)) for i in range(200)], "s string, x double")
    cells = B.joint_cells(rows, ["s"], {"a": F.col("x"), "b": F.col("x"), "n": F.lit(1)})
    sums = B.drawn_sums(cells, ["a", "b", "n"], 150).collect()
    assert len(sums) == 150 and all(r.a == r.b and r.n == 200 for r in sums) and len({r.a for r in sums}) > 50
    again = {r.rep: r.a for r in B.drawn_sums(cells.repartition(1), ["a", "b", "n"], 150).collect()}
    assert again == {r.rep: r.a for r in sums}
    assert B.drawn_sums(B.joint_cells(rows.limit(0), ["s"], {"a": F.col("x")}), ["a"], 150).collect() == []


def test_poisson_weights(spark):
    w = B._poisson(np.arange(20000), np.arange(20), 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w.T)[np.triu_indices(20, 1)]).max() < 0.05
    rng = np.random.default_rng(2)
    x, y = rng.random(600), rng.random(600) + 0.5
    rows = spark.createDataFrame([(i, None if i % 2 else "g", float(a * b), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, g string, xy double, y double")
    sums = B.poisson_sums(rows, "k", "g", {"xy": F.col("xy"), "y": F.col("y")}, 1000).toPandas()
    for g, own in (("g", np.arange(0, 600, 2)), ("", np.arange(1, 600, 2))):
        ratio = sums[sums.g == g].xy / sums[sums.g == g].y
        pick = rng.choice(own, (1000, len(own)))
        drawn = (x * y)[pick].sum(1) / y[pick].sum(1)
        assert len(ratio) == 1000 and abs(ratio.mean() - drawn.mean()) < 0.2 * drawn.std() and abs(ratio.std() / drawn.std() - 1) < 0.12


def test_weighted_query(spark):
    found = B.boot_weighted(spark, SF).collect()
    assert len(found) == 5 and all(0 < r.lo < r.mid < r.hi < 1 for r in found)
