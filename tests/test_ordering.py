"""Numbers and order statistics against sorted lists: ties, nulls, one value for all, far values."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import ordering

RNG = random.Random(4)


def test_numbers(spark):
    rows = [(i, RNG.choice(["a", "b", None]), RNG.random()) for i in range(500)] + [(1000 + i, "hot", 0.5) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, s string, x double")
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert {r.id: r.number for r in ordering.numbered(df, ["x", "id"]).collect()} == {r[0]: i for i, r in enumerate(order, 1)}
    found = {r.id: (r.rn, r.n) for r in ordering.numbered_within(df, ["s"], ["x", "id"]).collect()}
    for s in ("a", "b", None, "hot"):
        own = [r[0] for r in order if r[1] == s]
        assert [found[i] for i in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
    assert ordering.numbered(df.limit(0), ["x"]).collect() == []


@pytest.mark.parametrize("values", [[7.0] * 300, [1.0], [0.0, 0.0, 1e300, -1e300, 1e-300, 5e-324], [float(i % 11) for i in range(400)], [RNG.gauss(0, 1) ** 9 for _ in range(300)], [1.0 + i * 2**-52 for i in range(50)]])
def test_percentiles_are_exact(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("none", None)], "grp string, v double")
    (r,) = ordering.percentiles(df, {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()
    for k, p in (("p0", 0), ("p50", 50), ("p99", 99), ("p100", 100)):
        assert math.isclose(r[k], float(np.percentile(values, p)), rel_tol=1e-12, abs_tol=1e-320)


def test_ranks_of_integers(spark):
    values = [RNG.choice([1, 2, 2, 3, 1 << 40, -(1 << 50)]) for _ in range(500)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "grp int, v long")
    ranks = spark.createDataFrame([(g, k) for g in (0, 1) for k in (1, 50, 125, 250)], "grp int, rank long")
    found = {(r.grp, r["rank"]): r.v for r in ordering.order_statistics(df, ranks).collect()}
    assert found == {(g, k): sorted(values[g::2])[k - 1] for g in (0, 1) for k in (1, 50, 125, 250)}
    assert ordering.percentiles(df.limit(0), {"p": 0.5}).collect() == []


def test_no_window_over_rows(spark):
    """Windows of the numbered queries see a row a range or a stratum, never the table."""
    for name in ("sort_reviews", "split_train_val", "ordinal_check"):
        plan = ordering.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "row_number" not in plan and plan.count("SinglePartition") <= 2  # counts of ranges
