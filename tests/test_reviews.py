"""Text traps, intervals, and queries against their SQL on the smallest tables."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions import text as T
from tidemark.operators import bootstrap, joins, ml, scoring
from tidemark.plans import registry
from tidemark.plans.views import view
from tidemark.sources import files, paged

SF = "/root/testdata/sf0.001"


def test_cleaning_traps():
    assert T.cap_repeats("AaAaa 1111 !!!!") == "AA 1111 !!"
    assert T.clean("a" + chr(0xA0) + chr(0x3000) + "b http://x.y/z c") == "a b c"
    assert T.clean(None) == "" and T.clean("") == ""
    assert T.clean(chr(0xFF21) * 2) == "AA"
    grin = "\U0001f621"
    assert T.cap_emoji(grin * 5 + "x" + grin) == grin * 2 + "x" + grin
    thumb, tone, flag = "\U0001f44d", "\U0001f3fd", "\U0001f1ee\U0001f1e9"
    assert T.cap_emoji(thumb * 2 + thumb + tone) == thumb * 2 + thumb + tone  # the toned one is another
    assert T.cap_emoji((thumb + tone) * 4 + flag * 3) == (thumb + tone) * 2 + flag * 2
    family = chr(0x200D).join(["\U0001f468", "\U0001f469", "\U0001f467"])
    assert T.cap_emoji(family * 3) == family * 2 and T.cap_emoji(chr(0x2B50) * 3) == chr(0x2B50) * 2
    assert T.demojize_counted(chr(0x2B50) + grin, {chr(0x2B50): "star"}) == ("star pouting face", 2, 1)
    assert "pouting face" in T.demojize(grin)


@given(st.text(alphabet=st.characters(max_codepoint=126, min_codepoint=32), max_size=40))
def test_cleaning_twice_is_cleaning_once(text):
    once = T.clean(text)
    assert T.clean(once) == once


@given(st.lists(st.none() | st.text(alphabet="aAbB1 .\t\n" + chr(0xA0) + "\U0001f621" + chr(0xFF21) + "htpw:/", max_size=30), max_size=8))
def test_cleaning_a_batch_is_cleaning_each(texts):
    import pyarrow as pa

    assert T.clean_batch(pa.array(texts, pa.string())) == [T.clean(t) for t in texts]
    assert T.clean_batch(pa.array([None, "xx", *texts], pa.string()).slice(2)) == [T.clean(t) for t in texts]


def test_scripts_and_markers(spark):
    rows = spark.createDataFrame([(chr(0x3400),), (chr(0x985),), (chr(0x2B50),), (chr(0x231A),), ("x",), (None,)], "t string")
    found = rows.select(T.non_latin(F.col("t")).alias("n"), T.has_emoji(F.col("t")).alias("e")).collect()
    assert [r.n for r in found] == [True, False, False, False, False, False] and [r.e for r in found] == [False, False, True, True, False, False]
    rule = T.language_rule(F.col("t"), {"x": ["la", "le"]}, detector=lambda t: F.lit("detected"))
    rows = spark.createDataFrame([("la, le! sur",), ("la la la",), ("la le",), (chr(0x430) * 9,)], "t string")
    assert [r.r for r in rows.select(rule.alias("r")).collect()] == ["x?", "detected", "too_short", "non_latin"]
    words = spark.createDataFrame([("lagi",), ("a Lag.",), ("lagé",), (None,)], "t string").select(T.whole_word(F.col("t"), ["lag"]).alias("w"))
    assert [r.w for r in words.collect()] == [False, True, False, False]


def test_counts_of_blank_texts(spark):
    rows = spark.createDataFrame([("",), (None,), ("   ",), ("a b",), ("a" + chr(0x2003) + "b c",)], "t string")
    assert [r.n for r in rows.select(T.word_count(F.col("t")).alias("n")).collect()] == [0, 0, 0, 2, 3]


def test_clitic_stays(spark):
    apply, counts = T.neutralizer([("gopay", "app")])
    row = spark.createDataFrame([("Gopaynya gopay",)], "t string").select(apply(F.col("t")).alias("t"), counts(F.col("t"))[0].alias("n")).first()
    assert (row.t, row.n) == ("appnya app", 2)


def test_intervals(spark):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (0, 0)], "k long, n long").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert rows[3].lo is None and all(r.lo <= r.hi for r in rows[:3])
    assert math.isclose(rows[1].lo, 0.2366, abs_tol=1e-4)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"create view {file.split('.')[0]} as select * from read_parquet('{SF}/{file}')")
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), db.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    missing = lambda v: v is None or v is pd.NA or v is pd.NaT or v != v
    key = lambda df: sorted(tuple(str(None if missing(v) else round(float(v), 9) if isinstance(v, int | float) else v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert key(ours) == key(theirs)


def test_bootstrap_draws_as_rows_would(spark):
    """Cell counts drawn per replicate against whole rows drawn with replacement within each app."""
    cells = {r.app: np.array([r.yp, r.yn, r.np, r.nn]) for r in bootstrap.cell_counts(view(spark, SF, "labeled")).collect()}
    assert sum(c.sum() for c in cells.values()) == view(spark, SF, "labeled").count()
    assert all((bootstrap.draw(app, 3, c) == bootstrap.draw(app, 3, c)).all() and bootstrap.draw(app, 3, c).sum() == c.sum() for app, c in cells.items())
    rng, drawn = np.random.default_rng(1), {}
    for app, c in cells.items():
        rows = np.repeat(np.arange(4), c)
        drawn[app] = np.array([np.bincount(rng.choice(rows, len(rows)), minlength=4) for _ in range(2000)])

    def diffs(x):
        return x[:, 0] / (x[:, 0] + x[:, 1]) - x[:, 2] / (x[:, 2] + x[:, 3])

    everything = diffs(sum(drawn.values()))
    ci, above = (registry.QUERIES[name](spark, SF).first() for name in ("bootstrap_ci", "boot_prob"))
    assert np.allclose([ci.lo, ci.hi], np.percentile(everything, [2.5, 97.5]), atol=6 * everything.std() / np.sqrt(2000 * 0.05)) and above.above == (everything > 0).mean()
    for r in registry.QUERIES["bootstrap_app"](spark, SF).collect():
        own = diffs(drawn[r.app])
        assert np.allclose([r.lo, r.hi], np.percentile(own, [2.5, 97.5]), atol=6 * own.std() / np.sqrt(2000 * 0.05))
    chosen = {r.app: r.frequency for r in registry.QUERIES["boot_selected"](spark, SF).collect()}
    assert math.isclose(sum(chosen.values()), 1.0)


def ranked_strata(spark):
    """Rows of each (app, weak_label), by md5 of seed and id."""
    strata = {}
    for r in view(spark, SF, "labeled").collect():
        strata.setdefault((r.app, r.weak_label), []).append(r)
    return {k: sorted(rows, key=lambda r: (hashlib.md5(f"42:{r.review_id}".encode()).hexdigest(), r.review_id)) for k, rows in strata.items()}


def test_ordinal_check_aligns_all_documents(spark):
    rows = [(r.app, r.review_id) for r in view(spark, SF, "docs").select("app", "review_id").collect()]
    left, right = sorted(i for _, i in rows), [i for _, i in sorted(rows)]
    bigger = os.path.join(os.path.dirname(SF), "sf0.01")  # more than 200 documents
    assert registry.QUERIES["ordinal_check"](spark, bigger).count() == view(spark, bigger, "docs").count() > 200
    found = registry.QUERIES["ordinal_check"](spark, SF).orderBy("rn").collect()
    assert [(r.left_id, r.right_id, r.same) for r in found] == [(a, b, a == b) for a, b in zip(left, right, strict=True)]


def test_samples_are_the_ranked_ones(spark):
    strata = ranked_strata(spark)
    weights = {r.review_id: r.weight for r in registry.QUERIES["strata_weights"](spark, SF).collect()}
    assert weights == {r.review_id: len(rows) / min(50, len(rows)) for rows in strata.values() for r in rows[:50]}
    share = sum(len(rows) * sum(r.gold == "negative" for r in rows[:50]) / min(50, len(rows)) for rows in strata.values()) / sum(map(len, strata.values()))
    assert math.isclose(registry.QUERIES["poststratified"](spark, SF).first().share, share, abs_tol=1e-9)


def test_text_model_has_the_whole_grid(spark):
    rows = spark.createDataFrame([("Ab  abcd",), ("x",), (None,)], "content string")
    assert [r.g for r in rows.select(ml.char_grams(F.coalesce("content", F.lit(""))).alias("g")).collect()] == [
        [" ab", "ab ", " ab ", " ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "], [" x "], []
    ]
    scored = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0)], "label double, prediction double")
    assert math.isclose(ml.macro_f1(scored), (2 / 3 + 1 / 2 + 0) / 3)
    assert len(ml.MIN_DF) * len(ml.C) == 15


def test_neutral_words(spark):
    """Rules apply in order, whatever the case; a name keeps an ending but isn't found inside another word."""
    apply, _ = T.neutralizer([("kestrel bank|kestrel", "app"), ("lumio", "shop")])
    cases = {"Kestrel Bank is down": "app is down", "my KESTREL": "my app", "lumionya late": "shopnya late", "Lumio or kestrel?": "shop or app?", "kestrels fly": "kestrels fly", "volumio": "volumio", "": ""}
    found = {r.t: r.n for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", apply(F.col("t")).alias("n")).collect()}
    assert found == cases


def brute_allocation(sizes, total, mode):
    """One row at a time to the stratum that is farthest below its wish, in fractions."""
    total, whole = min(total, sum(sizes.values())), sum(sizes.values())
    given = dict.fromkeys(sizes, 0)
    if mode == "proportional":
        given = {k: n * total // whole for k, n in sizes.items()}
        for k in sorted(sizes, key=lambda k: (-(sizes[k] * total % whole), k))[: total - sum(given.values())]:
            given[k] += 1
        return given
    for _ in range(total):
        k = min((k for k in sizes if given[k] < sizes[k]), key=lambda k: (given[k], k))
        given[k] += 1
    return given


def test_allocation(spark):
    with pytest.raises(files.ContractError, match="unknown mode"):
        joins.allocate(spark.range(1).selectExpr("id AS k", "id AS n"), "k", 1, "other")
    for sizes in ({"a": 1, "b": 9, "c": 30}, {"a": 100, "b": 2, "c": 50, "d": 2}, {"x": 5}):
        strata = spark.createDataFrame(list(sizes.items()), "k string, n long")
        for total in (1, 2, 7, 13, 38, 60, 200):
            for mode in ("equal", "proportional"):
                assert {r.k: r.alloc for r in joins.allocate(strata, "k", total, mode).collect()} == brute_allocation(sizes, total, mode)


def test_contracts_stop(spark, tmp_path):
    one, twice = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string"), spark.createDataFrame([(1, "c"), (1, "d")], "k long, y string")
    with pytest.raises(Exception, match="right: k 1 occurs twice"):
        joins.validated_join(one, twice, "k").collect()
    with pytest.raises(Exception, match="left: k 1 occurs twice"):
        joins.validated_join(twice, one, "k").collect()
    with pytest.raises(Exception, match="no k on the right: 2"):
        joins.validated_join(one, twice.limit(1), "k", cover=True).collect()
    assert joins.validated_join(one, twice, "k", "left", unique=("left",)).count() == 3
    home = f"file://{tmp_path}"
    files.write_new(one, f"{home}/t")
    with pytest.raises(files.ContractError, match="there already"):
        files.write_new(one, f"{home}/t")
    assert files.replace_table(one.limit(1), f"{home}/t").count() == 1 and not [p for p in os.listdir(tmp_path) if p.endswith((".part", ".old"))]
    with pytest.raises(Exception, match="no way"):
        files.replace_table(one.select(F.raise_error(F.lit("no way")).cast("string").alias("k")), f"{home}/t")
    assert spark.read.parquet(f"{home}/t").count() == 1  # a failed write leaves what was there
    files.write_sheet(one, f"{home}/s")
    with pytest.raises(files.ContractError, match="lacks"):
        files.read_sheet(spark, f"{home}/s", ["k", "label"])
    with pytest.raises(files.ContractError, match="too"):
        files.read_sheet(spark, f"{home}/s", ["k"])
    files.write_report(spark, f"{home}/c.yaml", {"a": 1})
    with pytest.raises(files.ContractError, match="lacks"):
        files.read_config(spark, f"{home}/c.yaml", ("a", "b"))


def test_paged_ingest_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i == 3 else f"2024-01-{1 + i % 9:02d} 00:00:00") for i in [*range(40), 7, 7]], "id long, t string").selectExpr("id", "cast(t as timestamp) as t")
    home, listing = f"file://{tmp_path}/i", f"file://{tmp_path}/listing"
    paged.publish(rows, "id", "t", 6, listing)
    first = paged.Ingest(spark, listing, home)
    assert first.run(max_pages=2) is None
    newest = sorted(([f"2024-01-{1 + i % 9:02d}", i] for i in [*range(40), 7, 7] if i != 3), reverse=True)
    assert {r.id for r in first.rows().collect()} == {i for _, i in newest[:12]}  # two pages of six
    spark.range(3).selectExpr("id", "current_timestamp() as t").write.parquet(f"{home}/part-000002")  # an orphan
    assert paged.Ingest(spark, listing, home).run() == "exhausted"
    found = paged.Ingest(spark, listing, home).rows()
    assert sorted(r.id for r in found.collect()) == list(range(40))  # the state of ids outlived the stop
    assert {(r.id, r.t) for r in found.collect()} == {(r.id, r.t) for r in rows.collect()}
    assert paged.Ingest(spark, listing, home).run() == "exhausted" and found.count() == 40
    with pytest.raises(files.ContractError, match="begun with"):
        paged.Ingest(spark, listing, home, cap=3)
    capped = paged.Ingest(spark, listing, f"{home}c", since="2024-01-02", cap=10)
    assert capped.run() == "cap" and capped.rows().count() == 10
    old = paged.Ingest(spark, listing, f"{home}s", since="2024-01-08")
    assert old.run() == "since" and {r.id % 9 for r in old.rows().collect()} == {7, 8}
    paged.publish(rows.limit(0), "id", "t", 6, f"{listing}e")
    assert paged.Ingest(spark, f"{listing}e", f"{home}e").run() == "exhausted"
    waits, asked = [], []

    def flaky():
        asked.append(1)
        if len(asked) < 4:
            raise OSError("busy")
        return 5

    assert paged.with_retries(flaky, base=1, most=3, sleep=waits.append) == 5 and waits == [1, 2, 3]


def test_scoring(spark):
    scorer = scoring.keyword_scorer()
    p = scorer.probabilities(["an error", "view", "", "error view purchase"])
    assert np.allclose(p.sum(axis=1), 1) and p.argmax(axis=1).tolist() == [0, 1, 0, 0] and scorer.probabilities([]).shape == (0, 3)
    rows = spark.createDataFrame([(1, "view"), (2, None), (3, "view"), (4, "")], "id long, t string")
    found = {r.id: r.pred_label for r in scoring.score_distinct(rows, "t", scoring.keyword_scorer, scoring.LABELS, batch=1).collect()}
    assert found == {1: "neutral", 2: "negative", 3: "neutral", 4: "negative"}
    assert scoring.score_distinct(rows.limit(0), "t", scoring.keyword_scorer, scoring.LABELS).count() == 0
    assert scoring.analyze_one(spark, "error again", 5, 3) == {"id": 0, "text_clean": "error again", "pred_label": "negative", "complaint": True, "flagged_by": "model", "topic": 3, "note": "topic"}
    assert scoring.analyze_one(spark, "view", 1)["note"] == "stars only" and scoring.analyze_one(spark, "error", None)["note"] == "too short" and scoring.analyze_one(spark, None, 5)["complaint"]


def test_entry_points_need_no_session():
    """Nothing is made of the engine's at import, and every oracle has its query."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(o) > 130"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
