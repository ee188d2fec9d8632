"""A cache asks for what it lacks alone, and isn't shuffled itself."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.cache import ResultCache, Settings
from tidemark.sources.files import ContractError

TEXTS = ["a", "b", "a", None, "", "c" * 5000, "a"]


def test_asks_for_what_it_lacks(spark, tmp_path):
    home, asked = f"file://{tmp_path}/cache", []

    def compute(rows):
        asked.append(sorted(r.text for r in rows.collect()))
        return rows.select(F.length("text").alias("n"), "key")

    table = lambda texts: spark.createDataFrame([(t, "k") for t in texts], "t string, key string")
    own = Settings("m", "p", 8)
    cache = ResultCache(spark, home, "n INT", 8)
    assert sorted(r.n for r in cache.results(table(TEXTS[:2]), "t", own, compute).collect()) == [1, 1]
    assert sorted(r.n for r in cache.results(table(TEXTS), "t", own, compute).collect()) == [0, 1, 1, 5000]
    assert asked == [["a", "b"], ["", "c" * 5000]]
    for k, other in enumerate((Settings("m2", "p", 8), Settings("m", "", 8), Settings("m", "p", 9), Settings("m", "p"), Settings("mp", "", 8)), 2):
        assert cache.results(table(["a"]), "t", other, compute).count() == 1
        assert asked[k] == ["a"]
    spark.sql(f"DROP TABLE {cache.name}")  # as in a later session
    again = ResultCache(spark, home, "n INT", 8)
    assert again.lacking(table(TEXTS), "t", own).count() == 0 and again.lacking(table([]), "t", own).count() == 0
    assert again.rows().count() == 9
    with pytest.raises(ContractError):
        ResultCache(spark, home, "n BIGINT", 8)


def test_cache_is_not_shuffled(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cache = ResultCache(spark, f"file://{tmp_path}/cache", "n INT", 8)
        rows = spark.range(1000).select(F.col("id").cast("string").alias("t"))
        found = cache.results(rows, "t", Settings("m"), lambda lack: lack.select("key", F.length("text").alias("n")))
        for df in (found, cache.lacking(rows, "t", Settings("m"))):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            # The texts asked for are shuffled; above the cache's scan is no exchange up to the join.
            depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
            lines = plan.splitlines()
            at = next(i for i, line in enumerate(lines) if "FileScan" in line and cache.name in line)
            above, least = [], depth(lines[at])
            for line in reversed(lines[:at]):
                if depth(line) < least:
                    above.append(line)
                    least = depth(line)
                if "Join" in line:
                    break
            assert "Join" in above[-1] and not any("Exchange" in line for line in above), plan
        assert found.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
