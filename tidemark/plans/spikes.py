"""Weeks that stand out: volume, stars, topics and days of a spike week against an app's other complete weeks.

The oracle of each query is written from the definition, in another form than
the query, so agreement says more than that two engines read one text alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import newcombe, rate, wilson
from tidemark.plans.views import duck, view

SPIKE, OUTLIER, UNSPECIFIC, RISING = "2024-01-15", -1, (0,), 3
QUERIES, ORACLES = {}, {}
_Z = "1.959963984540054e0"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, duck(sql)
        return f

    return add


def _macro(k: str, n: str, sign: str) -> str:
    """A Wilson bound in its textbook form."""
    return f"(({k}) / ({n}) + {_Z} * {_Z} / (2 * ({n})) {sign} {_Z} * sqrt((({k}) / ({n})) * (1 - ({k}) / ({n})) / ({n}) + {_Z} * {_Z} / (4 * ({n}) * ({n})))) / (1 + {_Z} * {_Z} / ({n}))"


def _difference(k1: str, n1: str, k2: str, n2: str) -> tuple[str, str]:
    d = f"(({k1}) / ({n1}) - ({k2}) / ({n2}))"
    low = f"{d} - sqrt(power(({k1}) / ({n1}) - {_macro(k1, n1, '-')}, 2) + power({_macro(k2, n2, '+')} - ({k2}) / ({n2}), 2))"
    high = f"{d} + sqrt(power({_macro(k1, n1, '+')} - ({k1}) / ({n1}), 2) + power(({k2}) / ({n2}) - {_macro(k2, n2, '-')}, 2))"
    return low, high


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with `side`: of the spike week, of another complete week, or null."""
    week = F.col("week").cast("string")
    side = F.when(week == SPIKE, "spike").when(~F.col("is_partial_week"), "base")
    return view(spark, sf_dir, "reviews").select("app", "score", "ts", "day", "topic", "is_complaint", "is_partial_week", week.alias("week"), side.alias("side"))


def _elapsed(reviews: DataFrame) -> DataFrame:
    """week, days: 7 for complete weeks, else from the first day with data, or Monday, to the last review."""
    monday = F.col("week").cast("timestamp_ntz")
    span = reviews.groupBy("week").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.bool_or("is_partial_week").alias("partial"))
    first, last = F.greatest(F.date_trunc("day", "a").cast("timestamp_ntz"), monday), F.least("b", monday + F.expr("INTERVAL 7 DAYS"))
    micros = F.expr("timestampdiff(MICROSECOND, first, last)")
    span = span.withColumn("first", first).withColumn("last", last)
    return span.select("week", F.when(F.col("partial"), micros / 86400e6).otherwise(7.0).alias("days"))


_DUCK_DAYS = "CASE WHEN bool_or(is_partial_week) THEN (epoch_us(least(max(ts), CAST(week AS TIMESTAMP) + INTERVAL 7 DAY)) - epoch_us(greatest(CAST(CAST(min(ts) AS DATE) AS TIMESTAMP), CAST(week AS TIMESTAMP)))) / 86400e6 ELSE 7.0 END"


@query(f"SELECT CAST(week AS STRING) AS week, CAST({_DUCK_DAYS} AS DOUBLE) AS days FROM {{reviews}} GROUP BY week")
def week_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elapsed(_reviews(spark, sf_dir))


_LO, _HI = _difference("k1", "n1", "k2", "n2")


@query(
    f"WITH r AS (SELECT *, week = DATE '{SPIKE}' AS spike FROM {{reviews}} WHERE NOT is_partial_week), w AS (SELECT app, week, count(*)::DOUBLE AS n, sum(is_complaint::INT) / count(*)::DOUBLE AS share FROM r WHERE NOT spike GROUP BY app, week), m AS (SELECT app, median(n) AS med, median(share) AS med_share FROM w GROUP BY app), c AS (SELECT app, count(*) FILTER (spike)::DOUBLE AS n1, count(*) FILTER (spike AND is_complaint)::DOUBLE AS k1, count(*) FILTER (NOT spike)::DOUBLE AS n2, count(*) FILTER (NOT spike AND is_complaint)::DOUBLE AS k2 FROM r GROUP BY app) SELECT app, CAST(n1 AS BIGINT) AS n_spike, 7e0 AS days, n1 / 7 AS per_day, med AS median_week, (n1 / 7) / (med / 7) AS ratio_per_day, k1 / n1 AS share, med_share, k2 / n2 AS pooled_share, round(k1 / n1 - k2 / n2, 9) AS diff, round({_LO}, 9) AS lo, round({_HI}, 9) AS hi FROM c JOIN m USING (app)"
)
def spike_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = _reviews(spark, sf_dir)
    weeks = reviews.where("side is not null").groupBy("app", "side", "week").agg(F.count("*").alias("n"), F.count_if("is_complaint").alias("k"))
    days = _elapsed(reviews.where(F.col("week") == SPIKE)).select("days")
    of = lambda side, c: F.sum(F.when(F.col("side") == side, F.col(c)))
    base = lambda c: F.when(F.col("side") == "base", c)
    sums = weeks.groupBy("app").agg(of("spike", "n").alias("n1"), of("spike", "k").alias("k1"), of("base", "n").alias("n2"), of("base", "k").alias("k2"), F.median(base(F.col("n").cast("double"))).alias("median_week"), F.median(base(rate(F.col("k"), F.col("n")))).alias("med_share"))
    s = sums.crossJoin(F.broadcast(days))  # one row
    lo, hi = newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    per_day = F.col("n1") / F.col("days")
    return s.select(
        "app", F.col("n1").alias("n_spike"), "days", per_day.alias("per_day"), "median_week", (per_day / (F.col("median_week") / 7.0)).alias("ratio_per_day"),
        rate(F.col("k1"), F.col("n1")).alias("share"), "med_share", rate(F.col("k2"), F.col("n2")).alias("pooled_share"),
        F.round(rate(F.col("k1"), F.col("n1")) - rate(F.col("k2"), F.col("n2")), 9).alias("diff"), F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"),
    )


@query(
    f"WITH r AS (SELECT app, score, week = DATE '{SPIKE}' AS spike FROM {{reviews}} WHERE NOT is_partial_week), t AS (SELECT app, count(*) FILTER (spike) AS n1, count(*) FILTER (NOT spike) AS n2 FROM r GROUP BY app) SELECT app, score, share_spike, share_base, round(100 * (share_spike - share_base), 9) AS diff_pp FROM (SELECT t.app, CAST(s AS INT) AS score, (SELECT count(*) FROM r WHERE r.app = t.app AND r.score = s AND spike) / n1::DOUBLE AS share_spike, (SELECT count(*) FROM r WHERE r.app = t.app AND r.score = s AND NOT spike) / n2::DOUBLE AS share_base FROM t CROSS JOIN range(1, 6) AS x(s)) AS u"
)
def spike_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _reviews(spark, sf_dir).where("side is not null").groupBy("app").agg(*[F.count_if((F.col("side") == side) & (F.col("score") == s)).alias(f"{side}{s}") for side in ("spike", "base") for s in range(1, 6)])
    total = lambda side: sum((F.col(f"{side}{s}") for s in range(2, 6)), F.col(f"{side}1"))
    stars = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), rate(F.col(f"spike{s}"), total("spike")).alias("share_spike"), rate(F.col(f"base{s}"), total("base")).alias("share_base")) for s in range(1, 6)]))
    return counted.select("app", stars.alias("x")).select("app", "x.*", F.round(100.0 * (F.col("x.share_spike") - F.col("x.share_base")), 9).alias("diff_pp"))


@query(
    f"WITH r AS (SELECT app, topic, week = DATE '{SPIKE}' AS spike FROM {{reviews}} WHERE is_complaint AND NOT is_partial_week), t AS (SELECT app, count(*) FILTER (spike)::DOUBLE AS n1, count(*) FILTER (NOT spike)::DOUBLE AS n2 FROM r GROUP BY app), c AS (SELECT r.app, topic, count(*) FILTER (spike)::DOUBLE AS k1, count(*) FILTER (NOT spike)::DOUBLE AS k2, any_value(n1) AS n1, any_value(n2) AS n2 FROM r JOIN t USING (app) GROUP BY r.app, topic), d AS (SELECT app, topic, topic NOT IN ({OUTLIER}, {UNSPECIFIC[0]}) AS specific, round(100 * (k1 / n1 - k2 / n2), 9) AS diff_pp, round(100 * ({_LO}), 7) AS lo, round(100 * ({_HI}), 7) AS hi FROM c) SELECT d.*, CASE WHEN specific AND diff_pp > 0 THEN CASE WHEN place <= {RISING} THEN place END END AS rising FROM (SELECT d.*, (SELECT count(*) FROM d e WHERE e.app = d.app AND e.specific AND e.diff_pp > 0 AND (e.diff_pp > d.diff_pp OR e.diff_pp = d.diff_pp AND e.topic <= d.topic)) AS place FROM d) AS d"
    .replace("SELECT d.*, CASE", "SELECT app, topic, specific, diff_pp, lo, hi, CASE")
)
def spike_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift of each topic's share of fitted complaints; the outlier topic and the unspecific ones are reported but never rising."""
    from pyspark.sql import Window

    base = _reviews(spark, sf_dir).where("is_complaint and side is not null")
    hits = base.groupBy("app", "topic").agg(F.count_if(F.col("side") == "spike").alias("k1"), F.count_if(F.col("side") == "base").alias("k2"))
    totals = hits.groupBy(F.col("app").alias("a")).agg(F.sum("k1").alias("n1"), F.sum("k2").alias("n2"))
    j = hits.join(totals, F.col("app") == F.col("a"))
    lo, hi = newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    diff = F.round(100.0 * (rate(F.col("k1"), F.col("n1")) - rate(F.col("k2"), F.col("n2"))), 9)
    out = j.select("app", "topic", (~F.col("topic").isin(OUTLIER, *UNSPECIFIC)).alias("specific"), diff.alias("diff_pp"), F.round(100.0 * lo, 7).alias("lo"), F.round(100.0 * hi, 7).alias("hi"))
    rises = F.col("specific") & (F.col("diff_pp") > 0)
    # A row a topic and app: rising ones first, so their places count only each other.
    place = F.row_number().over(Window.partitionBy("app").orderBy(F.desc(rises), F.desc("diff_pp"), "topic"))
    return out.withColumn("place", place).select("app", "topic", "specific", "diff_pp", "lo", "hi", F.when(rises & (F.col("place") <= RISING), F.col("place").cast("long")).alias("rising"))


@query(
    f"SELECT app, CAST(d AS STRING) AS day, count(*) AS n, sum(is_complaint::INT)::BIGINT AS k, count(*) / (SELECT count(*)::DOUBLE FROM {{reviews}} s WHERE s.app = r.app AND s.week = DATE '{SPIKE}') AS share_of_week FROM (SELECT *, CAST(ts AS DATE) AS d FROM {{reviews}}) r WHERE d >= DATE '{SPIKE}' - 7 AND d < DATE '{SPIKE}' + 7 GROUP BY app, d"
)
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from a week before the spike week to its end, each against the spike week's volume."""
    rows = _reviews(spark, sf_dir).where(F.col("day").between(F.date_sub(F.lit(SPIKE).cast("date"), 7), F.date_add(F.lit(SPIKE).cast("date"), 6)))
    daily = rows.groupBy("app", "day").agg(F.count("*").alias("n"), F.count_if("is_complaint").alias("k"), F.count_if(F.col("side") == "spike").alias("in_week"))
    week = daily.groupBy(F.col("app").alias("a")).agg(F.sum("in_week").alias("week_n"))
    return daily.join(week, F.col("app") == F.col("a")).select("app", F.col("day").cast("string").alias("day"), "n", "k", rate(F.col("n"), F.col("week_n")).alias("share_of_week"))


_LO1, _HI1 = _macro("k::DOUBLE", "n::DOUBLE", "-"), _macro("k::DOUBLE", "n::DOUBLE", "+")


@query(
    f"WITH d AS (SELECT app, CAST(ts AS DATE) AS day, count(*) AS n, sum(is_complaint::INT)::BIGINT AS k FROM {{reviews}} WHERE week = DATE '{SPIKE}' GROUP BY 1, 2), w AS (SELECT app, sum(n)::DOUBLE AS week_n, max(n) AS top FROM d GROUP BY app) SELECT d.app, CAST(min(day) AS STRING) AS peak_day, arg_min(n, day) AS n, arg_min(n, day) / any_value(week_n) AS share_of_week, arg_min(k / n::DOUBLE, day) AS share, round(arg_min({_LO1}, day), 9) AS lo, round(arg_min({_HI1}, day), 9) AS hi, (any_value(week_n) - arg_min(n, day)) / 6e0 AS rest_per_day FROM d JOIN w ON d.app = w.app AND n = top GROUP BY d.app"
)
def peak_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spike week's busiest day (the first of equal ones) and the rate of its other days."""
    reviews = _reviews(spark, sf_dir).where(F.col("side") == "spike")
    daily = reviews.groupBy("app", "day").agg(F.count("*").alias("n"), F.count_if("is_complaint").alias("k"))
    peak = daily.groupBy("app").agg(F.sum("n").alias("week_n"), F.max_by(F.struct("day", "n", "k"), F.struct("n", -F.datediff("day", F.lit(SPIKE)))).alias("p"))
    p = peak.select("app", "week_n", "p.*").crossJoin(F.broadcast(_elapsed(reviews).select("days")))  # one row
    lo, hi = wilson(F.col("k"), F.col("n"))
    rest = (F.col("week_n") - F.col("n")).cast("double") / F.greatest(F.col("days") - 1.0, F.lit(1e-9))
    return p.select("app", F.col("day").cast("string").alias("peak_day"), "n", rate(F.col("n"), F.col("week_n")).alias("share_of_week"), rate(F.col("k"), F.col("n")).alias("share"), F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"), rest.alias("rest_per_day"))


@query(f"WITH c AS (SELECT app, score, count(*) FILTER (pred_label = 'negative')::DOUBLE AS k, count(*)::DOUBLE AS n FROM {{labeled}} GROUP BY app, score) SELECT a.app, a.score AS score, b.score AS other, round(a.k / a.n - b.k / b.n, 9) AS diff, round({_difference('a.k', 'a.n', 'b.k', 'b.n')[0]}, 9) AS lo, round({_difference('a.k', 'a.n', 'b.k', 'b.n')[1]}, 9) AS hi FROM c a JOIN c b ON a.app = b.app AND a.score < b.score")
def newcombe_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the predicted negative shares of each two stars of an app, with its interval."""
    c = view(spark, sf_dir, "labeled").groupBy("app", "score").agg(F.count_if(F.col("pred_label") == "negative").alias("k"), F.count("*").alias("n"))
    d = c.select(F.col("app").alias("b"), F.col("score").alias("other"), F.col("k").alias("k2"), F.col("n").alias("n2"))
    j = c.join(d, (F.col("app") == F.col("b")) & (F.col("score") < F.col("other")))
    lo, hi = newcombe(F.col("k"), F.col("n"), F.col("k2"), F.col("n2"))
    return j.select("app", "score", "other", F.round(rate(F.col("k"), F.col("n")) - rate(F.col("k2"), F.col("n2")), 9).alias("diff"), F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))
