"""Joins that check what they rely on, and allocation of a sample over strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.views import duck, view
from tidemark.sources.files import ContractError

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def required(holds: Column, message: Column) -> Column:
    """A filter that lets every row through and stops the query at one that breaks a contract."""
    return F.when(holds, True).otherwise(F.raise_error(message).cast("boolean"))


def _by_key(df: DataFrame, key: str, side: str, unique: bool) -> DataFrame:
    """key, rows as one struct column; with `unique` a row a key, checked by the place of rows of a key, on the sort that the join needs."""
    rows = df.select(F.col(key).alias("__key"), F.struct(*[c for c in df.columns if c != key]).alias(f"__{side}"))
    if not unique:
        return rows
    placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("__key")))
    said = F.concat(F.lit(f"{side}: {key} "), F.coalesce(F.col("__key").cast("string"), F.lit("null")), F.lit(" occurs twice"))
    return placed.where(required(F.col("__n") == 1, said)).drop("__n")


def validated_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", unique: tuple[str, ...] = ("left", "right"), cover: bool = False) -> DataFrame:
    """A join on one key whose contracts are part of its plan: they are checked by the job that reads the result, on the same shuffle.

    `unique` names the sides on which the key must be; with `cover` each row of the left must find one.
    """
    a, b = _by_key(left, key, "left", "left" in unique), _by_key(right, key, "right", "right" in unique)
    joined = a.join(b, "__key", "left" if cover else how)
    if cover:
        joined = joined.where(required(F.col("__right").isNotNull(), F.concat(F.lit(f"no {key} on the right: "), F.coalesce(F.col("__key").cast("string"), F.lit("null")))))
    return joined.select(F.col("__key").alias(key), "__left.*", "__right.*").select(*left.columns, *[c for c in right.columns if c != key])


@query("SELECT review_id, app, text_clean, pred_label FROM {reviews} WHERE is_complaint")
def join_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews and their predictions, one to one, none missing."""
    reviews = view(spark, sf_dir, "reviews")
    return validated_join(reviews.select("review_id", "app", "text_clean"), reviews.select("review_id", "pred_label", "is_complaint"), "review_id", cover=True).where("is_complaint").drop("is_complaint")


@query("SELECT review_id, app, CAST(week AS STRING) AS week, CAST(day AS STRING) AS day, is_complaint AS in_fit, CASE WHEN is_complaint THEN topic END AS topic FROM {reviews}")
def trends_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews, predictions and topics; just the complaints must have topics."""
    reviews = view(spark, sf_dir, "reviews")
    text = lambda c: F.col(c).cast("string").alias(c)
    base = validated_join(reviews.select("review_id", "app", text("week"), text("day")), reviews.select("review_id", "is_complaint"), "review_id", cover=True)
    topics = reviews.where("is_complaint").select("review_id", "topic", F.lit(True).alias("in_fit"))
    out = validated_join(base, topics, "review_id", how="left")
    out = out.where(required(F.col("is_complaint") == F.col("topic").isNotNull(), F.lit("topics are not those of the complaints")))
    return out.select("review_id", "app", "week", "day", F.coalesce("in_fit", F.lit(False)).alias("in_fit"), "topic")


@query("SELECT doc_id, quality, CAST((SELECT length(text) FROM {documents} d WHERE d.doc_id = l.doc_id) AS INT) AS n_text FROM {labels} l")
def attach_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the length of their texts; a label without text is an error."""
    labels, docs = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    lengths = docs.where("text is not null").select("doc_id", F.length("text").alias("n_text"))
    return validated_join(labels.select("doc_id", "quality"), lengths, "doc_id", how="left", unique=("right",), cover=True)


# ---- allocation over strata


def allocate(strata: DataFrame, key: str, total: Column | int, mode: str) -> DataFrame:
    """strata (key, n) with alloc: parts of `total` that no stratum's size falls short of. Windows are over strata, not their rows.

    `proportional`: whole parts, and the rest one by one to the largest remainders. `equal`: strata are filled to one
    level, small ones whole; what the level leaves goes one by one to those above it. By key where equal.
    """
    every = Window.partitionBy(F.lit(0))  # a row a stratum
    sized = strata.select(key, "n", F.least(F.lit(total) if isinstance(total, int) else total, F.sum("n").over(every)).cast("long").alias("total"))
    if mode == "proportional":
        whole = F.sum("n").over(every)
        parts = sized.select(key, "n", "total", F.expr("(n * total) div (sum(n) over (partition by 0))").alias("base"), ((F.col("n") * F.col("total")) % whole).alias("rest"))
        place = F.row_number().over(every.orderBy(F.desc("rest"), key))
        gets = place <= F.col("total") - F.sum("base").over(every)
    elif mode == "equal":
        up = every.orderBy("n", key)
        # With the smaller strata whole, this is the level of the others; the first stratum that isn't below its own sets it.
        ranked = sized.select("*", F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), (F.count("*").over(every) - F.row_number().over(up) + 1).alias("left"))
        own = ranked.withColumn("level", F.expr("(total - below) div left"))
        level = F.max(F.when(F.col("n") > F.col("level"), F.col("level"))).over(every)  # later ones are lower
        parts = own.select(key, "n", "total", F.least("n", F.coalesce(level, F.col("n"))).alias("base"), (F.col("n") > F.coalesce(level, F.col("n"))).alias("room"))
        place = F.row_number().over(every.orderBy(F.desc("room"), key))
        gets = F.col("room") & (place <= F.col("total") - F.sum("base").over(every))
    else:
        raise ContractError(f"unknown mode {mode}")
    return parts.select("*", gets.alias("gets")).select(key, "n", (F.col("base") + F.col("gets").cast("int")).cast("long").alias("alloc"))


@query(
    "WITH c AS (SELECT topic::STRING AS topic, count(*) AS n FROM {reviews} GROUP BY topic), t AS (SELECT (sum(n) * 2 // 3)::BIGINT AS total FROM c), l AS (SELECT unnest(range(0, 100000)) AS level), f AS (SELECT max(level) AS level FROM l, t WHERE (SELECT sum(least(n, level)) FROM c) <= total), g AS (SELECT topic, n, least(n, level) AS base, n > level AS room FROM c, f), r AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY topic) AS place FROM g) SELECT topic, n, (base + CASE WHEN room AND place <= (SELECT total FROM t) - (SELECT sum(base) FROM g) THEN 1 ELSE 0 END)::BIGINT AS alloc FROM r"
)
def allocate_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal parts of two thirds of all reviews by topic, small topics whole."""
    strata = view(spark, sf_dir, "reviews").groupBy(F.col("topic").cast("string").alias("topic")).agg(F.count("*").alias("n"))
    two_thirds = F.expr("(sum(n) over (partition by 0)) * 2 div 3")
    return allocate(strata, "topic", two_thirds, "equal")
