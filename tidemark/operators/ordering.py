"""Row numbers and order statistics without a task that holds a whole table or group.

Numbers: rows are sorted by ranges, a task a range, and written with their place in
it; a range's rows before it (a count a range) are added. Within strata, the rows
are sorted by stratum and order together, and a stratum's first number is taken off.

Order statistics: a rank's value is looked for in ranges that shrink. Each round
counts the values of the range that holds it in CLASSES classes of equal width, on
the map side first, and goes on with the values' bounds in the class of the rank,
until they are equal. Ties are counts, so a value that all rows have ends the
search at once.

Defined results: orders must end with a unique key, else the order of equal rows
is any; null values have no rank; a group without values has no row; empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.catalog import DUCK, SQL, rnd
from tidemark.plans.storage import materialize
from tidemark.plans.views import duck, view

QUERIES, ORACLES = {}, {}
CLASSES = 1024


def query(f):
    """In place of the catalog's query of this name, held against the same SQL."""
    QUERIES[f.__name__] = f
    ORACLES[f.__name__] = duck(DUCK.get(f.__name__, SQL[f.__name__]))
    return f


def numbered(df: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """df with the number of each row, from 1."""
    cores = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = df.repartitionByRange(cores, *order).sortWithinPartitions(*order)
    placed = materialize(ranges.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    offsets = placed.groupBy("__range").agg(F.count("*").alias("n")).select("__range", before.alias("__before"))
    return placed.join(offsets, "__range").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def numbered_within(df: DataFrame, strata: list[str], order: list[str | Column], name: str = "rn", size: str = "n") -> DataFrame:
    """df with the number of each row in its stratum, from 1, and the stratum's size."""
    every = numbered(df, [*strata, *order], "__number")
    first = every.groupBy(*strata).agg(F.min("__number").alias("__first"), F.count("*").alias(size))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in strata]
    joined = every.alias("a").join(first.alias("b"), same)
    return joined.select("a.*", (F.col("__number") - F.col("__first") + 1).alias(name), size).drop("__number")


def order_statistics(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """grp, rank, v: the values of some ranks (from 1). rows: grp, v; ranks: grp, rank, a few a group."""
    rows = rows.where("v is not null")
    state = ranks.join(rows.groupBy("grp").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "grp").withColumn("left", F.col("rank"))
    while True:
        state = materialize(state.select("grp", "rank", "left", "lo", "hi"), "ranks")
        if state.where("lo < hi").isEmpty():
            return state.select("grp", "rank", F.col("lo").alias("v"))
        wide = state.where("lo < hi")
        inside = rows.join(wide, "grp").where("v between lo and hi")
        width = F.col("hi").cast("double") / 2 - F.col("lo").cast("double") / 2  # halves, as the whole may be infinite
        cell = F.least(F.floor((F.col("v").cast("double") / 2 - F.col("lo").cast("double") / 2) / width * CLASSES), F.lit(CLASSES - 1)).cast("int")
        # Of values that differ by less than the width can tell, the least are a class of their own.
        cell = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), CLASSES).otherwise(cell)
        counts = inside.withColumn("cell", cell).groupBy("grp", "rank", "left", "cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        up_to = F.sum("n").over(Window.partitionBy("grp", "rank").orderBy("cell"))  # CLASSES + 2 rows
        found = counts.withColumn("up", up_to).where((F.col("left") <= F.col("up")) & (F.col("left") > F.col("up") - F.col("n")))
        state = found.select("grp", "rank", (F.col("left") - F.col("up") + F.col("n")).alias("left"), "lo", "hi").unionByName(state.where("lo = hi").select("grp", "rank", "left", "lo", "hi"))


def percentiles(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """grp and a column for each share: between the two nearest ranks, in proportion."""
    sizes = rows.where("v is not null").groupBy("grp").agg(F.count("*").alias("n"))
    at = sizes.select("grp", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for k, p in shares.items()])).alias("q")).select("grp", "q.*", "n")
    ends = materialize(at.select("grp", "name", "at", (F.floor("at") + 1).cast("long").alias("below"), F.least(F.floor("at") + 2, F.col("n")).cast("long").alias("above")), "places")
    ranks = ends.select("grp", F.explode(F.array("below", "above")).alias("rank")).distinct()
    values = materialize(order_statistics(rows, ranks), "values")
    both = ends.join(values.select("grp", F.col("rank").alias("below"), F.col("v").alias("low")), ["grp", "below"]).join(values.select("grp", F.col("rank").alias("above"), F.col("v").alias("high")), ["grp", "above"])
    part = F.col("at") - F.floor("at")
    value = (1 - part) * F.col("low").cast("double") + part * F.col("high").cast("double")
    return both.groupBy("grp").agg(*[F.max(F.when(F.col("name") == k, value)).alias(k) for k in shares])


# ---- queries of the catalog, planned this way


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "labeled").select("review_id", "app", "weak_label", F.expr(rnd(42)).alias("draw"))
    return numbered_within(rows, ["app", "weak_label"], ["draw", "review_id"])


@query
def split_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each stratum, by a random order, to validate on."""
    return _ranked(spark, sf_dir).select("review_id", F.when(F.col("rn") * 10 <= F.col("n"), "val").otherwise("train").alias("part"))


@query
def sort_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each review's place in its app, by time and id."""
    rows = view(spark, sf_dir, "reviews").select("review_id", "app", "ts")
    return numbered_within(rows, ["app"], ["ts", "review_id"], "place").select("review_id", "app", "place")


@query
def ordinal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of the texts, aligned row by row."""
    rows = view(spark, sf_dir, "texts").select("review_id", "app")
    left = numbered(rows.select("review_id"), ["review_id"], "rn").select("rn", F.col("review_id").alias("left_id"))
    right = numbered(rows, ["app", "review_id"], "rn").select("rn", F.col("review_id").alias("right_id"))
    return left.join(right, "rn").select("rn", "left_id", "right_id", (F.col("left_id") == F.col("right_id")).alias("same"))


@query
def roundrobin_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty errors, one of each kind in turn, kinds with fewer errors first."""
    errors = view(spark, sf_dir, "labeled").where("gold <> pred_label").select("review_id", F.expr("gold || '>' || pred_label").alias("kind"), F.expr(rnd(3)).alias("draw"))
    turns = numbered_within(errors, ["kind"], ["draw", "review_id"], "rn", "size")
    return turns.orderBy("rn", "size", "kind").limit(40).select("review_id", "kind", "rn")


@query
def downsample_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand reviews, of each app in proportion, by a random order."""
    from tidemark.operators.joins import allocate

    rows = view(spark, sf_dir, "labeled").select("review_id", "app", F.expr(rnd(5)).alias("draw"))
    parts = allocate(rows.groupBy("app").agg(F.count("*").alias("n")), "app", 1000, "proportional").select(F.col("app").alias("of"), "alloc")
    drawn = numbered_within(rows, ["app"], ["draw", "review_id"])
    return drawn.join(parts, F.col("app") == F.col("of")).where("rn <= alloc").select("review_id", "app")


@query
def len_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, ninth decile and last percentile of the texts' lengths, by app."""
    rows = view(spark, sf_dir, "texts").select(F.col("app").alias("grp"), F.col("n_chars").alias("v"))
    return percentiles(rows, {"p50": 0.5, "p90": 0.9, "p99": 0.99}).withColumnRenamed("grp", "app")


@query
def calibrate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that a tenth of all rows doesn't exceed."""
    rows = view(spark, sf_dir, "reviews").select(F.lit(0).alias("grp"), F.col("value").alias("v"))
    rank = rows.where("v is not null").groupBy("grp").agg(F.expr("(count(*) + 9) div 10").alias("rank"))
    return order_statistics(rows, rank).select((F.col("v") + 1e-9).alias("threshold"))
