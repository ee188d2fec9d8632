"""Model operators on Spark ML: tuned logistic regression, reduction and clustering with an outlier cut-off.

PCA and k-means stand in for manifold reduction and density clustering, which
the engine has no twin of; results differ from those by design.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, PCAModel, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import softmax, text_vectors
from tidemark.plans.storage import WIDE, materialize, new_path, settings
from tidemark.plans.views import view


#: The reference's grid. Every term is in a bucket; a bucket that min_df training rows have is a feature.
MIN_DF, C = (2, 3, 5), (0.25, 0.5, 1.0, 2.0, 4.0)


def char_grams(text: Column) -> Column:
    """Runs of 3 to 5 characters in each word with a blank on either side; shorter words once, whole.

    Batches of Arrow arrays: the engine's own lambdas are much slower at this.
    """

    @F.arrow_udf("array<string>")
    def grams_of(texts: pa.Array) -> pa.Array:
        grams, ends = [], [0]
        for t in texts.to_pylist():
            grams += text_vectors.char_grams(t or "")
            ends.append(len(grams))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams, pa.string()))

    return grams_of(text)


def fit(rows: DataFrame, c: float) -> LogisticRegressionModel:
    """Multinomial logistic regression with class weights, which add up to the rows, so 1 / (c rows) is the reference's penalty."""
    return LogisticRegression(family="multinomial", regParam=1.0 / (c * rows.count()), standardization=False, maxIter=300, tol=1e-3, weightCol="weight").fit(rows)


def macro_f1(scored: DataFrame) -> float:
    """Mean F1 of all labels that are given or predicted; undefined ones count 0."""
    return f1_of([(r.label, r.prediction, r["count"]) for r in scored.groupBy("label", "prediction").count().collect()])  # a row for each pair of labels


def f1_of(cells: list[tuple[float, float, int]]) -> float:
    """The same of (label, prediction, rows)."""
    labels = {x for label, prediction, _ in cells for x in (label, prediction)}
    hits = {label: n for label, prediction, n in cells if label == prediction}
    sizes = {x: sum(n * ((label == x) + (prediction == x)) for label, prediction, n in cells) for x in labels}
    return sum(2.0 * hits.get(x, 0) / sizes[x] for x in labels) / len(labels) if labels else 0.0


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "texts").select("review_id", "app", "content")
    counts = docs.groupBy("app").agg(F.count("*").alias("n"))
    total = docs.count()
    k = counts.count()
    return docs.join(counts, "app").withColumn("weight", F.lit(float(total)) / (F.lit(float(k)) * F.col("n")))


#: Rows of one task while a model is fitted, at least.
ROWS_A_TASK = 100


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows to train on and to hold out, their terms counted by bucket once."""
    weighted = _weighted(spark, sf_dir)
    labelled = StringIndexer(inputCol="app", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip").fit(weighted).transform(weighted)
    data = text_vectors.counted(labelled.select("review_id", "label", "weight", "content"))
    return data.where("review_id % 5 <> 0"), data.where("review_id % 5 = 0")


def _features(data: DataFrame, idf: np.ndarray) -> DataFrame:
    """Vectors, written once: neither the regression's passes nor the next model compute them again."""
    rows = text_vectors.sparse_vectors(data, idf)
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
    return rows.repartition(max(1, tasks)) if rows.rdd.getNumPartitions() < tasks else rows


def logreg_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held_out = _split(spark, sf_dir)
    idf = text_vectors.weights(train, MIN_DF[0])
    with settings(spark, WIDE):
        model = fit(_features(train, idf), C[0])  # which keeps the rows in blocks; kept here too, they would be there twice
    return materialize(model.transform(text_vectors.sparse_vectors(held_out, idf)).select("review_id", "label", "prediction"), "predictions", WIDE)


def bucket_names(texts: DataFrame, wanted: list[int]) -> DataFrame:
    """at, feature: the most frequent term of each of some buckets, by all texts; of equal ones the first."""
    some = set(wanted)  # as many as are reported

    @F.arrow_udf("array<struct<at: int, feature: string, n: int>>")
    def named(column: pa.Array) -> pa.Array:
        out = [[{"at": b, "feature": f"{part}__{term}", "n": n} for part, found in text_vectors.terms(t).items() for term, n in found.items() if (b := text_vectors.bucket(part, term)) in some] for t in column.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("at", pa.int32()), ("feature", pa.string()), ("n", pa.int32())])))

    counts = texts.select(F.explode(named("content")).alias("t")).groupBy("t.at", "t.feature").agg(F.sum("t.n").alias("n"))
    return counts.groupBy("at").agg(F.min_by("feature", F.struct(-F.col("n"), F.col("feature"))).alias("feature"))


def top_features(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """label, sign, place, feature, coefficient: the terms that speak most for and against each label; a bucket has the name of its most frequent term."""
    train, _ = _split(spark, sf_dir)
    rows = _features(train, text_vectors.weights(train, MIN_DF[0]))
    with settings(spark, WIDE):
        coefficients = fit(rows, C[0]).coefficientMatrix.toArray()  # a row a label
    out = []
    for label, own in enumerate(coefficients):
        order = np.argsort(own, kind="stable")
        for sign, best in (("positive", order[::-1][:n]), ("negative", order[:n])):
            out += [(label, sign, place, int(i), float(own[i])) for place, i in enumerate(best, 1)]
    best = spark.createDataFrame(out, "label int, sign string, place int, at int, coefficient double")
    names = bucket_names(view(spark, sf_dir, "texts"), [i for *_, i, _ in out])
    return best.join(names, "at").select("label", "sign", "place", "feature", "coefficient")


def tune_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1 on held-out rows for each grid point, and the best; of equal ones the first stays best. All points are fitted in the same passes."""
    train, held_out = _split(spark, sf_dir)
    points = [(min_df, c) for min_df in MIN_DF for c in C]
    rows = [(float(min_df), c, f1_of(cells)) for (min_df, c), cells in zip(points, softmax.fit_grid(train, held_out, points), strict=True)]
    best = 0
    for i, (_, _, f1) in enumerate(rows):
        best = i if f1 > rows[best][2] + 1e-9 else best
    return spark.createDataFrame([(*row, i == best) for i, row in enumerate(rows)], "min_df double, c double, macro_f1 double, best boolean")


def _vectors(spark, sf_dir):
    return view(spark, sf_dir, "vectors").select("review_id", "topic", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))


def reduce_pca(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    data = _vectors(spark, sf_dir)
    return PCA(k=k, inputCol="v", outputCol="r").fit(data).transform(data).select("review_id", vector_to_array("r").alias("reduced"))


def cluster(data: DataFrame, k: int, cut: float, least: int) -> DataFrame:
    """review_id, cluster: the farthest rows (beyond quantile `cut` of distances, from a sketch) and clusters of fewer than `least` rows are outliers, -1."""
    model = KMeans(k=k, seed=1, featuresCol="v", predictionCol="cluster").fit(data)
    centres = data.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, c array<double>")  # k rows
    far = F.aggregate(F.zip_with(vector_to_array("v"), F.col("c"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    placed = materialize(model.transform(data).join(F.broadcast(centres), "cluster").select("review_id", "cluster", far.alias("far")), "clusters")
    limit = placed.agg(F.percentile_approx("far", F.lit(cut), F.lit(10_000)).alias("edge")).first().edge
    near = placed.select("review_id", F.when(F.col("far") > F.lit(limit), -1).otherwise(F.col("cluster")).alias("cluster"))
    small = near.where("cluster <> -1").groupBy("cluster").count().where(F.col("count") < least).select(F.col("cluster").alias("small"))  # at most k rows
    return near.join(F.broadcast(small), F.col("cluster") == F.col("small"), "left").select("review_id", F.when(F.col("small").isNotNull(), -1).otherwise(F.col("cluster")).alias("cluster"))


LEAST_SIZE, CANDIDATES, TARGET = 5, (4, 6, 8, 10, 12, 16), 9


def cluster_fit(spark: SparkSession, sf_dir: str, k: int = 10, cut: float = 0.9) -> DataFrame:
    """Cluster of each vector; about the farthest tenth of all are outliers, -1."""
    return cluster(_vectors(spark, sf_dir), k, cut, LEAST_SIZE)


def cluster_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's number of clusters, outlier share, largest share and smallest size; chosen is the one nearest to the target, of equal ones the coarsest."""
    data = materialize(_vectors(spark, sf_dir), "vectors")
    n, rows = data.count(), []
    for k in CANDIDATES:
        sizes = {r.cluster: r["count"] for r in cluster(data, k, 0.9, LEAST_SIZE).groupBy("cluster").count().collect()}  # a row a cluster
        named = [size for c, size in sizes.items() if c != -1]
        rows.append((k, len(named), sizes.get(-1, 0) / n if n else None, max(named, default=0) / n if n else None, min(named, default=0)))
    best = min(range(len(rows)), key=lambda i: (abs(rows[i][1] - TARGET), rows[i][0]))
    return spark.createDataFrame([(*row, i == best) for i, row in enumerate(rows)], "k int, n_topics int, outlier_share double, largest_share double, smallest int, chosen boolean")


def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted reduction, saved and loaded, gives what it gave."""
    data = _vectors(spark, sf_dir)
    path = new_path(spark, "model")
    PCA(k=5, inputCol="v", outputCol="r").fit(data).write().overwrite().save(path)
    return PCAModel.load(path).transform(data).select("review_id", vector_to_array("r").alias("reduced"))


QUERIES = {f.__name__: f for f in (logreg_pred, top_features, tune_grid, reduce_pca, cluster_fit, cluster_grid, model_roundtrip)}
