"""Topics: representatives, keyword coherence, style words, assignment rules, and the choice among candidate clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.text_queries import _dot, ctfidf
from tidemark.plans.storage import materialize
from tidemark.plans.views import duck, view

QUERIES, ORACLES = {}, {}
REPRESENTATIVES, KEYWORDS, STYLE_HITS = 3, 10, 2
#: Words that tell how something is said, not what about.
STYLE = ["which", "their", "with", "dans", "pour", "sich", "eine", "para", "como", "that", "this", "from"]
#: The least similarity at which the threshold rule gives a topic.
SIMILAR = 0.15


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


# ---- vectors


def _unit(v):
    norm = F.sqrt(_dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def centroids(vectors: DataFrame) -> DataFrame:
    """topic, centre (mean of unit vectors), n: a row a topic, outliers too; sums are made on the map side."""
    parts = vectors.select("topic", F.posexplode("unit").alias("i", "x")).groupBy("topic", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return parts.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"), F.max("n").alias("n"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "vectors").select("review_id", "topic", _unit(F.col("embedding")).alias("unit"))


#: Vectors, centres and similarities in long form, summed by the other engine.
_LONG = """x AS (SELECT review_id, topic, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM {vectors}),
u AS (SELECT review_id, topic, i, x / sqrt(sum(x * x) OVER (PARTITION BY review_id)) AS x FROM x),
c AS (SELECT topic, i, avg(x) AS m FROM u GROUP BY topic, i),
s AS (SELECT u.review_id, u.topic AS own, c.topic, sum(x * m) AS dot, sqrt(sum(m * m)) AS norm FROM u JOIN c USING (i) GROUP BY u.review_id, u.topic, c.topic)"""


@query(f"WITH {_LONG}, n AS (SELECT topic, count(*) AS size FROM {{vectors}} GROUP BY topic), r AS (SELECT topic, review_id, norm, row_number() OVER (PARTITION BY topic ORDER BY round(dot, 9) DESC, review_id) AS place FROM s WHERE own = topic) SELECT r.topic, size, round(norm, 6) AS norm, place, review_id FROM r JOIN n ON r.topic = n.topic WHERE place <= {REPRESENTATIVES}")
def topic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, length of the centre and nearest documents of each topic.

    Only the nearest few of each part go on to a topic's window, so a topic with most rows isn't sorted in one task.
    """
    units = _units(spark, sf_dir)
    near = units.join(centroids(units).withColumnRenamed("topic", "t"), F.col("topic") == F.col("t"))
    near = near.select("topic", "review_id", "n", F.sqrt(_dot(F.col("centre"), F.col("centre"))).alias("norm"), F.round(_dot(F.col("unit"), F.col("centre")), 9).alias("dot"))
    part = Window.partitionBy("topic", F.pmod(F.xxhash64("review_id"), F.lit(64))).orderBy(F.desc("dot"), "review_id")
    whole = Window.partitionBy("topic").orderBy(F.desc("dot"), "review_id")
    few = near.withColumn("p", F.row_number().over(part)).where(F.col("p") <= REPRESENTATIVES)
    return few.withColumn("place", F.row_number().over(whole).cast("long")).where(F.col("place") <= REPRESENTATIVES).select("topic", F.col("n").alias("size"), F.round("norm", 6).alias("norm"), "place", "review_id")


def cosine_of(a, b):
    """Cosine of two arrays; null where one has length 0."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


@query(f"WITH {_LONG} SELECT a.topic AS a, b.topic AS b, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) AS cosine FROM c a JOIN c b ON a.i = b.i AND a.topic < b.topic GROUP BY a.topic, b.topic")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each two topics' centres."""
    c = materialize(centroids(_units(spark, sf_dir)), "centres")
    other = c.select(F.col("topic").alias("b"), F.col("centre").alias("other"))
    return c.join(other, F.col("topic") < F.col("b")).select(F.col("topic").alias("a"), "b", F.round(cosine_of(F.col("centre"), F.col("other")), 6).alias("cosine"))


def assign(vectors: DataFrame, centres: DataFrame, rule: str, similar: float = SIMILAR) -> DataFrame:
    """review_id, topic, sim. `argmax_all`: the nearest centre, the outliers' too; `threshold`: the nearest topic if it is similar enough, else -1.

    Centres are a row a topic. They are folded into one row of arrays, so each vector meets them without a shuffle of vectors.
    """
    if rule not in ("argmax_all", "threshold"):
        raise ValueError(f"unknown rule {rule}")
    named = centres if rule == "argmax_all" else centres.where("topic <> -1")
    table = named.agg(F.sort_array(F.collect_list(F.struct("topic", F.col("centre").alias("c")))).alias("centres"))
    norms = table.select(F.transform("centres", lambda s: F.struct(s["topic"].alias("topic"), _unit(s["c"]).alias("c"))).alias("centres"))
    score = F.transform("centres", lambda s: F.struct(F.round(_dot(F.col("unit"), s["c"]), 9).alias("sim"), (-s["topic"]).alias("minus")))
    best = vectors.crossJoin(F.broadcast(norms)).select("review_id", F.array_max(score).alias("b"))  # one row
    topic = -F.col("b.minus")
    return best.select("review_id", topic.alias("topic") if rule == "argmax_all" else F.when(F.col("b.sim") >= similar, topic).otherwise(-1).alias("topic"), F.col("b.sim").alias("sim"))


_RULES = f"{_LONG}, k AS (SELECT review_id, topic, round(dot / norm, 9) AS sim FROM s), a AS (SELECT review_id, topic FROM k QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY sim DESC, topic) = 1), t AS (SELECT review_id, CASE WHEN sim >= {SIMILAR} THEN topic ELSE -1 END AS topic FROM k WHERE topic <> -1 QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY sim DESC, topic) = 1)"


@query(
    f"WITH {_RULES}, r AS (SELECT a.topic = v.topic AS hit_a, t.topic = v.topic AS hit_t, a.topic = t.topic AS same FROM a JOIN t USING (review_id) JOIN {{vectors}} v USING (review_id)), f AS (SELECT avg(hit_a::INT) AS argmax_all, avg(hit_t::INT) AS threshold, avg(same::INT) AS same FROM r) SELECT round(argmax_all, 9) AS argmax_all, round(threshold, 9) AS threshold, round(same, 9) AS same, CASE WHEN threshold > argmax_all THEN 'threshold' ELSE 'argmax_all' END AS better FROM f"
)
def assign_rule_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule gives the fitted topic, how often both agree, and which is better."""
    units = _units(spark, sf_dir)
    centres = materialize(centroids(units), "centres")
    a, t = (assign(units, centres, rule).select(F.col("review_id").alias(f"{rule[0]}_id"), F.col("topic").alias(rule)) for rule in ("argmax_all", "threshold"))
    rows = units.select("review_id", "topic").join(a, F.col("review_id") == F.col("a_id")).join(t, F.col("review_id") == F.col("t_id"))
    share = lambda c: F.round(F.avg(c.cast("double")), 9)
    out = rows.agg(share(F.col("argmax_all") == F.col("topic")).alias("argmax_all"), share(F.col("threshold") == F.col("topic")).alias("threshold"), share(F.col("argmax_all") == F.col("threshold")).alias("same"))
    return out.withColumn("better", F.when(F.col("threshold") > F.col("argmax_all"), "threshold").otherwise("argmax_all"))


# ---- keywords


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """app, term: the KEYWORDS terms with the largest class-based tf-idf of each app (apps stand for topics)."""
    return ctfidf(spark, sf_dir).select("app", "term")


_KEYS = r"""t AS (SELECT review_id, app, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z]+'), lambda w: length(w) > 3)) AS term FROM {texts}),
n AS (SELECT app, term, count(*) AS n FROM t GROUP BY app, term), a AS (SELECT sum(n)::DOUBLE / count(DISTINCT app) AS avg_n FROM n),
r AS (SELECT n.app, n.term, round(n / sum(n) OVER (PARTITION BY app) * ln(1e0 + avg_n / sum(n) OVER (PARTITION BY term)), 9) AS score FROM n, a),
k AS (SELECT app, term FROM r QUALIFY row_number() OVER (PARTITION BY app ORDER BY score DESC, term) <= 10)"""


@query(
    rf"WITH {_KEYS}, h AS (SELECT DISTINCT review_id, term FROM t WHERE term IN (SELECT term FROM k)), d AS (SELECT count(*)::DOUBLE AS n FROM {{texts}}), df AS (SELECT term, count(*) / n AS p FROM h, d GROUP BY term, n), pairs AS (SELECT x.app, x.term AS a, y.term AS b, (SELECT count(*) FROM h i JOIN h j ON i.review_id = j.review_id WHERE i.term = x.term AND j.term = y.term) / n AS pab FROM k x JOIN k y ON x.app = y.app AND x.term < y.term, d) SELECT app, count(*) AS pairs, round(avg(CASE WHEN pab = 0 THEN -1 ELSE ln(pab / (p.p * q.p)) / nullif(-ln(pab), 0) END), 9) AS npmi FROM pairs JOIN df p ON p.term = a JOIN df q ON q.term = b GROUP BY app"
)
def npmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean normalised pointwise mutual information of each two keywords, documents as windows; a pair that never meets counts -1.

    Only keywords are looked for in documents, at most KEYWORDS an app, and a document's are one array: pairs are made inside it.
    """
    keys = materialize(keywords(spark, sf_dir), "keywords")
    vocabulary = keys.agg(F.array_sort(F.collect_set("term")).alias("vocabulary"))  # bounded by apps x KEYWORDS
    words = F.split(F.lower("content"), "[^a-z]+")
    texts = view(spark, sf_dir, "texts").crossJoin(F.broadcast(vocabulary)).select(F.array_sort(F.array_intersect(F.col("vocabulary"), words)).alias("own"))
    pair = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: y >= x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    met = materialize(texts.select(F.explode(pair).alias("p")).groupBy("p").count().select("p.*", "count"), "pairs")
    n = view(spark, sf_dir, "texts").count()
    alone = met.where("a = b").select(F.col("a").alias("term"), (F.col("count") / F.lit(float(n))).alias("p"))
    wanted = keys.join(keys.select(F.col("app").alias("app2"), F.col("term").alias("term2")), (F.col("app") == F.col("app2")) & (F.col("term") < F.col("term2")))
    found = wanted.join(met, (F.col("term") == F.col("a")) & (F.col("term2") == F.col("b")), "left").select("app", F.col("term").alias("x"), F.col("term2").alias("y"), (F.coalesce("count", F.lit(0)) / F.lit(float(n))).alias("pab"))
    found = found.join(alone.select(F.col("term").alias("x"), F.col("p").alias("px")), "x").join(alone.select(F.col("term").alias("y"), F.col("p").alias("py")), "y")
    value = F.when(F.col("pab") == 0, -1.0).otherwise(F.try_divide(F.log(F.col("pab") / (F.col("px") * F.col("py"))), -F.log("pab")))
    return found.groupBy("app").agg(F.count("*").alias("pairs"), F.round(F.avg(value), 9).alias("npmi"))


@query(rf"WITH {_KEYS} SELECT app, count(*) FILTER (term IN {tuple(STYLE)}) AS hits, count(*) FILTER (term IN {tuple(STYLE)}) >= {STYLE_HITS} AS flagged FROM k GROUP BY app")
def style_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apps whose keywords, or parts of them, are style words."""
    lexicon = F.array(*[F.lit(w) for w in STYLE])
    styled = F.exists(F.split("term", " "), lambda part: F.array_contains(lexicon, part))
    hits = F.count_if(styled)
    return keywords(spark, sf_dir).groupBy("app").agg(hits.alias("hits"), (hits >= STYLE_HITS).alias("flagged"))
