"""Queries over text functions, vectors and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.stats import rate, wilson, wilson_sql
from tidemark.plans.catalog import SHOWN
from tidemark.plans.storage import materialize
from tidemark.plans.views import duck, view

QUERIES, ORACLES = {}, {}
RULES = [("sh?pay", "app"), ("the|that", "it")]
MARKERS = {"german": ["und", "der", "die", "das", "nicht"], "romance": ["le", "la", "que", "de", "et"]}
#: Emoji that queries add to texts, which have none: (character, its Unicode name).
GRIN, STAR, WATCH = ("\U0001f621", "pouting face"), (chr(0x2B50), "white medium star"), (chr(0x231A), "watch")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


_LO, _HI = wilson_sql("CAST(k AS DOUBLE)", "CAST(n AS DOUBLE)")


@query(f"SELECT app, week, partial, n, k, CAST(k AS DOUBLE) / CAST(n AS DOUBLE) AS share, round({_LO}, 9) AS lo, round({_HI}, 9) AS hi FROM (SELECT app, CAST(week AS STRING) AS week, max(is_partial_week) AS partial, count(*) AS n, count_if(is_complaint) AS k FROM {{reviews}} WHERE NOT is_partial_week OR week = {SHOWN} GROUP BY app, week) AS t")
def weekly_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete weeks and the partial week that reports show."""
    shown = view(spark, sf_dir, "reviews").where(~F.col("is_partial_week") | (F.col("week") == F.expr(SHOWN)))
    counted = shown.groupBy("app", F.col("week").cast("string").alias("week")).agg(F.bool_or("is_partial_week").alias("partial"), F.count("*").alias("n"), F.count_if("is_complaint").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return counted.select("app", "week", "partial", "n", "k", rate(F.col("k"), F.col("n")).alias("share"), F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


def _texts(spark, sf_dir) -> DataFrame:
    """Texts; a table of fewer splits than there are cores is dealt out, a larger one is read as it lies."""
    texts, cores = view(spark, sf_dir, "texts").select("review_id", "app", "content"), spark.sparkContext.defaultParallelism
    return texts if texts.rdd.getNumPartitions() >= cores else texts.repartition(cores, "review_id")


def _docs(spark, sf_dir, *cols):
    return _texts(spark, sf_dir).select("review_id", *cols)


def _with_emoji(text):
    """Up to four grins, then up to three stars, behind a text."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.repeat(F.lit(GRIN[0]), (F.col("review_id") % 5).cast("int")), F.repeat(F.lit(STAR[0]), (F.col("review_id") % 4).cast("int")))


@query(r"SELECT review_id, regexp_replace(content, '(?i)https?://\S+|www\.\S+', ' ', 'g') AS stripped FROM {texts}")
def strip_urls(spark, sf_dir):
    return _docs(spark, sf_dir, T.strip_urls(F.col("content")).alias("stripped"))


@query(r"SELECT review_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS collapsed FROM {texts}")
def collapse_ws(spark, sf_dir):
    return _docs(spark, sf_dir, T.collapse_blanks(F.col("content")).alias("collapsed"))


@query(r"SELECT review_id, CAST(len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) AS INT) AS n_words, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) < 3 AS is_short FROM {texts}")
def word_count(spark, sf_dir):
    counted = _docs(spark, sf_dir, T.word_count(F.col("content")).alias("n_words"))
    return counted.select("review_id", "n_words", T.is_short(F.col("n_words")).alias("is_short"))


@query(r"SELECT review_id, NULLIF(regexp_extract(version, '^(\d+\.\d+)', 1), '') AS mm FROM {reviews}")
def version_mm(spark, sf_dir):
    return view(spark, sf_dir, "reviews").select("review_id", T.version_major_minor(F.col("version")).alias("mm"))


def _any_char(ranges) -> str:
    """Whether a text has a character of some code point ranges, character by character."""
    return "len(list_filter(string_split(content, ''), lambda c: " + " OR ".join(f"unicode(c) BETWEEN {a} AND {b}" for a, b in ranges) + ")) > 0"


@query(f"SELECT review_id, {_any_char([*T.PICTOGRAPHS, (0xFE0F, 0xFE0F), (0x200D, 0x200D)])} AS found FROM (SELECT review_id, content || CASE review_id % 3 WHEN 0 THEN '{STAR[0]}' WHEN 1 THEN '{WATCH[0]}' ELSE '' END AS content FROM {{texts}}) AS t")
def has_emoji(spark, sf_dir):
    """Texts, two of three with an emoji of a block that is easily missed."""
    added = F.when(F.col("review_id") % 3 == 0, STAR[0]).when(F.col("review_id") % 3 == 1, WATCH[0]).otherwise("")
    return _docs(spark, sf_dir, T.has_emoji(F.concat("content", added)).alias("found"))


@query(f"SELECT review_id, {_any_char([(0x400, 0x4FF), (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)])} AS found FROM {{texts}}")
def non_latin(spark, sf_dir):
    return _docs(spark, sf_dir, T.non_latin(F.col("content")).alias("found"))


@query(f"SELECT review_id, {_any_char([(0x1D400, 0x1D7FF), (0xFF01, 0xFF5E)])} AS found FROM {{texts}}")
def stylized(spark, sf_dir):
    return _docs(spark, sf_dir, T.stylized(F.col("content")).alias("found"))


@query(
    "WITH w AS (SELECT review_id, content, list_distinct(regexp_extract_all(lower(content), '[a-z]+')) AS words, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS n FROM {texts}) SELECT review_id, CASE WHEN "
    + _any_char(T.OTHER_SCRIPTS)
    + " THEN 'non_latin' WHEN n < 3 THEN 'too_short' "
    + " ".join(f"WHEN len(list_intersect(words, {own})) >= 2 THEN '{region}?'" for region, own in MARKERS.items())
    + " ELSE 'open' END AS rule FROM w"
)
def lang_rules(spark, sf_dir):
    return _docs(spark, sf_dir, T.language_rule(F.col("content"), MARKERS).alias("rule"))


def _neutral_sql() -> str:
    """Each rule after the other; the clitic is taken with the word and put back."""
    steps, text = [], "content"
    for i, (pattern, neutral) in enumerate(RULES):
        p = rf"(?i)\b(?:{pattern})((?:nya|ku|mu|lah)?\b)"
        steps.append(f"len(regexp_extract_all({text}, '{p}')) AS n{i}")
        text = rf"regexp_replace({text}, '{p}', '{neutral}\1', 'g')"
    return f"SELECT review_id, sha256({text}) AS h, {', '.join(f'CAST({s.split(" AS ")[0]} AS INT) AS n{i}' for i, s in enumerate(steps))} FROM {{texts}}"


@query(_neutral_sql())
def neutralize(spark, sf_dir):
    apply, counts = T.neutralizer(RULES)
    return _docs(spark, sf_dir, F.sha2(apply(F.col("content")), 256).alias("h"), *[c.alias(f"n{i}") for i, c in enumerate(counts(F.col("content")))])


@query("SELECT review_id, content AS normal FROM {texts}")  # none of these texts is changed by NFKC
def nfkc(spark, sf_dir):
    return _docs(spark, sf_dir, T.nfkc()("content").alias("normal"))


#: Runs of one character in either case, found by position; a run of three or more non-digits becomes its first, twice.
_CAPPED = r"""chars AS (SELECT review_id, unnest(string_split(content, '')) AS c, generate_subscripts(string_split(content, ''), 1) AS i FROM {texts} WHERE content <> ''),
marked AS (SELECT *, CASE WHEN lower(c) = lag(lower(c)) OVER (PARTITION BY review_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM chars),
runs AS (SELECT *, sum(new) OVER (PARTITION BY review_id ORDER BY i) AS run FROM marked),
joined AS (SELECT review_id, run, CASE WHEN count(*) > 2 AND NOT regexp_matches(any_value(c), '\p{Nd}') THEN repeat(arg_min(c, i), 2) ELSE string_agg(c, '' ORDER BY i) END AS piece FROM runs GROUP BY review_id, run),
capped AS (SELECT review_id, string_agg(piece, '' ORDER BY run) AS capped FROM joined GROUP BY review_id UNION ALL SELECT review_id, content FROM {texts} WHERE content = '' OR content IS NULL)"""


@query(f"WITH {_CAPPED} SELECT review_id, capped FROM capped")
def cap_repeats(spark, sf_dir):
    return _docs(spark, sf_dir, T.repeat_capper()("content").alias("capped"))


@query(f"SELECT review_id, content || ' ' || repeat('{GRIN[0]}', CAST(least(2, review_id % 5) AS INT)) || repeat('{STAR[0]}', CAST(least(2, review_id % 4) AS INT)) AS capped FROM {{texts}}")
def cap_emoji(spark, sf_dir):
    return _docs(spark, sf_dir, T.emoji_capper()(_with_emoji(F.col("content"))).alias("capped"))


@query(rf"SELECT review_id, trim(regexp_replace(content || ' ' || repeat('{GRIN[1]} ', CAST(review_id % 5 AS INT)) || repeat('star ', CAST(review_id % 4 AS INT)), '\s+', ' ', 'g')) AS words, CAST(review_id % 5 + review_id % 4 AS INT) AS n_emoji, CAST(review_id % 5 AS INT) AS n_lacking FROM {{texts}}")
def demojize(spark, sf_dir):
    """The star is in the table, the grin is named by Unicode."""
    return _docs(spark, sf_dir, T.demojizer({STAR[0]: "star"})(_with_emoji(F.col("content"))).alias("d")).select("review_id", "d.*")


@query(rf"WITH {_CAPPED} SELECT review_id, trim(regexp_replace(capped || ' ' || repeat('{GRIN[0]}', CAST(least(2, review_id % 5) AS INT)) || repeat('{STAR[0]}', CAST(least(2, review_id % 4) AS INT)), '\s+', ' ', 'g')) AS cleaned FROM capped")
def text_clean(spark, sf_dir):
    """Texts with emoji and an address behind them."""
    added = F.concat(_with_emoji(F.col("content")), F.lit(" https://Example.org/a?b=c"))
    return _docs(spark, sf_dir, T.cleaner()(added).alias("cleaned"))


# ---- vectors: 64 floats each, summed in element order on both sides, rounded


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _centroids(vectors: DataFrame) -> DataFrame:
    """topic, mean: one row a topic; partial sums are made on the map side."""
    parts = vectors.where("topic <> -1").select("topic", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("topic", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


_MEANS = "c AS (SELECT topic, i, avg(x) AS m FROM (SELECT topic, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM {vectors} WHERE topic <> -1) AS u GROUP BY topic, i)"
_SIMS = "e AS (SELECT review_id, topic AS own, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM {vectors}), s AS (SELECT e.review_id, any_value(own) AS own, c.topic, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS sim FROM e JOIN c ON e.i = c.i GROUP BY e.review_id, c.topic), b AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY round(sim, 6) DESC, topic) AS rn FROM s)"


@query(f"WITH {_MEANS} SELECT topic, i - 1 AS i, round(m, 6) AS m FROM c")
def centroids(spark, sf_dir):
    return _centroids(view(spark, sf_dir, "vectors")).select("topic", F.posexplode("mean").alias("i", "m")).select("topic", F.col("i").cast("long").alias("i"), F.round("m", 6).alias("m"))


def _assigned(spark, sf_dir):
    """review_id, own, topic, sim: the nearest topic of each vector. Topics are folded into one row, which each vector meets where it lies."""
    v = view(spark, sf_dir, "vectors")
    length = lambda x: F.sqrt(_dot(x, x))
    table = _centroids(v).agg(F.sort_array(F.collect_list(F.struct("topic", "mean", length(F.col("mean")).alias("length")))).alias("topics"))
    own = v.crossJoin(table).withColumn("length", length(F.col("embedding")))
    sims = F.transform("topics", lambda t: F.struct((_dot(F.col("embedding"), t["mean"]) / (F.col("length") * t["length"])).alias("sim"), t["topic"].alias("topic")))
    best = own.withColumn("sims", sims).withColumn("best", F.array_max(F.transform("sims", lambda s: F.struct(F.round(s["sim"], 6).alias("near"), (-s["topic"]).alias("minus"), s["sim"].alias("sim")))))
    return best.select("review_id", F.col("topic").alias("own"), (-F.col("best.minus")).alias("topic"), F.col("best.sim").alias("sim"))


@query(f"WITH {_MEANS}, {_SIMS} SELECT review_id, topic, round(sim, 5) AS sim FROM b WHERE rn = 1")
def centroid_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("review_id", "topic", F.round("sim", 5).alias("sim"))


@query(f"WITH {_MEANS}, {_SIMS} SELECT review_id, CASE WHEN own <> -1 THEN own WHEN sim >= 0.15e0 THEN topic ELSE -1 END AS topic FROM b WHERE rn = 1")
def centroid_reduce(spark, sf_dir):
    return _assigned(spark, sf_dir).select("review_id", F.when(F.col("own") != -1, F.col("own")).when(F.col("sim") >= 0.15, F.col("topic")).otherwise(-1).alias("topic"))


@query(f"WITH {_MEANS}, {_SIMS} SELECT CAST(count_if(own = topic) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS agreement FROM b WHERE rn = 1 AND own <> -1")
def transform_agree(spark, sf_dir):
    return _assigned(spark, sf_dir).where("own <> -1").agg((F.count_if(F.col("own") == F.col("topic")).cast("double") / F.count("*").cast("double")).alias("agreement"))


@query(f"WITH {_MEANS}, {_SIMS} SELECT t AS threshold, count_if(sim < t) AS outliers FROM b CROSS JOIN (VALUES (0.1e0), (0.2e0), (0.3e0)) AS x(t) WHERE rn = 1 GROUP BY t")
def outlier_curve(spark, sf_dir):
    return _assigned(spark, sf_dir).select(F.explode(F.array(*[F.lit(t) for t in (0.1, 0.2, 0.3)])).alias("threshold"), "sim").groupBy("threshold").agg(F.count_if(F.col("sim") < F.col("threshold")).alias("outliers"))


# ---- keywords, in long form


_TERMS = r"t AS (SELECT review_id, app, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z]+'), lambda w: length(w) > 3)) AS term FROM {texts})"


def _terms(spark, sf_dir):
    words = F.filter(F.split(F.lower("content"), "[^a-z]+"), lambda w: F.length(w) > 3)
    return _texts(spark, sf_dir).select("review_id", "app", F.explode(words).alias("term"))


@query(f"WITH {_TERMS}, n AS (SELECT count(DISTINCT review_id) AS n FROM {{texts}}) SELECT term, df, round(ln((1e0 + n) / (1e0 + df)) + 1e0, 9) AS idf FROM (SELECT term, count(DISTINCT review_id) AS df FROM t GROUP BY term) AS d, n WHERE df >= 2")
def tfidf_terms(spark, sf_dir):
    n = view(spark, sf_dir, "texts").agg(F.count_distinct("review_id").alias("n"))
    df = _terms(spark, sf_dir).groupBy("term").agg(F.count_distinct("review_id").alias("df")).where("df >= 2")
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0, 9).alias("idf"))  # n is one row


@query(f"WITH {_TERMS}, c AS (SELECT app, term, count(*) AS n FROM t GROUP BY app, term), a AS (SELECT CAST(sum(n) AS DOUBLE) / count(DISTINCT app) AS avg_n FROM c), f AS (SELECT term, CAST(sum(n) AS DOUBLE) AS all_n FROM c GROUP BY term), g AS (SELECT app, CAST(sum(n) AS DOUBLE) AS app_n FROM c GROUP BY app) SELECT app, term, score FROM (SELECT c.app, c.term, round(n / app_n * ln(1e0 + avg_n / all_n), 9) AS score, row_number() OVER (PARTITION BY c.app ORDER BY round(n / app_n * ln(1e0 + avg_n / all_n), 9) DESC, c.term) AS rn FROM c JOIN f USING (term) JOIN g USING (app), a) AS s WHERE rn <= 10")
def ctfidf(spark, sf_dir):
    from pyspark.sql import Window

    # Counted once: what follows reads counts of terms, not texts.
    c = materialize(_terms(spark, sf_dir).groupBy("app", "term").agg(F.count("*").alias("n")), "terms")
    a = c.agg((F.sum("n").cast("double") / F.count_distinct("app")).alias("avg_n"))
    f = c.groupBy("term").agg(F.sum("n").cast("double").alias("all_n"))
    g = c.groupBy("app").agg(F.sum("n").cast("double").alias("app_n"))
    s = c.join(f, "term").join(g, "app").crossJoin(F.broadcast(a)).select("app", "term", F.round(F.col("n") / F.col("app_n") * F.log(1.0 + F.col("avg_n") / F.col("all_n")), 9).alias("score"))
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("app").orderBy(F.desc("score"), "term"))).where("rn <= 10").drop("rn")
