"""Contracts of label work: sheets against their key, names and merges of topics, and the choice among model options.

Problems are rows, so that all of them are seen at once; nothing stops at the first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import text_vectors
from tidemark.plans.storage import new_path
from tidemark.plans.views import duck, view
from tidemark.sources.files import read_sheet, write_sheet

QUERIES, ORACLES = {}, {}
LABELS, TAGS = ("negative", "neutral", "positive", "invalid"), ("sarcasm", "toxic", "mixed")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, duck(sql)
        return f

    return add


def _problems(kinds: dict[str, DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("problem"), F.col(key).cast("string").alias(key)) for kind, df in kinds.items()])


def parse_tags(notes):
    """Comma-separated tags, trimmed, lower-cased, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(notes, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")


def sheet_problems(sheet: DataFrame, key: DataFrame, labels=LABELS, tags=TAGS) -> DataFrame:
    """(problem, gold_id): ids missing, unknown or twice, another order, changed texts, unknown labels and tags, blank labels.

    The sheet has place, gold_id, text, label and notes; the key place, gold_id and text.
    """
    k = key.select(F.col("gold_id").alias("k_id"), F.col("place").cast("string").alias("k_place"), F.col("text").alias("k_text"))
    both = sheet.join(k, F.col("gold_id") == F.col("k_id"))
    return _problems(
        {
            "missing": key.join(sheet.select(F.col("gold_id").alias("s_id")), F.col("gold_id") == F.col("s_id"), "left_anti"),
            "extra": sheet.join(k, F.col("gold_id") == F.col("k_id"), "left_anti"),
            "twice": sheet.groupBy("gold_id").count().where("count > 1"),
            "order": both.where(~F.col("place").eqNullSafe(F.col("k_place"))),
            "text": both.where(~F.col("text").eqNullSafe(F.col("k_text"))),
            "label": sheet.where(~F.col("label").isin(*labels)),
            "tag": sheet.where(F.size(F.array_except(parse_tags(F.col("notes")), F.array(*[F.lit(t) for t in tags]))) > 0),
            "blank": sheet.where("label is null"),
        },
        "gold_id",
    )


_KEY = "SELECT 'G' || lpad(CAST(doc_id AS STRING), 6, '0') AS gold_id, doc_id, doc_id AS place, trim(text) AS text, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS label FROM {documents} JOIN {labels} USING (doc_id)"


@query(
    f"WITH k AS ({_KEY}), p AS (SELECT gold_id, doc_id, unnest([CASE WHEN doc_id % 50 = 7 THEN 'missing' END, CASE WHEN doc_id % 50 <> 7 AND doc_id % 60 = 11 THEN 'text' END, CASE WHEN doc_id % 50 <> 7 AND doc_id % 70 = 13 THEN 'label' END, CASE WHEN doc_id % 50 <> 7 AND doc_id % 80 = 17 AND doc_id % 70 <> 13 THEN 'blank' END, CASE WHEN doc_id % 50 <> 7 AND doc_id % 90 = 19 THEN 'tag' END, CASE WHEN doc_id % 50 <> 7 AND doc_id % 95 = 21 THEN 'order' END, CASE WHEN doc_id % 50 <> 7 AND doc_id % 99 = 23 THEN 'twice' END]) AS problem FROM k) SELECT problem, gold_id FROM p WHERE problem IS NOT NULL UNION ALL SELECT problem, gold_id FROM p WHERE problem IN ('text', 'label', 'blank', 'tag', 'order') AND doc_id % 99 = 23 UNION ALL SELECT 'extra', 'G-1'"
)
def validate_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of all labelled documents, exported, filled in with errors of each kind, and read back."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    i = F.col("doc_id")
    key = docs.join(labels, "doc_id").select(F.concat(F.lit("G"), F.lpad(i.cast("string"), 6, "0")).alias("gold_id"), i, i.alias("place"), F.trim("text").alias("text"), F.when(F.col("quality") == 1, " Positive").otherwise("negative").alias("label"))
    filled = key.where(i % 50 != 7).select(
        F.when(i % 95 == 21, i + 1).otherwise(i).alias("place"), "gold_id", F.when(i % 60 == 11, F.concat(F.lit("x "), F.col("text"))).otherwise(F.col("text")).alias("text"),
        F.when(i % 70 == 13, "bad").when(i % 80 == 17, " ").otherwise(F.col("label")).alias("label"), F.when(i % 90 == 19, "Toxic, unheard of").otherwise(" Sarcasm,,toxic ").alias("notes"), "doc_id",
    )
    more = spark.createDataFrame([(0, "G-1", "unknown", "neutral", None)], "place long, gold_id string, text string, label string, notes string")
    sheet = filled.unionByName(filled.where(i % 99 == 23)).drop("doc_id").unionByName(more)
    path = new_path(spark, "sheet")
    write_sheet(sheet, path)
    return sheet_problems(read_sheet(spark, path, ["place", "gold_id", "text", "label", "notes"]), key)


def merge_problems(names: DataFrame, topics: DataFrame) -> DataFrame:
    """(problem, topic) of a sheet topic_id, topic_name, merge_into (texts) against the model's topics (topic)."""
    # What isn't a number is a problem of its own and no merge.
    n = names.select(F.col("topic_id").try_cast("int").alias("topic"), F.nullif(F.trim("topic_name"), F.lit("")).alias("name"), F.nullif(F.trim("merge_into"), F.lit("")).alias("raw"))
    n = n.withColumn("number", F.col("raw").try_cast("double"))
    n = n.withColumn("target", F.when(F.col("number") == F.floor("number"), F.col("number").cast("int")))
    inner = n.where("topic <> -1")
    merges = inner.where("target is not null")
    known = topics.select(F.col("topic").alias("known"))
    sources, named = merges.select(F.col("topic").alias("source")), inner.where("name is not null")
    proper = merges.where("target <> topic and target <> -1").join(known, F.col("target") == F.col("known"), "left_semi")
    chained = proper.join(sources, F.col("target") == F.col("source"), "left_semi")
    ended = proper.join(sources, F.col("target") == F.col("source"), "left_anti")
    same = named.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("name").alias("same"))
    ids = n.groupBy("topic").count()
    return _problems(
        {
            "unknown": ids.join(known, F.col("topic") == F.col("known"), "left_anti"),
            "absent": topics.join(ids.select(F.col("topic").alias("t")), F.col("topic") == F.col("t"), "left_anti"),
            "repeated": ids.where("count > 1"),
            "outliers": n.where("topic = -1 and raw is not null"),
            "no id": inner.where("raw is not null and number is null"),
            "no integer": inner.where("number is not null and target is null"),
            "both": merges.where("name is not null"),
            "neither": inner.where("raw is null and name is null"),
            "self": merges.where("target = topic"),
            "into outliers": merges.where("target = -1"),
            "no target": merges.where("target <> topic and target <> -1").join(known, F.col("target") == F.col("known"), "left_anti"),
            "chain": chained,
            "unnamed target": ended.join(named.select(F.col("topic").alias("t")), F.col("target") == F.col("t"), "left_anti"),
            "same name": named.join(same, F.col("name") == F.col("same"), "left_semi"),
        },
        "topic",
    )


#: A sheet with each mistake once, and what is wrong in it.
_NAMES = [("-1", None, "3"), ("0", "login", None), ("1", None, "2.5"), ("2", "pay", "3"), ("3", "update", None), ("4", None, "4"), ("5", "login", None), ("6", None, None), ("7", None, "-1"), ("8", None, "99"), ("9", None, "x"), ("10", None, "4"), ("11", None, "6"), ("12", None, "3.0"), ("12", None, "3"), ("77", "more", None)]
_WRONG = [("outliers", -1), ("no integer", 1), ("both", 2), ("self", 4), ("same name", 0), ("same name", 5), ("neither", 6), ("into outliers", 7), ("no target", 8), ("no id", 9), ("chain", 10), ("unnamed target", 11), ("repeated", 12), ("unknown", 77), ("absent", 13)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{t}')" for p, t in _WRONG) + ") AS w(problem, topic)")
def validate_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of topic names, written and read back, against topics -1 to 13."""
    path = new_path(spark, "names")
    write_sheet(spark.createDataFrame(_NAMES, "topic_id string, topic_name string, merge_into string"), path)
    return merge_problems(read_sheet(spark, path, ["topic_id", "topic_name", "merge_into"], label_col=""), spark.range(-1, 14).select(F.col("id").cast("int").alias("topic")))


# ---- choosing among options

SCHEMES, RULES, WEIGHTS, TOLERANCE = ("spec", "drop3", "3neg"), ("model", "star+model"), ("raw", "weighted"), 0.02


def select_option(scored: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """best, simplest, selected, literal of (option, place, f1), a row an option: the simplest (least place) within the tolerance of the best is selected."""
    s = scored.withColumn("top", F.max("f1").over(Window.partitionBy(F.lit(0))))  # a few options
    fits = F.col("f1") >= F.col("top") - tolerance - 1e-12
    best = F.min_by("option", F.struct(-F.col("f1"), F.col("place")))
    simplest, its_f1 = F.min_by("option", "place"), F.min_by("f1", "place")
    out = s.agg(best.alias("best"), simplest.alias("simplest"), F.min_by("option", F.when(fits, F.col("place"))).alias("selected"), its_f1.alias("own"), F.max("top").alias("top"))
    return out.select("best", "simplest", "selected", F.when(F.col("top") - F.col("own") <= tolerance + 1e-12, F.col("simplest")).otherwise(F.col("best")).alias("literal"))


_OPTIONS = """
o AS (SELECT * FROM (VALUES ('spec', 0), ('drop3', 1), ('3neg', 2)) AS a(scheme, i) CROSS JOIN (VALUES ('model', 0), ('star+model', 1)) AS b(rule, j) CROSS JOIN (VALUES ('raw', 0), ('weighted', 1)) AS c(weights, k)),
r AS (SELECT scheme || '/' || rule || '/' || weights AS option, 100 * i + 10 * j + k AS place, gold = 'negative' AS y, pred_label = 'negative' OR (scheme = '3neg' AND score = 3) OR (rule = 'star+model' AND score <= 2) AS p, CASE weights WHEN 'raw' THEN 1 ELSE weight_units END AS w FROM {labeled} CROSS JOIN o WHERE NOT (scheme = 'drop3' AND score = 3)),
f AS (SELECT option, place, round(2 * sum(CASE WHEN y AND p THEN w ELSE 0 END)::DOUBLE / (sum(CASE WHEN y THEN w ELSE 0 END) + sum(CASE WHEN p THEN w ELSE 0 END)), 9) AS f1 FROM r GROUP BY option, place)"""


@query(f"WITH {_OPTIONS}, e AS (SELECT * FROM f WHERE f1 >= (SELECT max(f1) FROM f) - {TOLERANCE} - 1e-12) SELECT (SELECT option FROM f ORDER BY f1 DESC, place LIMIT 1) AS best, (SELECT option FROM f ORDER BY place LIMIT 1) AS simplest, (SELECT option FROM e ORDER BY place LIMIT 1) AS selected, CASE WHEN (SELECT min(place) FROM e) = (SELECT min(place) FROM f) THEN (SELECT option FROM f ORDER BY place LIMIT 1) ELSE (SELECT option FROM f ORDER BY f1 DESC, place LIMIT 1) END AS literal")
def select_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve options of label scheme, complaint rule and weights, by the F1 of complaints."""
    labeled, parts = view(spark, sf_dir, "labeled"), []
    y = F.col("gold") == "negative"
    for i, scheme in enumerate(SCHEMES):
        for j, rule in enumerate(RULES):
            for k, weights in enumerate(WEIGHTS):
                p = F.col("pred_label") == "negative"
                p = p | (F.col("score") == 3) if scheme == "3neg" else p
                p = p | (F.col("score") <= 2) if rule == "star+model" else p
                w, inside = F.lit(1) if weights == "raw" else F.col("weight_units"), F.col("score") != 3 if scheme == "drop3" else F.lit(True)
                total = lambda c: F.sum(F.when(inside & c, w).otherwise(0)).cast("double")  # noqa: B023, E731
                parts.append(F.struct(F.lit(f"{scheme}/{rule}/{weights}").alias("option"), F.lit(100 * i + 10 * j + k).alias("place"), F.round(F.try_divide(2 * total(y & p), total(y) + total(p)), 9).alias("f1")))
    # One pass over the labels gives all options.
    return select_option(labeled.agg(F.array(*parts).alias("all")).select(F.explode("all").alias("o")).select("o.*"))


# ---- text features in long form, dates, exports


_WORDS = r"w AS (SELECT review_id, list_filter(regexp_split_to_array(lower(content), '\W+'), lambda x: x <> '') AS words, list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '') AS tokens FROM {texts})"


#: Runs and words that a task holds before it gives their counts, a text's beyond that; bits of a character in a run's number.
HELD_RUNS, HELD_WORDS, BITS = 1 << 21, 1 << 17, 12
_NOT_WORD, _BLANK = re.compile(r"\W+", re.ASCII), re.compile(r"[ \t\n\f\r]+")  # as the SQL's are


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, term, df: how many of some texts have each term, whenever enough terms are held; texts in lower case, one by one.

    A character run is a number of its characters' places in a table of those seen; a text with too many characters for the table is taken run by run.
    """
    words, others, runs, held = Counter(), Counter(), [], 0
    place, seen = np.zeros(0x110000, np.int16), [0]

    def given() -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *runs]), return_counts=True)
        spelt = np.ascontiguousarray(np.array(seen, np.uint32)[(keys[:, None] >> (BITS * np.arange(5))) & ((1 << BITS) - 1)]).view("<U5")[:, 0] if len(keys) else []
        for kind, terms, counts in (("char", spelt, n), ("char", list(others), list(others.values())), ("word", list(words), list(words.values()))):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["kind", "term", "df"])
        runs.clear(), words.clear(), others.clear(), seen.__delitem__(slice(1, None)), place.fill(0)

    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            own = [w for w in _NOT_WORD.split(text) if w]
            words.update({*own, *(f"{a} {b}" for a, b in zip(own, own[1:]))})
            points = text_vectors.spaced([t for t in _BLANK.split(text) if t])
            new = np.unique(points[place[points] == 0])
            if len(seen) + len(new) > 1 << BITS:
                yield from given()
                held, new = 0, np.unique(points)
            if len(new) >= 1 << BITS or not points.all():  # the number 0 is none
                others.update({points[i : i + n].tobytes().decode("utf-32-le") for n, starts in text_vectors.runs(points) for i in starts})
            else:
                place[new] = np.arange(len(seen), len(seen) + len(new))
                seen.extend(new.tolist())
                at = place[points].astype(np.int64)
                numbers = [sum(at[starts + i] << (BITS * i) for i in range(n)) for n, starts in text_vectors.runs(points)]
                runs.append(np.unique(np.concatenate(numbers)))
                held += len(runs[-1])
            if held >= HELD_RUNS or len(words) + len(others) >= HELD_WORDS:
                yield from given()
                held = 0
    yield from given()


@query(
    rf"WITH {_WORDS}, p AS (SELECT review_id, ' ' || unnest(tokens) || ' ' AS t FROM w), g AS (SELECT DISTINCT review_id, 'char' AS kind, substr(t, i, n) AS term FROM (SELECT review_id, t, unnest(range(3, 1 + least(5, length(t)))) AS n FROM p) AS x, LATERAL (SELECT unnest(range(1, length(t) - n + 2)) AS i) AS y UNION SELECT DISTINCT review_id, 'word', unnest(words) FROM w UNION SELECT DISTINCT review_id, 'word', unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w), n AS (SELECT count(*) AS n FROM {{texts}}) SELECT kind, term, count(*) AS df, round(ln((1e0 + any_value(n)) / (1e0 + count(*))) + 1e0, 9) AS idf FROM g, n GROUP BY kind, term HAVING count(*) >= 2"
)
def tfidf_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and weight of all word uni- and bigrams and character runs of 3 to 5 that two documents have."""
    texts = view(spark, sf_dir, "texts")
    counts = texts.select(F.lower("content").alias("content")).mapInArrow(_document_frequencies, "kind string, term string, df long")
    n = texts.count()
    df = counts.groupBy("kind", "term").agg(F.sum("df").alias("df")).where("df >= 2")
    return df.select("kind", "term", "df", F.round(F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1.0, 9).alias("idf"))


@query("SELECT review_id, strftime(CASE review_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 7 HOUR ELSE ts + INTERVAL 90 MINUTE END, '%Y-%m-%d %H:%M:%S') AS utc FROM {reviews}")
def iso_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO texts, without an offset (taken as UTC), seven hours east and an hour and a half west, as UTC."""
    i = F.col("review_id") % 3
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(i == 0, "Z").when(i == 1, "+07:00").otherwise("-01:30"))
    zoned = F.to_timestamp(text)
    return view(spark, sf_dir, "reviews").select("review_id", F.date_format(F.to_utc_timestamp(zoned, F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("SELECT review_id, 'G' || right('000000' || CAST(review_id AS STRING), 7) AS gold_id, replace(content[:60], '|', '\\|') AS cell FROM (SELECT review_id, CASE WHEN review_id % 2 = 0 THEN 'a|b ' || content ELSE content END AS content FROM {texts}) AS t")
def escape_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells: cut to 60 characters, bars escaped, ids padded."""
    content = F.when(F.col("review_id") % 2 == 0, F.concat(F.lit("a|b "), F.col("content"))).otherwise(F.col("content"))
    return view(spark, sf_dir, "texts").select("review_id", F.format_string("G%07d", "review_id").alias("gold_id"), F.replace(F.left(content, F.lit(60)), F.lit("|"), F.lit("\\|")).alias("cell"))
