"""Batched scoring of texts, and what is made of scores.

A scorer turns a list of texts into rows of class probabilities. It is built
once a worker from a factory and sees each distinct text once, in batches of
texts of like length; scores are mapped back to all rows with that text, which
must all get one. `KeywordScorer` stands in for a fine-tuned network: anything
with the same two members may take its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.views import duck, view

BATCH = 128
QUERIES, ORACLES = {}, {}


class Scorer(Protocol):
    labels: list[str]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each label."""


@dataclass
class KeywordScorer:
    """Softmax of how many of a label's words a text has; of equal labels the first wins."""

    words: dict[str, list[str]]
    labels: list[str] = field(init=False)

    def __post_init__(self):
        self.labels = list(self.words)
        self.sets = [frozenset(w) for w in self.words.values()]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        hits = np.array([[len(own & set(re.findall("[a-z]+", t.lower()))) for own in self.sets] for t in texts], np.float64).reshape(len(texts), len(self.labels))
        raised = np.exp(hits - hits.max(axis=1, keepdims=True)) if len(texts) else hits
        return raised / raised.sum(axis=1, keepdims=True) if len(texts) else raised


def score_texts(texts: DataFrame, text_col: str, factory: Callable[[], Scorer], labels: list[str], batch: int = BATCH, by_length: bool = True) -> DataFrame:
    """text_col, pred_label and p_<label> of each row's text, in batches; `by_length` sorts a partition first, so batches need little padding."""
    rows = texts.select(text_col)
    if by_length:
        rows = rows.sortWithinPartitions(F.length(text_col), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        if scorer.labels != labels:
            raise ValueError(f"the scorer's labels are {scorer.labels}")
        for part in batches:
            for i in range(0, part.num_rows, batch):
                column = part.column(0).slice(i, batch)
                p = scorer.probabilities([t or "" for t in column.to_pylist()])
                best = [labels[j] for j in p.argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([column.cast(pa.string()), pa.array(best, pa.string()), *[pa.array(p[:, j]) for j in range(len(labels))]], names=[text_col, "pred_label", *[f"p_{x}" for x in labels]])

    return rows.mapInArrow(run, f"{text_col} string, pred_label string, " + ", ".join(f"p_{x} double" for x in labels))


def score_distinct(df: DataFrame, text_col: str, factory: Callable[[], Scorer], labels: list[str], batch: int = BATCH) -> DataFrame:
    """df with the scores of its texts, each distinct text scored once; null texts are scored as empty ones."""
    known = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    scored = score_texts(known.select("__text").distinct(), "__text", factory, labels, batch).withColumnRenamed("__text", "__scored")
    joined = known.join(scored, F.col("__text") == F.col("__scored"), "left").drop("__text", "__scored")
    # A text without a score would be an error of the engine, not of the data: it stops the query.
    return joined.withColumn("pred_label", F.coalesce("pred_label", F.raise_error(F.lit("a text has no score")).cast("string")))


def consistency(texts: DataFrame, text_col: str, factory: Callable[[], Scorer], labels: list[str], batches: tuple[int, int] = (BATCH, 64)) -> DataFrame:
    """Share of texts with one label whether scored by length in large batches or as they come in small ones."""
    one = score_texts(texts, text_col, factory, labels, batches[0]).select(F.col(text_col).alias("a"), F.col("pred_label").alias("x"))
    two = score_texts(texts, text_col, factory, labels, batches[1], by_length=False).select(F.col(text_col).alias("b"), F.col("pred_label").alias("y"))
    both = one.join(two, F.col("a") == F.col("b"))
    return both.agg(F.count("*").alias("n"), (F.count_if(F.col("x") == F.col("y")).cast("double") / F.count("*")).alias("agreement"))


# ---- queries: the review texts are an event type and a number

WORDS = {"negative": ["error"], "neutral": ["view"], "positive": ["purchase", "click", "signup", "login", "search"]}
LABELS = list(WORDS)


def keyword_scorer() -> KeywordScorer:
    return KeywordScorer(WORDS)


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, duck(sql)
        return f

    return add


_HITS = "CASE WHEN text_clean LIKE 'error%' THEN 'negative' WHEN text_clean LIKE 'view%' THEN 'neutral' WHEN regexp_matches(text_clean, '^(purchase|click|signup|login|search)') THEN 'positive' ELSE 'negative' END"
_P = "CASE WHEN regexp_matches(text_clean, '^(error|view|purchase|click|signup|login|search)') THEN exp(1e0) / (exp(1e0) + 2) ELSE 1e0 / 3 END"


@query(f"SELECT review_id, {_HITS} AS pred_label, round({_P}, 9) AS p FROM {{reviews}}")
def score_unique_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_distinct(view(spark, sf_dir, "reviews").select("review_id", "text_clean"), "text_clean", keyword_scorer, LABELS)
    return scored.select("review_id", "pred_label", F.round(F.greatest(*[f"p_{x}" for x in LABELS]), 9).alias("p"))


@query("SELECT count(DISTINCT text_clean) AS n, 1e0 AS agreement FROM {reviews}")
def score_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency(view(spark, sf_dir, "reviews").select("text_clean").distinct(), "text_clean", keyword_scorer, LABELS)


STAR_NEGATIVE, WORDS_FOR_TOPIC = 2, 2


def analyze_reviews(rows: DataFrame, factory: Callable[[], Scorer] = keyword_scorer, labels: list[str] = LABELS) -> DataFrame:
    """id, text_clean, pred_label, complaint, flagged_by, topic, note of rows (id, content, star, topic): one path for a table and for a single review.

    A complaint has few stars or a negative text. It gets a topic only if its
    text is negative and has words enough. A missing star decides nothing.
    """
    cleaned = rows.withColumn("text_clean", T.cleaner()(F.coalesce("content", F.lit(""))))
    s = score_distinct(cleaned, "text_clean", factory, labels)
    star, text = F.coalesce(F.col("star") <= STAR_NEGATIVE, F.lit(False)), F.col("pred_label") == "negative"
    flagged = F.when(star & text, "star+model").when(star, "star rule").when(text, "model").otherwise("-")
    long = T.word_count(F.col("text_clean")) >= WORDS_FOR_TOPIC
    note = F.when(~(star | text), "no complaint").when(~text, "stars only").when(~long, "too short").when(F.col("topic") == -1, "no clear topic").otherwise("topic")
    return s.select("id", "text_clean", "pred_label", (star | text).alias("complaint"), flagged.alias("flagged_by"), F.when(text & long & (F.col("topic") != -1), F.col("topic")).alias("topic"), note.alias("note"))


def analyze_one(spark: SparkSession, content: str | None, star: int | None, topic: int = -1) -> dict:
    """A single review, by the same path."""
    row = spark.createDataFrame([(0, content, star, topic)], "id long, content string, star int, topic int")
    return analyze_reviews(row).first().asDict()


@query(
    f"WITH s AS (SELECT *, {_HITS} = 'negative' AS t, score <= 2 AS f FROM {{reviews}}) SELECT review_id AS id, t OR f AS complaint, ['-', 'star rule', 'model', 'star+model'][1 + f::INT + 2 * t::INT] AS flagged_by, CASE WHEN t AND topic <> -1 THEN topic END AS topic, CASE WHEN t THEN CASE topic WHEN -1 THEN 'no clear topic' ELSE 'topic' END WHEN f THEN 'stars only' ELSE 'no complaint' END AS note FROM s"
)
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "reviews").select(F.col("review_id").alias("id"), F.col("text_clean").alias("content"), F.col("score").alias("star"), "topic")
    return analyze_reviews(rows).drop("text_clean", "pred_label")
