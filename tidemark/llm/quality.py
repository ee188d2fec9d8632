"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters, of digits and of other marks, lower-cased; unigrams
and bigrams are hashed into 2**BITS weights. A document's vector holds its
n-gram counts over their number (times SCALE), a bias and a feature for the
power of two of its length, and its score is the sparse dot product's sigmoid.

Training takes at most MAX_TRAIN labelled rows, those with the smallest hashes
of their id, and of these, in that order, as many as have MAX_ENTRIES n-grams
together: documented bounds, so the sample takes 8 bytes an entry of one task,
however long its texts are, and the model (1 MB) is all that reaches the driver.
Scoring reads every byte of every text.

Defined results: null and empty texts are scored by bias and length alone; rows
without label, or with null label, train nothing; of several labels for an id
the largest counts; if there is nothing to train on, every score is 0.5; an
empty table gives an empty result. Other columns pass through `keep_good`
untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytescan import LOWER, RUNS, Hasher, mix, slices, tokens, utf8
from tidemark.llm.shared import crc32_bucket, small_batches

BITS, SCALE, EPOCHS, MAX_TRAIN = 18, 10.0, 4, 8000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: Distinct n-grams of a document, summed over the sample's; the first document always counts.
MAX_ENTRIES = 1 << 24
THRESHOLD = 0.3
#: The first weights are the bias and the length features; n-grams hash to the rest.
_FIXED = 64


def _ngrams(data: np.ndarray, offsets: np.ndarray):
    """Weight indices of all unigrams, then of all bigrams, with each document's bounds in both."""
    low = LOWER[data]
    starts, ends, at = tokens(low, offsets, RUNS)
    words = Hasher(low).spans(starts, ends)
    pairs = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)
    span = np.uint64((1 << BITS) - _FIXED)
    index = lambda h: ((h >> np.uint64(16)) % span + np.uint64(_FIXED)).astype(np.int64)
    return index(words), index(pairs), at


def _fixed(n: np.ndarray) -> np.ndarray:
    """The length feature's index."""
    return 1 + np.ceil(np.log2(n + 1.0)).astype(np.int64)


class Model:
    def __init__(self, weights: np.ndarray):
        self.weights = weights.astype(np.float32)

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = utf8(texts)
        out = np.empty(len(offsets) - 1)
        w = self.weights
        for lo, hi, part, bounds in slices(data, offsets):
            one, two, at = _ngrams(part, bounds)
            a = np.concatenate([[0.0], np.cumsum(w[one], dtype=np.float64)])
            b = np.concatenate([[0.0], np.cumsum(w[two], dtype=np.float64), [0.0, 0.0]])
            b[len(two) + 1 :] = b[len(two)]
            first, last = at[:-1], at[1:]
            n = last - first
            total = a[last] - a[first] + np.where(n > 1, b[np.maximum(last - 1, first)] - b[first], 0.0)
            count = np.maximum(1, 2 * n - 1)
            logit = float(w[0]) + w[_fixed(n)] + SCALE * total / count
            out[lo:hi] = 1 / (1 + np.exp(-logit))
        return out


def _vectors(texts: pa.Array):
    """Sparse vectors of documents: indices and values."""
    data, offsets = utf8(texts)
    for _, _, part, bounds in slices(data, offsets):
        one, two, at = _ngrams(part, bounds)
        for a, b in zip(at[:-1], at[1:], strict=True):
            grams = np.concatenate([one[a:b], two[a : max(a, b - 1)]])
            index, counts = np.unique(grams, return_counts=True)
            value = SCALE * counts / max(1, len(grams))
            yield np.concatenate([[0, int(_fixed(np.array([b - a]))[0])], index]), np.concatenate([[1.0, 1.0], value])


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Follow-the-regularised-leader (proximal) with per-coordinate rates, L1 and L2."""
    z, n, w = (np.zeros(1 << BITS) for _ in range(3))
    for _ in range(epochs):
        for short, single, label in examples:
            index, value = short.astype(np.int64), single.astype(np.float64)
            zi, root = z[index], np.sqrt(n[index])
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ value, -35, 35)))
            g = (p - label) * value
            after = n[index] + g * g
            z[index] += g - (np.sqrt(after) - root) / ALPHA * wi
            n[index] = after
    live = np.abs(z) > L1
    w[live] = (np.sign(z[live]) * L1 - z[live]) / ((BETA + np.sqrt(n[live])) / ALPHA + L2)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, max_entries: int = MAX_ENTRIES) -> Model:
    """Fit on at most max_train labelled documents, of at most max_entries n-grams together."""
    order = F.xxhash64(F.lit(7), F.col("i"))
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y is not null")
    sample = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(order, "i").limit(max_train)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    found = texts.join(F.broadcast(sample), "i")  # at most max_train ids

    def vectors(batches):
        for batch in batches:
            pairs = list(_vectors(batch.column(1)))
            yield pa.RecordBatch.from_pydict(
                {"i": batch.column(0), "y": batch.column(2).cast(pa.int32()), "index": pa.array([i.tolist() for i, _ in pairs], pa.list_(pa.int32())), "value": pa.array([v.tolist() for _, v in pairs], pa.list_(pa.float32()))}
            )

    def fit(batches):
        examples, entries = [], 0
        for b in batches:  # read to the end; what is beyond the bound isn't kept
            for y, index, value in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                entries += len(index)
                if not examples or entries <= max_entries:
                    examples.append((index.values.to_numpy().copy(), value.values.to_numpy().copy(), int(y > 0)))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([ftrl(examples).astype("<f4").tobytes()], pa.binary())})

    rows = found.select("i", "t", "y").mapInArrow(vectors, "i long, y int, index array<int>, value array<float>")
    rows = rows.repartition(1).sortWithinPartitions(order, "i", F.hash("index"))
    parts = rows.mapInArrow(fit, "weights binary").collect()
    return Model(np.frombuffer(parts[0].weights, "<f4") if parts else np.zeros(1 << BITS))


def scorer(spark: SparkSession, model: Model):
    """A column function: text to score."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model.weights)  # 2**BITS floats

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(Model(shared.value).score(texts))

    return score


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier doesn't reject, all columns as they were."""
    score = scorer(docs.sparkSession, train(docs, labels, id_col, text_col))
    return docs.where(score(F.col(text_col)) >= threshold)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc32_bucket(doc_id, 5) == 0, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = scorer(spark, train(docs, labels.where(~held_out())))
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.select("*", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
