"""Hashed features against exact counts, and the cosines of projections against those of exact tf-idf."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import checks, ml, text_vectors as V

RNG = random.Random(8)


def texts(n):
    topics = [[f"{w}{i}" for w in ("river", "stone", "lamp", "été", "wolke") for i in range(8)], [f"{w}{i}" for w in ("coin", "ledger", "tax", "zins") for i in range(9)]]
    return [" ".join(RNG.choices(topics[i % 2], k=RNG.choice([12, 40, 120]))) + ("." if i % 3 else " !") for i in range(n)]


def exact(all_texts):
    """tf-idf vectors without hashing, each half of length 1."""
    counts = [V.terms(t) for t in all_texts]
    df = Counter((part, term) for c in counts for part in V.PARTS for term in c[part])
    out = []
    for c in counts:
        v = {}
        for part in V.PARTS:
            own = {(part, t): (1 + math.log(n)) * (math.log((1 + len(all_texts)) / (1 + df[part, t])) + 1) for t, n in c[part].items()}
            length = math.sqrt(sum(x * x for x in own.values())) or 1.0
            v |= {k: x / length for k, x in own.items()}
        out.append(v)
    return out


def test_cosines_of_projections(spark):
    rows = texts(60)
    wanted = exact(rows)
    found = {r.i: np.array(r.embedding) for r in V.embed(spark.createDataFrame(list(enumerate(rows)), "i int, content string")).collect()}
    errors = []
    for i in range(60):
        assert abs(np.linalg.norm(found[i]) - 1) < 1e-5 and len(found[i]) == V.DIMENSIONS
        for j in range(i):
            errors.append(found[i] @ found[j] - sum(x * wanted[j].get(k, 0.0) for k, x in wanted[i].items()) / 2)
    errors = np.array(errors)
    assert abs(errors.mean()) < 0.03 and math.sqrt((errors**2).mean()) < 1.3 / math.sqrt(V.DIMENSIONS)


def test_features_are_hashed_counts(spark):
    rows = [*texts(20), None, "", "!!!", texts(1)[0]]
    counted = V.counted(spark.createDataFrame(list(enumerate(rows)), "i int, content string"))
    df = Counter()
    for r in counted.collect():
        own = Counter()
        for part, found in V.terms(rows[r.i]).items():
            for term, n in found.items():
                own[V.bucket(part, term)] += n
        assert dict(zip(r.at, r.n)) == own and list(r.at) == sorted(own)
        df.update(own.keys())
    idf = V.weights(counted, 2)
    assert all((idf[b] > 0) == (df[b] >= 2) for b in range(len(idf)))
    for r in V.sparse_vectors(counted, idf).collect():
        at = [b for b in sorted(Counter(V.bucket(p, t) for p, c in V.terms(rows[r.i]).items() for t in c)) if df[b] >= 2]
        assert r.features.size == 2 * V.BUCKETS and list(r.features.indices) == at
        assert math.isclose(r.features.norm(2) ** 2, sum(any(lo <= b < lo + V.BUCKETS for b in at) for lo in (0, V.BUCKETS)), abs_tol=1e-9)
    assert V.embed(spark.createDataFrame([], "i int, content string")).collect() == []
    zero = V.embed(spark.createDataFrame([(1, None), (2, "a b c")], "i int, content string")).where("i = 1").first().embedding
    assert not any(zero)


def test_features_have_names(spark):
    rows = spark.createDataFrame([("wolke wolke wolke",), ("wolke zins",), (None,)], "content string")
    wanted = [V.bucket("word", "wolke"), V.bucket("word", "zins"), V.bucket("char", "olk")]
    assert {r.at: r.feature for r in ml.bucket_names(rows, wanted).collect()} == dict(zip(wanted, ["word__wolke", "word__zins", "char__olk"]))
    assert ml.bucket_names(rows.limit(0), wanted).agg(F.count("*")).first()[0] == 0


ODD = [None, "", " ", "a", "ab\x00c d", "é ü　ﬁ 漢字かな 😀😀a i\x85x", "".join(chr(RNG.randrange(1, 0xD000)) for _ in range(9000))] + ["".join(RNG.choice("aé漢😀 \n\x00\xa0_-") for _ in range(RNG.randrange(60))) for _ in range(300)]


def test_document_frequencies_are_given_in_parts(monkeypatch):
    """Counts equal to plain ones for odd characters, more of them than the table holds, and low bounds, which no batch of terms passes by more than a text."""
    rows = [(t or "").lower() for t in ODD]
    wanted = Counter()
    for t in rows:
        words = [w for w in re.split(r"\W+", t, flags=re.ASCII) if w]
        own = {("word", w) for w in words} | {("word", f"{a} {b}") for a, b in zip(words, words[1:])}
        for word in filter(None, re.split(r"[ \t\n\f\r]+", t)):
            own |= {("char", f" {word} "[i : i + n]) for n in (3, 4, 5) for i in range(len(word) + 3 - n)}
        wanted.update(own)
    for runs, words in ((1 << 21, 1 << 17), (500, 100)):
        monkeypatch.setattr(checks, "HELD_RUNS", runs)
        monkeypatch.setattr(checks, "HELD_WORDS", words)
        found, largest = Counter(), 0
        for part in checks._document_frequencies(iter([pa.RecordBatch.from_arrays([pa.array(rows)], ["content"])])):
            largest = max(largest, len(part))
            for kind, term, n in zip(*(c.to_pylist() for c in part.columns)):
                found[kind, term] += n
        assert found == wanted and (runs > 500 or largest < 30_000)


def test_buckets_of_odd_texts_and_vectors_of_copies(spark):
    for t in ODD:
        own = Counter()
        for part, found in V.terms(t).items():
            for term, n in found.items():
                own[V.bucket(part, term)] += n
        at, n = V.bucket_counts(t)
        assert dict(zip(at.tolist(), n.tolist())) == own and at.tolist() == sorted(own)
    rows = [*texts(70), *["river0 stone1 lamp2 " * 9] * 70]
    found = V.embed(spark.createDataFrame(list(enumerate(rows)), "i int, content string").repartition(3)).where("i >= 70").select("embedding").distinct()
    assert found.count() == 1


def test_models_read_wide_rows_a_few_at_a_time(spark, monkeypatch):
    """The rows of a model are kept once, by the model, and few of them are decoded at once."""
    seen = []

    class Fitted(Exception):
        pass

    def fit(rows, c):
        seen.append((int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")), rows.storageLevel.useMemory))
        raise Fitted

    monkeypatch.setattr(ml, "fit", fit)
    train = spark.createDataFrame([(i, float(i % 2), 1.0, t) for i, t in enumerate(texts(12))], "review_id int, label double, weight double, content string")
    counted = V.counted(train)
    monkeypatch.setattr(ml, "_split", lambda *_: (counted, counted))
    for query in (ml.logreg_pred, ml.top_features):
        try:
            query(spark, "")
        except Fitted:
            pass
    assert len(seen) == 2 and all(n <= 128 and not kept for n, kept in seen)


def test_packed_counts_are_those_of_lists(spark):
    rows = spark.createDataFrame(list(enumerate([*ODD[:40], *texts(20)])), "i int, content string")
    lists, found = V.counted(rows), V.packed(rows)
    wanted = {r.i: list(zip(r.at, r.n)) for r in lists.collect()}
    assert {r.i: np.frombuffer(r.counts, V._PACKED).tolist() for r in found.collect()} == wanted
    df, n = V.packed_frequencies(found)
    assert n == 60 and df.tolist() == V.frequencies(lists).tolist()
