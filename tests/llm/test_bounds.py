"""Bounds that are part of an operator's contract: the training sample, and files that can't be encoded in pieces."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import quality
from tidemark.llm.decontaminate import Items, tile
from tidemark.llm.token_output import PieceEncoder


def test_sample_is_bounded_by_ngrams(spark):
    """The first documents by hash that have no more n-grams together than asked for; with room for all, all."""
    texts = [" ".join(f"w{i}x{j}" for j in range(5 + 3 * i)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    order = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(7, doc_id) AS h").orderBy("h", "doc_id").collect()]
    vectors = dict(enumerate(quality._vectors(pa.array(texts, pa.large_string()))))

    def fitted(ids):
        return quality.ftrl([(vectors[i][0].astype(np.int32), vectors[i][1].astype(np.float32), i % 2) for i in ids]).astype("<f4")

    sizes = np.cumsum([len(vectors[i][0]) for i in order])
    for most, ids in ((1 << 24, order), (int(sizes[6]), order[:7]), (int(sizes[6]) - 1, order[:6]), (0, order[:1])):
        assert np.array_equal(quality.train(docs, labels, max_entries=most).weights, fitted(ids))
    assert not np.array_equal(fitted(order), fitted(order[:7]))


def test_unfit_files_are_refused(tmp_path):
    assert PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError, match="in pieces"):
        PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        said = json.load(f)
    for key, value, problem in (("normalizer", {"type": "Lowercase"}, "in pieces"), ("pre_tokenizer", said["pre_tokenizer"] | {"add_prefix_space": True}, "in pieces"), ("added_tokens", [said["added_tokens"][0] | {"lstrip": True}], "beyond")):
        path = tmp_path / "file.json"
        path.write_text(json.dumps(said | {key: value}))
        with pytest.raises(ValueError, match=problem):
            PieceEncoder(str(path))


def test_best_item_is_that_of_all_items_tiled():
    """Whatever bound an item has from its seeds, the best coverage is that of tiling every item."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(30)]
    items = Items(list(range(30)), texts, min_tile=2)
    from tidemark.llm.decontaminate import _windows

    for _ in range(60):
        parts = [t.split() for t in rng.choice(texts, 3)]
        text = " ".join(w for p in parts for w in p[int(rng.integers(0, len(p))) :])
        own = Items([0], [text], min_tile=2).words[0] if text else np.zeros(0, np.uint64)
        if len(own) < 2:
            continue
        every = [sum(t[2] for t in tile(w, own, 2)) / len(w) if len(w) else 0.0 for w in items.words]
        best = [(0.0, None)]
        items.scan(own, _windows(own, 2), np.array([0, len(own)]), best)
        assert best[0][0] == pytest.approx(max(every))
