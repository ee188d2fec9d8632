"""Subword counts against the libraries, and the report against plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import subwords as S

SF = "/root/testdata/sf0.001"
GRIN = chr(0x1F621)
TEXTS = [("a", "one two three"), ("a", "one unheard of"), ("b", f"one {GRIN} two"), ("b", "what"), ("b", None), ("b", ""), (None, "two " * 300), ("a", f"{GRIN}"), ("a", "one two three"), ("a", "x" * 5000)]


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    """A file of whole words with an unknown one, and ids before and after each text."""
    words = {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2, "one": 3, "two": 4, "three": 5}
    special = [{"id": i, "content": c, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for c, i in list(words.items())[:3]]
    piece = lambda c: {"SpecialToken": {"id": c, "type_id": 0}}
    ends = {c: {"id": c, "ids": [words[c]], "tokens": [c]} for c in ("[CLS]", "[SEP]")}
    post = {"type": "TemplateProcessing", "single": [piece("[CLS]"), {"Sequence": {"id": "A", "type_id": 0}}, piece("[SEP]")], "pair": [{"Sequence": {"id": "A", "type_id": 0}}, {"Sequence": {"id": "B", "type_id": 1}}], "special_tokens": ends}
    # Cutting and padding of the file are not to be used.
    cut = {"direction": "Right", "max_length": 4, "strategy": "LongestFirst", "stride": 0}
    file = {"version": "1.0", "truncation": cut, "padding": None, "added_tokens": special, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": post, "decoder": None, "model": {"type": "WordLevel", "vocab": words, "unk_token": "[UNK]"}}
    path = tmp_path_factory.mktemp("vocabulary") / "words.json"
    path.write_text(json.dumps(file))
    return str(path)


def brute(text):
    words = (text or "").split()
    return len(words) + 2, len(words), sum(w not in ("one", "two", "three") for w in words)


def test_report(spark, vocabulary):
    rows = spark.createDataFrame([(*r, "x") for r in TEXTS], "app string, text string, v string").repartition(3)
    found = {r.grp: r.asDict() for r in S.subword_report(rows, "text", F.col("app"), vocabulary, above=(3, 4)).collect()}
    groups = {"all": TEXTS, "non_short": [t for t in TEXTS if len((t[1] or "").split()) >= T.SHORT_WORDS]}
    groups |= {f"app:{a or ''}": [t for t in TEXTS if t[0] == a] for a in ("a", "b", None)}
    assert found.keys() == groups.keys()
    for name, members in groups.items():
        counts = [brute(t) for _, t in members]
        lengths, emoji = [c[0] for c in counts], [GRIN in (t or "") for _, t in members]
        r = found[name]
        assert (r["n_rows"], r["longest"], r["above_3"], r["above_4"]) == (len(counts), max(lengths), sum(n > 3 for n in lengths), sum(n > 4 for n in lengths))
        assert all(abs(r[k] - np.percentile(lengths, 100 * p)) < 1e-9 for k, p in S.SHARES.items())
        mean = lambda values: float(np.mean(values)) if len(values) else None
        assert r["any_unknown"] == pytest.approx(mean([c[2] > 0 for c in counts])) and r["all_unknown"] == pytest.approx(mean([c[2] == c[1] > 0 for c in counts]))
        assert r["with_emoji"] == pytest.approx(mean(emoji)) and r["emoji_unknown"] == (None if not any(emoji) else pytest.approx(mean([c[2] > 0 for c, e in zip(counts, emoji, strict=True) if e])))


def test_counts_keep_columns(spark, vocabulary, monkeypatch):
    rows = spark.createDataFrame([(t, "x", 1) for _, t in TEXTS], "text string, tokens string, `a.b` int")
    found = S.subword_counts(rows, "text", vocabulary)
    assert found.columns == ["text", "tokens", "a.b", "n_tokens", "n_content", "n_unknown"]
    assert sorted(tuple(r)[3:] for r in found.collect()) == sorted(brute(t) for _, t in TEXTS)
    with pytest.raises(ValueError, match="already"):
        S.subword_counts(found, "text", vocabulary)
    empty = S.subword_report(rows.limit(0), "text", F.lit("a"), vocabulary).collect()
    assert [(r.grp, r.n_rows, r.p50, r.any_unknown) for r in empty] == [("all", 0, None, None)]
    monkeypatch.setattr(S, "SLICE", 5)
    assert list(S._slices(["abc", "ab", "x" * 9, "", "abcd", "ab"])) == [["abc", "ab"], ["x" * 9], ["", "abcd"], ["ab"]] and list(S._slices([])) == []


def test_queries(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=S.default_vocabulary())
    texts = {r.doc_id: T.clean(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.review_id: (r.n_tokens, r.n_content, r.n_unknown) for r in S.subword_lengths(spark, SF).collect()}
    want = {i: library.encode(t) for i, t in texts.items()}
    assert found == {i: (len(ids) + 2, len(ids), ids.count(library.unk_id())) for i, ids in want.items()}
    whole = next(r for r in S.subword_shares(spark, SF).collect() if r.grp == "all")
    assert whole.n_rows == len(texts) and whole.p50 == np.percentile([len(ids) + 2 for ids in want.values()], 50)
