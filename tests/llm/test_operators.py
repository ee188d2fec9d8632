"""Each operator on small tables with nulls, empty and long texts, repeated rows and clashing column names, held against brute force."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, repeats
from tidemark.llm.chat_format import canonical_turns, format_chats, parse_chats, turns_by_row
from tidemark.llm.components import connected_components
from tidemark.llm.decontaminate import find_contaminated, keep_clean, tile
from tidemark.llm.exact_dedup import StreamingExactDedup
from tidemark.llm.language import infer_languages
from tidemark.llm.mixing import budgets, entropy, mix, weights_at
from tidemark.llm.quality import keep_good
from tidemark.llm.token_output import ShardReader, ShardWriter, default_tokenizer, key_of, lookup, token_table, write_shards
from tidemark.llm.url_filter import judge_urls

RNG = random.Random(3)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
LONG = " ".join(RNG.choice(WORDS) + str(RNG.randrange(500)) for _ in range(400))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, h string"


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", "z") for i, t, lang, s in rows], SCHEMA)


ROWS = [
    (1, LONG, "en", "a"), (2, LONG, "en", "a"), (3, LONG.replace("alpha", "ALPHA"), "en", "b"), (4, LONG + " more words at the end", None, "b"), (5, None, "en", None), (6, "", "de", "a"), (7, "  \n", "de", "a"),
    (8, "one two", "fr", "a"), (9, "One two", "fr", "a"), (9, "One two", "fr", "a"), (None, LONG, "en", "a"), (10, "x" * 3000, "en", "b"), (11, "y" + "x" * 200, "en", "b"), (12, "é" * 60 + LONG[:90], "fr", "c"),
]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (6, 6), (None, 1), (9, 3), (9, 1)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4}


def brute_components(rows, k, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


@pytest.mark.parametrize("limit", [4_000_000, 500])  # the second splits the groups
def test_jaccard_join(spark, limit):
    found = jaccard_join.jaccard_components(table(spark, ROWS), 3, 90, 100, group_shingles=limit).collect()
    assert len(found) == len(ROWS)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == brute_components(ROWS, 3, 90, 100)


def test_keep_one_of_each(spark):
    kept = jaccard_join.keep_one_of_each(table(spark, ROWS))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert {r.doc_id for r in kept.collect()} == {1, 5, 6, 7, 8, 10, 11, 12, None}


def test_repeats(spark):
    first, want = {}, {}
    rows = sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0])
    for i, t, *_ in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        want[i] = (len(b), int(gone.sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    for size in (1 << 20, 100):  # the second takes the way for hot hashes
        found = repeats.remove_repeats(table(spark, ROWS), bin_bytes=size).collect()
        assert len(found) == len(ROWS)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in found if r.doc_id is not None} == want


def test_index_against_brute_force():
    strings = [bytes(RNG.choice(b"ab") for _ in range(RNG.randrange(6, 40))) for _ in range(12)]
    data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    found = repeats.RunLengthIndex(data, sizes, np.arange(12), 5).stream(data, sizes, 5)
    for s, own in zip(strings, np.split(found, np.cumsum(sizes)[:-1]), strict=True):
        for j in range(len(s) - 4):
            assert own[j] == min(i for i, t in enumerate(strings) if s[j : j + 5] in t)


def test_tiling():
    item = np.arange(20, dtype=np.uint64)
    text = np.concatenate([item[10:], np.arange(100, 103, dtype=np.uint64), item[:10]])  # reordered halves
    assert sum(t[2] for t in tile(item, text)) == 20
    assert tile(item, np.arange(50, 90, dtype=np.uint64)) == []


def brute_tiles(item, text, k):
    """The longest match of unmarked words, again and again."""
    item, text, tiles = list(item), list(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] is not None and item[i + n] == text[j + n]:
                    n += 1
                best = min(best, (-n, i, j))
        n, i, j = best
        if -n < k:
            return tiles
        tiles.append((i, j, -n))
        item[i : i - n], text[j : j - n] = [None] * -n, [None] * -n


def test_tiling_goes_on_with_what_is_left():
    item = np.arange(20, dtype=np.uint64)
    text = np.concatenate([item[:9], [100], item[8:17], [101, 101, 101]]).astype(np.uint64)  # runs that overlap by a word
    assert tile(item, text) == [(0, 0, 9), (9, 11, 8)]
    rng = random.Random(8)
    for _ in range(300):
        kinds = rng.choice([2, 3, 8])
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(1, 45))] for _ in range(2))
        assert tile(np.array(a, np.uint64), np.array(b, np.uint64), 3) == brute_tiles(a, b, 3)


def test_decontamination(spark):
    bench = spark.createDataFrame([(0, LONG[:300]), (1, None), (2, "too short")], "item_id long, text string")
    docs = table(spark, ROWS)
    found = {r.doc_id for r in find_contaminated(docs, bench).collect() if r.contaminated}
    assert found == {1, 2, 3, 4, None}
    assert sorted(r.doc_id for r in keep_clean(docs, bench).collect()) == [5, 6, 7, 8, 9, 9, 10, 11, 12]
    assert keep_clean(docs, bench.limit(0)).count() == len(ROWS)


def test_exact_dedup_goes_on_where_it_stopped(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    path = str(tmp_path / "documents")
    table(spark, ROWS[:6]).coalesce(1).write.parquet(path)
    for digest in (lambda t: F.sha2(t, 256), lambda t: F.length(t).cast("string")):  # the second collides
        dedup = StreamingExactDedup(spark, path, digest=digest, files_per_batch=1)
        dedup.ingest()
    table(spark, ROWS[6:]).coalesce(1).write.mode("append").parquet(path)
    dedup.ingest()
    rows = dedup.result().collect()
    assert len(rows) == len(ROWS) and sum(r.kept for r in rows) == len({t or "" for _, t, *_ in ROWS})
    assert {r.id: r.keep_id for r in rows}[1] == 2


def test_shards(spark):
    out = io.BytesIO()
    writer = ShardWriter(out)
    for i in [None, -5, 0, 7, 7, 1 << 40]:
        writer.add(key_of(i), np.array([i or 3, 70000][: 1 + (i == 7)]) % 100000)
    writer.close()
    reader = ShardReader(out.getvalue())
    reader.verify()
    assert len(reader.get(key_of(7))) == 2 and not reader.get(key_of(8)) and reader.entries == 6


def test_token_table_equals_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(default_tokenizer()), 0
    texts = ROWS + [(20, "it's  a" + chr(0xA0) + " b\t\n c.d'll x<|endoftext|> y", "en", "a")]
    found = token_table(table(spark, texts), default_tokenizer()).orderBy("start").collect()
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(found) == len(texts)
    for r, (i, t, *_) in zip(found, order, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = f"file://{tmp_path}/s"
    write_shards(table(spark, texts), folder, default_tokenizer()).collect()
    assert len(lookup(spark, folder, [9, 999])[9]) == 2


def test_texts_with_added_tokens_are_encoded_whole(spark):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(default_tokenizer()), 0
    texts = ["x<|endoftext|> y", "plain", "<|endoftext|><|endoftext|>a", "cut<|endof", "text|> over two texts", "x<|endoftext |>"]
    assert 50256 in library.encode(texts[0], add_special_tokens=False).ids
    for r in token_table(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), default_tokenizer()).orderBy("start").collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_chats(spark):
    hard = "</s>[INST] <\\ ok [/INST]\\]\n<s>["
    rows = spark.createDataFrame([(1, 1, "assistant", hard), (1, 0, "us]\ner", hard), (1, 2, None, None), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    back = {r.id: r for r in parse_chats(format_chats(turns_by_row(rows))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("us]\ner", hard), ("assistant", hard), ("", "")]
    assert back[1].loss_text == hard and back[2].loss_text == ""
    records = spark.createDataFrame([(1, '{"prompt": "a", "completion": "b"}'), (2, '{"messages": [{"content": "c", "role": "user"}]}'), (3, "{"), (4, None), (5, '{"other": 1}')], "id long, j string")
    found = {r.id: r for r in canonical_turns(records, "id", "j").collect()}
    assert [tuple(t) for t in found[1].turns] == [("user", "a"), ("assistant", "b")] and found[2].layout == "messages"
    assert all(found[i].turns is None for i in (3, 4, 5))


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://Example.com/en/x?q"), (2, "https://www.example.com/en/"), (3, "http://a.org/1"), (4, "http://b.org/2"), (5, None), (6, "none"), (7, "http://a.net/fr/")], "page_id long, url string")
    edges = spark.createDataFrame([("a.org/1", "example.com/en/z"), ("b.org/2", "c.org/"), ("c.org/", "a.net/es/"), ("b.org/2", "www.x.com/")], "src string, dst string")
    found = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, edges).collect()}
    assert found == {1: ("example.com/en/", "block"), 2: ("www.example.com/en/", "allow"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("net/fr/", "block")}


def test_mixing(spark):
    exponent, given = budgets([900, 90, 10], None, 1.25, None)
    assert all(n <= g <= 1.26 * n for g, n in zip(given, [900, 90, 10], strict=True)) and 0 < exponent < 1
    exponent, _ = budgets([900, 90, 10], 1000, None, 0.8)
    assert abs(entropy(weights_at([0.9, 0.09, 0.01], exponent)) - 0.8) < 1e-6
    docs = table(spark, ROWS)
    taken = mix(docs, max_repetition=1.25, block_tokens=64).collect()
    assert {r.doc.doc_id for r in taken} == {r[0] for r in ROWS}
    half = mix(docs, budget=800, block_tokens=64).collect()
    assert sum(r.n_tokens for r in half) <= 800
    assert mix(docs.limit(0), max_repetition=2.0).count() == 0


def test_quality_and_language(spark):
    good = [(i, " ".join(RNG.choice(WORDS) for _ in range(30)), "en", "a") for i in range(100, 160)]
    bad = [(i, " ".join(RNG.choice(["ze", "du", "kri"]) + "###" for _ in range(30)), "de", "a") for i in range(200, 260)]
    docs = table(spark, good + bad + ROWS)
    labels = spark.createDataFrame([(i, 1) for i, *_ in good[:40]] + [(i, 0) for i, *_ in bad[:40]] + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = {r.doc_id for r in keep_good(docs, labels).collect()}
    assert {i for i, *_ in good} <= kept and not kept & {i for i, *_ in bad}
    found = {r.doc_id: r for r in infer_languages(docs, docs.where("doc_id >= 100")).collect()}
    assert all(found[i].lang_pred == "en" for i, *_ in good) and all(found[i].lang_pred == "de" for i, *_ in bad)
    assert found[5].lang_pred == found[6].lang_pred == "und" and found[5].score == 0
    assert infer_languages(docs, docs.limit(0)).where("lang_pred <> 'und'").count() == 0


def test_a_document_may_have_all_languages(spark):
    rng = random.Random(4)
    letters = {"de": "abcdef", "en": "ghijkl", "es": "mnopqr", "fr": "stuvwx"}
    texts = {lang: " ".join("".join(rng.choice(own) for _ in range(6)) for _ in range(200)) for lang, own in letters.items()}
    training = table(spark, [(i, t, lang, "a") for i, (lang, t) in enumerate(texts.items())])
    mixed = table(spark, [(9, " ".join(texts.values()), None, "a"), (10, texts["en"], None, "a")])
    found = {r.doc_id: r for r in infer_languages(mixed, training).collect()}
    assert sorted(found[9].langs) == sorted(letters) and np.allclose(found[9].shares, 0.25, atol=0.02)
    assert found[10].langs == ["en"]
