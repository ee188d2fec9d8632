"""The ten queries and the pipeline on tables on disk, held against plain Python, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_tiles
from tidemark.llm import queries
from tidemark.llm.language import PENALTY, ROUNDS, Mixture, _trigrams, count_trigrams
from tidemark.llm.mixing import REPETITION, budgets
from tidemark.llm.quality import THRESHOLD, _vectors, train
from tidemark.llm.token_output import default_tokenizer

RNG = random.Random(11)
LANGS = {"en": "the of and some words that are well known here", "de": "und der die das nicht wenn aber auch sehr", "fr": "le la les que dans pour avec mais toujours", "es": "el los que para como pero muy siempre nunca"}
ITEM = " ".join(f"bench{i}" for i in range(40))


def sentence(lang, n):
    return " ".join(RNG.choice(LANGS[lang].split()) + (str(RNG.randrange(900)) if RNG.random() < 0.5 else "") for _ in range(n))


def make_rows():
    rows = [(i, sentence(lang := list(LANGS)[i % 4], RNG.choice([5, 40, 160])), lang, f"s{min(i % 7, 2)}") for i in range(120)]
    base = rows[2][1] + " " + rows[6][1] + " " + rows[10][1]
    rows += [(200 + i, base if i < 2 else base.replace(base.split()[3 * i], f"edit{i}"), "fr", "s0") for i in range(8)]
    rows += [(300, rows[0][1] + " " + ITEM, "en", "s1"), (301, " ".join(ITEM.split()[20:] + ["x"] + ITEM.split()[:20]), None, "s1"), (302, " ".join(ITEM.split()[:8]) + " " + rows[1][1], "de", "s1")]
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, "  \n\t", "de", "s0"), (403, "one two", "en", "s0"), (404, "ONE two", "en", "s0"), (404, "ONE two", "en", "s0"), (405, "!!! 123 \U0001f600", "en", "s2"), (406, "x<|endoftext|> y" + chr(0xA0) + "z", "en", "s2")]
    rows += [(500, (" ".join(f"long{i % 997}" for i in range(4000)) + " ") * 100, "en", "s3")]  # 3.5 MB that repeat themselves
    return rows


ROWS = make_rows()
PAGES = [(0, "http://Example.com/en/x?q#f"), (1, "https://www.example.com/en/"), (2, "ftp://a.b.net/es/"), (3, "http://net/fr/1"), (4, None), (5, "no address"), (6, "http://x.org"), (6, "http://x.org"), (7, "http://a.com?x://y")]
TURNS = [(1, 1, "assistant", "b </s>[INST] \\ x"), (1, 0, "user", "a\n[/INST]"), (2, 0, "user", None), (2, 1, "assistant", None), (3, 0, "system", ""), (3, 1, "assistant", "é" * 50)]


def tables(spark, home, rows, labels, items, pages, turns):
    docs = spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "y", 1) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, uid string, h long")
    docs.coalesce(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    spark.createDataFrame([(i, u, None) for i, u in pages], "page_id long, url string, html string").write.parquet(f"{home}/pages.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{home}/conversations.parquet")
    return f"file://{home}"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    labels = [(i, int(lang != "es"), 0) for i, _, lang, _ in ROWS[:100]] + [(0, None, None), (None, 1, 0), (999, 1, 1)]
    return tables(spark, tmp_path_factory.mktemp("sf"), ROWS, labels, [(0, ITEM), (1, None), (2, "too short"), (3, "")], PAGES, TURNS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [], [], [], [], [])


def collect(spark, name, home):
    return queries.QUERIES[name](spark, home).collect()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    found = (corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name])(spark, empty).collect()
    assert [r.conv_id for r in found] == [-1] if name == "op3_chat_format" else found == []


def test_op1(spark, sf):
    found = collect(spark, "op1_quality_classifier", sf)
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in ROWS)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ours = [i for i, *_ in ROWS if crc(i, 5)]
    weights = train(docs, labels.where(F.col("doc_id").isin(ours))).weights.astype(np.float64)
    import pyarrow as pa

    for (i, t, *_), (index, value) in zip(ROWS, _vectors(pa.array([r[1] for r in ROWS], pa.large_string())), strict=True):
        score = 1 / (1 + np.exp(-(weights[index] @ value)))  # a sparse dot product
        for r in (r for r in found if r.doc_id == i):
            assert abs(r.score - score) < 1e-4 and r.predicted == int(r.score >= 0.3) and r.held_out == (crc(i, 5) == 0)


def test_op2(spark, sf):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(default_tokenizer()), 0
    found = sorted(collect(spark, "op2_token_output", sf), key=lambda r: r.start)
    for r, (i, t, *_) in zip(found, sorted(ROWS, key=lambda r: (r[0], r[1] or "")), strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3(spark, sf):
    hard = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for c, _, role, t in sorted([*TURNS, (-1, 0, "user", hard), (-1, 1, "assistant", hard)], key=lambda r: r[:2]):
        turns[c].append((role, t or ""))
    found = {r.conv_id: r for r in collect(spark, "op3_chat_format", sf)}
    assert found.keys() == turns.keys()
    for c, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for role, t in own).encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss.encode())) and r.formatted_chars >= sum(len(t) for _, t in own)


def test_op4(spark, sf):
    taken = collect(spark, "op4_mix_sources", sf)
    words = {(s, i, t): len(re.findall(r"[^ \t\n\x0B\f\r]+", t or "")) for i, t, _, s in ROWS}
    rows = Counter((s, i, t) for i, t, _, s in ROWS)
    tokens = Counter()
    for key, n in rows.items():
        tokens[key[0]] += n * words[key]
    order = sorted(tokens, key=lambda s: (s is not None, s or ""))
    _, given = budgets([tokens[s] for s in order], sum(tokens.values()), REPETITION, None)
    assert sum(r.n_tokens for r in taken) <= sum(tokens.values())
    for s, budget in zip(order, given, strict=True):
        own = [r for r in taken if r.source == s]
        spent, passes = sum(r.n_tokens for r in own), budget // tokens[s] if tokens[s] else 1
        assert spent <= budget and spent <= REPETITION * tokens[s] + 1
        times = Counter((r.doc_id, r.n_tokens) for r in own)
        largest = max((words[k] * n for k, n in rows.items() if k[0] == s), default=0)
        assert budget - spent < max(1, largest)  # the next document would not have fit
        for (src, i, t), n in rows.items():
            if src == s:
                assert n * passes <= times[i, words[src, i, t]] <= n * (passes + 1)


def test_op5(spark, sf):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    found = collect(spark, "op5_url_filter", sf)
    assert sorted(r.page_id for r in found) == sorted(i for i, _ in PAGES)
    for r in found:
        url, host, path = dict(PAGES)[r.page_id], "", ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        assert (r.host, r.path, r.rule, r.verdict) == (host.lower(), path, best[2], best[1])


def plain_mixture(model, text):
    """Shares of languages of one text, by loops."""
    data = np.frombuffer(text.encode(), np.uint8)
    bucket, words, _, _ = _trigrams(data, np.array([0, len(data)]))
    logs = [[float(sum(model.logs[k][b] for b in bucket[a:z])) for k in range(len(model.langs))] for a, z in zip(words, [*words[1:], len(bucket)], strict=True)]
    like = [[max(np.exp(x - max(row)), 1e-30) for x in row] for row in logs]

    def em(allowed):
        share = [a / sum(allowed) for a in allowed]
        for _ in range(ROUNDS):
            parts = [[x * s for x, s in zip(row, share, strict=True)] for row in like]
            share = [sum(p[k] / sum(p) for p in parts) / len(like) for k in range(len(share))]
        return share, sum(np.log(sum(x * s for x, s in zip(row, share, strict=True))) for row in like)

    full, _ = em([1] * len(model.langs))
    order, found = sorted(range(len(full)), key=lambda k: -full[k]), []
    for n in range(1, len(full) + 1):
        share, value = em([1 if k in order[:n] else 0 for k in range(len(full))])
        found.append((value - (n - 1) * PENALTY * 0.5 * np.log(len(like) + 1.0), -n, share))
    return max(found)[2]


def test_op6(spark, sf):
    found = collect(spark, "op6_language_id", sf)
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in ROWS)
    by_id = {r.doc_id: r for r in found}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Mixture(count_trigrams(docs.where(F.col("doc_id").isin([i for i, *_ in ROWS if crc(i, 4) != 2])), "lang", "text"))
    right = []
    for i, t, lang, _ in ROWS:
        r = by_id[i]
        assert r.held_out == (crc(i, 4) == 2) and 0 <= r.score <= 1
        if not re.search(r"[^\W\d_]", t or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif len(t) < 3000:
            share = plain_mixture(model, t)
            assert r.lang_pred == model.langs[int(np.argmax(share))] and abs(r.score - max(share)) < 1e-3
            right += [r.lang_pred == lang] if i < 120 and r.held_out else []
    assert np.mean(right) > 0.9


def test_op7(spark, sf):
    found = collect(spark, "op7_jaccard_join", sf)
    assert len(found) == len(ROWS) and {r.doc_id: r.component_id for r in found} == brute_components(ROWS, 3, 90, 100)
    for r in found:
        words = next((t or "") for i, t, *_ in ROWS if i == r.doc_id).encode().lower().split()
        assert r.n_shingles == (len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}) if len(words) > 2 else bool(words))


def coverage(text):
    words, item = re.findall(r"[a-z]+|[0-9]+", (text or "").lower()), re.findall(r"[a-z]+|[0-9]+", ITEM)
    near = [i for i, w in enumerate(words) if w == "bench"]
    words = words[near[0] : near[-1] + 2] if near else []  # the rest can't match
    return sum(n for *_, n in brute_tiles(item, words, 5)) / len(item)


def test_op8(spark, sf):
    found = collect(spark, "op8_decontaminate", sf)
    assert len(found) == len(ROWS)
    for r in found:
        want = coverage(next(t for i, t, *_ in ROWS if i == r.doc_id))
        assert abs(r.coverage - want) < 1e-12 and r.contaminated == (want >= 0.5) and r.item_id == (0 if want else None)
    assert 0 < next(r.coverage for r in found if r.doc_id == 302) < 0.5


def test_op9(spark, sf):
    found, groups = collect(spark, "op9_exact_dedup", sf), defaultdict(list)
    for i, t, *_ in ROWS:
        groups[t or ""].append(i)
    assert len(found) == len(ROWS) and sum(r.kept for r in found) == len(groups)
    for r in found:
        text = next((t or "") for i, t, *_ in ROWS if i == r.doc_id)
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(groups[text]), len(groups[text]), sha(text.encode()))


def test_op9_with_many_partitions(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert sum(r.kept for r in collect(spark, "op9_exact_dedup", sf)) == len({t or "" for _, t, *_ in ROWS})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_op10(spark, sf):
    found, first = {r.doc_id: r for r in collect(spark, "op10_remove_repeats", sf)}, {}
    rows = sorted({(i, t or "") for i, t, *_ in ROWS})
    for i, t in rows:
        b = t.encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j] += 1
                gone[j + 50] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))


def test_pipeline(spark, sf):
    """Each stage's decisions on what its predecessor kept."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = train(docs, spark.read.parquet(f"{sf}/labels.parquet")).weights.astype(np.float64)
    import pyarrow as pa

    scores = [1 / (1 + np.exp(-(weights[i] @ v))) for i, v in _vectors(pa.array([r[1] for r in ROWS], pa.large_string()))]
    good = [r for r, s in zip(ROWS, scores, strict=True) if s >= THRESHOLD]
    component = brute_components(good, 5, 80, 100)
    single = [r for r in good if component[r[0]] == r[0]]
    clean = [r for r in single if coverage(r[1]) < 0.5]
    assert len(ROWS) > len(good) > len(single) > len(clean)
    found = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.start)
    library, start, times = Tokenizer.from_file(default_tokenizer()), 0, Counter(r.doc_id for r in found)
    assert times.keys() == {r[0] for r in clean}
    assert all(Counter(r[0] for r in clean)[i] <= n <= 2 * Counter(r[0] for r in clean)[i] for i, n in times.items())
    ids_of = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t, *_ in clean}
    for r in found:
        ids = ids_of[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
