"""Collocations of two to five words, grown from frequent prefixes.

Pattern growth on contiguous patterns: an occurrence of a frequent word is a
pointer into its piece, and what may follow it there, up to MOST words, is its
projection. A projection ends where a word or a pair of words is surely rare, as
no phrase across it can be frequent. Equal projections are counted together, and
sorted: the projections of a prefix are then one range of rows, and its longer
prefixes are ranges within it. A task holds a range of prefixes and extends each
frequent one to the right, depth first, by its next words' ranges, as long as
they are frequent. Ranges are cut by Spark's range partitioning, so a prefix with
very many projections is shared by several tasks, and nothing of it is gathered:
what a task or a batch sees of the prefixes at its two ends is added up at last.

Which words and pairs are surely rare is told by counts in hashed buckets (2**BITS
at most; each no more than the least frequency, as this is enough), whose sums
reach the tasks as one bit a bucket: 32 MB at most, whatever the input. A bucket
that rare pairs fill together only lets projections be longer than they need be.

Words are compared by their bytes, and scores are computed in decimals of 38
digits, rounded down.

Defined results: null text is empty, null language is `und`; texts without words
count for nothing; repeated rows count each; a table without frequent phrases,
or an empty one, gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bytescan import LOWER, Hasher, mix, slices, utf8
from tidemark.llm.shared import blob_partitions, materialize, small_batches, trimmed
from tidemark.llm.token_output import _equal, _pick, _words

UNKNOWN = "und"
#: Words of a phrase, at most; least frequency; reported phrases of a language; hundredths of its occurrences that a longer phrase must hold to absorb one.
MOST, LEAST, TOP, ABSORB = 5, 100, 2000, 100
#: Buckets are about one for each BYTES_A_BUCKET of text, from 2**16 to 2**BITS; a part of them is added in one task.
BITS, BYTES_A_BUCKET, PART_BITS = 28, 8, 20
#: Bytes of text scanned together. Longer documents are cut behind marks that end a piece.
TOGETHER = 2 << 20
#: Hashes that are gathered before they are counted, and projections that a task sorts, about.
GATHER, SORTED = 2 << 20, 1 << 20
#: Places that a language's phrases are dealt to when they meet its number of words.
SALTS = 256

_KINDS = np.ones(256, np.uint8)
_KINDS[[0x20, 0x09]] = 0
_KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Scan:
    """The words of some documents: where they are in `low`, their hashes, and which follow the one before in its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.low, kinds = LOWER[data], _KINDS[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(kinds[1:], kinds[:-1], out=edge[1:-1])
        edge[offsets] = True
        at = np.flatnonzero(edge)
        word = kinds[at[:-1]] == 1
        self.starts, ends = at[:-1][word], at[1:][word]
        self.sizes = ends - self.starts
        self.hashes = Hasher(self.low).spans(self.starts, ends)
        doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.lang = langs[doc]
        piece = np.cumsum(kinds == 2)[self.starts] if len(data) else np.zeros(0, np.int64)
        self.follows = np.zeros(len(doc), bool)
        self.follows[1:] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])

    def buckets(self, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, and of each with the one after it; the latter is only right where that follows."""
        shift, key = np.uint64(64 - bits), keys[self.lang]
        pair = self.hashes[:-1] * _PAIR + self.hashes[1:]
        return (mix(self.hashes ^ key) >> shift).astype(np.uint32), (mix(pair ^ key[:-1]) >> shift).astype(np.uint32)


def scans(batch: pa.RecordBatch):
    """(scan, names of its languages, their keys) over a batch of lang, text."""
    coded = batch.column(0).dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = coded.indices.to_numpy(zero_copy_only=False)
    keys = np.array([_key(x) for x in names], np.uint64)
    data, offsets = utf8(batch.column(1))
    size = np.diff(offsets)
    for i in np.flatnonzero(size > TOGETHER)[::-1].tolist():
        behind = np.flatnonzero(_KINDS[data[offsets[i] : offsets[i + 1] - 1]] == 2) + 1
        cuts = offsets[i] + behind[np.diff(behind // TOGETHER, prepend=0) > 0]
        offsets, langs = np.insert(offsets, i + 1, cuts), np.insert(langs, i + 1, [langs[i]] * len(cuts))
    for lo, hi, part, bounds in slices(data, offsets, TOGETHER):
        yield Scan(part, bounds, langs[lo:hi]), names, keys


def frequent_buckets(texts: DataFrame, bits: int, least: int) -> np.ndarray:
    """A bit for each bucket: whether words or pairs fill it `least` times in all."""
    part_bits = min(PART_BITS, bits)
    size, kind = 1 << part_bits, np.uint8 if least < 256 else np.uint32

    def count(batches):
        held, n = [], 0

        def told():
            bucket, times = np.unique(np.concatenate(held), return_counts=True)
            times = np.minimum(times, least).astype(kind)
            bounds = np.searchsorted(bucket, np.arange((1 << bits - part_bits) + 1, dtype=np.uint64) << np.uint64(part_bits))
            some = np.flatnonzero(np.diff(bounds)).tolist()
            cells = [(bucket[bounds[p] : bounds[p + 1]] & np.uint32(size - 1)).tobytes() for p in some]
            return pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "cells": pa.array(cells, pa.binary()), "times": pa.array([times[bounds[p] : bounds[p + 1]].tobytes() for p in some], pa.binary())})

        for batch in batches:
            for scan, _, keys in scans(batch):
                word, pair = scan.buckets(keys, bits)
                held += [word, pair[scan.follows[1:]]]
                n += len(held[-1]) + len(word)
                if n >= GATHER:
                    yield told()
                    held, n = [], 0
        if n:
            yield told()

    def add(batches):
        now, sums = None, np.zeros(0, np.uint32)

        def told():
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for part, cells, times in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if part != now:
                    if now is not None:
                        yield told()
                    now, sums = part, np.zeros(size, np.uint32)
                cells = np.frombuffer(cells, np.uint32)
                sums[cells] = np.minimum(sums[cells] + np.frombuffer(times, kind), least)  # a part names each cell once
        if now is not None:
            yield told()

    counted = texts.mapInArrow(trimmed(count), "part int, cells binary, times binary")
    found = counted.repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(add), "part int, bits binary")
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in found.collect():  # a bit a bucket, 32 MB at most
        table[r.part * (size // 8) : (r.part + 1) * (size // 8)] = np.frombuffer(r.bits, np.uint8)
    return table


def projections(texts: DataFrame, bits: int, table) -> DataFrame:
    """lang, words, times: what follows occurrences of frequent words, a space after each word, and how often; no words: all words of the language. `table`: a broadcast of frequent_buckets()."""

    def project(batches):
        for batch in batches:
            for scan, names, keys in scans(batch):
                filled = table.value
                n = len(scan.starts)
                word, pair = scan.buckets(keys, bits)
                frequent = (filled[word >> np.uint32(3)] >> (word & np.uint32(7)).astype(np.uint8)) & 1 > 0
                reach = frequent.astype(np.int64)
                if n > 1:
                    on = scan.follows[1:] & frequent[:-1] & frequent[1:] & ((filled[pair >> np.uint32(3)] >> (pair & np.uint32(7)).astype(np.uint8)) & 1 > 0)
                    run = on.copy()
                    for k in range(1, MOST):
                        reach[: n - k] += run[: n - k]
                        run = run[:-1] & on[k:]
                at = np.flatnonzero(reach)
                # Only words that a projection has are written out, each with one space behind it.
                used = np.zeros(n + 1, np.int64)
                np.add.at(used, at, 1)
                np.add.at(used, at + reach[at], -1)
                use = np.flatnonzero(np.cumsum(used)[:n])
                place = np.zeros(n + 1, np.int64)
                size = scan.sizes[use] + 1
                ends = np.cumsum(size)
                place[use] = ends - size
                text = scan.low[_pick_padded(scan.starts[use], scan.sizes[use], len(scan.low))] if len(use) else np.zeros(0, np.uint8)
                if len(use):
                    text[ends - 1] = 0x20
                begin = place[at]
                last = at + reach[at] - 1
                end = place[last] + scan.sizes[last] + 1
                mixed = mix(scan.hashes[at] ^ keys[scan.lang[at]])
                for k in range(1, MOST):
                    deep = np.flatnonzero(reach[at] > k)
                    mixed[deep] = mix(mixed[deep] * _PAIR + scan.hashes[at[deep] + k])
                _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
                # Hashes only suggest which are equal; one that differs from the first of its hash is counted by itself.
                words8 = _words(text)
                same = _equal(words8, begin[first][which], (end - begin)[first][which], words8, begin, end - begin) & (scan.lang[at][first][which] == scan.lang[at])
                times = np.bincount(which[same], minlength=len(first))
                odd = np.flatnonzero(~same)
                first, times = np.append(first, odd), np.append(times, np.ones(len(odd), np.int64))
                total = np.bincount(scan.lang, minlength=len(names))
                some = np.flatnonzero(total)
                sizes = (end - begin)[first]
                raw = text[_pick(begin[first], sizes)] if len(first) else np.zeros(0, np.uint8)
                spans = np.concatenate([[0], np.cumsum(sizes), np.full(len(some), int(sizes.sum()))]).astype(np.int64)
                strings = pa.Array.from_buffers(pa.large_string(), len(first) + len(some), [None, pa.py_buffer(spans.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.string())
                langs = pa.DictionaryArray.from_arrays(pa.array(np.append(scan.lang[at][first], some).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_pydict({"lang": langs, "words": strings, "times": pa.array(np.append(times, total[some]).astype(np.int64))})

    return texts.mapInArrow(trimmed(project), "lang string, words string, times long").groupBy("lang", "words").agg(F.sum("times").alias("times"))


def _pick_padded(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Indices of words in a row, each with one more for the space behind it."""
    return np.minimum(_pick(starts, sizes + 1), n - 1)


def grow_batch(langs: list[str], words: pa.Array, times: np.ndarray, least: int) -> list[tuple[str, str, int, int]]:
    """(lang, phrase, its words, occurrences) of the prefixes of sorted projections that are frequent here, or that lie at either end of the rows and may go on elsewhere."""
    data, offsets = utf8(words)
    n = len(langs)
    spaces = np.flatnonzero(data == 0x20)
    first = np.searchsorted(spaces, offsets)
    depth = np.diff(first)
    sums = np.append(0, np.cumsum(times))
    same_lang = np.zeros(n, bool)
    same_lang[1:] = [a == b for a, b in zip(langs, langs[1:])]
    view, ends, breaks = _words(data), {}, {}
    for k in range(1, MOST + 1):
        has = depth >= k
        end = np.full(n, -1)
        end[has] = spaces[first[:-1][has] + k - 1] + 1
        same = np.zeros(n, bool)
        both = np.flatnonzero(has[1:] & has[:-1] & same_lang[1:]) + 1
        same[both] = _equal(view, offsets[both], end[both] - offsets[both], view, offsets[both - 1], end[both - 1] - offsets[both - 1])
        ends[k], breaks[k] = end, np.flatnonzero(~same)
    raw, out = data.tobytes(), []

    def grow(lo: int, hi: int, k: int) -> None:
        """Rows lo to hi share k words: report each frequent way to go on, and go on."""
        if k == MOST:
            return
        while k and lo < hi and depth[lo] == k:  # what ends here comes first
            lo += 1
        if lo == hi:
            return
        starts = breaks[k + 1][slice(*np.searchsorted(breaks[k + 1], [lo, hi]))]
        starts = starts if len(starts) and starts[0] == lo else np.append(lo, starts)
        stops = np.append(starts[1:], hi)
        found = sums[stops] - sums[starts]
        for i in np.flatnonzero((found >= least) | (starts == 0) | (stops == n)).tolist():
            a, b = int(starts[i]), int(stops[i])
            if depth[a] > k:
                out.append((langs[a], raw[offsets[a] : ends[k + 1][a] - 1].decode(), k + 1, int(found[i])))
                grow(a, b, k + 1)

    grow(0, n, 0)
    return out


def frequent_phrases(projected: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, size (words), f of all phrases of up to MOST words that occur `least` times. `projected`: a table of projections() on disk."""

    def grown(batches):
        for batch in batches:
            if batch.num_rows:
                found = grow_batch(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False), least)
                lang, phrase, size, f = zip(*found)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "phrase": pa.array(phrase, pa.string()), "size": pa.array(size, pa.int32()), "f": pa.array(f, pa.int64())})

    rows = projected.where("words != ''")
    parts = blob_partitions(rows, rows.count(), SORTED)
    ranges = rows.repartitionByRange(parts, "lang", "words").sortWithinPartitions("lang", "words")
    found = ranges.mapInArrow(grown, "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(phrases: DataFrame, totals: DataFrame, top: int = TOP, absorb: int = ABSORB) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases. `phrases`: lang, phrase, size, f, closed under parts; `totals`: lang, n."""
    long = phrases.where("size >= 2")
    # A longer phrase that absorbs one has a part, one word longer than that one, which does so too: it occurs no less often.
    outer = long.where("size >= 3").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
    outer = outer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = long.join(outer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("f")))
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - size)").alias("tail"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    # A language may have most phrases: its total is there SALTS times, and its phrases are dealt to them.
    dealt = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    scored = parts.join(dealt, ["lang", "salt"])
    scored = scored.withColumn("score", F.expr("(cast(a as decimal(16)) * cast(n as decimal(18)) * cast(1000 as decimal(4))) div (cast(l as decimal(18)) * cast(r as decimal(18)))"))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    by_part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SALTS))).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    # Only the best of each part can be among a language's best.
    few = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("place", F.row_number().over(by_part)).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, absorb: int = ABSORB) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(lang_col, F.lit(UNKNOWN)).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(BITS, max(16, (size // BYTES_A_BUCKET).bit_length()))
    table = spark.sparkContext.broadcast(frequent_buckets(texts, bits, least))
    projected = materialize(projections(texts, bits, table), "projections")
    totals = projected.where("words = ''").select("lang", F.col("times").alias("n"))
    return collocations(materialize(frequent_phrases(projected, least), "phrases"), totals, top, absorb)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), f AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, k AS size, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, range(1, {MOST + 1}) t(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= {LEAST}
), free AS (
  SELECT * FROM f c WHERE size >= 2 AND NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = c.lang AND q.size > c.size AND 100 * q.f >= {ABSORB} * c.f AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM free)
), scored AS (
  SELECT c.lang, c.phrase, c.a, h.f AS l, t.f AS r, n, c.k, CAST((1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN totals o ON o.lang = c.lang
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM worst QUALIFY rank <= {TOP}
"""
