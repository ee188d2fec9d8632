"""Language of documents by multilingual mixture inference.

Each language has a distribution of byte trigrams around letters (lower-cased,
words padded with blanks), counted over all training rows. A document's words
are drawn from a mixture of languages; expectation-maximisation estimates the
proportions from the words' trigram likelihoods. Then nested sets of its best
languages are fitted again, and the set with the largest penalised likelihood
(half a log of the words per extra language, times PENALTY) is kept.

Training sums counts of trigrams, 2**BITS of them for each language: each task
gives one table per language it has seen, dealt in PARTS, so one language's is
added in several tasks, and only the sums reach the driver.

Defined results: text that is null, empty or without letters is `und`, score 0;
rows with null language don't train; with nothing to train on all is `und`; an
empty table gives an empty result; of equal shares the alphabetically first
language wins. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytescan import LOWER, RUNS, slices, utf8
from tidemark.llm.shared import crc32_bucket, small_batches

BITS, SMOOTH, ROUNDS, PENALTY = 16, 0.5, 6, 6.0
#: Parts that a language's table is dealt in.
PARTS = 16
UNKNOWN = "und"
_LETTERS = RUNS == 1
#: Marks and digits count as blanks.
_FOLD = np.where(_LETTERS, LOWER, 0x20).astype(np.uint8)
#: Few bytes from 0x80 are no letters, but a text of such alone has no letter either.


def _trigrams(data: np.ndarray, offsets: np.ndarray):
    """Buckets of the trigrams around all letters, the words' starts in them, and the documents' bounds in words and in letters."""
    now = _FOLD[data]
    before, after = np.empty_like(now), np.empty_like(now)
    before[1:], after[:-1] = now[:-1], now[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = 0x20
    after[offsets[1:][filled] - 1] = 0x20
    at = np.flatnonzero(now != 0x20)
    new = before[at] == 0x20
    code = (before[at].astype(np.uint32) << np.uint32(16)) | (now[at].astype(np.uint32) << np.uint32(8)) | after[at]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    words = np.flatnonzero(new)
    letters = np.searchsorted(at, offsets)
    return bucket, words, np.searchsorted(words, letters), letters


def count_trigrams(docs: DataFrame, lang_col: str, text_col: str) -> dict[str, np.ndarray]:
    """Trigram counts of each language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            data, offsets = utf8(batch.column(1))
            for lo, hi, part, bounds in slices(data, offsets):
                bucket, _, _, letters = _trigrams(part, bounds)
                own = langs[lo:hi]
                for lang in sorted(set(own)):
                    mine = np.repeat(own == lang, np.diff(letters))
                    sums[lang] = sums.get(lang, 0) + np.bincount(bucket[mine], minlength=1 << BITS)
        for lang, c in sums.items():
            parts = [p.astype("<i8").tobytes() for p in np.split(c, PARTS)]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * PARTS, "part": pa.array(range(PARTS), pa.int32()), "counts": pa.array(parts, pa.binary())})

    def add(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, part, raw in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                sums[lang, part] = sums.get((lang, part), 0) + np.frombuffer(raw, "<i8")
        for (lang, part), c in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "part": pa.array([part], pa.int32()), "counts": pa.array([c.tobytes()], pa.binary())})

    schema = "lang string, part int, counts binary"
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found: dict[str, dict[int, np.ndarray]] = {}
    for r in rows.mapInArrow(count, schema).repartition("lang", "part").mapInArrow(add, schema).collect():  # 2**BITS counts a language
        found.setdefault(r.lang, {})[r.part] = np.frombuffer(r.counts, "<i8")
    return {lang: np.concatenate([parts[i] for i in range(PARTS)]) for lang, parts in found.items()}


class Mixture:
    """Trigram models of several languages, and inference of mixtures of them."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.logs = np.array([np.log((counts[k] + SMOOTH) / (counts[k].sum() + SMOOTH * (1 << BITS))) for k in self.langs], dtype=np.float32).reshape(len(self.langs), 1 << BITS)

    def _em(self, like: np.ndarray, first: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the allowed languages in each document, and its log likelihood (less the words' constants)."""
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            weight = like * np.repeat(share.astype(np.float32), sizes, axis=0)
            total = weight.sum(axis=1, keepdims=True)
            weight /= total
            share = np.add.reduceat(weight, first, axis=0, dtype=np.float64) / sizes[:, None]
        total = (like * np.repeat(share.astype(np.float32), sizes, axis=0)).sum(axis=1)
        return share, np.add.reduceat(np.log(np.maximum(total, 1e-37), dtype=np.float64), first)

    def infer(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: shares of languages; all 0 where there is nothing to tell."""
        data, offsets = utf8(texts)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not self.langs:
            return out
        for lo, hi, part, bounds in slices(data, offsets):
            bucket, words, at, _ = _trigrams(part, bounds)
            has = np.flatnonzero(np.diff(at))
            if not len(has):
                continue
            first, sizes = at[:-1][has], np.diff(at)[has]
            like = np.stack([np.add.reduceat(row[bucket], words) for row in self.logs], axis=1)
            like -= like.max(axis=1, keepdims=True)
            np.exp(like, out=like)
            np.maximum(like, 1e-30, out=like)
            everything = np.ones((len(has), len(self.langs)))
            share, full = self._em(like, first, sizes, everything)
            order = np.argsort(-share, axis=1, kind="stable")
            single = np.zeros_like(share)
            np.put_along_axis(single, order[:, :1], 1.0, axis=1)
            best, best_value = single, np.add.reduceat(np.log((like * np.repeat(single.astype(np.float32), sizes, axis=0)).sum(axis=1), dtype=np.float64), first)
            cost = PENALTY * 0.5 * np.log(sizes + 1.0)
            ranked = np.take_along_axis(share, order, axis=1)
            for k in range(2, len(self.langs) + 1):
                # No set can beat the full one's likelihood; where that doesn't pay for k languages, what was found is best.
                open_ = np.flatnonzero((full - (k - 1) * cost > best_value) & (ranked[:, k - 1] > 0))
                if not len(open_):
                    break
                pick = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in open_])
                some = sizes[open_]
                allowed = np.zeros((len(open_), len(self.langs)))
                np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
                found, value = self._em(like[pick], np.cumsum(some) - some, some, allowed)
                value = value - (k - 1) * cost[open_]
                better = value > best_value[open_]
                best[open_[better]], best_value[open_[better]] = found[better], value[better]
            out[lo + has] = best
        return out


def infer_languages(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang_pred, score, langs, shares of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(Mixture(count_trigrams(training, lang_col, text_col)))  # 2**BITS floats a language

    @F.arrow_udf("struct<lang_pred: string, score: double, langs: array<string>, shares: array<double>>")
    def infer(texts: pa.Array) -> pa.Array:
        m = model.value
        rows = []
        for share in m.infer(texts):
            order = [i for i in np.argsort(-share, kind="stable") if share[i] > 0]
            rows.append({"lang_pred": m.langs[order[0]] if order else UNKNOWN, "score": float(min(1.0, share[order[0]])) if order else 0.0, "langs": [m.langs[i] for i in order], "shares": [float(share[i]) for i in order]})
        return pa.array(rows, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))]))

    # A letter is what Unicode calls one; digits, marks and symbols of any script are none.
    seen = docs.select(F.col(id_col), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("seen"))
    return seen.select(id_col, infer("seen").alias("found")).select(id_col, "found.*")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc32_bucket(doc_id, 4) == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out().alias("held_out"))
    training = docs.where(~F.col("held_out") & F.col("doc_id").isNotNull())
    found = infer_languages(docs.select(F.struct("doc_id", "held_out").alias("row"), "text"), training, id_col="row")
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "langs", "shares")
