"""How long texts are in subwords of a given vocabulary, and how much of them it doesn't know.

The vocabulary is a file of a public library (`.json` of tokenizers, `.model` of
sentencepiece); its path is a parameter and must be readable where tasks run.
Texts are counted where they are: a task builds the encoder once and gives it
batches of bounded size, so nothing is shuffled but the counts.

Defined results: null counts as empty; ids that the library adds before and after
a text are counted in `n_tokens` and not in `n_content`; a vocabulary without an
unknown word has none; shares of no rows are null; an empty table has one row of
the whole, with null percentiles.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.ordering import percentiles
from tidemark.plans.storage import materialize
from tidemark.plans.views import view

QUERIES = {}
SLICE = 1 << 20  # characters given to the library at a time, or one text
SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
ABOVE = (64, 128, 256)

#: n_tokens, n_content and n_unknown of some texts.
Counter = Callable[[list[str]], list[tuple[int, int, int]]]


def counter(path: str) -> Counter:
    """Of a file of either library."""
    if path.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        unknown, ends = library.unk_id(), (library.bos_id() >= 0) + (library.eos_id() >= 0)

        def count(texts: list[str]) -> list[tuple[int, int, int]]:
            found = library.encode(texts, add_bos=library.bos_id() >= 0, add_eos=library.eos_id() >= 0, num_threads=1)
            return [(len(ids), len(ids) - ends, ids.count(unknown)) for ids in found]

        return count
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    word = json.loads(library.to_str())["model"].get("unk_token")
    unknown, ends = library.token_to_id(word) if word else None, library.num_special_tokens_to_add(False)

    def count(texts: list[str]) -> list[tuple[int, int, int]]:
        found = library.encode_batch(texts, add_special_tokens=True)
        return [(len(e), len(e) - ends, 0 if unknown is None else e.ids.count(unknown)) for e in found]

    return count


def _slices(texts: list[str]) -> Iterator[list[str]]:
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > SLICE:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def subword_counts(rows: DataFrame, text_col: str, path: str, names: tuple[str, str, str] = ("n_tokens", "n_content", "n_unknown")) -> DataFrame:
    """All columns of rows and the three counts of each text; names that rows have already are refused."""
    if taken := set(names) & set(rows.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")

    @F.arrow_udf("struct<tokens: bigint, content: bigint, unknown: bigint>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path)
        for batch in batches:
            found = [c for some in _slices([t or "" for t in batch.to_pylist()]) for c in count(some)]
            yield pa.StructArray.from_arrays([pa.array([c[i] for c in found], pa.int64()) for i in range(3)], ["tokens", "content", "unknown"])

    made = rows.select("*", counts(F.col(f"`{text_col}`")).alias("__subwords"))
    return made.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__subwords.{k}").alias(n) for k, n in zip(("tokens", "content", "unknown"), names, strict=True)])


def subword_report(texts: DataFrame, text_col: str, group: Column, path: str, shares: dict[str, float] = SHARES, above: tuple[int, ...] = ABOVE) -> DataFrame:
    """A row for all texts, for those that aren't short, and for each group: rows, percentiles and greatest length, texts longer than
    each of `above`, shares of texts with an unknown subword and of nothing else, and of texts with an emoji, and of these with one unknown."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    asked = texts.select(F.coalesce(group.cast("string"), F.lit("")).alias("app"), text.alias("text"))
    counted = subword_counts(asked.select("app", "text", T.is_short(T.word_count(F.col("text"))).alias("short"), T.has_emoji(F.col("text")).alias("emoji")), "text", path)
    kept = materialize(counted.drop("text"), "subwords")
    member = F.array_compact(F.array(F.lit("all"), F.when(~F.col("short"), "non_short"), F.concat(F.lit("app:"), F.col("app"))))
    rows = kept.select(F.explode(member).alias("grp"), F.col("n_tokens").alias("v"), "n_content", "n_unknown", "emoji")
    share = lambda which, of=None: (F.count_if(which).cast("double") / F.nullif(F.count("*") if of is None else F.count_if(of), F.lit(0)))
    some, only = F.col("n_unknown") > 0, (F.col("n_unknown") == F.col("n_content")) & (F.col("n_content") > 0)
    sums = [F.count("*").alias("n_rows"), F.max("v").alias("longest"), *[F.count_if(F.col("v") > t).alias(f"above_{t}") for t in above]]
    unknown = [share(some).alias("any_unknown"), share(only).alias("all_unknown"), share(F.col("emoji")).alias("with_emoji"), share(some & F.col("emoji"), F.col("emoji")).alias("emoji_unknown")]
    report = rows.groupBy("grp").agg(*sums, *unknown)
    if report.isEmpty():
        report = rows.agg(*sums, *unknown).select(F.lit("all").alias("grp"), "*")
    return report.join(percentiles(rows.select("grp", "v"), shares), "grp", "left")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def subword_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subwords of each document's cleaned text."""
    texts = view(spark, sf_dir, "texts").select("review_id", T.cleaner()(F.coalesce("content", F.lit(""))).alias("text"))
    return subword_counts(texts, "text", default_vocabulary()).select("review_id", "n_tokens", "n_content", "n_unknown")


def subword_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all documents' cleaned texts, by language."""
    texts = view(spark, sf_dir, "texts").select("app", T.cleaner()(F.coalesce("content", F.lit(""))).alias("text"))
    return subword_report(texts, "text", F.col("app"), default_vocabulary())


QUERIES |= {"subword_lengths": subword_lengths, "subword_shares": subword_shares}
