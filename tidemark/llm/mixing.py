"""Temperature mixing of sources, realised as budgeted block permutations.

Source token shares are raised to an exponent and normalised. The exponent is
found by bisection: the smallest in [0, 1] at which no source is repeated more
often than `max_repetition`, or the one at which the weights' entropy meets
`target_entropy`. Each source then gets its weight of the token budget: whole
passes over all its documents, and for the rest a prefix of a permutation of
its blocks, cut inside the last block by a permutation of its documents.

A block is all documents of a source whose hash falls into one of as many
classes as the corpus has BLOCK_TOKENS of tokens. Only sums are shuffled: of
classes of blocks, then of one class's blocks, of classes of the cut block's
documents, and of one class's documents; so a source with most rows is spread
like any other, and texts are never moved.

Defined results: the null source is a source; null text has no words, and
documents without words come with every whole pass and with blocks wholly inside
the rest; rows equal in id and text are taken or left together; a budget is
never exceeded; an empty table gives an empty mixture. All columns pass through
`mix` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import materialize

BLOCK_TOKENS = 1 << 22
#: A budget of as many tokens as the corpus has.
CORPUS = "corpus"
#: Bits of an order below its class: 4,096 classes.
CLASS_SHIFT = 52
#: Sources up to which their plan is broadcast; with more it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def weights_at(shares: list[float], exponent: float) -> list[float]:
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [r / total for r in raised] if total else raised


def _bisect(holds, low: float = 0.0, high: float = 1.0) -> float:
    """The smallest exponent at which `holds`, which stays true above it; `high` if it never does."""
    if holds(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def budgets(tokens: list[int], budget: int | None, max_repetition: float | None, target_entropy: float | None) -> tuple[float, list[int]]:
    """The exponent, and each source's tokens. Without a budget: the least at which every source is seen whole."""
    total = sum(tokens)
    if not total:
        return 1.0, [0] * len(tokens)
    shares = [t / total for t in tokens]

    def given(exponent: float) -> list[float]:
        w = weights_at(shares, exponent)
        whole = budget if budget is not None else max(t / x for t, x in zip(tokens, w, strict=True) if t)
        return [x * whole for x in w]

    if target_entropy is not None:
        exponent = _bisect(lambda e: entropy(weights_at(shares, e)) <= target_entropy)
    else:
        limit = max_repetition if max_repetition is not None else math.inf
        exponent = _bisect(lambda e: all(g <= limit * t * (1 + 1e-9) for g, t in zip(given(e), tokens, strict=True)))
    return exponent, [int(g + 1e-6) for g in given(exponent)]


def _first_beyond(rows: DataFrame, level: Column, room: DataFrame) -> DataFrame:
    """(s, level, room) for each source: the first level, in order, at whose end more than the room is taken, and what room is left before it.

    Equal levels are summed on the map side, so a window sees levels, not rows.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("source", level.alias("level")).agg(F.sum("n_tokens").alias("n"))
    end = F.sum("n").over(Window.partitionBy("source").orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    over = sums.withColumn("end", end).join(room.select("s", "room"), F.col("source").eqNullSafe(F.col("s"))).where("end > room")
    first = over.groupBy("source").agg(F.min_by(F.struct("level", (F.col("room") - F.col("end") + F.col("n")).alias("room")), "level").alias("c"))
    first = first.select(F.col("source").alias("s"), "c.level", "c.room")
    return spark.createDataFrame(first.collect(), first.schema)  # a row for each source


def _within(rows: DataFrame, level: Column, first: DataFrame, small) -> DataFrame:
    """The rows of each source's level."""
    there = first.select(F.col("s").alias("__s"), F.col("level").alias("__level"))
    return rows.join(small(there), F.col("source").eqNullSafe(F.col("__s")) & (level == F.col("__level"))).drop("__s", "__level")


def mix(docs: DataFrame, budget: int | str | None = None, max_repetition: float | None = None, target_entropy: float | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 17, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """struct `doc` (the row as it was), n_tokens, pass_no (from 0), block, position: a row each time a document is taken."""
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("n_tokens"), key.alias("h"))
    slim = materialize(rows.drop("doc"), "mixing")  # planning reads this, not the texts
    sums = slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).orderBy("source").collect()  # a row for each source
    if budget == CORPUS:
        budget = sum(s.tokens for s in sums)
    _, given = budgets([s.tokens for s in sums], budget, max_repetition, target_entropy)
    blocks = max(1, -(-sum(s.tokens for s in sums) // block_tokens))
    spark = docs.sparkSession
    plan_schema = f"src {dict(rows.dtypes)['source']}, passes long, rest long"
    plan = spark.createDataFrame([(s.source, g // s.tokens if s.tokens else 1, g % s.tokens if s.tokens else 0) for s, g in zip(sums, given, strict=True)], plan_schema)
    small = F.broadcast if len(sums) <= BROADCAST_SOURCES else (lambda df: df)

    def permuted(df: DataFrame) -> DataFrame:
        """With each row's block, and the block's place in the permutation of its source's blocks."""
        df = df.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(blocks)))
        return df.withColumn("order", F.xxhash64(F.lit(seed + 2), "source", "block"))

    rows, slim = permuted(rows), permuted(slim)
    # The block that is cut, and the last document of it that fits: found level by level, from sums of a few thousand classes a source.
    block_class, doc_class = F.shiftright("order", CLASS_SHIFT), F.shiftright("h", CLASS_SHIFT)
    room = plan.select(F.col("src").alias("s"), F.col("rest").alias("room"))
    cut = _first_beyond(slim, block_class, room)
    inside = _within(slim, block_class, cut, small)
    cut_block = _first_beyond(inside, F.col("order"), cut)
    inside = _within(inside, F.col("order"), cut_block, small)
    cut_class = _first_beyond(inside, doc_class, cut_block)
    inside = _within(inside, doc_class, cut_class, small)
    cut_doc = _first_beyond(inside, F.col("h"), cut_class)
    told = plan.join(cut_block.select(F.col("s").alias("s1"), F.col("level").alias("cut_order")), F.col("src").eqNullSafe(F.col("s1")), "left")
    told = told.join(cut_doc.select(F.col("s").alias("s2"), F.col("level").alias("cut_h")), F.col("src").eqNullSafe(F.col("s2")), "left")
    told = told.select("src", "passes", "rest", "cut_order", "cut_h")

    out = rows.join(small(told), F.col("source").eqNullSafe(F.col("src")))
    in_rest = (F.col("rest") > 0) & ((F.col("order") < F.col("cut_order")) | ((F.col("order") == F.col("cut_order")) & F.coalesce(F.col("h") < F.col("cut_h"), F.lit(False))))
    copies = F.col("passes") + F.when(in_rest, 1).otherwise(0)
    out = out.withColumn("copies", copies).where("copies > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return out.select("doc", "n_tokens", "pass_no", "block", F.xxhash64(F.lit(seed + 3), "pass_no", "block", "h").alias("position"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the columns of docs; a document occurs each time it is taken."""
    return mix(docs, **options).select("doc.*")


#: Production parameters of the query: as many tokens as there are, none repeated more than so often.
REPETITION = 1.25


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, budget=CORPUS, max_repetition=REPETITION).select("doc.doc_id", "doc.source", "n_tokens", "pass_no", "block", "position")
