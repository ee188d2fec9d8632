"""Numbers of tokens of whole texts, without their ids leaving the library.

Texts come to an Arrow function in batches of bytes, are cut at safe boundaries
into pieces, and the distinct pieces of a slice are given to the library in
batches of about BATCH bytes; only how many tokens each piece has is kept. A
document's number is the sum over its pieces. So a text of any length is counted
in slices' worth of pieces, not as one call.

A boundary is safe where the library can never make one token of what lies on
both sides:

* `.json`, byte-level with the common pattern and no normalizer: before white
  space that follows a character which is none, and between an ASCII letter and
  an ASCII mark. Added tokens are found by the library before its pattern, so
  their occurrences are pieces of their own and aren't cut.
* `.model`, if no piece of the vocabulary has a word's start inside it: at a
  single space between ASCII letters or digits; the library writes the space as
  the start of a word by itself.
* any other file: none. Texts are then counted whole.

Defined results: null and empty texts have 0 tokens; repeated rows are counted
each; an empty table gives an empty result; lone surrogates can't occur, as
columns are UTF-8. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytescan import WORDS, Hasher, slices, utf8
from tidemark.llm.shared import small_batches
from tidemark.llm.token_output import _equal, _words, default_tokenizer

#: Bytes of texts that are cut together, and bytes of pieces that the library gets at once.
TOGETHER, BATCH = 1 << 21, 1 << 18
LIMIT = 1024

_SPACE = WORDS == 0
_SOLID = (np.arange(256) > 0x20) & (np.arange(256) != 0x7F)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[[*range(ord("0"), ord("9") + 1)]] = True
_MARK = _SOLID & ~_LETTER & ~_DIGIT & (np.arange(256) < 0x80)
_WIDE = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])  # lead bytes of all blanks of three bytes


class JsonLibrary:
    """A vocabulary of the tokenizers library."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        with open(file, encoding="utf-8") as f:
            said = json.load(f)
        added, cutter = said.get("added_tokens") or [], said.get("pre_tokenizer") or {}
        self.cuttable = said.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        contents = sorted((t["content"].encode() for t in added if t["content"]), key=lambda c: (-len(c), c))
        self.added = re.compile(b"|".join(map(re.escape, contents))) if contents else None

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of pieces; none spans two documents."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if self.cuttable and n:
            space, solid = _SPACE[data], _SOLID[data]
            cut[1:n] = (space[1:] & solid[:-1]) | (_LETTER[data[:-1]] & _MARK[data[1:]])
            # A blank outside ASCII before white space belongs to the same run.
            cut[3:n] &= ~(space[3:] & _WIDE[data[: n - 3]])
            cut[2:n] &= ~(space[2:] & (data[: n - 2] == 0xC2) & ((data[1 : n - 1] == 0x85) | (data[1 : n - 1] == 0xA0)))
            raw = data.tobytes()
            if self.added and self.added.search(raw):
                for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                    for m in self.added.finditer(raw, a, b):
                        cut[m.start() : m.end() + 1] = False
                        cut[[m.start(), m.end()]] = True
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        return edges[:-1], edges[1:]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class ModelLibrary:
    """A vocabulary of the sentencepiece library."""

    def __init__(self, file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=file)
        start, one = "▁", self.library.encode
        inside = any(start in self.library.id_to_piece(i).lstrip(start) for i in range(self.library.get_piece_size()))
        # As the library itself shows: a word's start is added at the front, and two words are as many tokens as each alone.
        self.cuttable = not inside and one("a", out_type=str) == [start + "a"] and one("to be", out_type=str) == one("to", out_type=str) + one("be", out_type=str)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if self.cuttable and n > 2:
            word = _LETTER[data] | _DIGIT[data]
            cut[1 : n - 1] = (data[1:-1] == 0x20) & word[:-2] & word[2:]
            at = offsets[(offsets > 0) & (offsets < n)]
            cut[at] = False  # a document's first space isn't between words,
            cut[at - 1] = False  # nor is its last
        drop = cut.copy()
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        return edges[:-1] + drop[edges[:-1]], edges[1:]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]


_libraries: dict[str, JsonLibrary | ModelLibrary] = {}


def library(file: str) -> JsonLibrary | ModelLibrary:
    """The worker's library for a vocabulary file, by its kind."""
    if file not in _libraries:
        _libraries[file] = (ModelLibrary if file.endswith(".model") else JsonLibrary)(file)
    return _libraries[file]


def count_pieces(lib, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many tokens each piece has. Each distinct piece is encoded once, in batches of bytes."""
    size = ends - starts
    hashes, first, which = np.unique(Hasher(data).spans(starts, ends), return_index=True, return_inverse=True)
    # Hashes only suggest which pieces are equal: one whose bytes differ from the first of its hash stands for itself.
    words = _words(data)
    odd = np.flatnonzero(~_equal(words, starts[first][which], size[first][which], words, starts, size))
    which[odd], first = len(first) + np.arange(len(odd)), np.append(first, odd)
    begin, end, raw = starts[first].tolist(), ends[first].tolist(), data.tobytes()
    found: list[int] = []
    batch_of = np.cumsum(size[first]) // BATCH
    bounds = np.flatnonzero(np.diff(batch_of, prepend=-1)).tolist() + [len(first)]
    for lo, hi in zip(bounds, bounds[1:]):
        found += lib.counts([raw[a:b].decode() for a, b in zip(begin[lo:hi], end[lo:hi], strict=True)])
    return np.array(found, np.int64)[which]


def count_texts(lib, texts: pa.Array) -> np.ndarray:
    """How many tokens each text has."""
    data, offsets = utf8(texts)
    out = np.zeros(len(offsets) - 1, np.int64)
    for lo, hi, part, bounds in slices(data, offsets, TOGETHER):
        if not len(part):
            continue
        starts, ends = lib.pieces(part, bounds)
        # A text far longer than a slice goes through the hashes a slice's worth of pieces at a time.
        turn = starts // TOGETHER
        for t in range(int(turn[-1]) + 1):
            a, b = np.searchsorted(turn, [t, t + 1])
            if a < b:
                base = int(starts[a])
                n = count_pieces(lib, part[base : ends[b - 1]], starts[a:b] - base, ends[a:b] - base)
                np.add.at(out, lo + np.searchsorted(bounds, starts[a:b], "right") - 1, n)
    return out


def count_tokens(docs: DataFrame, file: str, text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs and n_bytes, n_tokens, over_limit (more tokens than `limit`) for each row. `file`: a vocabulary that every executor has."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(count_texts(library(file), texts), pa.int64())

    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": tokens(text)})
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, default_tokenizer()).select("doc_id", "n_bytes", "n_tokens", "over_limit")
