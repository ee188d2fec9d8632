"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. A document and a benchmark
item meet if they share a seed, MIN_TILE words in a row. For a pair that meets,
running Karp-Rabin hashing finds the longest matches not yet covered, marks
them as tiles, and goes on with shorter ones down to MIN_TILE words; tiles
never overlap on either side, so passages in another order count as well. A
document is contaminated when tiles cover THRESHOLD of an item's words.

Items are a stated query set: blocks of BLOCK_WORDS words are files in the shared
folder, and all pass over the texts in one job; a worker holds one at a time, and
the driver none. Items are tiled in order of how many of their words lie under
shared seeds, until what lies there can't beat the best; tiles lie under seeds,
so nothing is missed.

Defined results: null and empty texts are clean; items with fewer words than a
tile, or null text, match nothing; repeated rows are judged alike; empty tables
on either side give clean or empty results. Other columns pass through
`keep_clean` untouched, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
import posixpath
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytescan import ALNUM, LOWER, SLICE, Hasher, mix, slices, tokens, utf8
from tidemark.llm.shared import new_path, small_batches

MIN_TILE, THRESHOLD, BLOCK_WORDS = 5, 0.5, 1 << 20
_FIRST_LENGTH = 20
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the documents' bounds in them."""
    hashes, bounds, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, _, part, own in slices(data, offsets):
        low = LOWER[part]
        starts, ends, at = tokens(low, own, ALNUM)
        hashes.append(Hasher(low).spans(starts, ends))
        bounds.append(at[1:] + n)
        n += len(starts)
    return np.concatenate(hashes), np.concatenate(bounds)


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of k words from each position; rolled by doubling."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    h, size = words.copy(), 1
    done, n = np.zeros(0, np.uint64), 0
    rest = k
    while True:
        if rest & 1:
            if n == 0:
                done, n = h, size
            else:
                m = len(words) - n - size + 1
                with np.errstate(over="ignore"):
                    done = done[:m] * np.uint64(pow(int(_BASE), size, 1 << 64)) + h[n : n + m]
                n += size
        rest >>= 1
        if not rest:
            return mix(done[: len(words) - k + 1].copy())
        m = len(words) - 2 * size + 1
        h = h[:m] * np.uint64(pow(int(_BASE), size, 1 << 64)) + h[size : size + m]
        size *= 2


def _pick(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at `at`, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)


def _open_windows(marked: np.ndarray, k: int) -> np.ndarray:
    """Where k unmarked words begin."""
    if len(marked) < k:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[k:] == sums[:-k])


def _matches(item: np.ndarray, text: np.ndarray, in_item: np.ndarray, in_text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal matches of at least `length` unmarked words: starts in item and in text, and lengths.

    Of equal windows only those are paired whose words before differ (or are marked
    or none): the others lie inside a longer match. So a phrase that both sides
    repeat makes pairs where the repetition begins, not for each of its words.
    """
    here, there = _open_windows(in_item, length), _open_windows(in_text, length)
    none = np.zeros(0, np.int64)
    if not len(here) or not len(there):
        return none, none, none
    windows, which = np.unique(_windows(item, length)[here], return_inverse=True)
    theirs = _windows(text, length)[there]
    at = np.minimum(np.searchsorted(windows, theirs), len(windows) - 1)
    hit = windows[at] == theirs
    there, at = there[hit], at[hit]
    # The word before, as a number; what can't be equal has a number of its own on either side.
    words, own = np.unique(item, return_inverse=True)
    place = np.minimum(np.searchsorted(words, text), len(words) - 1)
    k = len(words) + 2
    before_here = np.where((here > 0) & ~in_item[here - 1], own[here - 1], k - 2)
    before_there = np.where((there > 0) & ~in_text[there - 1] & (words[place[there - 1]] == text[there - 1]), place[there - 1], k - 1)
    keys = which * k + before_here
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    low, high = np.searchsorted(keys, at * k), np.searchsorted(keys, (at + 1) * k)
    same_low, same_high = np.searchsorted(keys, at * k + before_there), np.searchsorted(keys, at * k + before_there, "right")
    i = here[order[np.concatenate([_pick(low, same_low - low), _pick(same_high, high - same_high)])]]
    j = np.concatenate([np.repeat(there, same_low - low), np.repeat(there, high - same_high)])
    # How far they go: in steps of `length`, then of halves.
    n, marks_i, marks_j = np.full(len(i), length), np.concatenate([[0], np.cumsum(in_item)]), np.concatenate([[0], np.cumsum(in_text)])
    size = length
    while size:
        ours, theirs, live = _windows(item, size), _windows(text, size), np.arange(len(i))
        while len(live):
            a, b = i[live] + n[live], j[live] + n[live]
            ok = (a + size <= len(item)) & (b + size <= len(text))
            live, a, b = live[ok], a[ok], b[ok]
            ok = (ours[a] == theirs[b]) & (marks_i[a + size] == marks_i[a]) & (marks_j[b + size] == marks_j[b])
            live = live[ok]
            n[live] += size
        size //= 2
    return i, j, n


def tile(item: np.ndarray, text: np.ndarray, min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles of two word sequences: (start in item, start in text, length), longest first."""
    in_item, in_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles, length = [], max(min_tile, min(_FIRST_LENGTH, len(item), len(text)))
    while True:
        found_i, found_j, found_n = _matches(item, text, in_item, in_text, length)
        longest = int(found_n.max()) if len(found_n) else 0
        if longest > 2 * length:
            length = longest
            continue
        heap = list(zip((-found_n).tolist(), found_i.tolist(), found_j.tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            taken = in_item[i : i - n] | in_text[j : j - n]
            if not taken.any():
                in_item[i : i - n] = in_text[j : j - n] = True
                tiles.append((i, j, -n))
                continue
            # What longer tiles left of it is a match itself; parts under this length are found again in a later round.
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= length:
                    heapq.heappush(heap, (a - b, i + a, j + a))
        if length == min_tile:
            return tiles
        length = max(min_tile, length // 2)


class Items:
    """A block of benchmark items: word hashes, and their seeds in order."""

    def __init__(self, ids: list, texts: list[str], min_tile: int = MIN_TILE):
        self.min_tile = min_tile
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        words, at = _words(data, offsets)
        self.ids, self.words = ids, [words[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        seeds = [_windows(w, min_tile) for w in self.words]
        item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        where = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.where = seed[order], item[order], where[order]

    def cover(self, words: np.ndarray, seeds: np.ndarray, least: float) -> tuple[float, object]:
        """The best coverage of any item by a text, if above `least`, and the item's id; else (least, None).

        Tiles lie under shared seeds, so what these cover bounds an item's coverage: items are tiled from the largest bound on.
        """
        at = np.minimum(np.searchsorted(self.seed, seeds), len(self.seed) - 1)
        shared = np.unique(seeds[self.seed[at] == seeds])
        low, high = np.searchsorted(self.seed, shared, "left"), np.searchsorted(self.seed, shared, "right")
        hits = _pick(low, high - low)
        hits = hits[np.argsort(self.item[hits], kind="stable")]
        found, first = np.unique(self.item[hits], return_index=True)
        bounds = []
        for i, begins in zip(found.tolist(), np.split(self.where[hits], first[1:]), strict=False):
            n = len(self.words[i])
            edges = np.bincount(begins, minlength=n + 1)
            ends = np.bincount(begins + self.min_tile, minlength=n + 1)
            bounds.append((-float((np.cumsum(edges - ends)[:n] > 0).sum()) / n, i))
        best = (least, None)
        for bound, i in sorted(bounds):
            if -bound <= best[0]:
                break
            share = sum(t[2] for t in tile(self.words[i], words, self.min_tile)) / len(self.words[i])
            if share > best[0]:
                best = (share, self.ids[i])
        return best

    def scan(self, words: np.ndarray, seeds: np.ndarray, at: np.ndarray, best: list[tuple[float, object]]) -> None:
        """Better each document's best coverage; `at` are the documents' bounds in words."""
        if not len(self.seed) or not len(seeds):
            return
        pos = np.minimum(np.searchsorted(self.seed, seeds), len(self.seed) - 1)
        hits = np.concatenate([[0], np.cumsum(self.seed[pos] == seeds)])
        first = np.minimum(at[:-1], len(seeds))
        last = np.clip(at[1:] - self.min_tile + 1, first, len(seeds))
        for d in np.flatnonzero(hits[last] > hits[first]).tolist():
            share, item = self.cover(words[at[d] : at[d + 1]], seeds[first[d] : last[d]], best[d][0])
            if item is not None:
                best[d] = (share, item)


#: Bytes of text whose words are kept while all blocks pass, if there are several.
_AT_A_TIME = 4 << 20
_loaded: dict[str, Items] = {}


def load_block(path: str) -> Items:
    """A block of items; the worker keeps the last one."""
    if path not in _loaded:
        _loaded.clear()
        fs, where = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_stream(where) as f:
            _loaded[path] = pickle.loads(f.read())
    return _loaded[path]


def write_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> list[str]:
    """Blocks of items of about so many words, each a file in the shared folder that one task made; their paths."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    words = items.agg(F.sum(F.octet_length("t") / 4 + 1)).first()[0] or 0
    folder = new_path(benchmark.sparkSession, "benchmark")

    def write(batches):
        ids, texts = [], []
        for batch in batches:  # a block's worth
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        if ids:
            fs, base = pyarrow.fs.FileSystem.from_uri(folder)
            fs.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            with fs.open_output_stream(posixpath.join(base, name)) as f:
                f.write(pickle.dumps(Items(ids, texts)))
            yield pa.RecordBatch.from_pydict({"least": pa.array([ids[0]], pa.int64()), "path": pa.array([f"{folder}/{name}"], pa.string())})

    dealt = items.repartitionByRange(max(1, -(-int(words) // block_words)), F.col("i").asc_nulls_first(), "t").sortWithinPartitions(F.col("i").asc_nulls_first(), "t")
    return [r.path for r in sorted(dealt.mapInArrow(write, "least long, path string").collect(), key=lambda r: (r.least is not None, r.least))]  # a row a block


def _matcher(paths: list[str], least: float):
    """A column function: text to the best coverage above `least` and the item, or (0, null). All blocks pass over a part of the texts, one at a time."""

    @F.arrow_udf("struct<coverage: double, item_id: long>")
    def match(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        best: list[tuple[float, object]] = []
        for lo, hi, part, bounds in slices(data, offsets, _AT_A_TIME if len(paths) > 1 else SLICE):
            words, at = _words(part, bounds)
            seeds, own = _windows(words, MIN_TILE), [(least, None)] * (hi - lo)
            for path in paths:
                load_block(path).scan(words, seeds, at, own)
            best += own
        return pa.array([{"coverage": c if i is not None else 0.0, "item_id": i} for c, i in best], pa.struct([("coverage", pa.float64()), ("item_id", pa.int64())]))

    return match


def find_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, coverage (of the best covered item, 0 if none shares a seed), item_id, contaminated of every document."""
    small_batches(docs.sparkSession)
    match = _matcher(write_blocks(benchmark, block_words=block_words), 0.0)
    found = docs.select(F.col(id_col), match(F.col(text_col)).alias("found"))
    return found.select(id_col, "found.coverage", "found.item_id", (F.col("found.coverage") >= threshold).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Documents that no item contaminates, all columns as they were."""
    small_batches(docs.sparkSession)
    match = _matcher(write_blocks(benchmark), float(np.nextafter(threshold, 0)))
    return docs.where(match(F.col(text_col))["coverage"] < threshold)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
