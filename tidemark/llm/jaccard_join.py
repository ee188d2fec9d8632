"""N-gram Jaccard join by prefix trees.

A document's set is its distinct shingles of k words (lower-cased A-Z, split at
ASCII white space), as 64-bit hashes. Two documents link when the sets' Jaccard
similarity reaches the threshold, a fraction of whole numbers; the comparison
is exact on the sets. Result: one row per document with its set's size, its
class (the smallest id with the same set) and its component over all links.

1. A scan sends all shingles, packed, to where equal ones meet, and gets back for
   each document how many of its shingles another document has. A document with
   fewer than t*n of them can't link; the others' texts, one of each class of
   equal sets, go on. A shingle that several documents of a scan's slice share
   is sent once, so one in a third of all documents costs an entry a slice.
2. Those texts' shingles are counted in a sketch of 2**SKETCH_BITS counters, and
   (count, hash) is the global order, rare shingles first; the sketch decides
   nothing else. Linked sets share a shingle of both prefixes, the rarest
   n - ceil(t*n) + 1 shingles.
3. Classes that share a prefix shingle, and whose sizes and shared shingles allow
   a link, are joined to the smallest of them, and those edges' components are the
   candidate groups: no link leaves a group.
4. Each group's sets are stored in a prefix tree in the global order, from its
   frequent end, so near copies share branches. Every set walks the tree with the
   partial overlap so far and leaves a branch as soon as the shingles that remain
   on both sides can't reach the overlap needed, or all sets below are in its
   component.
5. Groups above GROUP_SHINGLES are split: the smallest member is the pivot and
   walks trees of all others. 1 - similarity is a metric, so members that link to
   the pivot needn't be compared with each other; only the others are, in blocks,
   with blocks of the members whose distance to the pivot allows a link.

Nothing is capped: hot groups take more tasks. Defined results: null and empty
texts and texts of white space have size 0 and link with nothing; with fewer
than k words the whole sequence is the one shingle; repeated rows are returned
as often as they come, rows of one id count as one node; a null id links with
nothing and has itself, null, as component; empty tables give empty results.
Only the id and text columns are read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytescan import LOWER, WORDS, Hasher, mix, shingles, slices, tokens, utf8
from tidemark.llm.components import connected_components
from tidemark.llm.shared import WRITING, materialize, settings, trimmed

SKETCH_BITS, SKETCH_BLOCKS = 21, 64
#: Shingles of a group that one task takes on at once; about 60 MB with its tree.
GROUP_SHINGLES = 2_000_000
#: Bits of the map of candidates that thins the scan for their texts; fixed, so it may be broadcast.
FILTER_BITS = 23
#: Bytes of text whose shingles meet at once, and partitions they are dealt to at most; a partition takes its share one after another.
MEET, MEETINGS = 16 << 20, 1 << 14
#: Documents of a scan's slice at most.
_SLICE_DOCS = 0xFFFF


# ---- sets -----------------------------------------------------------------------------------------------------------


def sets_of(texts: pa.Array, k: int):
    """The sorted distinct shingles of each text, in order."""
    data, offsets = utf8(texts)
    for _, _, part, bounds in slices(data, offsets):
        low = LOWER[part]
        starts, ends, at = tokens(low, bounds, WORDS)
        words = Hasher(low).spans(starts, ends)
        at = at.tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(shingles(words[a:b], k))


def needed(n: int, m: int, num: int, den: int) -> int:
    """The least overlap of sets of sizes n and m at which den * overlap >= num * union."""
    return -(-num * (n + m) // (num + den))


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def count_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """The sketch: how many documents have a shingle in each of 2**SKETCH_BITS classes."""

    @trimmed
    def scan(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            held, size = [], 0
            for s in sets_of(batch.column(1), k):
                held.append(_slots(s))
                size += len(s)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
            if size:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
        for i, part in enumerate(np.split(counts, SKETCH_BLOCKS)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": pa.array([part.astype("<i8").tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw.as_buffer(), "<i8")
        for i, part in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": pa.array([np.minimum(part, 2**31 - 1).astype("<i4").tobytes()], pa.binary())})

    schema = "block int, counts binary"
    # 2**SKETCH_BITS counters of 4 bytes in all, whatever the input.
    with settings(docs.sparkSession, WRITING):
        parts = {r.block: np.frombuffer(r.counts, "<i4") for r in docs.mapInArrow(scan, schema).repartition(SKETCH_BLOCKS, "block").mapInArrow(add, schema).collect()}
    return np.concatenate([parts[i] for i in range(SKETCH_BLOCKS)]) if parts else np.zeros(1 << SKETCH_BITS, np.int32)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """id, uid, n, d1, d2 (the set's digest) of each document (id, uid, text)."""

    @trimmed
    def scan(batches):
        for batch in batches:
            n, d1, d2 = [], [], []
            for s in sets_of(batch.column(2), k):
                n.append(len(s))
                d1.append(int(s.sum(dtype=np.uint64)) + len(s) & (1 << 64) - 1)
                d2.append(int(mix(s.copy()).sum(dtype=np.uint64)))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), signed(d1), signed(d2)], names=["id", "uid", "n", "d1", "d2"])

    return docs.select("id", "uid", "text").mapInArrow(scan, "id long, uid long, n long, d1 long, d2 long")


def count_shared(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(uid, shared): how many shingles of a document (uid, text) occur in another."""
    parts = min(buckets, MEETINGS)

    @trimmed
    def scan(batches):
        held, own, size = [], [], 0

        def told():
            return pack(np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]), np.array(own, np.int64))

        for batch in batches:
            for uid, s in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), k), strict=True):
                if len(s):
                    held.append(s)
                    own.append(uid)
                    size += len(s)
                if size > 1 << 19 or len(held) == _SLICE_DOCS:
                    yield told()
                    held, own, size = [], [], 0
        if held:
            yield told()

    def pack(s: np.ndarray, doc: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        """For each bucket: keys, those known to be shared first, then each document's; the documents that have some; and how many."""
        sig = (((s >> np.uint64(34)) % np.uint64(buckets)) << np.uint64(32) | s & np.uint64(0xFFFFFFFF)).view(np.int64)
        order = np.argsort(sig, kind="stable")
        sig, doc = sig[order], doc[order]
        first = np.append(True, sig[1:] != sig[:-1])
        alone = first & np.append(first[1:], True)
        # What several documents of the slice have is shared for them, and stands once for those elsewhere.
        here, many = np.unique(doc[~alone], return_counts=True)
        out = {"bucket": [-1], "keys": [many.astype("<i8").tobytes()], "uids": [own[here].tobytes()], "sizes": [b""]}
        sig, place = sig[first], np.where(alone, doc + 1, 0)[first]
        slot = (sig >> 32) * (len(own) + 1) + place
        order = np.argsort(slot, kind="stable")
        slot, keys = slot[order], (sig[order] & 0xFFFFFFFF).astype("<u4")
        begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        sizes, ends = np.diff(np.append(begin, len(slot))), np.append(begin, len(slot))
        bucket, place = slot[begin] // (len(own) + 1), slot[begin] % (len(own) + 1)
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(bucket)).tolist(), strict=True):
            known = place[a] == 0
            out["bucket"].append(int(bucket[a]))
            out["keys"].append(keys[ends[a] : ends[b]].tobytes())
            out["uids"].append(own[place[a + known : b] - 1].tobytes())
            out["sizes"].append((sizes[a:b] if known else np.append(0, sizes[a:b])).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(out[c], pa.binary()) for c in ("keys", "uids", "sizes")]], names=list(out))

    def packed_counts(uids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Counts, packed by where each uid's are added up."""
        to = uids % parts
        order = np.argsort(to, kind="stable")
        uids, n, to = uids[order], n[order], to[order]
        edges = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)).tolist() if len(to) else [0]
        pack = lambda x, t: pa.array([x[a:b].astype(t).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(to[edges[:-1]], pa.int32()), pack(uids, "<i8"), pack(n, "<u4")], names=["to", "uids", "n"])

    @trimmed
    def meet(batches):
        # Entries are one word each, key and place in `names`; place 0 is no document.
        held: list[np.ndarray] = []
        names, at, known_names = [np.zeros(1, np.int64)], -1, 1

        def told():
            entries, at = np.empty(sum(map(len, held)), np.uint64), 0
            for i, part in enumerate(held):  # each goes as soon as it is copied
                entries[at : at + len(part)], at, held[i] = part, at + len(part), None
            held.clear()
            entries.sort()
            counts = np.zeros(known_names, np.int64)
            for i in range(0, len(entries), 1 << 18):
                # A part with its neighbours; those only tell whether the part's ends are shared.
                lo, hi = max(0, i - 1), min(len(entries), i + (1 << 18) + 1)
                same = (entries[lo + 1 : hi] ^ entries[lo : hi - 1]) < np.uint64(1 << 32)
                shared = np.append(same, False)
                shared[1:] |= same
                part = slice(i - lo, min(len(entries), i + (1 << 18)) - lo)
                counts += np.bincount((entries[lo:hi][part][shared[part]] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=known_names)
            counts[0] = 0
            some = np.flatnonzero(counts)
            return packed_counts(np.concatenate(names)[some], counts[some])

        for batch in batches:
            for bucket, keys, uids, sizes in zip(batch.column(0).to_pylist(), *[batch.column(i) for i in (1, 2, 3)], strict=True):
                keys, own = keys.as_buffer(), np.frombuffer(uids.as_buffer(), np.int64).copy()  # the copy lets the batch go
                if bucket < 0:
                    yield packed_counts(own, np.frombuffer(keys, np.int64))
                    continue
                if bucket != at and held:
                    yield told()
                    names, known_names = [np.zeros(1, np.int64)], 1
                at, sizes = bucket, np.frombuffer(sizes.as_buffer(), "<u4")
                entries = np.frombuffer(keys, "<u4").astype(np.uint64) << np.uint64(32)
                # Place 0 stands twice for a shingle that a slice knows to be shared: its documents have counted it.
                held.append(entries[: sizes[0]].copy())
                entries[sizes[0] :] |= np.repeat(np.arange(known_names, known_names + len(own), dtype=np.uint64), sizes[1:])
                held.append(entries)
                names.append(own)
                known_names += len(own)
        if held:
            yield told()

    @trimmed
    def add(batches):
        uids, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:  # compacted batch by batch, so only a partition's documents are held
            more = [np.frombuffer(b"".join(batch.column(i).to_pylist()), t) for i, t in ((1, "<i8"), (2, "<u4"))]
            uids, which = np.unique(np.append(uids, more[0]), return_inverse=True)
            n = np.bincount(which, weights=np.append(n, more[1]), minlength=len(uids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(n)], names=["uid", "shared"])

    packed = docs.select("uid", "text").mapInArrow(scan, "bucket int, keys binary, uids binary, sizes binary")
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("uids"), F.lit(parts))).otherwise(F.col("bucket") % parts).cast("int")
    dealt = packed.repartitionById(parts, spread)
    if buckets > parts:
        dealt = dealt.sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "to int, uids binary, n binary").repartitionById(parts, F.col("to")).mapInArrow(add, "uid long, shared long")


def prefixes_of(docs: DataFrame, k: int, num: int, den: int, sketch) -> DataFrame:
    """(token, size_class, rep, small): rows for each prefix shingle of each document (id, text, m).

    Of two linked documents the smaller has at most m shingles in common with the
    larger, so the larger's size is bounded. A document stands in its own size
    class as a larger one, and as a smaller one (`small`) in all classes that the
    sizes of its possible partners are in.
    """

    @trimmed
    def scan(batches):
        for batch in batches:
            counts, ids, shared, out, n = sketch.value, batch.column(0).to_numpy(), batch.column(2).to_numpy(), [], []
            for s in sets_of(batch.column(1), k):
                size = prefix_size(len(s), num, den)
                # (count, hash) in order: s ascends, so a stable sort by count will do.
                out.append(s[np.argsort(counts[_slots(s)], kind="stable")[:size]] if len(s) else s)
                n.append(len(s))
            n = np.array(n)
            most = (num + den) * np.minimum(shared, n) // num - n  # the largest partner
            class_of = lambda x: np.floor(np.log(np.maximum(x, 1)) / np.log(den / num) if num < den else x).astype(np.int32)
            own, last, sizes = class_of(n), class_of(most), np.array([len(o) for o in out])
            tokens_, reps = np.concatenate(out).view(np.int64), np.repeat(ids, sizes)
            classes, small = np.repeat(own, sizes), np.repeat(most >= n, sizes)
            further = np.repeat(np.maximum(0, last - own), sizes)
            again = np.repeat(np.arange(len(reps)), further)
            step = np.arange(len(again)) - np.repeat(np.cumsum(further) - further, further) + 1
            columns = [np.append(tokens_, tokens_[again]), np.append(classes, classes[again] + step).astype(np.int32), np.append(reps, reps[again]), np.append(small, np.ones(len(again), bool))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["token", "size_class", "rep", "small"])

    return docs.select("id", "text", "m").mapInArrow(scan, "token long, size_class int, rep long, small boolean")


def thinned(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df that may be in keys, by a bit map of fixed size: it spares the join after it most rows, or at worst none."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    words = keys.select(slot(F.col(key)).alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 AS INT)))").alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for batch in words.toLocalIterator():  # at most 2**FILTER_BITS bits
        table[batch.w] = batch.bits
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def may(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return df.where(may(slot(F.col(key))))


#: Branches with so few shingles left, or at such a depth, are not divided further.
SMALL, DEEP = 16_384, 20
#: Shingles of a run that are looked at before the bounds are asked again; later pieces double.
PIECE = 32


# ---- prefix trees ---------------------------------------------------------------------------------------------------


class PrefixTree:
    """Sets of a group, each a path from the root in the global order, frequent shingles first; common beginnings are stored once.

    Nodes hold runs of shingles: node i is part `low[i]:high[i]` of the sequence
    of set `first[i]`, and below it are the sets first[i] to last[i] - 1, in the
    order of their paths. Shingles that only one set has can't be met, so paths
    leave them out; sizes count them. Without a sketch the group's own counts make
    the order.
    """

    def __init__(self, sets: list[np.ndarray], sketch: np.ndarray | None = None):
        everything, counts = np.unique(np.concatenate(sets), return_counts=True)
        everything, counts = everything[counts > 1], counts[counts > 1]
        counts = counts if sketch is None else sketch[_slots(everything)]
        rank = np.empty(len(everything), np.int32)
        rank[np.lexsort((everything, counts))[::-1]] = np.arange(len(everything), dtype=np.int32)
        paths = [np.sort(rank[np.searchsorted(everything, s[np.isin(s, everything, assume_unique=True)])]) for s in sets]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">i4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes, self.lengths = np.array([len(sets[i]) for i in self.order]), np.array([len(p) for p in self.paths])
        self.vocabulary = len(everything)
        self._build()

    def _build(self) -> None:
        n = len(self.paths)
        common = [0] * (n + 1)  # with the path before
        for i in range(1, n):
            a, b = self.paths[i - 1], self.paths[i]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            common[i] = int(differ.argmax()) if differ.any() else m
        self.common = common
        self.low, self.high, self.first, self.last, self.children = [], [], [], [], []
        stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]  # (depth where the branch ends, first set, nodes below)
        roots: list[int] = []

        def node(low: int, high: int, first: int, last: int, below: list[int]) -> int:
            self.low.append(low), self.high.append(high), self.first.append(first), self.last.append(last), self.children.append(below)
            return len(self.low) - 1

        # Branch points along the rightmost path; what ends before the next common depth is closed.
        for i in range(n):
            stack.append((len(self.paths[i]), i, []))
            depth = common[i + 1] if i + 1 < n else 0
            while len(stack) > 1 and stack[-1][0] > depth:
                high, first, below = stack.pop()
                low = max(depth, stack[-1][0])
                made = node(low, high, first, i + 1, below)
                if stack[-1][0] < depth:
                    stack.append((depth, first, [made]))
                else:
                    stack[-1][2].append(made)
            # A path that is a whole beginning of the next stays open as a leaf of length 0.
        for high, first, below in stack[:0:-1]:
            roots.append(node(0, high, first, n, below))
        roots += stack[0][2]
        # Small or deep branches burst: below such a node, each set is a leaf with the rest of its path.
        # Elsewhere a set that ends where others go on is a leaf with an empty run.
        sums = np.concatenate([[0], np.cumsum(self.lengths)]).tolist()
        level, depth = list(roots), 0
        while level:
            below_all: list[int] = []
            for x in level:
                first, last, high = self.first[x], self.last[x], self.high[x]
                if not self.children[x]:
                    continue
                if depth >= DEEP or sums[last] - sums[first] - (last - first) * high <= SMALL:
                    self.children[x] = [node(high, len(self.paths[i]), i, i + 1, []) for i in range(first, last)]
                    continue
                if len(self.paths[first]) == high:
                    self.children[x].insert(0, node(high, high, first, first + 1, []))
                below_all += self.children[x]
            level, depth = below_all, depth + 1
        self.roots = np.array(sorted(roots), np.int64)
        runs = [self.paths[f][lo:hi] for f, lo, hi in zip(self.first, self.low, self.high, strict=True)]
        self.run_at = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        self.runs = np.concatenate(runs)
        self.child_at = np.concatenate([[0], np.cumsum([len(c) for c in self.children])])
        self.child = np.array([x for c in self.children for x in c], np.int64)
        self.low, self.first, self.last = np.array(self.low), np.array(self.first), np.array(self.last)
        self.leaf = np.diff(self.child_at) == 0
        self.shortest = np.array([self.sizes[a:b].min() for a, b in zip(self.first, self.last, strict=True)])
        self.longest = np.array([self.lengths[a:b].max() for a, b in zip(self.first, self.last, strict=True)])

    def walk(self, walkers: np.ndarray, num: int, den: int, stay=None):
        """Pairs (walker, set, overlap) of positions that reach the threshold, as arrays, level by level.

        All walkers go down all branches of a level at once, each with the overlap
        so far; of a long run a piece at a time. Branches are left as soon as the
        shingles that remain on both sides can't make up the overlap needed, and
        those that `stay(walkers, nodes)` doesn't keep.
        """
        paths, n_walkers = [self.paths[p] for p in walkers], len(walkers)
        seen = np.zeros((n_walkers, self.vocabulary + 1), bool)
        for i, path in enumerate(paths):
            seen[i, path] = True
        # Positions in all walkers' paths, one after another, tell how much of a path lies beyond a shingle.
        along, begin = np.concatenate([path + i * self.vocabulary for i, path in enumerate(paths)]), np.cumsum([0, *map(len, paths)])
        who, at = np.repeat(np.arange(n_walkers), len(self.roots)), np.tile(self.roots, n_walkers)
        done, overlap, mine = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), self.lengths[walkers][who]
        least = lambda n, m: -((-num * (n + m)) // (num + den))
        while True:
            go = overlap + np.minimum(mine, self.longest[at] - self.low[at] - done) >= least(self.sizes[walkers[who]], self.shortest[at])
            if stay is not None:
                go[go] = stay(walkers[who[go]], at[go])
            who, at, done, overlap, mine = who[go], at[go], done[go], overlap[go], mine[go]
            if not len(at):
                return
            start, size = self.run_at[at] + done, self.run_at[at + 1] - self.run_at[at]
            piece = np.minimum(size - done, np.maximum(PIECE, done))
            ends = np.cumsum(piece)
            sums = np.concatenate([[0], np.cumsum(seen[np.repeat(who, piece), self.runs[_pick(start, piece)]], dtype=np.int32)])
            overlap = overlap + sums[ends] - sums[ends - piece]
            some = piece > 0
            mine[some] = begin[who[some] + 1] - np.searchsorted(along, who[some] * self.vocabulary + self.runs[start[some] + piece[some] - 1], "right")
            done = done + piece
            over, leaf = done == size, self.leaf[at]
            if (at_end := np.flatnonzero(over & leaf)).size:
                other = self.first[at[at_end]]
                reached = overlap[at_end] >= least(self.sizes[walkers[who[at_end]]], self.sizes[other])
                if reached.any():
                    yield walkers[who[at_end]][reached], other[reached], overlap[at_end][reached]
            # On along the run, or to the branches below it.
            more, below = np.flatnonzero(~over), np.flatnonzero(over & ~leaf)
            count = self.child_at[at[below] + 1] - self.child_at[at[below]]
            children, below = self.child[_pick(self.child_at[at[below]], count)], np.repeat(below, count)
            again = np.concatenate([more, below])
            at = np.concatenate([at[more], children])
            who, overlap, mine, done = who[again], overlap[again], mine[again], np.concatenate([done[more], np.zeros(len(below), np.int64)])

    def link(self, num: int, den: int, probes=None) -> list[tuple[int, int]]:
        """Links, as positions in the list of sets, enough to connect all that are linked.

        Leaves that stand next to each other share the longest partial overlaps and
        are compared first. Then the sets walk the tree, some at a time, and leave
        branches whose sets all are in the walker's component. With probes, only
        those sets walk, and meet all others.
        """
        n_sets, found = len(self.paths), []
        up = list(range(n_sets))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def join(p: int, q: int) -> bool:
            a, b = top(p), top(q)
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append((self.order[p], self.order[q]))
            return a != b

        walks = np.ones(n_sets, bool) if probes is None else np.array([probes[i] for i in self.order], bool)
        for p in range(1, n_sets):
            if walks[p] or walks[p - 1]:
                c, a, b, need = self.common[p], self.paths[p - 1], self.paths[p], needed(int(self.sizes[p - 1]), int(self.sizes[p]), num, den)
                if min(len(a), len(b)) >= need and c + len(np.intersect1d(a[c:], b[c:], assume_unique=True)) >= need:
                    join(p, p - 1)
        state: list[np.ndarray] = []

        def refresh() -> None:
            label = np.array(up)
            while (label[label] != label).any():
                label = label[label]
            state[:] = [label, np.cumsum(np.append(0, label[1:] != label[:-1]))]

        def stay(walkers: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            label, changes = state
            first = self.first[nodes]
            keep = ~((changes[self.last[nodes] - 1] == changes[first]) & (label[first] == label[walkers]))
            # Later sets walk later, and meet this one then.
            return keep & (first < walkers) if probes is None else keep

        refresh()
        walkers, at_once = np.flatnonzero(walks), max(1, min(64, (1 << 24) // max(1, self.vocabulary)))
        for i in range(0, len(walkers), at_once):
            for ours, theirs, _ in self.walk(walkers[i : i + at_once], num, den, stay):
                if any([join(p, q) for p, q in zip(ours.tolist(), theirs.tolist(), strict=True)]):
                    refresh()
        return found


def _pick(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at `at`, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)


def link_sets(ids: list[int], sets: list[np.ndarray], num: int, den: int, sketch: np.ndarray | None = None, probes=None) -> list[tuple[int, int]]:
    """Links between ids, enough to connect all that are linked; with probes, those that a probe has."""
    if len(sets) < 2:
        return []
    return [(ids[a], ids[b]) for a, b in PrefixTree(sets, sketch).link(num, den, probes)]


# ---- on Spark -------------------------------------------------------------------------------------------------------


def with_sets(members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """members with `s`, the packed set of each rep; texts are (id, text)."""
    return members.join(texts.select("id", "text"), F.col("rep") == F.col("id")).select(*members.columns, "text").transform(lambda df: _map_text(df, k))


def _map_text(df: DataFrame, k: int) -> DataFrame:
    """Replace the last column, a text, by its packed set `s`."""
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes[:-1]) + ", s binary"

    def scan(batches):
        for batch in batches:
            packed = pa.array([s.tobytes() for s in sets_of(batch.column(batch.num_columns - 1), k)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=[*batch.schema.names[:-1], "s"])

    return df.mapInArrow(scan, schema)


def _groups(batches, names: list[str]):
    """Runs of rows with equal key columns (all but the last two: rep and s), over batch borders; one run in memory at a time."""
    key, ids, sets = None, [], []
    for batch in batches:
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(names))], strict=True))
        for own, rep, s in zip(keys, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1), strict=True):
            if own != key and ids:
                yield key, ids, sets
                ids, sets = [], []
            key = own
            ids.append(rep)
            sets.append(np.frombuffer(s.as_buffer(), np.uint64).copy())
    if ids:
        yield key, ids, sets


def _edges(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["src", "dst"])


def links_within(grouped: DataFrame, num: int, den: int, sketch) -> DataFrame:
    """(src, dst) links of small groups: rows (comp, rep, s); sketch is broadcast."""

    @trimmed
    def run(batches):
        for _, ids, sets in _groups(batches, ["comp"]):
            if pairs := link_sets(ids, sets, num, den, sketch.value):
                yield _edges(pairs)

    return grouped.select("comp", "rep", "s").repartition("comp").sortWithinPartitions("comp").mapInArrow(run, "src long, dst long")


def reach_of(sets: list[np.ndarray], pivot: np.ndarray, num: int, den: int, sketch=None) -> np.ndarray:
    """Of each set, by the pivot's walk of their tree: 0 links to the pivot; 1 may link to such; 2 is farther than that."""
    tree = PrefixTree([*sets, pivot], sketch)
    where, close = np.empty(len(tree.order), np.int64), max(0, 2 * num - den)
    where[tree.order] = np.arange(len(tree.order))
    reach = np.full(len(sets) + 1, 2 if close else 1)
    me = int(where[-1])
    for _, other, overlap in tree.walk(np.array([me]), max(1, close), den):
        union = tree.sizes[me] + tree.sizes[other] - overlap
        reach[np.array(tree.order)[other]] = np.where(den * overlap >= num * union, 0, 1)
    return reach[:-1]


def links_of_hot(members: DataFrame, num: int, den: int, limit: int, sketch) -> DataFrame:
    """(src, dst) links of groups that are too large for a task: rows (comp, rep, n, total, s)."""
    members = materialize(members, "jaccard-candidates")
    pivots = members.groupBy("comp").agg(F.min(F.struct("rep", "s")).alias("p")).select(F.col("comp").alias("c"), F.col("p.rep").alias("pivot"), F.col("p.s").alias("ps"))
    paired = members.join(pivots, F.col("comp") == F.col("c")).select("comp", "rep", "n", "s", "total", "pivot", "ps")

    @trimmed
    def near(batches):
        for batch in batches:
            comps, reach = np.array(batch.column(0).to_pylist()), np.empty(batch.num_rows, np.int32)
            set_at = lambda column, i: np.frombuffer(batch.column(column)[i].as_buffer(), np.uint64)
            for c in np.unique(comps):
                mine = np.flatnonzero(comps == c).tolist()
                reach[mine] = reach_of([set_at(3, i) for i in mine], set_at(6, mine[0]), num, den, sketch.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(6)], pa.array(reach)], names=["comp", "rep", "n", "s", "total", "pivot", "reach"])

    placed = materialize(paired.mapInArrow(near, "comp long, rep long, n long, s binary, total long, pivot long, reach int"), "jaccard-hot")
    linked = placed.where("reach = 0 and rep != pivot").select(F.col("pivot").alias("src"), F.col("rep").alias("dst"))
    # Blocks hold half of what a task takes; a probe block meets every block that may have links with it.
    blocks = F.ceil(F.col("total") * 2 / F.lit(limit)).cast("long")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("blocks", blocks)
    probing = placed.where("reach > 0").groupBy("comp", "block").agg(F.max((F.col("reach") == 1).cast("int")).alias("close")).select(F.col("comp").alias("pc"), F.col("block").alias("pb"), "close")
    asks = placed.where("reach > 0").select("comp", "rep", "s", F.col("block").alias("pb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("tb"), F.lit(True).alias("probe"))
    told = placed.join(probing, (F.col("comp") == F.col("pc")) & ((F.col("reach") > 0) | (F.col("close") == 1)))
    told = told.where("reach = 0 or block != pb").select("comp", "rep", "s", "pb", F.col("block").alias("tb"), F.lit(False).alias("probe"))
    tasks = asks.unionByName(told).select("comp", "pb", "tb", F.struct("rep", "probe").alias("rep"), "s").repartition("comp", "pb", "tb").sortWithinPartitions("comp", "pb", "tb")

    @trimmed
    def run(batches):
        for _, ids, sets in _groups(batches, ["comp", "pb", "tb"]):
            probes = [i["probe"] for i in ids]
            if any(probes) and (pairs := link_sets([i["rep"] for i in ids], sets, num, den, sketch.value, probes)):
                yield _edges(pairs)

    return linked.unionByName(tasks.mapInArrow(run, "src long, dst long"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("uid", F.xxhash64("id", "text"))
    table = materialize(describe(docs, k), "jaccard-sets")
    classes = table.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "uid")).alias("m")).select("d1", "d2", "n", F.col("m.id").alias("rep"), F.col("m.uid").alias("uid"))
    classes = materialize(classes, "jaccard-classes")

    # What can link at all.
    total = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    counts = count_shared(docs.where("id is not null"), k, max(1, -(-total // MEET)))
    able = classes.join(counts, "uid").where(F.col("shared") * den >= F.col("n") * num).select("rep", "uid", "n", F.col("shared").alias("m"))
    able = materialize(able, "jaccard-able")
    few = thinned(docs, able, "uid").join(able.select(F.col("uid").alias("u"), F.col("rep").alias("r"), "m"), (F.col("uid") == F.col("u")) & (F.col("id") == F.col("r")))
    texts = materialize(few.select("id", "uid", "text", "m").dropDuplicates(["uid", "id"]).select("id", "text", "m"), "jaccard-texts")

    # Candidate groups.
    sketch = spark.sparkContext.broadcast(count_shingles(texts, k))
    prefixes = prefixes_of(texts, k, num, den, sketch)
    hubs = prefixes.groupBy("token", "size_class").agg(F.min(F.when(F.col("small"), F.col("rep"))).alias("hub"), F.min("rep").alias("least"), F.max("rep").alias("most")).where("hub is not null and least < most")
    hubs = hubs.select(F.col("token").alias("t"), F.col("size_class").alias("c"), "hub")
    stars = prefixes.join(hubs, (F.col("token") == F.col("t")) & (F.col("size_class") == F.col("c"))).where("rep != hub").select(F.col("hub").alias("src"), F.col("rep").alias("dst"))
    groups = connected_components(stars).withColumnRenamed("component", "comp")
    members = materialize(groups.join(able.groupBy("rep").agg(F.sum("n").alias("n")), F.col("node") == F.col("rep")).select("comp", "rep", "n"), "jaccard-members")

    # Their links.
    totals = members.groupBy("comp").agg(F.sum("n").alias("total")).withColumnRenamed("comp", "tc")
    hot = totals.where(F.col("total") > group_shingles)
    if hot.isEmpty():
        links = links_within(with_sets(members, texts, k), num, den, sketch)
    else:
        placed = materialize(members.join(totals, F.col("comp") == F.col("tc")).drop("tc"), "jaccard-placed")
        links = links_within(with_sets(placed.where(F.col("total") <= group_shingles), texts, k), num, den, sketch).unionByName(links_of_hot(with_sets(placed.where(F.col("total") > group_shingles), texts, k), num, den, group_shingles, sketch))
    found = connected_components(links)

    # Every document, by class and component.
    named = classes.select("d1", "d2", "n", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("m"), "rep", F.coalesce("component", "rep").alias("component"))
    out = table.select("id", "n", "d1", "d2").join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("m")) & F.col("id").isNotNull() & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that have the smallest id of their component, all columns as they were."""
    found = jaccard_components(docs, k, num, den, id_col, text_col)
    gone = materialize(found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct(), "jaccard-gone")
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "class_id")


__all__ = ["PrefixTree", "jaccard_components", "keep_one_of_each", "op7_jaccard_join"]
