"""Removal of long repeats with a run-length compressed index.

A byte goes if a LENGTH-byte string covers it that also starts in a document
with a smaller id. Any two occurrences of such a string have the same smallest
hash of its GRAM-byte grams; so windows are dealt by that hash, and only windows
whose hash two documents share are looked at further:

1. Equal texts are one, held by the smallest id; a copy of LENGTH bytes or more
   goes whole. Only digests are moved for that.
2. A scan cuts each text into segments, runs of windows with one smallest hash,
   and sends the hashes, packed, to where they are compared. A hash that several
   documents of a scan's slice share is known to be shared and sent once, so a
   passage in a third of all documents costs an entry a slice.
3. Texts write the segments whose hash is shared, by place and digest; of equal
   ones in a slice only the first with its bytes. A hash with one distinct segment
   has nothing to compare: its smallest id has all of its windows.
4. Bytes of the others' distinct segments are moved, once each. Where they meet,
   they are concatenated, and a Burrows-Wheeler transform is built over them,
   run-length compressed, with the suffix array sampled at run ends. Segments are
   streamed through it from right to left; where the matching statistic reaches
   LENGTH, the match's rows are known, and with them the smallest id that has the
   string. The segment of a hash's smallest id needn't be streamed.
5. Marked windows go back to their documents.

Hashes that gather more than HOT bytes of distinct segments are compared window
by window in the engine instead, which needs no memory per hash.

Defined results: null text is empty; texts under LENGTH bytes lose nothing; rows
of one id count as one document, so they don't remove each other's bytes unless
their texts are equal to an earlier document's; rows with null id lose nothing
and remove nothing; an empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytescan import Hasher, slices, utf8
from tidemark.llm.shared import blob_partitions, discard, materialize, trimmed

LENGTH, GRAM = 50, 20
#: Bytes of distinct segments after which an index is full, and beyond which a hash's are too many for one.
BIN, HOT = 1 << 17, 1 << 20
#: Bytes of text whose hashes meet at once, and partitions they are dealt to at most; a partition takes its share one after another.
MEET, MEETINGS = 32 << 20, 1 << 14
#: Bytes of text whose hashes are sent together.
MESSAGE = 2 << 20
_KNOWN = 0xFFFF


# ---- segments -------------------------------------------------------------------------------------------------------


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, document, start, end) of all runs of windows with one smallest gram hash; start and end are positions in data."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, np.uint64), none, none, none
    low = Hasher(data).grams(gram)
    done = 1
    while done < width:  # minimum over `done` grams, doubled up to the width
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    # low[i] is the smallest of the window that starts at i; windows that cross documents are no windows.
    size = np.diff(offsets)
    inside = np.zeros(n + 1, np.int32)
    whole = size >= length
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - length + 1, -1)
    valid = np.cumsum(inside[: len(low)]) > 0
    cut = np.ones(len(low) + 1, bool)
    cut[1:-1] = (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])
    cut[offsets[offsets < len(low)]] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    good = valid[starts]
    starts, ends = starts[good], ends[good]
    return low[starts], np.searchsorted(offsets, starts, "right") - 1, starts, ends - 1 + length


def segments_of(data: np.ndarray, offsets: np.ndarray):
    """The segments of a slice, found in parts that stay in the processor's cache."""
    parts = []
    for lo, _, part, bounds in slices(data, offsets, 1 << 17):
        hashes, doc, starts, ends = segments(part, bounds)
        parts.append((hashes, doc + lo, starts + offsets[lo], ends + offsets[lo]))
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _signature(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 further bits of a hash. A chance agreement only makes a segment be looked at."""
    return ((hashes >> np.uint64(34)) % np.uint64(buckets) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)).view(np.int64)


def shared_hashes(texts: DataFrame, buckets: int) -> DataFrame:
    """(uid, sigs): the hashes of a text that another text also has; rows (uid, text), where copies have one uid."""
    parts = min(buckets, MEETINGS)

    def reply(uids: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        """Pairs, packed by where a uid's are gathered."""
        to = uids % parts
        order = np.argsort(to, kind="stable")
        uids, sigs, to = uids[order], sigs[order], to[order]
        edges = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)).tolist() if len(to) else [0]
        pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(to[edges[:-1]], pa.int32()), pack(uids), pack(sigs)], names=["to", "uids", "sigs"])


    @trimmed
    def scan(batches):
        for batch in batches:
            uids = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            for lo, hi, part, bounds in slices(data, offsets, MESSAGE):
                hashes, doc, _, _ = segments_of(part, bounds)
                sig, own = _signature(hashes, buckets), uids[lo:hi]
                _, first, same = np.unique(own, return_index=True, return_inverse=True)
                doc = first[same][doc]  # copies in a slice are one
                if buckets <= 1 << 15 and hi - lo <= 1 << 16:  # both fit one word, which sorts faster
                    both = np.sort(sig << 16 | doc)
                    sig, doc = both >> 16, both & 0xFFFF
                else:
                    order = np.lexsort((doc, sig))
                    sig, doc = sig[order], doc[order]
                new = np.ones(len(sig), bool)
                new[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
                sig, doc = sig[new], doc[new]
                if not len(sig):
                    continue
                first = np.ones(len(sig), bool)
                first[1:] = sig[1:] != sig[:-1]
                alone = first & np.append(first[1:], True)
                out = {"bucket": [-1], "keys": [sig[~alone].tobytes()], "which": [b""], "uids": [own[doc[~alone]].tobytes()]}
                sig, doc, alone = sig[first], np.where(alone, doc, _KNOWN)[first], None
                at = np.searchsorted(sig >> 32, np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(at)).tolist():
                    keys, which = sig[at[b] : at[b + 1]], doc[at[b] : at[b + 1]]
                    used = np.unique(which)
                    used = used[used != _KNOWN]
                    index = np.where(which == _KNOWN, _KNOWN, np.searchsorted(used, which))
                    out["bucket"].append(b)
                    out["keys"].append((keys & 0xFFFFFFFF).astype("<u4").tobytes())
                    out["which"].append(index.astype("<u2").tobytes())
                    out["uids"].append(own[used].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *[pa.array(out[c], pa.binary()) for c in ("keys", "which", "uids")]], names=list(out))

    @trimmed
    def meet(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = -1

        def told():
            keys, uids = np.concatenate([k for k, _ in held]), np.concatenate([u for _, u in held])
            order = np.argsort(keys)
            keys, uids = keys[order], uids[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            many = np.minimum.reduceat(uids, first) != np.maximum.reduceat(uids, first)
            shared = np.repeat(many, np.diff(np.append(first, len(keys)))) & (uids != 0)
            return reply(uids[shared], (at << 32) | keys[shared].astype(np.int64))

        for batch in batches:
            for bucket, keys, which, uids in zip(batch.column(0).to_pylist(), *[batch.column(i) for i in (1, 2, 3)], strict=True):
                keys, which, own = keys.as_buffer(), which.as_buffer(), np.frombuffer(uids.as_buffer(), np.int64)
                if bucket < 0:
                    yield reply(own, np.frombuffer(keys, np.int64))
                    continue
                if bucket != at and held:
                    yield told()
                    held = []
                at = bucket
                index = np.frombuffer(which, "<u2")
                # Where a slice knows a hash to be shared, 0 stands for its texts: they know already.
                held.append((np.frombuffer(keys, "<u4").copy(), np.append(own, 0)[np.where(index == _KNOWN, len(own), index)]))
        if held:
            yield told()

    @trimmed
    def gather(batches):
        """A partition's texts with their hashes; what copies were told twice is there once."""
        uids, sigs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int64) for i in (1, 2)]
            uids, sigs = np.append(uids, more[0]), np.append(sigs, more[1])
            order = np.lexsort((sigs, uids))
            uids, sigs = uids[order], sigs[order]
            new = np.append(True, (uids[1:] != uids[:-1]) | (sigs[1:] != sigs[:-1]))[: len(uids)]
            uids, sigs = uids[new], sigs[new]
        at = np.flatnonzero(np.append(True, uids[1:] != uids[:-1]))[: len(uids)]
        yield pa.RecordBatch.from_arrays([pa.array(uids[at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(uids)), pa.int32()), pa.array(sigs))], names=["uid", "sigs"])

    packed = texts.mapInArrow(scan, "bucket int, keys binary, which binary, uids binary")
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("uids"), F.lit(parts))).otherwise(F.col("bucket") % parts).cast("int")
    dealt = packed.repartitionById(parts, spread)
    if buckets > parts:
        dealt = dealt.sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "to int, uids binary, sigs binary").repartitionById(parts, F.col("to")).mapInArrow(gather, "uid long, sigs array<long>")


# ---- the index ------------------------------------------------------------------------------------------------------


class RunLengthIndex:
    """Run-length compressed Burrows-Wheeler transform of several byte strings, the suffix array sampled at run ends."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int = LENGTH):
        """Of strings that stand one after another in `data`."""
        k = len(sizes)
        self.text = np.zeros(int(sizes.sum()) + k, np.int64)  # each string, then an end mark of its own, smaller than any byte
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(self.text), bool)
        inside[ends] = False
        self.text[inside] = data.astype(np.int64) + k
        self.text[ends] = np.arange(k)
        self.base, n = k, len(self.text)
        owner = np.repeat(owners, sizes + 1)
        suffixes = self._sort()
        # The transform, as runs: head, first row, and how many of the head's rows are before.
        bwt = self.text[suffixes - 1]
        new = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.heads, self.starts = bwt[new], new
        lengths = np.diff(np.append(new, n))
        self.run_of = np.repeat(np.arange(len(new)), lengths)
        order = np.argsort(self.heads, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        self.first_row = np.empty(len(new), np.int64)  # where a run's first row goes when its head is put in front
        self.first_row[order] = before
        self.sample_first, self.sample_last = suffixes[new], suffixes[np.append(new[1:], n) - 1]
        self.lasts = np.append(new[1:], n) - 1
        # Runs by head, for the nearest run of a byte above or below a row.
        self.by_head = order
        self.head_row = self.heads[order] * (n + 1) + self.starts[order]
        self.n = n
        # Rows with the same first `length` bytes stand together; the smallest owner of each such stretch.
        together = self._agree(suffixes[:-1], suffixes[1:], length)
        stretch = np.append(0, np.cumsum(~together))
        self.smallest = np.minimum.reduceat(owner[suffixes], np.flatnonzero(np.append(True, ~together)))
        self.stretch = stretch

    def _sort(self) -> np.ndarray:
        """The suffix array, by prefix tripling (doubling, where keys would not fit) from a few characters on; ranks are kept for comparisons."""
        n = len(self.text)
        radix = int(self.text.max()) + 2
        padded = np.append(self.text + 1, np.zeros(4, np.int64))
        self.ranks: list[tuple[int, np.ndarray]] = []
        size = 4 if radix**4 < 1 << 62 else 2
        key = padded[:n]
        for i in range(1, size):
            key = key * radix + padded[i : n + i]
        while True:
            suffixes = np.argsort(key)  # equal keys get equal ranks, in any order
            ordered = key[suffixes]
            rank = np.empty(n, np.int64)
            rank[suffixes] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            self.ranks.append((size, rank))
            if rank[suffixes[-1]] == n - 1:
                return suffixes
            key, times = rank, 3 if (n + 1) ** 3 < 1 << 62 else 2
            for i in range(1, times):
                after = np.zeros(n, np.int64)
                after[: max(0, n - i * size)] = rank[i * size :] + 1
                key = key * (n + 1) + after
            size *= times

    def _agree(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether the text agrees over `length` characters from positions a and b, by blocks that overlap."""
        size, rank = max((r for r in self.ranks if r[0] <= length), key=lambda r: r[0], default=(0, None))
        if not size:
            return self._common(a, b, length) >= length
        same = rank[a] == rank[b]
        for shift in [*range(size, length - size, size), length - size]:
            # Blocks agree only where no end mark is in them, so what is cut off at the text's end is never needed.
            same[same] = rank[np.minimum(a[same] + shift, len(rank) - 1)] == rank[np.minimum(b[same] + shift, len(rank) - 1)]
        return same

    def _common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How far the text agrees from different positions a and b, up to about `most`."""
        start, above = a, most + 1
        for size, rank in [*reversed([r for r in self.ranks if r[0] <= most]), (1, self.text)]:
            # What a block of the level above left unmatched is shorter than that block.
            for _ in range(max(1, (above - 1) // size)):
                # End marks equal nothing else, so no two positions get past one.
                ok = rank[a] == rank[b]
                a, b = a + size * ok, b + size * ok
            above = size
        return a - start

    def stream(self, data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """For each position of patterns that stand one after another, the smallest owner of the string of `length` bytes from there, or a large number if no string has it.

        Patterns are read from right to left, all at once. The state is a row, the
        text position of its suffix and the matching statistic. A byte that isn't
        in the row's transform is looked for in the nearest runs above and below.
        """
        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes)
        joined = data.astype(np.int64) + self.base
        out = np.full(int(sizes.sum()), np.iinfo(np.int64).max)
        row, pos, match = (np.zeros(len(sizes), np.int64) for _ in range(3))
        pos[:] = self.sample_first[0]
        falling = -sizes[order]
        for t in range(int(sizes.max())):
            m = int(np.searchsorted(falling, -t, "left"))  # patterns longer than t
            who = order[:m]
            at = ends[who] - 1 - t
            c = joined[at]
            i, p, l = row[:m], pos[:m], match[:m]
            run = self.run_of[i]
            other = np.flatnonzero(self.heads[run] != c)
            if len(other):
                near = np.searchsorted(self.head_row, c[other] * (self.n + 1) + i[other], "right")
                up, down = np.maximum(near - 1, 0), np.minimum(near, len(self.by_head) - 1)
                up_run, down_run = self.by_head[up], self.by_head[down]
                has_up, has_down = self.heads[up_run] == c[other], self.heads[down_run] == c[other]
                p_up, p_down = self.sample_last[up_run], self.sample_first[down_run]
                common = self._common(np.concatenate([p[other], p[other]]), np.concatenate([p_up, p_down]), length)
                l_up = np.where(has_up, np.minimum(l[other], common[: len(other)]), -1)
                l_down = np.where(has_down, np.minimum(l[other], common[len(other) :]), -1)
                above = l_up >= l_down
                i[other] = np.where(above, self.lasts[up_run], self.starts[down_run])
                p[other] = np.where(above, p_up, p_down)
                l[other] = np.where(above, l_up, l_down)
                run[other] = np.where(above, up_run, down_run)
            ok = l >= 0  # else no string has this byte
            i[ok] = self.first_row[run[ok]] + i[ok] - self.starts[run[ok]]
            p[ok] -= 1
            l[ok] += 1
            i[~ok], p[~ok], l[~ok] = 0, self.sample_first[0], 0
            row[:m], pos[:m], match[:m] = i, p, l
            long = np.flatnonzero(l >= length)
            out[at[long]] = self.smallest[self.stretch[i[long]]]
        return out


# ---- on Spark -------------------------------------------------------------------------------------------------------


def owners_of_windows(distinct: DataFrame) -> DataFrame:
    """(sig, h, owner, owners) of distinct segments (sig, h, seg, id): the smallest id that has all windows, or else of each window."""

    def told(sig: np.ndarray, h: np.ndarray, ids: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        """Rows stand by hash, then id: the first of each hash has all its windows itself and isn't streamed."""
        rest = np.append(False, sig[1:] == sig[:-1])
        owner, mixed, kept = ids.copy(), np.zeros(len(sig), bool), np.zeros(0, np.int64)
        if rest.any():
            own = sizes[rest]
            found = RunLengthIndex(data, sizes, ids).stream(data[np.repeat(rest, sizes)], own)
            # Where windows begin: all but the last LENGTH - 1 positions of a pattern.
            windows = own - (LENGTH - 1)
            at = np.cumsum(own) - own
            found = found[np.arange(int(windows.sum())) + np.repeat(at - (np.cumsum(windows) - windows), windows)]
            first = np.cumsum(windows) - windows
            least, most = np.minimum.reduceat(found, first), np.maximum.reduceat(found, first)
            owner[rest], mixed[rest] = least, least != most
            kept = found[np.repeat(least != most, windows)]
        ends = np.cumsum(np.where(mixed, (sizes - (LENGTH - 1)) * 8, 0)).astype(np.int32)
        owners = pa.Array.from_buffers(pa.binary(), len(sig), [pa.py_buffer(np.packbits(mixed, bitorder="little")), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(kept)])
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(h), pa.array(owner, mask=mixed), owners], names=["sig", "h", "owner", "owners"])

    @trimmed
    def run(batches):
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint8), np.zeros(0, np.int64)]
        for part in batches:
            data, offsets = utf8(part.column(2))
            more = [part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(3).to_numpy(), data, np.diff(offsets)]
            held = [np.append(a, b) for a, b in zip(held, more, strict=True)]
            while True:
                # An index is full at the first hash that begins beyond BIN bytes.
                begins, at = np.append(False, held[0][1:] != held[0][:-1]), np.cumsum(held[4]) - held[4]
                cut = int(np.argmax(begins & (at >= BIN))) if len(begins) else 0
                if not cut:
                    break
                b = int(at[cut])
                yield told(*(x[:cut] for x in held[:3]), held[3][:b], held[4][:cut])
                held = [*(x[cut:] for x in held[:3]), held[3][b:], held[4][cut:]]
        if len(held[0]):
            yield told(*held)

    return distinct.select("sig", "h", "seg", "id").repartition("sig").sortWithinPartitions("sig", "id", "h").mapInArrow(run, "sig long, h long, owner long, owners binary")


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    """Covered bytes of marked windows."""
    at = np.flatnonzero(marked)
    cut = np.flatnonzero(np.diff(at) > LENGTH)  # windows that touch or overlap cover one run
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + LENGTH).tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bin_bytes: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (from, to) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Copies have one uid, a hash that only says where to look; whether texts are equal is told by their digests. It is never 0.
    told = rows.withColumn("sha", F.sha2("text", 256)).withColumn("n", F.octet_length("text").cast("long")).withColumn("uid", F.xxhash64("text"))
    told = told.withColumn("uid", F.when(F.col("uid") == 0, 1).otherwise(F.col("uid")))
    holders = told.where("id is not null").groupBy("sha").agg(F.min("id").alias("first"), F.first("uid").alias("uid"))
    holders = materialize(holders, "repeat-holders")
    long = told.where(f"n >= {LENGTH} and id is not null").select("uid", "id", "text")
    total = int(long.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = blob_partitions(docs, total, MEET)
    shared = shared_hashes(long.select("uid", "text"), buckets)
    shared = materialize(shared.join(holders.select(F.col("uid").alias("holder"), "first"), F.col("uid") == F.col("holder")).select("uid", "first", "sigs"), "repeat-hashes")

    @trimmed
    def send(batches):
        for batch in batches:
            uids, ids, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            wanted, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            data, offsets = utf8(batch.column(2))
            for lo, hi, part, bounds in slices(data, offsets, MESSAGE):
                hashes, doc, starts, ends = segments_of(part, bounds)
                sig = _signature(hashes, buckets)
                # Pairs of document and hash, mixed; what agrees by chance is sent in vain.
                pair = lambda d, x: x.view(np.uint64) ^ d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                asked = pair(np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])), wanted[at[lo] : at[hi]])
                keep = np.flatnonzero(np.isin(pair(doc, sig), asked))
                sig, doc, starts, ends = sig[keep], doc[keep], starts[keep], ends[keep]
                h = Hasher(part).spans(starts, ends)
                order = np.lexsort((h, sig))
                new = np.append(True, (sig[order][1:] != sig[order][:-1]) | (h[order][1:] != h[order][:-1]))[: len(order)]
                told = np.zeros(len(order), bool)
                told[order[new]] = True
                sizes = np.where(told, ends - starts, 0)
                places = np.cumsum(sizes)
                raw = part[np.arange(int(places[-1]) if len(places) else 0) + np.repeat(starts - (places - sizes), sizes)]
                segs = pa.Array.from_buffers(pa.binary(), len(told), [pa.py_buffer(np.packbits(told, bitorder="little")), pa.py_buffer(np.append(0, places).astype(np.int32)), pa.py_buffer(raw)])
                out = [sig, h.view(np.int64), uids[lo + doc], ids[lo + doc], starts - bounds[doc], (ends - starts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, out), segs], names=["sig", "h", "uid", "id", "start", "size", "seg"])

    # Where one side has a key once, it is hashed and the larger side isn't sorted.
    found = shared.withColumnRenamed("uid", "u").hint("shuffle_hash").join(long, (F.col("u") == F.col("uid")) & (F.col("first") == F.col("id"))).select("uid", "id", "text", "sigs")
    sent = materialize(found.mapInArrow(send, "sig long, h long, uid long, id long, start long, size int, seg binary"), "repeat-segments")
    discard(shared)
    # Distinct segments with their smallest id; how many a hash has, and how many bytes.
    distinct = sent.groupBy("sig", "h").agg(F.min("id").alias("least"), F.first("size").alias("bytes"))
    counted = distinct.groupBy("sig").agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).withColumnRenamed("sig", "s")
    distinct = materialize(distinct.join(counted.hint("shuffle_hash"), F.col("sig") == F.col("s")).select("sig", "h", "least", "n", "total"), "repeat-distinct")
    meeting = distinct.where("n > 1").select(F.col("sig").alias("os"), F.col("h").alias("oh"), "least", "total")
    with_bytes = sent.where("seg is not null").select("sig", "h", "seg").join(meeting.hint("shuffle_hash"), (F.col("sig") == F.col("os")) & (F.col("h") == F.col("oh")))
    with_bytes = with_bytes.groupBy("sig", "h").agg(F.first("seg").alias("seg"), F.min("least").alias("id"), F.first("total").alias("total"))
    some_hot = not distinct.where(F.col("total") > bin_bytes).where("n > 1").isEmpty()
    if some_hot:
        with_bytes = materialize(with_bytes, "repeat-bytes")
    indexed = materialize(owners_of_windows(with_bytes.where(F.col("total") <= bin_bytes)), "repeat-owners")
    alone = distinct.where("n = 1").select("sig", "h", F.col("least").alias("owner"), F.lit(None).cast("binary").alias("owners"))
    owners = alone.unionByName(indexed).select(F.col("sig").alias("os"), F.col("h").alias("og"), "owner", "owners")
    slim = sent.select("sig", "h", "uid", "id", "start", "size")

    @trimmed
    def mark(batches):
        for batch in batches:
            uid, ids, start, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            whole = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            out = [(uid[whole], start[whole], (start + size)[whole])]
            for r in np.flatnonzero(~whole).tolist():
                marked = np.frombuffer(batch.column(4)[r].as_buffer(), np.int64) < ids[r]
                if marked.any():
                    edges = np.array(_runs(marked)) + start[r]
                    out.append((np.full(len(edges), uid[r]), edges[:, 0], edges[:, 1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["uid", "from", "to"])

    spans_type = "array<struct<from: long, to: long>>"
    joined = slim.join(owners.hint("shuffle_hash"), (F.col("sig") == F.col("os")) & (F.col("h") == F.col("og"))).where("owner is null or owner < id")
    marks = joined.select("uid", "id", "start", "size", "owners").mapInArrow(mark, "uid long, from long, to long")
    # Hashes with very many distinct segments: each window on its own.
    texts_of_hot = with_bytes.where(F.col("total") > bin_bytes).select(F.col("sig").alias("os"), F.col("h").alias("og"), "seg")
    begin = F.explode(F.sequence(F.lit(1), F.length("seg") - (LENGTH - 1))).alias("b")
    windows = slim.join(texts_of_hot, (F.col("sig") == F.col("os")) & (F.col("h") == F.col("og"))).select("uid", "id", "start", "seg", begin).select("uid", "id", (F.col("start") + F.col("b") - 1).alias("at"), F.expr(f"substring(seg, b, {LENGTH})").alias("w"))
    least = windows.groupBy("w").agg(F.min("id").alias("least")).withColumnRenamed("w", "lw")
    single = windows.join(least, F.col("w") == F.col("lw")).where("least < id").select("uid", F.col("at").alias("from"), (F.col("at") + LENGTH).alias("to"))
    marks = marks.unionByName(single) if some_hot else marks
    spans = materialize(marks.groupBy("uid").agg(F.collect_list(F.struct("from", "to")).cast(spans_type).alias("spans")), "repeat-spans")
    spans = spans.join(holders.select(F.col("uid").alias("holder"), "first"), F.col("uid") == F.col("holder"))
    discard(sent, distinct, indexed, *([with_bytes] if some_hot else []))

    @trimmed
    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {"u": [], "n_removed": [], "n_spans": [], "kept": [], "spans": []}
            for uid, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, merged, kept, at = text.as_buffer().to_pybytes(), [], [], 0
                for s in sorted(spans, key=lambda s: (s["from"], s["to"])):
                    if merged and s["from"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["to"])
                    else:
                        merged.append([s["from"], s["to"]])
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out["u"].append(uid)
                out["n_removed"].append(sum(b - a for a, b in merged))
                out["n_spans"].append(len(merged))
                out["kept"].append(hashlib.sha256(b"".join(kept)).hexdigest())
                out["spans"].append([{"from": a, "to": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([pa.array(out["u"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["spans"], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], names=list(out))

    edited = spans.withColumnRenamed("uid", "u").hint("shuffle_hash").join(long, (F.col("u") == F.col("uid")) & (F.col("first") == F.col("id"))).select("uid", "text", "spans")
    edited = materialize(edited.mapInArrow(cut, f"u long, n_removed long, n_spans long, kept string, spans {spans_type}").dropDuplicates(["u"]), "repeat-edited")
    slim = told.select("id", "sha", "n", "uid")
    out = slim.join(holders.select(F.col("sha").alias("s"), "first"), F.col("sha") == F.col("s"), "left").join(edited, F.col("u") == F.col("uid"), "left")
    copy = F.col("id").isNotNull() & (F.col("id") > F.col("first")) & (F.col("n") >= LENGTH)
    some = F.col("id").isNotNull() & F.col("u").isNotNull()
    none = F.array().cast(spans_type)
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).when(some, F.col("n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(some, F.col("n_spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(some, F.col("kept")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n").alias("to")))).when(some, F.col("spans")).otherwise(none).alias("spans"),
    )


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
