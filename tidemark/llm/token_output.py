"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of key. Layout, little-endian:

* data blocks, each zstd-compressed: entries (varint shared prefix with the
  previous key, varint rest of key, varint bytes of value, rest of key, value);
  the first entry of a block shares nothing. A value is the bytes of an id (2 or
  4) and the ids.
* sparse index: for each block its first key (u16 length, bytes), offset u64,
  size u32, entries u32
* Bloom filter over keys (u8 hashes, u32 bytes, bits)
* footer, fixed 56 bytes: index offset u64, Bloom offset u64, entries u64,
  tokens u64, xxh64 of all before u64, version u64, magic 8 bytes

A lookup asks the Bloom filter, bisects the index, and reads one block.

Keys are the ids as 9 bytes: 0 for null, else 1 and the signed integer with
flipped sign bit, big-endian, so their byte order is the order of ids, null
first. Rows that share an id are entries one after another, ordered by text.

Defined results: null text is empty and has only the end id; repeated rows are
all written; an empty table gives no shards and an empty result. Only the id
and text columns are read. Texts are encoded whole, as the library would.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bytescan import RUNS, WORDS, Hasher, slices, utf8
from tidemark.llm.shared import WRITING, new_path, remove, settings, trimmed

MAGIC, VERSION = b"TMSSTBL1", 1
FOOTER = struct.Struct("<QQQQQQ8s")
#: Raw bytes of entries after which a block ends; Bloom bits and hashes for each key.
BLOCK, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 10, 7
#: Text bytes that go to a shard, about.
SHARD = 32 << 20


# ---- encoding -------------------------------------------------------------------------------------------------------

#: Blanks outside ASCII: a text that has one is given to the library as a whole.
_WIDE_BLANK = re.compile("[" + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
_MAYBE_WIDE = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])  # lead bytes of most of them
_SPACE = WORDS == 0
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
#: Bytes of text whose pieces are looked up together.
_AT_A_TIME = 1 << 20
_MARK = (RUNS == 3) & (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)


def _pick(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at `at`, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)


#: Masks of the first 0 to 8 bytes of a little-endian word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one word; zeros follow the data."""
    return np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(9, np.uint8)), strides=(1,))


def _equal(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether runs of bytes are the same; a and b are `_words`."""
    same = a_size == b_size
    live, step = np.flatnonzero(same), 0
    while len(live):
        left = a_size[live] - step
        equal = (a[a_at[live] + step] ^ b[b_at[live] + step]) & _MASKS[np.minimum(left, 8)] == 0
        same[live[~equal]] = False
        live, step = live[equal & (left > 8)], step + 8
        if step > 4096:  # very long ones, each at a time
            for i in live.tolist():
                at = np.arange(step, int(a_size[i]) - 7, 8)
                last = int(a_size[i]) - 8
                same[i] = (a[a_at[i] + at] == b[b_at[i] + at]).all() and a[a_at[i] + last] == b[b_at[i] + last]
            break
    return same


class PieceEncoder:
    """Encodes texts piece by piece, remembering pieces.

    The vocabulary's pre-tokenizer always ends a token between a character that
    is not white space and white space, and between an ASCII letter and an ASCII
    mark; so a text cut there has the ids of its pieces, in a row. Each new piece
    is encoded by the library once; pieces are equal if their bytes are. Added
    tokens are found before the pre-tokenizer cuts, so a text that contains one
    is given to the library as a whole, as those with wide blanks are. A file
    that isn't byte-level with the common pattern, or that changes texts first,
    is refused.
    """

    #: Pieces remembered, and bytes of them; beyond either, those that were met again since stay. A longer piece isn't remembered.
    MOST, MOST_BYTES, LONGEST = 1 << 20, 12 << 20, 64
    #: Pieces given to the library as one text, where they may stand side by side, and texts given to it at once.
    TOGETHER, AT_ONCE = 512, 64

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            said = json.load(f)
        cutter, tokens = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
        if said.get("normalizer") is not None or cutter.get("type") != "ByteLevel" or not cutter.get("use_regex", True) or cutter.get("add_prefix_space", True):
            raise ValueError(f"{file} isn't a byte-level vocabulary whose texts can be encoded in pieces")
        if wide := [t["content"] for t in tokens if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
            raise ValueError(f"{file} has added tokens that look beyond themselves: {wide}")
        added = [t["content"].encode() for t in tokens if t["content"]]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token, one a character in byte-level vocabularies
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        self.forget()

    def forget(self) -> None:
        """Memory of pieces, by ascending hash: where their bytes and ids are, how many, and whether they were met again."""
        self.hashes, self.again = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.byte_at, self.n_bytes, self.id_at, self.n_ids = (np.zeros(0, np.int32) for _ in range(4))
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)

    def _ask(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces in a row, and how many each has."""
        raw, out = data.tobytes(), [np.zeros(0, np.int32)] * len(begin)

        def alone(which: list[int]) -> None:
            texts = [raw[begin[i] : begin[i] + size[i]].decode() for i in which]
            for i, e in zip(which, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.int32)

        # Pieces from white space to a character that is none keep their bounds side by side.
        joins = _SPACE[data[begin]] & ~_SPACE[data[begin + size - 1]]
        rest, beside = np.flatnonzero(~joins).tolist(), np.flatnonzero(joins)
        groups = [beside[i : i + self.TOGETHER] for i in range(0, len(beside), self.TOGETHER)]
        for i in range(0, len(groups), self.AT_ONCE):
            some = groups[i : i + self.AT_ONCE]
            texts = [data[_pick(begin[g], size[g])].tobytes().decode() for g in some]
            for g, e in zip(some, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids, ends = np.array(e.ids, np.int32), np.cumsum(size[g])
                at = np.cumsum(self.lengths[ids])
                place = np.minimum(np.searchsorted(at, ends), len(at) - 1)
                if at[-1] == ends[-1] and (at[place] == ends).all():  # each piece ends where a token does
                    for piece, own in zip(g.tolist(), np.split(ids, place[:-1] + 1), strict=True):
                        out[piece] = own
                else:
                    rest += g.tolist()
        for i in range(0, len(rest), 4096):
            alone(rest[i : i + 4096])
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.fromiter(map(len, out), np.int32, len(out))

    def _remember(self, hashes: np.ndarray, text: np.ndarray, n_bytes: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        """Pieces with ascending hashes, none of them known."""
        if len(self.hashes) + len(hashes) > self.MOST or len(self.bytes) + len(text) > self.MOST_BYTES:
            stay = np.flatnonzero(self.again) if len(hashes) <= self.MOST // 2 else np.zeros(0, np.int64)
            self.bytes, self.ids = self.bytes[_pick(self.byte_at[stay], self.n_bytes[stay])], self.ids[_pick(self.id_at[stay], self.n_ids[stay])]
            self.hashes, self.n_bytes, self.n_ids = self.hashes[stay], self.n_bytes[stay], self.n_ids[stay]
            self.byte_at, self.id_at = (np.cumsum(n, dtype=np.int32) - n for n in (self.n_bytes, self.n_ids))
            self.again = np.zeros(len(stay), bool)
            if len(stay) + len(hashes) > self.MOST:
                return self.forget()
        at = np.searchsorted(self.hashes, hashes)
        byte_at, id_at = len(self.bytes) + np.cumsum(n_bytes) - n_bytes, len(self.ids) + np.cumsum(n_ids) - n_ids
        self.bytes, self.ids = np.append(self.bytes, text), np.append(self.ids, ids)
        self.hashes, self.again = np.insert(self.hashes, at, hashes), np.insert(self.again, at, False)
        self.byte_at, self.n_bytes = np.insert(self.byte_at, at, byte_at), np.insert(self.n_bytes, at, n_bytes)
        self.id_at, self.n_ids = np.insert(self.id_at, at, id_at), np.insert(self.n_ids, at, n_ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents in a row, and the offsets of documents in them."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space, letter = _SPACE[data], _LETTER[data]
        cut = np.empty(n + 1, dtype=bool)
        cut[0] = cut[n] = True
        cut[1:n] = (space[1:] & ~space[:-1]) | (letter[:-1] & _MARK[data[1:]])
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        starts, lengths = edges[:-1], np.diff(edges)
        hashes, first, which = np.unique(Hasher(data).spans(starts, edges[1:]), return_index=True, return_inverse=True)
        # Hashes only suggest which pieces are equal; one whose bytes differ from the first with its hash stands for itself.
        words = _words(data)
        odd = np.flatnonzero(~_equal(words, starts[first][which], lengths[first][which], words, starts, lengths))
        which[odd], first = len(first) + np.arange(len(odd)), np.append(first, odd)
        begin, size = starts[first], lengths[first]
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = np.zeros(len(first), bool)
        if len(self.hashes):
            hit = np.flatnonzero(self.hashes[at] == hashes)
            hit = hit[_equal(_words(self.bytes), self.byte_at[at[hit]], self.n_bytes[at[hit]], words, begin[hit], size[hit])]
            known[hit], self.again[at[hit]] = True, True
        new = np.flatnonzero(~known)
        asked, n_asked = self._ask(data, begin[new], size[new])
        # Ids of this slice's pieces: remembered ones, then those asked for.
        old = at[np.flatnonzero(known)]
        ids, n_ids = np.append(self.ids[_pick(self.id_at[old], self.n_ids[old])], asked), np.empty(len(first), np.int64)
        n_ids[known], n_ids[new] = self.n_ids[old], n_asked
        id_at, order = np.empty(len(first), np.int64), np.append(np.flatnonzero(known), new)
        id_at[order] = np.cumsum(n_ids[order]) - n_ids[order]
        # A hash that is known for other bytes isn't learnt again.
        learn = new[(new < len(hashes)) & (size[new] <= self.LONGEST)]
        if len(self.hashes):
            learn = learn[self.hashes[at[learn]] != hashes[learn]]
        self._remember(hashes[learn], data[_pick(begin[learn], size[learn])], size[learn], ids[_pick(id_at[learn], n_ids[learn])], n_ids[learn])
        bounds = np.concatenate([[0], np.cumsum(n_ids[which])])[np.searchsorted(starts, offsets)]
        return ids[_pick(id_at[which], n_ids[which])], bounds

    def encode_texts(self, texts: pa.Array):
        """The ids of each text, in order."""
        data, offsets = utf8(texts)
        for lo, _, part, bounds in slices(data, offsets, _AT_A_TIME):
            ids, at = self.encode(part, bounds)
            wide = _MAYBE_WIDE[part].any() or ((part[:-1] == 0xC2) & ((part[1:] == 0x85) | (part[1:] == 0xA0))).any()
            added = self.added is not None and self.added.search(part)
            for i in range(len(bounds) - 1):
                own = ids[at[i] : at[i + 1]]
                if wide or added:
                    raw = part[bounds[i] : bounds[i + 1]].tobytes()
                    if (added and self.added.search(raw)) or (wide and _WIDE_BLANK.search(raw.decode())):
                        own = np.array(self.library.encode(raw.decode(), add_special_tokens=False).ids, np.int32)
                yield lo + i, own


_encoders: dict[str, PieceEncoder] = {}


def encoder(file: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file. The library outlives a task; pieces are forgotten at its end."""
    if file not in _encoders:
        _encoders[file] = PieceEncoder(file)
    return _encoders[file]


# ---- shards ---------------------------------------------------------------------------------------------------------


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def pack_ids(ids: np.ndarray) -> bytes:
    """Bytes an id (2 or 4) and the ids, little-endian."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return b"\4" + ids.astype("<u4").tobytes() if wide else b"\2" + ids.astype("<u2").tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[0] == 4 else "<u2", offset=1).astype(np.uint32)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return n, at


def _bloom_bits(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Writes one shard to a file-like object; keys must not fall."""

    def __init__(self, out):
        self.out, self.sum, self.at = out, xxhash.xxh64(), 0
        self.block, self.raw, self.first, self.last, self.in_block = bytearray(), 0, b"", b"", 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.entries = self.tokens = 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = pack_ids(ids)
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        if not self.entries or key != self.last:
            self.keys.append(key)
        self.last, self.entries, self.tokens = key, self.entries + 1, self.tokens + len(ids)
        if len(self.block) >= BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        if self.in_block:
            packed = self.zip.compress(bytes(self.block))
            self.index.append((self.first, self.at, len(packed), self.in_block))
            self._write(packed)
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        self._write(b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QII", at, size, n) for k, at, size, n in self.index))
        bloom_at, size = self.at, max(8, -(-len(self.keys) * BLOOM_BITS // 8))
        bits = bytearray(size)
        for key in self.keys:
            for b in _bloom_bits(key, size * 8, BLOOM_HASHES):
                bits[b >> 3] |= 1 << (b & 7)
        self._write(struct.pack("<BI", BLOOM_HASHES, size) + bytes(bits))
        self.out.write(FOOTER.pack(index_at, bloom_at, self.entries, self.tokens, self.sum.intdigest(), VERSION, MAGIC))


class ShardReader:
    """Reads a shard, given as bytes or as an open file: footer, index and filter at first, then the blocks asked for."""

    def __init__(self, source):
        self.source, self.size = source, len(source) if isinstance(source, bytes) else source.size()
        footer = self._get(self.size - FOOTER.size, FOOTER.size)
        self.index_at, self.bloom_at, self.entries, self.tokens, self.sum, version, magic = FOOTER.unpack(footer)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        tail = self._get(self.index_at, self.size - FOOTER.size - self.index_at)
        self.firsts, self.blocks, at, end = [], [], 0, self.bloom_at - self.index_at
        while at < end:
            (n,) = struct.unpack_from("<H", tail, at)
            self.firsts.append(bytes(tail[at + 2 : at + 2 + n]))
            self.blocks.append(struct.unpack_from("<QII", tail, at + 2 + n))
            at += 2 + n + 16
        self.hashes, size = struct.unpack_from("<BI", tail, end)
        self.bloom = tail[end + 5 : end + 5 + size]
        self.unzip = zstandard.ZstdDecompressor()

    def _get(self, offset: int, size: int) -> bytes:
        if isinstance(self.source, bytes):
            return self.source[offset : offset + size]
        self.source.seek(offset)
        return self.source.read(size)

    def verify(self) -> None:
        if xxhash.xxh64(self._get(0, self.size - FOOTER.size)).intdigest() != self.sum:
            raise ValueError("the shard is damaged")

    def block(self, i: int):
        """(key, ids) of a block."""
        offset, size, n = self.blocks[i]
        data, at, key = self.unzip.decompress(self._get(offset, size)), 0, b""
        for _ in range(n):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, unpack_ids(data[at : at + length])
            at += length

    def __iter__(self):
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_contain(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, len(self.bloom) * 8, self.hashes))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of all entries of a key: Bloom filter, binary search of the index, then the blocks that may have it."""
        if not self.firsts or key < self.firsts[0] or not self.may_contain(key):
            return []
        i, found = max(0, bisect.bisect_left(self.firsts, key) - 1), []
        while i < len(self.firsts) and self.firsts[i] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found


# ---- on Spark -------------------------------------------------------------------------------------------------------


def _open_out(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, shard_bytes: int = SHARD) -> DataFrame:
    """Write all documents, sorted by id over shards `folder`/NNNNNN.sst; returns (shard, entries, tokens), computed by writing.

    Documents are range-partitioned by id. A task writes to a name of its own
    and then renames, so a repeated or doubled task leaves the same shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    total = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    ranged = rows.repartitionByRange(max(1, -(-total // shard_bytes)), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "content")
    ranged = ranged.withColumn("shard", F.spark_partition_id())

    @trimmed
    def write(batches):
        coder, out, writer = encoder(tokenizer_file), None, None
        try:
            yield from put(batches, coder, out, writer)
        finally:
            coder.forget()

    def put(batches, coder, out, writer):
        import posixpath

        end = np.zeros(0, np.int32) if end_id is None else np.array([end_id], np.int32)
        fs, base = _open_out(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                shard = batch.column(2)[0].as_py()
                fs.create_dir(base, recursive=True)
                part = posixpath.join(base, f"_{shard:06d}-{uuid.uuid4().hex}")
                out = fs.open_output_stream(part)
                writer = ShardWriter(out)
            ids = batch.column(0).to_pylist()
            for i, tokens in coder.encode_texts(batch.column(1)):
                writer.add(key_of(ids[i]), np.concatenate([tokens, end]))
        if writer is not None:
            writer.close()
            out.close()
            fs.move(part, posixpath.join(base, f"{shard:06d}.sst"))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "entries": pa.array([writer.entries], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())})

    return ranged.mapInArrow(write, "shard int, entries long, tokens long")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_id, at, n_tokens, ids_crc32, ids): every entry of every shard; `at` counts the shard's ids before it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select(F.regexp_extract("path", r"(\d+)\.sst$", 1).cast("int").alias("shard"), "content")

    @trimmed
    def read(batches):
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader, at = ShardReader(raw.as_buffer().to_pybytes()), 0
                reader.verify()
                for i in range(len(reader.blocks)):
                    keys, arrays = zip(*reader.block(i), strict=True)
                    sizes = np.array([len(a) for a in arrays], np.int64)
                    ends = np.cumsum(sizes)
                    crcs = [zlib.crc32(a.astype("<u4").tobytes()) for a in arrays]
                    values = pa.array(np.concatenate(arrays).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(keys), pa.int32()), pa.array([id_of(k) for k in keys], pa.int64()), pa.array(at + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)],
                        names=["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                    )
                    at += int(ends[-1])

    return files.mapInArrow(read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long, ids array<int>")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few documents: of each shard only the footer, filter and index are read, and the blocks that may have a key."""
    wanted = [key_of(i) for i in doc_ids]

    def find(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    reader = ShardReader(source)
                    hits = [(id_of(k), ids.tolist()) for k in wanted for ids in reader.get(k)]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    found: dict[int, list[np.ndarray]] = {}
    shards = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select("path")  # contents aren't read
    for row in shards.mapInArrow(find, "doc_id long, ids array<int>").collect():
        found.setdefault(row.doc_id, []).append(np.array(row.ids, np.uint32))
    return found


def token_table(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write shards, read them back: doc_id, start, n_tokens, ids_crc32, shard."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "shards")
    with settings(spark, WRITING):
        written = write_shards(docs, folder, tokenizer_file, id_col, text_col).collect()  # a row for each shard
    if not written:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
    totals = spark.createDataFrame([(r.shard, r.tokens) for r in written], "shard int, tokens long")
    base = totals.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))
    return read_shards(spark, folder).drop("ids").join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()).select("doc_id", "start", "n_tokens", "ids_crc32")


__all__ = ["PieceEncoder", "ShardReader", "ShardWriter", "lookup", "op2_token_output", "read_shards", "remove", "token_table", "write_shards"]
