"""Token-ID / binary output with a minimal perfect hash index.

Texts become ids of a public byte-level BPE. Words (pieces of the tokenizer's pattern) are found for a
whole batch in numpy, and only distinct pieces are encoded. Keys are hashed to shards; a shard holds
the raw ids of its documents, one after the other, and an index from key to offset: a minimal perfect
hash (buckets displaced by pilots), with a stored fingerprint that tells foreign keys.
"""

from __future__ import annotations

import base64
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import kernel
from corvane.llm.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DOCS_PER_SHARD = 2048
KEYS_PER_BUCKET = 4
CACHE = 250_000
BLOCK = 1 << 20
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class by code point. Code points that this Python doesn't know are other."""
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        if 0x323B0 <= c < 0xE0000:
            continue
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
        elif chr(c).isspace() and not 0x1C <= c <= 0x1F:
            out[c] = _SPACE
    return out


def pieces(cps: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Starts of the pieces into which PATTERN divides texts of the code points cps, of which each
    begins at one of cuts."""
    n = len(cps)
    if not n:
        return np.empty(0, np.int64)
    kind = _classes()[cps]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[cuts] = True
    text_end = np.zeros(n + 1, bool)
    text_end[cuts] = True
    text_end[n] = True
    # the last space character of a run leaves it, when the text goes on: a blank joins what follows
    last = np.flatnonzero((kind == _SPACE) & np.concatenate([start[1:], [True]]) & ~text_end[1:])
    start[last] = True
    blank = last[cps[last] == 32]
    start[blank + 1] = False
    # contractions begin a piece that has no blank before it, at an apostrophe
    quote = np.flatnonzero((cps == 39) & start)
    if len(quote):
        pad = np.concatenate([cps, np.zeros(3, cps.dtype)])
        ends = np.concatenate([text_end, np.ones(3, bool)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~ends[quote + 1]
        two = ((a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108)) & ~ends[quote + 1] & ~ends[quote + 2]
        for hit, length in ((one, 1), (two & ~one, 2)):
            q = quote[hit]
            start[q + 1] = False
            after = q + 1 + length
            after = after[after < n]
            joined = after[(kind[after] == kind[after - 1])]
            start[joined] = True
    return np.flatnonzero(start)


class Encoder:
    """tiktoken's ids, with distinct pieces encoded once for as long as the cache has room."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.plain = tiktoken.Encoding("corvane", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: hash of a piece -> where its ids are in the pool: first << 24 | number
        self.cache: dict[int, int] = {}
        self.pool, self.filled = np.empty(1 << 20, np.int32), 0

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """An array of ids for each text; none for null and empty ones."""
        out = [np.empty(0, np.int32)] * len(texts)
        block, size = [], 0
        for i, t in enumerate(texts):
            if t:
                block.append(i)
                size += len(t)
                if size >= BLOCK:
                    self._block(texts, block, out)
                    block, size = [], 0
        if block:
            self._block(texts, block, out)
        return out

    def _block(self, texts: list[str | None], block: list[int], out: list[np.ndarray]) -> None:
        strings = [texts[i] for i in block]
        joined = "".join(strings)
        try:
            joined.encode()
        except UnicodeEncodeError:  # lone surrogates: tiktoken's own repair
            for i in block:
                out[i] = np.array(self.plain.encode_ordinary(texts[i]), np.int32)
            return
        cps = kernel.code_points([joined])
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        cuts = np.cumsum(lengths) - lengths
        start = pieces(cps, cuts)
        end = np.concatenate([start[1:], [len(cps)]])
        value = kernel.tables()[2]
        power, inverse = kernel.powers(len(cps))
        sums = np.empty(len(cps) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(value[cps] * power[: len(cps)], out=sums[1:])
        h = kernel.mix((sums[end] - sums[start]) * inverse[start])
        check = (end - start).astype(np.uint64) << np.uint64(32) | cps[start].astype(np.uint64)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        if not np.array_equal(check[first][which], check):  # two pieces of one hash: the plain way
            for i in block:
                out[i] = np.array(self.plain.encode_ordinary(texts[i]), np.int32)
            return
        if len(self.cache) > CACHE:
            self.cache.clear()
            self.filled = 0
        cache, encode = self.cache, self.plain._encode_single_piece
        keys = distinct.tolist()
        places = list(map(cache.get, keys))
        missing = [k for k, p in enumerate(places) if p is None]
        new: list[int] = []
        for k, a, b in zip(missing, start[first[missing]].tolist(), end[first[missing]].tolist()):
            ids = encode(joined[a:b])
            places[k] = cache[keys[k]] = (self.filled + len(new)) << 24 | len(ids)
            new += ids
        if self.filled + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.empty(self.filled + len(new) + (1 << 20), np.int32)])
        self.pool[self.filled : self.filled + len(new)] = new
        self.filled += len(new)
        at = np.array(places, np.int64)[which]
        begin, own = at >> 24, at & ((1 << 24) - 1)
        pool = self.pool
        stop = np.cumsum(own)
        flat = pool[np.repeat(begin - (stop - own), own) + np.arange(stop[-1])]
        ends = stop[np.searchsorted(start, cuts + lengths) - 1]
        for i, part in zip(block, np.split(flat, ends[:-1])):
            out[i] = part


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def _encode(shared, width: str, shards: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        key = (len(ranks), hash(frozenset(ranks.items())))
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(ranks)
        encoder = _ENCODERS[key]
        for batch, low, high, texts in ((b, *c) for b in batches for c in kernel.chunks(b.column(1))):
            ids = encoder.encode(texts)
            raw = [None if t is None else x.astype(width).tobytes() for t, x in zip(texts, ids)]
            docs = batch.column(0).slice(low, high - low)
            null = docs.is_null().to_numpy(zero_copy_only=False)
            shard = shard_of(docs.fill_null(0).to_numpy(zero_copy_only=False), null, shards)
            for i in np.flatnonzero(null):  # rows without an id are spread by what they hold
                shard[i] = zlib.crc32(raw[i] or b"") % shards
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), docs, pa.array(raw, pa.binary()), pa.array([len(x) for x in ids], pa.int64())], ["shard", "doc_id", "ids", "n_tokens"])

    return run


def key_hash(doc_ids: np.ndarray, copies: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit hash of the key (doc_id, copy)."""
    h = kernel.mix(doc_ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return kernel.mix(np.where(null, np.uint64(0x5851F42D4C957F2D), h) ^ kernel.mix(copies.astype(np.uint64)))


def shard_of(doc_ids: np.ndarray, null: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; all copies of a doc_id are in one. Nulls: any."""
    h = key_hash(doc_ids, np.full(len(doc_ids), -1), null)
    return (kernel.mix(h) % np.uint64(max(1, shards))).astype(np.int32)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (kernel.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.int64)


def _slots(h: np.ndarray, pilot: int | np.ndarray, n: int) -> np.ndarray:
    return (kernel.mix(h ^ kernel.mix(np.asarray(pilot, np.uint64))) % np.uint64(n)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, pilots): distinct hashes h take the slots 0 .. len(h) - 1, one each. A key's bucket is
    h % len(pilots); its slot follows from the bucket's pilot, or is -1 - pilot if that is negative."""
    n = len(h)
    n_buckets = max(1, -(-n // KEYS_PER_BUCKET))
    pilots, slots, used = np.zeros(n_buckets, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    bucket = (h % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    first = np.cumsum(sizes) - sizes
    for b in np.argsort(-sizes, kind="stable"):
        own = order[first[b] : first[b] + sizes[b]]
        if len(own) < 2:
            break
        pilot = 0
        while True:
            tried = np.arange(pilot, pilot + 64)
            at = _slots(h[own][None, :], tried[:, None], n)
            ok = ~used[at].any(1)
            ordered = np.sort(at, 1)
            ok &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
            if ok.any():
                k = int(np.argmax(ok))
                pilots[b], slots[own] = tried[k], at[k]
                used[at[k]] = True
                break
            pilot += 64
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~used)[: len(single)]
    slots[order[first[single]]] = free
    pilots[single] = -1 - free
    return slots, pilots


def find_slot(h: int, pilots: np.ndarray, n: int) -> int:
    pilot = int(pilots[h % len(pilots)])
    return -1 - pilot if pilot < 0 else int(_slots(np.array([h], np.uint64), pilot, n)[0])


def _shard_rows(rows: pa.Table) -> pa.Table:
    """One shard: its rows in slot order, with copy numbers, pilots, fingerprints and offsets."""
    rows = rows.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending"), ("ids", "ascending")])
    null = rows.column("doc_id").is_null().to_numpy()
    doc = rows.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])])
    at = np.arange(len(doc))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    h = key_hash(doc, copy, null)
    slots, pilots = perfect_hash(h)
    order = np.argsort(slots)
    rows = rows.take(pa.array(order))
    n = rows.column("n_tokens").to_numpy()
    return pa.table({
        "shard": rows.column("shard"), "slot": pa.array(slots[order], pa.int32()), "doc_id": rows.column("doc_id"), "copy": pa.array(copy[order], pa.int32()),
        "fingerprint": pa.array(fingerprint(h)[order], pa.int64()), "pilot": pa.array(pilots[(h % np.uint64(len(pilots))).astype(np.int64)][order], pa.int64()),
        "token_offset": pa.array(np.cumsum(n) - n, pa.int64()), "n_tokens": rows.column("n_tokens"), "ids": rows.column("ids"),
    })


ROWS = "shard int, slot int, doc_id bigint, copy int, fingerprint bigint, pilot bigint, token_offset bigint, n_tokens bigint, ids binary"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def token_index(docs: DataFrame, vocabulary: str = VOCABULARY, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Token ids of every document and where a keyed reader finds them.

    Result: shard, n_shards, slot (0 .. keys of the shard - 1, no two alike), doc_id, copy, fingerprint (32 bits
    of the key's hash), pilot (of the key's bucket), token_offset (in ids, from the shard's start),
    n_tokens, ids (little-endian, 2 bytes each, or 4 if the vocabulary has more than 65,536). shard_of(doc_id,
    n_shards) is the key's shard; pack_shards makes one payload and one index of each shard, in which
    find (one key) and lookup (a table of keys) read in constant time a key.

    The key is (doc_id, copy): rows that repeat a doc_id are all kept and numbered from 0, by length,
    then ids. Rows with a null doc_id are kept, spread over the shards by what they hold, and numbered within
    each; they are read by shard. Null text: null ids and no tokens; empty text: empty
    ids. Texts are encoded whole, special tokens in them as ordinary text. Empty table: empty result.
    Other columns are ignored, whatever their names. Shards hold docs_per_shard keys on average; their
    number follows the row count, so that a shard's size doesn't grow with the input.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = max(1, -(-base.count() // docs_per_shard))
    ranks = load_ranks(vocabulary)
    shared = spark.sparkContext.broadcast(ranks)
    ids = base.mapInArrow(_encode(shared, "<u2" if max(ranks.values()) < 65536 else "<u4", shards), "shard int, doc_id bigint, ids binary, n_tokens bigint")
    return ids.groupBy("shard").applyInArrow(_shard_rows, ROWS).select("shard", F.lit(shards).alias("n_shards"), *COLUMNS[1:])


class ShardReader:
    """Constant-time access to one shard of token_index (rows: its pyarrow table, or as packed)."""

    def __init__(self, pilots: np.ndarray, fingerprints: np.ndarray, offsets: np.ndarray, payload: bytes, width: int = 2) -> None:
        self.pilots, self.fingerprints, self.offsets, self.payload, self.width = pilots, fingerprints, offsets, payload, width

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of the key, or None if it isn't in the shard (with a chance of error of 2**-32)."""
        if not len(self.fingerprints):
            return None
        h = key_hash(np.array([doc_id or 0], np.int64), np.array([copy]), np.array([doc_id is None]))
        slot = find_slot(int(h[0]), self.pilots, len(self.fingerprints))
        if not 0 <= slot < len(self.fingerprints) or self.fingerprints[slot] != fingerprint(h)[0]:
            return None
        a, b = self.offsets[slot : slot + 2]
        return np.frombuffer(self.payload, f"<u{self.width}")[a:b]


def _pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("slot")
    n = rows.num_rows
    null = rows.column("doc_id").is_null().to_numpy()
    h = key_hash(rows.column("doc_id").fill_null(0).to_numpy().astype(np.int64), rows.column("copy").to_numpy(), null)
    pilots = np.zeros(max(1, -(-n // KEYS_PER_BUCKET)), np.int64)
    pilots[(h % np.uint64(len(pilots))).astype(np.int64)] = rows.column("pilot").to_numpy()
    offsets = np.concatenate([[0], np.cumsum(rows.column("n_tokens").to_numpy())]).astype(np.int64)
    data = [pilots.astype("<i8").tobytes(), rows.column("fingerprint").to_numpy().astype("<i8").tobytes(), offsets.astype("<i8").tobytes()]
    payload = b"".join(x or b"" for x in rows.column("ids").to_pylist())
    return pa.table({"shard": rows.column("shard").slice(0, 1), "n_shards": rows.column("n_shards").slice(0, 1), "n_keys": pa.array([n], pa.int64()), "pilots": pa.array(data[:1], pa.binary()), "fingerprints": pa.array(data[1:2], pa.binary()), "offsets": pa.array(data[2:], pa.binary()), "payload": pa.array([payload], pa.binary())})


PACKED = "shard int, n_shards int, n_keys bigint, pilots binary, fingerprints binary, offsets binary, payload binary"


def pack_shards(index: DataFrame) -> DataFrame:
    """One row for each shard: n_shards, n_keys, pilots, fingerprints, offsets, payload (all little-endian)."""
    return index.groupBy("shard").applyInArrow(_pack, PACKED)


def read_packed(row) -> ShardReader:
    """A reader of one row of pack_shards."""
    pilots, fingerprints, offsets = (np.frombuffer(row[c], "<i8") for c in ("pilots", "fingerprints", "offsets"))
    width = len(row["payload"]) // int(offsets[-1]) if offsets[-1] else 2
    return ShardReader(pilots, fingerprints, offsets, row["payload"], width)


def find(packed: DataFrame, doc_id: int, copy: int = 0) -> np.ndarray | None:
    """The ids of one key, from the one row that can hold it; None if it isn't there. With packed written
    in the order of shard, the filter reads one row group."""
    any_row = packed.select("n_shards").head()
    if any_row is None:
        return None
    shard = int(shard_of(np.array([doc_id]), np.array([False]), any_row["n_shards"])[0])
    row = packed.filter(F.col("shard") == shard).head()
    return read_packed(row).get(doc_id, copy) if row else None


def _lookup(key: tuple, wanted: pa.Table, shard: pa.Table) -> pa.Table:
    reader = read_packed({c: shard.column(c)[0].as_py() for c in ("pilots", "fingerprints", "offsets", "payload")}) if shard.num_rows else None
    found = [reader.get(d, c) if reader else None for d, c in zip(wanted.column("doc_id").to_pylist(), wanted.column("copy").to_pylist())]
    raw = [None if x is None else x.tobytes() for x in found]
    return pa.table({"doc_id": wanted.column("doc_id"), "copy": wanted.column("copy"), "n_tokens": pa.array([None if x is None else len(x) for x in found], pa.int64()), "ids": pa.array(raw, pa.binary())})


def lookup(packed: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, n_tokens, ids) of every row of keys (doc_id, copy); nulls where there is no such
    key. A shard goes to one task once, with the keys that it may hold."""
    shards = (packed.select("n_shards").head() or [1])[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = shard_of(b.column(0).to_numpy(zero_copy_only=False), np.zeros(len(b), bool), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0), b.column(1)], ["shard", "doc_id", "copy"])

    rows = keys.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("copy").cast("int").alias("copy")).filter("doc_id IS NOT NULL AND copy IS NOT NULL")
    placed = rows.mapInArrow(place, "shard int, doc_id bigint, copy int")
    return placed.groupBy("shard").cogroup(packed.groupBy("shard")).applyInArrow(_lookup, "doc_id bigint, copy int, n_tokens bigint, ids binary")


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"))
