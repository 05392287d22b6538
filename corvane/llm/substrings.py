"""Substring dedup: FM-indexes over shards, streamed by backward search for matching statistics.

A passage of SPAN words that occurs twice holds a winnowed fingerprint that occurs twice. Occurrences
of repeated fingerprints are cut out with SPAN - K words to each side and sent to the fingerprint's
shard. A shard indexes its stretches (suffix array, Burrows-Wheeler transform in a bit-packed wavelet
matrix) and streams them through backward search: for every word, the longest match from there on that
occurs at two places at least. Matches of SPAN words or more make the result. A print that would fill a
shard by itself (a licence line in every tenth document) has no shard: the SPAN-word runs around its
occurrences are hashed instead, and those that occur twice make the same result in any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm import kernel
from corvane.llm.decontaminate import fingerprints
from corvane.llm.tables import BROADCAST_IDS, drop, keep, table

SPAN, K = 50, 12
SHARD_WORDS = 1 << 20
#: Words of a piece that is streamed at once; at least twice the span.
PIECE = 256
#: Occurrences of a print beyond which it has no shard.
HOT = SHARD_WORDS // (2 * SPAN - K)


class WaveletMatrix:
    """Bit-packed wavelet matrix: rank(symbol, i) counts a symbol before place i, for whole arrays."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        x = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            packed = np.zeros(-(-len(bit) // 64) * 8 + 8, np.uint8)
            part = np.packbits(bit, bitorder="little")
            packed[: len(part)] = part
            words = packed.view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int32)
            self.bits.append(words)
            self.sums.append(np.cumsum(counts, dtype=np.int32) - counts)
            self.zeros.append(int(len(bit) - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        # where each symbol's run begins at the last level
        order = np.argsort(x, kind="stable")
        values, first = np.unique(x[order], return_index=True)
        self.start = np.zeros(int(symbols.max(initial=0)) + 2, np.int64)
        self.start[values] = order[first]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        i = place
        for depth in range(self.levels):
            bit = (symbol >> (self.levels - 1 - depth) & 1).astype(bool)
            word = i >> 6
            below = self.bits[depth][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.sums[depth][word] + np.bitwise_count(below)
            i = np.where(bit, self.zeros[depth] + ones, i - ones)
        return i - self.start[symbol]


class FMIndex:
    """Over regions (arrays of codes from 1 on), with what matching statistics need: the wavelet matrix
    of the transform, counts of smaller symbols, and the longest common prefixes of neighbours in the
    suffix order with their nearest smaller values."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray) -> None:
        """text: codes; every region ends with a 0. lengths: of the regions, with their zeros."""
        n = len(text)
        region = np.repeat(np.arange(len(lengths)), lengths)
        end = np.repeat(np.cumsum(lengths) - 1, lengths)
        at = np.arange(n)
        pad = np.concatenate([text, np.zeros(3, text.dtype)]).astype(np.int64)
        room = int(text.max(initial=0)).bit_length() + 1
        width = max(1, min(3, 62 // room))
        key = pad[:n].copy()
        for j in range(1, width):
            key = key << room | np.where(at + j <= end, pad[j : n + j], 0)
        order = np.argsort(key, kind="stable")
        ranks, h = [], width
        steps = []
        while True:
            sorted_key = key[order]
            new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            ranks.append(rank.astype(np.int32))
            steps.append(h)
            if new.all():
                break
            follow = np.where(at + h <= end, rank[np.minimum(at + h, n - 1)] + len(lengths), region)
            key = rank * (n + len(lengths)) + follow
            order = np.argsort(key, kind="stable")
            h *= 2
        suffix = order
        a, b = suffix[:-1].copy(), suffix[1:].copy()
        common = np.zeros(max(0, n - 1), np.int64)
        for rank, step in zip(reversed(ranks[:-1]), reversed(steps[:-1])):
            while True:
                ok = (a + step <= n - 1) & (b + step <= n - 1)
                same = ok & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
                if not same.any():
                    break
                common += step * same
                a, b = a + step * same, b + step * same
                if step != steps[max(0, len(steps) - 2)]:
                    break
        for _ in range(width):
            same = (a < n) & (b < n)
            same &= (pad[np.minimum(a, n)] == pad[np.minimum(b, n)]) & (pad[np.minimum(a, n)] > 0)
            common += same
            a, b = a + same, b + same
        common = np.minimum(common, np.minimum(end[suffix[:-1]] - suffix[:-1], end[suffix[1:]] - suffix[1:]))
        self.lcp = np.concatenate([[-1], common, [-1]])
        self.before = self._smaller(self.lcp, -1)
        self.after = self._smaller(self.lcp, 1)
        transform = np.where(suffix > 0, text[suffix - 1], 0)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))])
        self.wavelet = WaveletMatrix(transform.astype(np.int64))
        self.n = n

    @staticmethod
    def _smaller(values: np.ndarray, side: int) -> np.ndarray:
        """The nearest place to a side with a smaller value, by pointer jumping; ends stay in bounds."""
        n = len(values)
        to = np.clip(np.arange(n) + side, 0, n - 1)
        live = np.flatnonzero(values[to] >= values)
        live = live[(live != 0) & (live != n - 1)]
        while len(live):
            to[live] = to[to[live]]
            live = live[values[to[live]] >= values[live]]
        return to

    def matching_statistics(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For every place of the pieces codes[start:stop] the length of the longest match from there to
        the piece's end at most that occurs twice or more. All pieces go at once, from right to left."""
        out = np.zeros(len(codes), np.int64)
        i, q = stop.copy(), np.zeros(len(start), np.int64)
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        live = np.flatnonzero(i > start)
        while len(live):
            c = codes[i[live] - 1].astype(np.int64)
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
            base = self.smaller[c]
            new_low, new_high = base + both[: len(live)], base + both[len(live) :]
            fits = new_high - new_low >= 2
            on = live[fits]
            low[on], high[on] = new_low[fits], new_high[fits]
            q[on] += 1
            i[on] -= 1
            out[i[on]] = q[on]
            off = live[~fits]
            none = off[q[off] == 0]
            i[none] -= 1
            some = off[q[off] > 0]
            left, right = self.lcp[low[some]], self.lcp[high[some]]
            depth = np.maximum(left, right)
            to_root = depth <= 0
            low[some] = np.where(to_root, 0, np.where(left == depth, self.before[low[some]], low[some]))
            high[some] = np.where(to_root, self.n, np.where(right == depth, self.after[high[some]], high[some]))
            q[some] = np.maximum(depth, 0)
            live = live[i[live] > start[live]]
        return out


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose print occurs more than once; sorted by print."""
    last = None
    for batch in batches:
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        h = batch.column(0).to_numpy()
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        # the last print may go on in the next batch: two of its rows are enough to know
        tail = int(np.searchsorted(h, h[-1], side="left"))
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        held = len(h) - 1 if len(h) - tail > 1 else tail
        yield batch.filter(pa.array(many[:held].tolist() + [False] * (len(h) - held)))
        last = batch.slice(held)
        if len(h) - tail > 1:
            # remember that the print is repeated by keeping two rows, of which one is out already
            first_out = batch.slice(tail, 1)
            last = pa.Table.from_batches([first_out, last]).combine_chunks().to_batches()[0]
            last = last.set_column(2, "pos", pa.array([-1] + last.column(2).to_pylist()[1:], pa.int64()))
    if last is not None:
        h = last.column(0).to_numpy()
        same = h[1:] == h[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        yield last.filter(pa.array(many))


def _prints(span: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, low, texts in ((b.column(0), low, texts) for b in batches for low, _, texts in kernel.chunks(b.column(1))):
            h, doc, pos = fingerprints(kernel.tokenize(texts), K, span - K + 1)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids.take(pa.array(doc + low)), pa.array(pos.astype(np.int64))], ["print", "tid", "pos"])

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for digests, low, texts in ((b.column(0), low, texts) for b in batches for low, _, texts in kernel.chunks(b.column(1))):
        yield pa.RecordBatch.from_arrays([digests.slice(low, len(texts)), pa.array(kernel.tokenize(texts).counts.astype(np.int64))], ["digest", "n"])


def _windows(span: int, shards: int) -> callable:
    """Cuts the stretches out: (shard, tid, start, words)."""
    side = span - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, high, texts in ((b, *c) for b in batches for c in kernel.chunks(b.column(1))):
            tokens = kernel.tokenize(texts)
            offsets = tokens.offsets
            codes = (tokens.hash >> np.uint64(32)).astype("<u4")
            lists = batch.column(2).slice(low, high - low)
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            row = np.repeat(np.arange(len(texts)), counts)
            row = row[flat.field("hot").to_numpy(zero_copy_only=False) == 0]
            flat = flat.filter(pc.invert(flat.field("hot")))
            pos, shard = flat.field("pos").to_numpy(), flat.field("print").to_numpy()
            begin = np.maximum(pos - side, 0)
            stop = np.minimum(pos + K + side, tokens.counts[row])
            base = offsets[row]
            words = [codes[s:e].tobytes() for s, e in zip((base + begin).tolist(), (base + stop).tolist())]
            place = (kernel.mix(shard.view(np.uint64)) % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(0).take(pa.array(row + low)), pa.array(begin.astype(np.int64)), pa.array(words, pa.binary())], ["shard", "tid", "start", "words"])

    return run


def _grams(span: int) -> callable:
    """Hashes of the runs of `span` words that hold a hot print: (print, tid, pos), as of prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, high, texts in ((b, *c) for b in batches for c in kernel.chunks(b.column(1))):
            tokens = kernel.tokenize(texts)
            lists = batch.column(2).slice(low, high - low)
            row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            hot = flat.field("hot").to_numpy(zero_copy_only=False)
            row, pos = row[hot], flat.field("pos").to_numpy()[hot]
            first, last = np.maximum(pos - (span - K), 0), np.minimum(pos, tokens.counts[row] - span)
            n = np.maximum(last - first + 1, 0)
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = np.repeat(row, n)
            key = np.unique(own << 40 | at)
            own, at = key >> 40, key & ((1 << 40) - 1)
            h = np.zeros(len(at), np.uint64)
            begin = tokens.offsets[own] + at
            for j in range(span):
                h = kernel.mix(h) ^ tokens.hash[begin + j]
            yield pa.RecordBatch.from_arrays([pa.array(kernel.mix(h).view(np.int64)), batch.column(0).take(pa.array(own + low)), pa.array(at)], ["print", "tid", "pos"])

    return run


def shard_matches(tid: np.ndarray, start: np.ndarray, words: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tid, from, to) of the matches of one shard's stretches."""
    length = np.fromiter((len(w) // 4 for w in words), np.int64, len(words))
    order = np.lexsort((length, start, tid))  # so that the stops of a text's stretches ascend, too
    tid, start, length = tid[order], start[order], length[order]
    raw = np.frombuffer(b"".join(words[i] for i in order), "<u4")
    # overlapping stretches of one text become one region
    stop = start + length
    fresh = np.concatenate([[True], (tid[1:] != tid[:-1]) | (start[1:] > stop[:-1])])
    skip = np.where(fresh, 0, np.concatenate([[0], stop[:-1]]) - start)
    skip = np.minimum(np.maximum(skip, 0), length)
    first = np.cumsum(length) - length
    kept = length - skip
    inside = np.repeat(first + skip - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())
    values, codes = np.unique(raw[inside], return_inverse=True)
    sizes = np.add.reduceat(kept, np.flatnonzero(fresh))
    text = np.zeros(len(codes) + len(sizes), np.int64)
    at = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)
    text[at] = codes + 1
    index = FMIndex(text, sizes + 1)
    region_start = np.cumsum(sizes + 1) - (sizes + 1)
    wide = max(PIECE, 2 * span)
    pieces = np.maximum(1, -(-(sizes - span + 1) // (wide - span + 1)))
    of = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = region_start[of] + nth * (wide - span + 1)
    end = np.minimum(begin + wide, region_start[of] + sizes[of])
    # pieces overlap, so each has its own copy of its words
    size = end - begin
    first = np.cumsum(size) - size
    flat = np.repeat(begin - first, size) + np.arange(size.sum())
    found = index.matching_statistics(text[flat], first, first + size)
    hit = np.flatnonzero(found >= span)
    piece = np.searchsorted(first, hit, side="right") - 1
    where = flat[hit] - region_start[of[piece]] + start[np.flatnonzero(fresh)][of[piece]]
    owner = tid[np.flatnonzero(fresh)][of[piece]]
    # runs of hits in a piece make one interval
    until = where + found[hit]
    new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (where[1:] > until[:-1])]) if len(hit) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    return owner[heads], where[heads], np.maximum.reduceat(until, heads) if len(hit) else until


def _match(span: int) -> callable:
    def run(rows: pa.Table) -> pa.Table:
        tid, begin, end = shard_matches(rows.column("tid").to_numpy(), rows.column("start").to_numpy(), rows.column("words").to_pylist(), span)
        return pa.table({"tid": pa.array(tid, pa.int64()), "start_word": pa.array(begin, pa.int64()), "end_word": pa.array(end, pa.int64())})

    return run


def _twice(prints: DataFrame) -> DataFrame:
    """The rows (print, tid, pos) whose print occurs more than once."""
    return prints.repartition("print").sortWithinPartitions("print").mapInArrow(_repeated, "print bigint, tid bigint, pos bigint").filter("pos >= 0")


def repeated_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, start_word, end_word): the maximal stretches of each document that are covered by
    passages of `span` words or more that occur at another place too, in this document or another.
    Words are numbered from 0 and compared in lower case without punctuation.

    Copies of a text are found by digest; one of them is indexed, and all are reported whole. Null texts
    and rows with a null doc_id take no part; texts of fewer than `span` words have no result. Rows that
    repeat doc_id and text are copies of each other. Texts are indexed whole. Empty table: empty result.
    Other columns are ignored, whatever their names.
    """
    if span <= K:
        raise ValueError(f"span must be more than {K}")
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    digests = keep(base.select("doc_id", F.md5("text").alias("digest")), "digests")
    groups = digests.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    many = keep(digests.join(groups.filter("copies > 1"), "digest").select("doc_id", "digest", "first"), "copies")
    gone = many.filter("doc_id != first").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    small = gone.count() <= BROADCAST_IDS
    single = base.join(F.broadcast(gone) if small else gone, (F.col("doc_id") == F.col("_id")) & (F.md5("text") == F.col("_digest")), "left_anti")
    keyed = single.select(F.xxhash64("doc_id", "text").alias("tid"), "doc_id", "text")
    prints = keyed.select("tid", "text").mapInArrow(_prints(span), "print bigint, tid bigint, pos bigint")
    repeated = _twice(prints)
    spot = F.struct("pos", "print", F.lit(False).alias("hot"))
    places = keep(repeated.groupBy("tid").agg(F.collect_list(spot).alias("places")), "places")
    total = places.agg(F.sum(F.size("places"))).head()[0] or 0
    shards = max(1, -(-total * (2 * span - K) // SHARD_WORDS))
    single_places = places.select("tid", F.explode("places").alias("p")).select("tid", "p.pos", "p.print")
    hot = keep(single_places.groupBy("print").count().filter(F.col("count") > HOT).select("print", F.lit(True).alias("hot")), "hot")
    some_hot = not hot.isEmpty()
    if some_hot:
        marked = single_places.join(hot, "print", "left").groupBy("tid").agg(F.collect_list(F.struct("pos", "print", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))
        before, places = places, keep(marked, "marked")
        drop(before)
    texts = keyed.select("tid", "text").join(places, "tid").select("tid", "text", "places")
    cut = texts.mapInArrow(_windows(span, shards), "shard int, tid bigint, start bigint, words binary")
    found = cut.groupBy("shard").applyInArrow(_match(span), "tid bigint, start_word bigint, end_word bigint")
    if some_hot:
        runs = _twice(texts.filter(F.exists("places", lambda p: p["hot"])).mapInArrow(_grams(span), "print bigint, tid bigint, pos bigint"))
        found = found.unionByName(runs.select("tid", F.col("pos").alias("start_word"), (F.col("pos") + span).alias("end_word")))
    found = keep(found, "matches")
    drop(places)
    # overlapping intervals of a text become one
    rows = Window.partitionBy("tid").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(rows.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.distinct().withColumn("new", F.when(reach >= F.col("start_word"), 0).otherwise(1)).withColumn("run", F.sum("new").over(rows))
    merged = runs.groupBy("tid", "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    whole = many.select("doc_id", "digest").distinct()
    ids = keyed.select("tid", "doc_id", F.md5("text").alias("digest")).distinct().join(whole, ["doc_id", "digest"], "left_anti")
    alone = merged.join(ids, "tid").select("doc_id", "start_word", "end_word")
    firsts = many.select(F.col("first").alias("_id"), F.col("digest").alias("_digest")).distinct()
    few = firsts.count() <= BROADCAST_IDS
    texts = base.join(F.broadcast(firsts) if few else firsts, (F.col("doc_id") == F.col("_id")) & (F.md5("text") == F.col("_digest"))).select("_digest", "text")
    counts = texts.mapInArrow(_count_words, "digest string, n bigint").filter(F.col("n") >= span).distinct()
    return alone.unionByName(many.join(counts, "digest").select("doc_id", F.lit(0).cast("bigint").alias("start_word"), F.col("n").alias("end_word"))).distinct()


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
