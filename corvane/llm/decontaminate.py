"""Benchmark decontamination by winnowing: least k-gram hash of every window, joined, then extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import kernel
from corvane.llm.tables import keep, table, without_ids

K, SPAN = 8, 13
BROADCAST_PRINTS = 4_000_000
_TOP = np.uint64(2**64 - 1)


def fingerprints(tokens: kernel.Tokens, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, position in words) of the k-grams that are the least of some window of `window`
    consecutive k-grams; all of the equal least ones. A document of fewer k-grams is one window."""
    n = len(tokens.hash)
    offsets = tokens.offsets
    left = offsets[tokens.doc + 1] - np.arange(n)
    total = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        total[: n - j] += tokens.hash[j:] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) & (2**64 - 1))
    at = np.flatnonzero(left >= k)
    h, doc = np.minimum(kernel.mix(total[at]), _TOP - np.uint64(1)), tokens.doc[at]
    # a gap of window - 1 between documents, so that no window has k-grams of two
    step = np.concatenate([[0], np.cumsum(np.diff(doc) != 0)]) if len(at) else np.empty(0, np.int64)
    place = np.arange(len(at)) + step * (window - 1)
    wide = np.full((place[-1] if len(at) else 0) + window, _TOP, np.uint64)
    wide[place] = h
    least = wide.copy()  # least[s]: of the window that begins at s
    for j in range(1, window):
        np.minimum(least[:-j], wide[j:], out=least[:-j])
    # windows that begin before a document hold fewer of its k-grams: only whole ones count, or the only one
    counts = np.bincount(doc, minlength=len(tokens.counts))
    first = np.concatenate([[0], np.cumsum(counts)])
    begin = np.arange(len(at)) - first[doc]
    whole = begin + window <= counts[doc]
    whole |= begin == 0
    starts = np.zeros(len(wide), np.uint64)
    starts[place[whole]] = least[place[whole]]
    chosen = wide[place] == starts[place]
    for j in range(1, window):
        ok = place >= j
        chosen |= ok & (wide[place] == starts[np.maximum(place - j, 0)]) & (begin >= j)
    return h[chosen], doc[chosen], (at - offsets[tokens.doc[at]])[chosen] if len(at) else at


def _prints(k: int, window: int, wanted=None) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value if wanted is not None else None
        if known is not None:
            bits = np.zeros(1 << 22, bool)
            bits[(known >> np.uint64(42)).astype(np.int64)] = True
        for ids, low, texts in ((b.column(0), low, texts) for b in batches for low, _, texts in kernel.chunks(b.column(1))):
            h, doc, pos = fingerprints(kernel.tokenize(texts), k, window)
            if known is not None:
                some = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)])
                some = some[np.isin(h[some], known)]
                h, doc, pos = h[some], doc[some], pos[some]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids.take(pa.array(doc + low)), pa.array(pos.astype(np.int64))], ["print", "id", "pos"])

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_ids, item_ids = batch.column(0), batch.column(1)
        a, b = kernel.tokenize(batch.column(2).to_pylist()), kernel.tokenize(batch.column(3).to_pylist())
        least = batch.column(5)[0].as_py() if len(batch) else 0
        out: list[tuple[int, int, int, int]] = []
        for row, seeds in enumerate(batch.column(4).to_pylist()):
            x, y = (t.hash[o[row] : o[row + 1]] for t, o in ((a, a.offsets), (b, b.offsets)))
            for shift in sorted({s["pos"] - s["item_pos"] for s in seeds}):  # word p of the document is word p - shift of the item
                low, high = max(0, shift), min(len(x), len(y) + shift)
                same = np.concatenate([[False], x[low:high] == y[low - shift : high - shift], [False]])
                edge = np.flatnonzero(same[1:] != same[:-1])
                for s, e in zip(edge[::2], edge[1::2]):
                    if e - s >= least:
                        out.append((row, int(low + s), int(low + e), int(low + s - shift)))
        rows = pa.array([o[0] for o in out], pa.int64())
        cols = [pa.array([o[i] for o in out], pa.int64()) for i in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays([doc_ids.take(rows), item_ids.take(rows), *cols], ["doc_id", "item_id", "start_word", "end_word", "item_start_word"])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, k: int = K, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, item_start_word): every maximal run of at least `span`
    equal words that a document and a benchmark item share; words are numbered from 0 and compared in
    lower case without punctuation.

    Every window of span - k + 1 k-grams keeps its least hash, so that a shared run of `span` words or
    more always shares a fingerprint; hits are extended word by word on the diagonals of the shared
    fingerprints. Up to BROADCAST_PRINTS benchmark fingerprints, counted first, filter the documents'
    fingerprints before they are joined; with more, all are shuffled.

    Null ids take no part, nor do texts of fewer than k words or null. Texts are used whole. Rows that
    repeat an id are each compared; equal result rows come once. Either table empty: empty result. Other
    columns are ignored, whatever their names.
    """
    if span < k:
        raise ValueError("span must be k at least")
    spark = docs.sparkSession
    window = span - k + 1
    a = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    b = benchmark.select(F.col("item_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    schema = "print bigint, id bigint, pos bigint"
    tests = keep(b.mapInArrow(_prints(k, window), schema), "prints")
    n = tests.count()
    wanted = None
    if n <= BROADCAST_PRINTS:
        known = tests.select("print").distinct().toPandas()["print"].to_numpy(np.int64)
        wanted = spark.sparkContext.broadcast(np.sort(known.view(np.uint64)))
    found = a.mapInArrow(_prints(k, window, wanted), schema)
    seeds = found.join(tests.select("print", F.col("id").alias("item_id"), F.col("pos").alias("item_pos")), "print")
    # one seed for each diagonal
    seeds = seeds.groupBy("id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.min(F.struct("pos", "item_pos")).alias("seed"))
    seeds = keep(seeds.groupBy("id", "item_id").agg(F.collect_list("seed").alias("seeds")), "seeds")
    texts = _with_ids(a, seeds.select("id").distinct())
    pairs = seeds.join(texts, "id").join(b.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id")
    pairs = pairs.select(F.col("id").alias("doc_id"), "item_id", "text", "item_text", "seeds", F.lit(span).alias("span"))
    return pairs.mapInArrow(_extend, "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, item_start_word bigint").distinct()


def _with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    small = ids.count() <= BROADCAST_PRINTS // 2
    return rows.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The documents that share no run of `span` words with the benchmark; null ids stay."""
    return without_ids(docs, contaminated_spans(docs, benchmark, **parameters).select("doc_id").distinct())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
