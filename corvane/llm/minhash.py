"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from corvane.llm import kernel
from corvane.llm.neighbours import _groups
from corvane.llm.tables import drop, keep, table, without_ids

SHINGLE, BINS, ROWS, THRESHOLD = 3, 128, 4, 0.55
STAR_ROUNDS, PIECE, PAIRS = 3, 4096, 50_000


def signatures(texts: list[str | None], shingle: int = SHINGLE, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(signature, has words): a row of 16-bit minima for each text. One hash of each shingle gives its
    bin and its value; an empty bin takes the minimum of the first filled bin in its own fixed random
    order of bins (optimal densification), the same for every document."""
    tokens = kernel.tokenize(texts)
    h, doc = kernel.shingles(tokens, shingle)
    empty = np.uint64(2**64 - 1)
    least = np.full(len(texts) * bins, empty, np.uint64)
    np.minimum.at(least, doc * bins + (h >> np.uint64(57) if bins == 128 else h % np.uint64(bins)).astype(np.int64), h & np.uint64(2**57 - 1))
    least = least.reshape(len(texts), bins)
    filled = least != empty
    some = filled.any(1)
    out = least.copy()
    row, col = np.nonzero(~filled & some[:, None])
    attempt = 0
    while len(row):
        other = (kernel.mix(col.astype(np.uint64) * np.uint64(0x100000001) + np.uint64(attempt << 20)) % np.uint64(bins)).astype(np.int64)
        hit = filled[row, other]
        # the value is tied to the bin it came from and to the attempt, as if it had been hashed there
        out[row[hit], col[hit]] = least[row[hit], other[hit]] + (np.uint64(attempt + 1) << np.uint64(57))
        row, col = row[~hit], col[~hit]
        attempt += 1
    return (kernel.mix(out) >> np.uint64(48)).astype(np.uint16), some


def _sign(rows: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, texts in ((b, low, texts) for b in batches for low, _, texts in kernel.chunks(b.column(1))):
            sig, some = signatures(texts)
            n_bands = sig.shape[1] // rows
            parts = sig[:, : n_bands * rows].reshape(len(texts), n_bands, rows).astype(np.uint64)
            keys = parts[:, :, 0]
            for r in range(1, rows):
                keys = (keys << np.uint64(16) if r < 4 else kernel.mix(keys)) ^ parts[:, :, r]
            keys = kernel.mix(keys) + np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            keep_rows = pa.array(np.flatnonzero(some) + low)
            raw = np.ascontiguousarray(sig[some])
            width = raw.shape[1] * 2
            offsets = np.arange(len(raw) + 1, dtype=np.int32) * width
            binary = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
            flat = pa.array(keys[some].view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * n_bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep_rows), binary, lists], ["doc_id", "sig", "bands"])

    return run


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal bins of two signatures: the Jaccard estimate."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(len(a), -1)
    return pd.Series((x == y).mean(1))


def _verified(edges: DataFrame, sigs: DataFrame) -> DataFrame:
    a = sigs.select(F.col("doc_id").alias("hub"), F.col("sig").alias("sig_a"))
    b = sigs.select(F.col("doc_id").alias("doc_id"), F.col("sig").alias("sig_b"))
    return edges.join(a, "hub").join(b, "doc_id").select("hub", "doc_id", agreement("sig_a", "sig_b").alias("sim"))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root): the least id of each connected component, of the ids in edges (a, b). Large-star
    and small-star steps alternate until nothing changes; every step is a shuffle of the edges only."""
    both = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        # large star: the larger neighbours of a node are linked to the least of its neighbours
        sym = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        large = sym.withColumn("m", low).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: the smaller neighbours of a node, and itself, are linked to the least of them
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct()
        after = keep(small, "edges")
        # done when every node hangs on one root and no root hangs on anything
        open_ones = after.select(F.col("b").alias("a")).distinct().join(after, "a", "left_semi").limit(1).count()
        many = after.groupBy("a").count().filter("count > 1").limit(1).count()
        drop(both)
        both = after
        if not open_ones and not many:
            return both.select(F.col("a").alias("doc_id"), F.col("b").alias("root"))


def _cross(threshold: float) -> callable:
    """Compares all members of every bucket whose roots differ: (a, b), the roots of those that agree.
    Rows come by bucket and root, so that pairs of one root aren't even made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 0, 20_000):
            bucket, root, piece = (rows.column(c).to_numpy() for c in ("bucket", "root", "piece"))
            apart = rows.column("apart").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(len(bucket), -1)
            # every row with those of later roots in its bucket, about PAIRS at a time
            last = np.searchsorted(bucket, bucket, side="right")
            turn = np.flatnonzero(np.concatenate([(bucket[1:] != bucket[:-1]) | (root[1:] != root[:-1]), [True]])) + 1
            begin = turn[np.searchsorted(turn, np.arange(len(bucket)), side="right")]
            after = last - begin
            upto = np.concatenate([[0], np.cumsum(after)])
            low = 0
            while low < len(bucket):
                high = max(low + 1, int(np.searchsorted(upto, upto[low] + PAIRS, side="right")) - 1)
                n = after[low:high]
                i = np.repeat(np.arange(low, high), n)
                j = np.repeat(begin[low:high] - (upto[low:high] - upto[low]), n) + np.arange(len(i))
                ok = ~apart[i] | (piece[i] != piece[j])
                i, j = i[ok], j[ok]
                near = (sig[i] == sig[j]).mean(1) >= threshold
                found = np.unique(np.stack([np.maximum(root[i[near]], root[j[near]]), np.minimum(root[i[near]], root[j[near]])]), axis=1)
                if found.size:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])
                low = high

    return run


def _across(members: DataFrame, sigs: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the roots of groups (doc_id, root) that two members of one bucket (band, doc_id) join.
    Pairs of one group are left out: they can't change it. Buckets of more than PIECE members are split,
    and each pair of pieces is compared in a place of its own."""
    rooted = members.join(groups, "doc_id", "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high")
    rows = rooted.join(mixed.select("band", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "band")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select(F.xxhash64("band", F.least("piece", "other"), F.greatest("piece", "other")).alias("bucket"), "doc_id", "root", "piece", (F.col("piece") != F.col("other")).alias("apart"))
    rows = rows.join(sigs, "doc_id").select("bucket", "root", "piece", "apart", "sig").repartition("bucket").sortWithinPartitions("bucket", "root")
    return rows.mapInArrow(_cross(threshold), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """(doc_id, kept_id, similarity): one row for every document that repeats an earlier one; kept_id is
    the least doc_id of its group, similarity the Jaccard estimate of their 3-word shingles.

    Documents are linked where their signatures agree in at least `threshold` of 128 bins, looked for in
    bands of `rows` bins (32 of 4; any number from 1 to 128); groups are the connected components. A bucket gives one edge for each member, to
    its least one (a star). Members that differ from that hub form the bucket's next star, up to
    STAR_ROUNDS. Then all members of a bucket that are still in different groups are compared with each
    other, whether or not they matched a hub, so that no pair of a bucket is given up.

    Texts without words (null, empty, only punctuation) and rows with a null doc_id take no part. Rows
    that repeat a doc_id with the same text are one document; if the texts differ, each counts and the
    id joins the groups of all. Ties go to the least doc_id. Texts are hashed whole. Empty table: empty
    result. Other columns are ignored, whatever their names.
    """
    if not 1 <= rows <= BINS:
        raise ValueError(f"rows must be 1 to {BINS}")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    sigs = keep(base.mapInArrow(_sign(rows), "doc_id bigint, sig binary, bands array<bigint>"), "signatures")
    # equal signatures first: copies by the thousand become one member of their buckets
    hub = F.min("doc_id").over(Window.partitionBy(F.xxhash64("sig"), "sig"))
    firsts = keep(sigs.select("doc_id", "sig", "bands", hub.alias("hub")), "collapsed")
    drop(sigs)
    same = firsts.filter("doc_id != hub").select("hub", "doc_id", F.lit(1.0).alias("sim")).distinct()
    reps = firsts.filter("doc_id = hub")
    rep_sigs = reps.select("doc_id", "sig").distinct()
    members = keep(reps.select("doc_id", F.explode("bands").alias("band")).distinct().withColumn("n", F.count("*").over(Window.partitionBy("band"))).filter("n > 1").drop("n"), "members")
    pending = members.withColumn("hub", F.min("doc_id").over(Window.partitionBy("band"))).filter("hub != doc_id")
    pending = keep(pending, "buckets")
    good: list[DataFrame] = []
    for turn in range(STAR_ROUNDS):
        checked = keep(_verified(pending.select("hub", "doc_id").distinct(), rep_sigs), "checked")
        good.append(checked.filter(F.col("sim") >= threshold))
        if turn == STAR_ROUNDS - 1:
            break
        failed = checked.filter(F.col("sim") < threshold).select("hub", "doc_id")
        rest = pending.join(failed, ["hub", "doc_id"], "left_semi").select("band", "doc_id")
        rest = rest.withColumn("hub", F.min("doc_id").over(Window.partitionBy("band")))
        after = keep(rest.filter("hub != doc_id"), "buckets")
        drop(pending)
        pending = after
        if pending.isEmpty():
            break
    edges = same
    for x in good:
        edges = edges.unionByName(x)
    edges = keep(edges.filter("hub != doc_id"), "links")
    groups = components(edges.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    across = keep(_across(members, rep_sigs, groups, threshold), "across")
    if not across.isEmpty():
        joined = components(across)  # of roots
        moved = groups.join(joined.select(F.col("doc_id").alias("root"), F.col("root").alias("least")), "root", "left")
        groups = keep(moved.select("doc_id", F.coalesce("least", "root").alias("root")).unionByName(joined), "groups")
    pairs = groups.select(F.col("root").alias("hub"), "doc_id")
    all_sigs = firsts.groupBy("doc_id").agg(F.min("sig").alias("sig"))
    found = _verified(pairs, all_sigs)
    return found.select("doc_id", F.col("hub").alias("kept_id"), F.round("sim", 4).alias("similarity"))


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without those that near_duplicates finds, and with one row of those that repeat
    a doc_id and text. Rows with a null doc_id stay."""
    gone = near_duplicates(docs, **parameters).select("doc_id").distinct()
    left = without_ids(docs, gone)
    twice = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return left
    order = [F.col(f"row.`{c}`") for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]
    packed = left.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text").join(twice, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*order))
    repeated = packed.withColumn("copy", first).filter("copy = 1").select("row.*")
    return without_ids(left, twice).unionByName(repeated)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
