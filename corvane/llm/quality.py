"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse random index vector; its word vector is the sum of the index vectors of its
neighbours (two to each side) over the whole corpus. All words of the corpus are counted; those that
make up MIN_SHARE of it have a vector of their own, rarer ones share BUCKETS vectors by their hash. A
document is the mean and the spread of its tokens' vectors. The network has one hidden layer and its
probabilities are calibrated by a temperature fitted on held-out labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corvane.llm import kernel
from corvane.llm.tables import drop, keep, small_batches, table

#: Least share of all tokens of a word with a vector of its own: there are 1 / MIN_SHARE such words at
#: most, however large the corpus is, so that their table can go to every executor.
MIN_SHARE = 2e-6
BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 14, 48, 4, 2
BLOCKS, FAN_IN = 16, 64
MAX_TRAIN = 20_000
TOKENS_AT_ONCE = 1 << 16
HELD_WORDS = 1 << 19


class Vocabulary:
    """Places of tokens: 0 .. BUCKETS - 1 for rare words by hash, then the words (sorted hashes)."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.size = BUCKETS + len(words)
        slot = (words >> np.uint64(44)).astype(np.int64)
        #: by the first 20 bits: the one word there (-1 none, -2 several)
        self.direct = np.full(1 << 20, -1, np.int32)
        self.direct[slot] = np.arange(len(words))
        self.direct[slot[1:][slot[1:] == slot[:-1]]] = -2

    def places(self, hashes: np.ndarray) -> np.ndarray:
        out = (hashes >> np.uint64(50)).astype(np.int32)
        if not len(self.words):
            return out
        at = self.direct[(hashes >> np.uint64(44)).astype(np.int64)]
        several = np.flatnonzero(at == -2)
        at[several] = np.minimum(np.searchsorted(self.words, hashes[several]), len(self.words) - 1)
        some = np.flatnonzero(at >= 0)
        some = some[self.words[at[some]] == hashes[some]]
        out[some] = BUCKETS + at[some]
        return out


def index_vectors(hashes: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, signs), NONZERO of them for each of hashes (words', or bucket numbers)."""
    r = kernel.mix(hashes[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64) + np.uint64(seed << 32))
    return (r % np.uint64(DIMENSIONS)).astype(np.int32), np.where(r >> np.uint64(63), 1.0, -1.0)


def _tokens(texts: list[str | None]) -> kernel.Tokens:
    return kernel.tokenize(texts, punctuation=True, lowered=False)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): counts of the words, summed over about HELD_WORDS distinct ones at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, which = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(which, np.concatenate([n for _, n in held])).astype(np.int64)

    def batch() -> pa.RecordBatch:
        words, n = held[0]
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    for texts in (texts for b in batches for _, _, texts in kernel.chunks(b.column(0))):
        held.append(np.unique(_tokens(texts).hash, return_counts=True))
        if sum(len(w) for w, _ in held) > HELD_WORDS:
            held[:] = [merged()]
            if len(held[0][0]) > HELD_WORDS // 2:
                yield batch()
                held.clear()
    if held:
        held[:] = [merged()]
        yield batch()


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The words of docs that make up MIN_SHARE of its tokens."""
    counts = keep(docs.select("text").mapInArrow(_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).head()[0] or 0
    words = counts.filter(F.col("n") >= MIN_SHARE * total).select("word").toArrow().column("word").to_numpy()
    drop(counts)
    return Vocabulary(np.sort(words.view(np.uint64)))


def _count(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        places, signs = index_vectors(np.concatenate([np.arange(BUCKETS, dtype=np.uint64), known.words]))
        # a column for each place and sign, so that plain counting is enough; a word's columns in one number
        columns = np.ascontiguousarray(places + DIMENSIONS * (signs < 0), np.int16).view(np.uint64).ravel()
        total = np.zeros(known.size * 2 * DIMENSIONS, np.int32)
        any_rows = False
        for texts in (texts for b in batches for _, _, texts in kernel.chunks(b.column(0), kernel.CHUNK // 2)):
            any_rows = True
            tokens = _tokens(texts)
            ids, doc = known.places(tokens.hash), tokens.doc
            cells = []
            for step in range(1, REACH + 1):
                near = doc[step:] == doc[:-step]
                a, b = ids[step:][near], ids[:-step][near]
                for centre, other in ((a, b), (b, a)):
                    cells.append((columns[other].view(np.int16).reshape(-1, NONZERO) + (centre * np.int32(2 * DIMENSIONS))[:, None]).ravel())
            # sorted first, so that no array of the table's size is made for a chunk
            found, times = np.unique(np.concatenate(cells), return_counts=True)
            total[found] += times.astype(np.int32)
        if any_rows:
            plus, minus = np.moveaxis(total.reshape(known.size, 2, DIMENSIONS), 1, 0)
            # float32 halves what is moved; whole numbers up to 2**24 stay exact, larger ones to 7 digits
            parts = np.array_split((plus - minus).ravel().astype(np.float32), BLOCKS)
            part = kernel.mix(np.array([hash(total.tobytes()) & (2**63 - 1)], np.uint64))[0] >> np.uint64(1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([int(part)] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "part", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("sums").to_pylist())
    return pa.table({"block": table.column("block").slice(0, 1), "part": table.column("part").slice(0, 1), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def word_vectors(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and a vector of unit length for each of its places, from every token of every
    document. Partitions sum their own table; the sums are added FAN_IN at a time."""
    known = vocabulary(docs)
    parts = docs.select("text").mapInArrow(_count(docs.sparkSession.sparkContext.broadcast(known)), "block int, part bigint, sums binary")
    left = max(1, docs.rdd.getNumPartitions())
    schema = parts.schema
    while True:
        groups = -(-left // FAN_IN)
        parts = parts.groupBy("block", F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(_add, schema)
        if groups == 1:
            break
        left = groups
    with small_batches(docs.sparkSession):
        blocks = {row["block"]: np.frombuffer(row["sums"], np.float32).astype(np.float64) for row in parts.toLocalIterator()}
    total = np.concatenate([blocks[i] for i in range(BLOCKS)]) if blocks else np.zeros(known.size * DIMENSIONS)
    total = total.reshape(known.size, DIMENSIONS)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return known, (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(texts: list[str | None], known: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each text's token vectors; zeros without tokens."""
    tokens = _tokens(texts)
    ids, doc = known.places(tokens.hash), tokens.doc
    d = vectors.shape[1]
    sums, squares = np.zeros((len(texts), d)), np.zeros((len(texts), d))
    for at in range(0, len(ids), TOKENS_AT_ONCE):
        part, own = vectors[ids[at : at + TOKENS_AT_ONCE]], doc[at : at + TOKENS_AT_ONCE]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[own[first]] += np.add.reduceat(part, first, axis=0)
        squares[own[first]] += np.add.reduceat(part * part, first, axis=0)
    n = np.maximum(tokens.counts, 1)[:, None]
    mean = sums / n
    return np.hstack([mean, np.sqrt(np.maximum(squares / n - mean**2, 0))]).astype(np.float32)


@dataclass
class Network:
    """x -> sigmoid(relu(z W1 + b1) w2 + b2) / temperature), z being x standardised."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 0) -> Network:
        """Adam on the class-balanced log loss; a fifth of the rows is held out for the temperature."""
        rng = np.random.default_rng(seed)
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        if not len(x):
            d = x.shape[1] if x.ndim == 2 else 0
            return cls(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), 4.0)
        order = rng.permutation(len(x))
        held, own = order[: len(x) // 5], order[len(x) // 5 :]
        mean, scale = x[own].mean(0), x[own].std(0) + 1e-4
        net = cls(mean, scale, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), 0.0)
        z = (x - mean) / scale
        share = np.clip(y[own].mean(), 1e-3, 1 - 1e-3)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        names, first, second, t = ("w1", "b1", "w2", "b2"), {}, {}, 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
                a = z[batch] @ net.w1 + net.b1
                h = np.maximum(a, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30)))
                g = (p - y[batch]) * weight[batch] / len(batch)
                gh = np.outer(g, net.w2) * (a > 0)
                grads = {"w1": z[batch].T @ gh + decay * net.w1, "b1": gh.sum(0), "w2": h.T @ g + decay * net.w2, "b2": g.sum()}
                t += 1
                for k in names:
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * grads[k]
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * grads[k] ** 2
                    setattr(net, k, getattr(net, k) - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8))
        # the balanced loss is undone by the prior, then the temperature by the least held-out log loss
        net.b2 += float(np.log(share / (1 - share)))
        if len(held):
            raw = net.logits(x[held])
            best = []
            for temperature in np.geomspace(0.25, 8, 41):
                p = np.clip(1 / (1 + np.exp(-np.clip(raw / temperature, -30, 30))), 1e-6, 1 - 1e-6)
                best.append((-(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean(), temperature))
            net.temperature = float(min(best)[1])
        return net


def _pool_rows(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in kernel.chunks(batch.column(1)):
                x = pool(texts, *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(list(x), pa.list_(pa.float32()))], ["y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_train: int = MAX_TRAIN) -> tuple[Vocabulary, np.ndarray, Network]:
    """(vocabulary, word vectors, network). The vectors come from all documents; the network from the
    labelled ones, or, of more than max_train, those of the least hash of doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known, vectors = word_vectors(docs)
    labelled = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.avg("y").alias("y"))
    chosen = keep(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "labels")
    shared = spark.sparkContext.broadcast((known, vectors))
    with small_batches(spark):
        rows = docs.filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("y", "text").mapInArrow(_pool_rows(shared), "y double, x array<float>").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(rows.num_rows, 2 * DIMENSIONS)
    y = rows.column("y").to_numpy()
    order = np.lexsort((*x.T[:4], y)) if len(x) else np.arange(0)
    return known, vectors, Network.fit(x[order], (y[order] >= 0.5).astype(float))


def _probabilities(texts: list[str | None], model: tuple[Vocabulary, np.ndarray, Network]) -> np.ndarray:
    known, vectors, net = model
    return np.where([bool(t and not t.isspace()) for t in texts], net.probability(pool(texts, known, vectors)), 0.0).astype(np.float64)


def _score(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in kernel.chunks(batch.column("text")):
                p = _probabilities(texts, shared.value)
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns), pa.array(p)], [*batch.schema.names, "p_quality"])

    return run


def p_quality(docs: DataFrame, model: tuple[Vocabulary, np.ndarray, Network]) -> Column:
    """The probability of docs' text as a column: only texts go to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0), *(_probabilities(t, shared.value) for _, _, t in kernel.chunks(texts))]))

    return run(F.col("text").cast("string"))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_train: int = MAX_TRAIN, rows: bool = False) -> DataFrame:
    """(doc_id, p_quality, is_kept) of every row; with rows, the input's columns of the rows that are
    kept.

    p_quality is the calibrated probability that the document is good; it is kept from `threshold` on.
    Null, empty and blank texts have probability 0. Rows with a null doc_id are scored like others but
    aren't trained on. Repeated rows are scored alike; labels that differ for one doc_id are averaged.
    Without labels everything that has tokens is kept. Texts are pooled whole. Empty table: empty result.
    Other columns are ignored, whatever their names, or passed through with rows.
    """
    model = train(docs, labels, "quality", max_train)
    if rows:
        return docs.filter(p_quality(docs, model) >= threshold)
    narrow = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    scored = narrow.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), StructType([*narrow.schema, StructField("p_quality", DoubleType())])).drop("text")
    return scored.select("doc_id", F.round("p_quality", 6).alias("p_quality"), (F.col("p_quality") >= threshold).alias("is_kept"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
