"""The pipeline's stages: each decision takes effect, on what the one before kept."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import minhash, quality, tokens
from corvane.llm.tables import keep, table

DATA = "/root/testdata/sf0.01"


def plain_duplicates(texts: dict[int, str]) -> set[int]:
    """Ids that go: every pair is compared, the groups' least ids stay."""
    ids = sorted(i for i, t in texts.items() if re.search(r"\w", t or ""))
    sigs, _ = minhash.signatures([texts[i] for i in ids])
    bands = sigs.reshape(len(ids), -1, minhash.ROWS)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        near = ((sigs[:x] == sigs[x]).mean(1) >= minhash.THRESHOLD) & (bands[:x] == bands[x]).all(2).any(1)
        for y in np.flatnonzero(near):
            a, b = find(x), find(int(y))
            root[max(a, b)] = min(a, b)
    return {i for k, i in enumerate(ids) if find(k) != k}


def plain_contaminated(texts: dict[int, str], items: list[str]) -> set[int]:
    runs = lambda t: {tuple(w[i : i + 13]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - 12)}
    wanted = set().union(*map(runs, items))
    return {i for i, t in texts.items() if runs(t) & wanted}


def plain_mix(rows: list[tuple[int, str, str, float]]) -> dict[int, int]:
    """Copies by doc_id: (doc_id, source, text, weight) sorted by key, whole epochs, then the prefix."""
    n = {i: len((t or "").split()) for i, _, t, _ in rows}
    have: dict = {}
    for i, s, _, _ in rows:
        have[s] = have.get(s, 0) + n[i]
    shares = {s: math.sqrt(t) for s, t in have.items()}
    out = {}
    for s, t in have.items():
        budget = math.floor(sum(have.values()) * shares[s] / sum(shares.values()))
        epochs, left = divmod(budget, t) if t else (0, budget)
        u = lambda i: (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        order = sorted((-math.log(u(i)) / max(w, 0.05), i) for i, x, _, w in rows if x == s)
        room = left
        for _, i in order:
            room = room - n[i] if room >= n[i] else -1
            out[i] = epochs + (room >= 0)
    return {i: c for i, c in out.items() if c}


def test_stages_one_by_one(spark):
    docs = table(spark, DATA, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, DATA), name)
        seen.append(docs)
    raw, good, unique, clean, mixed, ids = seen
    held = lambda d: {r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()}
    kept = {r["doc_id"] for r in quality.score_quality(raw, table(spark, DATA, "labels")).filter("is_kept").collect()}
    texts = held(good)
    assert set(texts) == kept
    copies = plain_duplicates(texts)
    assert copies and set(held(unique)) == kept - copies
    leaks = plain_contaminated(held(unique), [r["text"] for r in table(spark, DATA, "benchmark").collect()])
    assert leaks and set(held(clean)) == kept - copies - leaks
    model = quality.train(raw, table(spark, DATA, "labels"))
    weighted = [tuple(r) for r in clean.select("doc_id", "source", "text", quality.p_quality(clean, model)).collect()]
    wanted = plain_mix(weighted)
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == wanted
    text = held(clean)
    plain = tokens.Encoder(tokens.load_ranks()).plain
    got = Counter()
    for r in ids.collect():
        assert plain.decode(np.frombuffer(bytes(r["ids"]), "<u2").tolist()) == text[r["doc_id"]]
        got[r["doc_id"]] += 1
    assert got == wanted
    assert all(d.columns == raw.columns for d in seen[1:-1])


def test_batches_that_go_to_python_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([batch.nbytes])], ["n", "size"])

    long_texts = spark.range(0, 4000, 1, 1).select(F.expr("repeat('word ', 1000)").alias("text"))
    seen = keep(long_texts.mapInArrow(sizes, "n bigint, size bigint"), "sizes").collect()
    assert sum(r["n"] for r in seen) == 4000 and max(r["size"] for r in seen) < 3 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_word_vectors_do_not_depend_on_batches(spark):
    docs = table(spark, DATA, "documents")
    words, vectors = quality.word_vectors(docs)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64k")
    try:
        again = quality.word_vectors(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert np.array_equal(words.words, again[0].words) and np.array_equal(vectors, again[1])
