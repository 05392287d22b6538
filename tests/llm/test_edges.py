"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

from __future__ import annotations

import pytest

import corpus_pipeline
from corvane.llm import chat, decontaminate, minhash, mixing, neighbours, pii, quality, substrings, tokens, toxicity

EXTRA = ["sig", "bands", "hub", "id", "print", "y", "p_quality", "row", "_row", "band", "rank", "copy", "_copy", "start", "end", "shard", "tid", "es_key", "bucket", "_gone", "sim", "vec", "worst", "kind", "label", "n", "t", "sys", "w"]
LONG = "long words " * 120_000


def nasty(spark):
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
        (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
        (1, "same id, other text", "en", "a", 1), (None, "no id", None, None, None), (2, None, "en", "a", 1), (3, "", "en", None, 0),
        (4, " \n\t ", "en", "a", 1), (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)), (7, "\U0001f389\U0001f389 é́", None, "b", 1), (8, "...!!!", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in EXTRA})


def labels(spark, empty=False):
    rows = [] if empty else [(1, 1, 0), (1, 0, 1), (5, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark, empty=False):
    rows = [] if empty else [(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, None), (None, "x"), (3, ""), (4, "short")]
    return spark.createDataFrame(rows, "item_id long, text string")


RUNS = {
    "toxicity": lambda s, d, e: toxicity.toxic_documents(d, labels(s, e)),
    "tokens": lambda s, d, e: tokens.token_index(d, docs_per_shard=3),
    "pii": lambda s, d, e: pii.private_spans(d),
    "substrings": lambda s, d, e: substrings.repeated_spans(d),
    "minhash": lambda s, d, e: minhash.near_duplicates(d),
    "deduplicate": lambda s, d, e: minhash.deduplicate(d),
    "decontaminate": lambda s, d, e: decontaminate.contaminated_spans(d, benchmark(s, e)),
    "decontaminated": lambda s, d, e: decontaminate.decontaminate(d, benchmark(s, e)),
    "quality": lambda s, d, e: quality.score_quality(d, labels(s, e)),
    "kept": lambda s, d, e: quality.score_quality(d, labels(s, e), rows=True),
    "mixing": lambda s, d, e: mixing.mix_sources(d),
    "mixed": lambda s, d, e: mixing.mix_sources(d, rows=True),
}


@pytest.mark.parametrize("name", RUNS)
def test_nasty_rows(spark, name):
    found = RUNS[name](spark, nasty(spark), False).collect()
    ids = [r["doc_id"] for r in found]
    expected = {
        "toxicity": [], "pii": [], "tokens": sorted([1, 1, 1, 2, 3, 4, 5, 6, 7, 8, None], key=repr), "minhash": [6], "decontaminate": [1], "substrings": [5, 6],
        "quality": sorted([1, 1, 1, 2, 3, 4, 5, 6, 7, 8, None], key=repr), "deduplicate": sorted([1, 1, 2, 3, 4, 5, 7, 8, None], key=repr), "decontaminated": sorted([2, 3, 4, 5, 6, 7, 8, None], key=repr),
    }
    if name in expected:
        assert sorted(ids, key=repr) == expected[name]
    if name == "substrings":
        assert {(r["start_word"], r["end_word"]) for r in found} == {(0, 240_000)}
    if name in ("deduplicate", "decontaminated", "kept", "mixed"):
        assert set(EXTRA) <= set(found[0].asDict()) and found[0]["hub"] == "clash"


@pytest.mark.parametrize("targets", [None, {"a": 1.0, "b": 3.0}, {None: 1.0}, {"a": 0.0}])
def test_mixing_of_nasty_rows_matches_sql(spark, targets):
    import duckdb

    docs = nasty(spark)
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "source", "text").toPandas().astype({"doc_id": "Int64"}))
    given = None
    if targets is not None:
        db.execute("CREATE TABLE targets (source VARCHAR, weight DOUBLE)")
        db.executemany("INSERT INTO targets VALUES (?, ?)", list(targets.items()))
        given = spark.createDataFrame(list(targets.items()), "source string, weight double")
    want = sorted(db.execute(mixing.oracle_sql(targets is not None)).fetchall(), key=repr)
    assert sorted((tuple(r) for r in mixing.mix_sources(docs, given).collect()), key=repr) == want
    assert mixing.mix_sources(docs, given, rows=True).count() == sum(r[3] for r in want)


def test_kept_rows_are_those_that_score(spark):
    docs = nasty(spark)
    kept = sorted((r["doc_id"] for r in quality.score_quality(docs, labels(spark), rows=True).collect()), key=repr)
    scored = quality.score_quality(docs, labels(spark)).collect()
    assert kept == sorted((r["doc_id"] for r in scored if r["is_kept"]), key=repr)
    assert {r["doc_id"] for r in scored if r["p_quality"] == 0} >= {2, 3, 4} and not {2, 3, 4} & set(kept)
    assert len({r["p_quality"] for r in scored if r["doc_id"] in (5, 6)}) == 1


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(spark, name):
    assert RUNS[name](spark, nasty(spark).limit(0), True).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "quality", "decontaminate"])
def test_without_labels_or_benchmark(spark, name):
    RUNS[name](spark, nasty(spark), True).collect()


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 0.1]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, []), (8, [1.0, 0.1]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in EXTRA})
    got = sorted((r["vec_id"], r["rank"], r["neighbour_id"]) for r in neighbours.nearest_neighbours(df, 3).collect())
    assert got == [(1, 1, 2), (1, 2, 8), (2, 1, 8), (2, 2, 1), (8, 1, 2), (8, 2, 1)]  # 2 and 8 are equal: the least id first
    assert neighbours.nearest_neighbours(df.limit(0)).collect() == []


def test_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, None, None), (1, 1, None, None), (1, None, "assistant", ""), (None, 0, "user", "x"), (2, 0, "system", "only"), (3, 0, "assistant", LONG[:5000]), (3, 1, "user", "y")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in EXTRA})
    got = chat.chat_windows(df, budget=50).collect()
    assert len([r for r in got if r["conv_id"] == 1]) == 4 and len([r for r in got if r["conv_id"] == 2]) == 1
    assert {r["window_no"] for r in got if r["conv_id"] == 3} == {0, 1}
    assert chat.chat_windows(df.limit(0)).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_survive_nasty_rows(spark, tmp_path, k):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    nasty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = nasty(spark)
    for d in (docs, docs.limit(0)):
        out = corpus_pipeline.STAGES[k][1](spark, d, str(tmp_path))
        rows = out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in d.collect()}
