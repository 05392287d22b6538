"""Queries against their SQL on small tables of odd rows, and their steps against plain Python."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.operators import cluster, joins
from corvane.plans import queries as core


def same_as_sql(spark, folder, name, **tables):
    """Runs the query and its SQL over tables (DuckDB's SELECTs) and compares the rows."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = core.QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({core.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    return want


@pytest.mark.parametrize("ids", ["i", "i // 3", "nullif(i // 2, 1)"])
def test_range_innermost_rounds_seconds(spark, tmp_path, ids):
    """Fractions of a second at the ends of the spans, halves, and event ids that repeat or are null."""
    at = "TIMESTAMP '2024-01-01' + to_microseconds((86400000000 * (i % 4) + [0, 500000, 1500000, 499999, 700000, -300000][1 + i * 7 % 6])::BIGINT)"
    events = f"SELECT {ids} AS event_id, {at} AS ts, (i % 2)::BIGINT AS user_id, CASE WHEN i % 3 = 0 THEN 'purchase' ELSE 'view' END AS event_type FROM range(48) t(i)"
    same_as_sql(spark, tmp_path, "range_innermost", events=events)


WORDS = "array_to_string([chr((97 + (hash(i * 31 + k) % least(26, 3 + i))::INT)::INT) || ['', 'x', 'É'][1 + (hash(k * 7 + i) % 3)::INT] FOR k IN range(i % 9)], ' ')"


@pytest.mark.parametrize("ids", ["i", "i // 2", "nullif(i // 3, 4)"])
def test_name_overlap_with_repeated_and_null_ids(spark, tmp_path, ids):
    docs = f"SELECT {ids} AS doc_id, {WORDS} AS text FROM range(60) t(i) UNION ALL SELECT 70, NULL"
    want = same_as_sql(spark, tmp_path, "name_overlap", documents=docs, benchmark=f"SELECT i AS item_id, {WORDS} AS text FROM range(20, 40) t(i)")
    assert len(want) > 30


def test_name_overlap_reads_the_larger_side_once(spark, monkeypatch):
    """No shuffle of the larger side's tokens; with too many tokens on the left, the same rows by joins."""
    rows = [(i, [f"t{(i * k) % 23}" for k in range(i % 7)]) for i in range(300)]
    right = spark.createDataFrame(rows, "id long, tokens array<string>")
    left = right.filter("id < 40").withColumnRenamed("id", "own")
    short = joins.name_overlap(left, "own", right, "id")
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    monkeypatch.setattr(joins, "OVERLAP_TOKENS", 5)
    joined = joins.name_overlap(left, "own", right, "id")
    assert "MapInArrow" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(short.collect()) == sorted(joined.collect())


@pytest.mark.parametrize("kept", [2, 1_000_000])
@pytest.mark.parametrize("name", ["tfidf", "cosine", "semantic_cluster"])
def test_vectors_with_rare_terms_apart(spark, tmp_path, monkeypatch, name, kept):
    """The same rows whether all terms go to the executors or two at most, the rest by joins."""
    monkeypatch.setattr(cluster, "BROADCAST_TERMS", kept)
    monkeypatch.setattr(cluster, "WORKER_TERMS", kept)
    docs = f"SELECT i AS doc_id, {WORDS} AS text, CASE WHEN i % 7 = 3 THEN 'de' ELSE 'en' END AS lang, 's' || i % 3 AS source, i % 11 AS n_chars FROM range(400) t(i) UNION ALL SELECT 70, NULL, 'en', 's', 0"
    assert same_as_sql(spark, tmp_path, name, documents=docs)


def test_tfidf_has_no_shuffle_of_its_rows(spark, tmp_path):
    """Rows that share a doc_id are one document, whose vector isn't sorted or shuffled otherwise."""
    assert same_as_sql(spark, tmp_path, "tfidf", documents=f"SELECT i // 2 AS doc_id, {WORDS} AS text, 'en' AS lang FROM range(900) t(i)")
    docs = spark.createDataFrame([(i, [f"t{i % 5}", "t"]) for i in range(40)], "id long, tokens array<string>")
    plan = cluster.tfidf(docs, "id", F.col("tokens"), least=8)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
