"""Composite scores of files and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import pagerank

KIND_WEIGHT = {"class": 1.2, "component": 1.2, "function": 1.0, "interface": 0.9, "type": 0.9, "enum": 0.9, "const": 0.7}


def file_scores(nodes: DataFrame, edges: DataFrame, exports: DataFrame, calls: DataFrame) -> DataFrame:
    """(node, score): 0.6 PageRank + 0.2 exports / most exports + 0.02 for an entrypoint + 0.1 calls in
    and out / most calls in one direction. nodes: node, is_entry; exports: node, exports; calls: edges."""
    ranks = pagerank(nodes, edges)
    ends = calls.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.col("w").alias("o")).unionByName(calls.select(F.col("dst").alias("node"), F.col("w").alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    most = sums.agg(F.greatest(F.coalesce(F.max(F.greatest("i", "o")), F.lit(1)), F.lit(1)).alias("_calls")).crossJoin(exports.agg(F.greatest(F.coalesce(F.max("exports"), F.lit(1)), F.lit(1)).alias("_exports")))
    rows = nodes.join(ranks, "node").join(exports, "node", "left").join(sums, "node", "left").fillna(0, ["exports", "i", "o"]).crossJoin(F.broadcast(most))
    score = 0.6 * F.col("rank") + 0.2 * F.col("exports") / F.col("_exports") + F.lit(0.1) * F.when(F.col("is_entry"), 0.2).otherwise(0.0) + 0.1 * (F.col("i") + F.col("o")) / F.col("_calls")
    return rows.select("node", score.alias("score"))


def symbol_scores(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(symbol, kind, refs_in, refs_out, score): the kind's weight, 0.3 if public, and 0.2 refs in / most
    refs in. symbols: symbol, kind, visibility; refs: src, dst."""
    into = refs.groupBy(F.col("dst").alias("symbol")).agg(F.count("*").alias("refs_in"))
    out = refs.filter("src IS NOT NULL").groupBy(F.col("src").alias("symbol")).agg(F.count("*").alias("refs_out"))
    weight = F.lit(0.8)
    for kind, w in KIND_WEIGHT.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    most = into.agg(F.greatest(F.coalesce(F.max("refs_in"), F.lit(1)), F.lit(1)).alias("_most"))
    rows = symbols.join(into, "symbol", "left").join(out, "symbol", "left").fillna(0, ["refs_in", "refs_out"]).crossJoin(F.broadcast(most))
    score = weight + F.when(F.col("visibility") == "public", 0.3).otherwise(0.0) + 0.2 * F.col("refs_in") / F.col("_most")
    return rows.select("symbol", "kind", "refs_in", "refs_out", score.alias("score"))
