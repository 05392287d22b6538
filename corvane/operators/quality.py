"""Evidence, coverage, capability and risk metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIGNAL_WEIGHT = {"ast": 3, "config": 3, "graph": 2, "lexical": 1}
CONFIDENCE = {"default": (5, 2), "entrypoint": (4, 2), "route": (4, 2)}


def evidence(signals: dict[str, Column]) -> Column:
    """Sum of the weights of the signals that hold."""
    total = F.lit(0)
    for name, holds in signals.items():
        total = total + F.when(holds, SIGNAL_WEIGHT[name]).otherwise(0)
    return total


def confidence(score: Column, domain: str = "default") -> Column:
    high, medium = CONFIDENCE[domain]
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def with_fallback(rows: DataFrame, key: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """(key, target, via): targets of the first relation (key, target), and of the second, as name, for
    keys that the first lacks."""
    direct = first.join(rows, key, "left_semi").select(key, "target", F.lit("direct").alias("via"))
    others = second.join(rows, key, "left_semi").join(first.select(key).distinct(), key, "left_anti")
    return direct.unionByName(others.groupBy(key).agg(F.min("target").alias("target")).select(key, "target", F.lit("name").alias("via")))


def capabilities(rows: DataFrame, text: str, rules: list[tuple[str, str]], score: Column) -> DataFrame:
    """(capability, hits, top, status) for each (capability, regex): one scan, all rules in one pass."""
    marks = rows.select(score.alias("_s"), *[F.col(text).rlike(p).alias(f"_r{i}") for i, (_, p) in enumerate(rules)])
    sums = marks.agg(*[F.struct(F.count(F.when(F.col(f"_r{i}"), 1)).alias("hits"), F.coalesce(F.max(F.when(F.col(f"_r{i}"), F.col("_s"))), F.lit(0)).alias("top")).alias(f"_a{i}") for i in range(len(rules))])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("capability"), F.col(f"_a{i}.hits").alias("hits"), F.col(f"_a{i}.top").alias("top")) for i, (n, _) in enumerate(rules)]))
    status = F.when(F.col("top") >= 2, "exists/high").when(F.col("hits") >= 2, "exists/medium").when(F.col("hits") == 1, "uncertain").otherwise("missing")
    return sums.select(each.alias("x")).select("x.*").withColumn("status", status)


def change_risk(nodes: DataFrame, degrees: DataFrame, untested: DataFrame, invariants: DataFrame, top: int = 8) -> DataFrame:
    """(node, score): min(6, 1 + fan_in / 2) + min(4, .5 + fan_out / 4) + min(2.5, 2.5 instability) from
    .7 on + 3 if untested + 2 for an invariant; the `top` highest."""
    rows = nodes.join(degrees, "node", "left").fillna(0, ["in_degree", "out_degree"]).join(untested.select("node", F.lit(True).alias("u")).distinct(), "node", "left").join(invariants.select("node", F.lit(True).alias("v")).distinct(), "node", "left")
    total = F.col("in_degree") + F.col("out_degree")
    inst = F.when(total >= 2, F.col("out_degree") / total).otherwise(0.0)
    score = (
        F.when(F.col("in_degree") > 0, F.least(F.lit(6.0), 1 + 0.5 * F.col("in_degree"))).otherwise(0.0)
        + F.when(F.col("out_degree") > 0, F.least(F.lit(4.0), 0.5 + 0.25 * F.col("out_degree"))).otherwise(0.0)
        + F.when(inst >= 0.7, F.least(F.lit(2.5), 2.5 * inst)).otherwise(0.0)
        + F.when(F.col("u"), 3.0).otherwise(0.0)
        + F.when(F.col("v"), 2.0).otherwise(0.0)
    )
    return rows.select("node", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "node").limit(top)


def test_confidence(tests: DataFrame, targets: DataFrame, symbols: DataFrame, entries: DataFrame) -> DataFrame:
    """(test, bucket): strong if it uses symbols or reaches an entrypoint, weak if it has other targets,
    theatrical without any. targets: test, target; symbols: test, symbol; entries: node."""
    hit = targets.join(entries.select(F.col("node").alias("target"), F.lit(True).alias("e")).distinct(), "target", "left").groupBy("test").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("e"), F.lit(False)).alias("entry"))
    used = symbols.groupBy("test").agg(F.count("*").alias("s"))
    rows = tests.select("test").distinct().join(hit, "test", "left").join(used, "test", "left")
    return rows.select("test", F.when((F.coalesce("s", F.lit(0)) > 0) | F.coalesce("entry", F.lit(False)), "strong").when(F.coalesce("n", F.lit(0)) > 0, "weak").otherwise("theatrical").alias("bucket"))


def doc_quality(symbols: DataFrame) -> DataFrame:
    """One row of counters over symbols (params, doc_params: arrays; summary, returns_value: boolean,
    doc_returns)."""
    documented = F.length(F.coalesce("summary", F.lit(""))) > 0
    n, m = F.size("params"), F.size("doc_params")
    return symbols.agg(
        F.count("*").alias("total"),
        F.count(F.when(~documented, 1)).alias("missing"),
        F.count(F.when(documented & (n > 0) & (m == 0), 1)).alias("param_missing_all"),
        F.count(F.when(documented & (m > 0) & (F.size(F.array_except("params", "doc_params")) + F.size(F.array_except("doc_params", "params")) > 0), 1)).alias("param_mismatch"),
        F.count(F.when(documented & F.col("returns_value") & F.col("doc_returns").isNull(), 1)).alias("return_missing"),
    )


def layer_counts(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(down, up, same, style): edges between ordered layers (node, layer as presentation, application,
    domain or data); layered is high with at most 10 % upward, medium with at most 30 %."""
    order = F.create_map(*[F.lit(x) for kv in {"presentation": 0, "application": 1, "domain": 2, "data": 3}.items() for x in kv])
    known = layers.select("node", F.try_element_at(order, F.col("layer")).alias("l")).filter("l IS NOT NULL")
    met = edges.join(known.select(F.col("node").alias("src"), F.col("l").alias("a")), "src").join(known.select(F.col("node").alias("dst"), F.col("l").alias("b")), "dst")
    sums = met.agg(F.count(F.when(F.col("a") < F.col("b"), 1)).alias("down"), F.count(F.when(F.col("a") > F.col("b"), 1)).alias("up"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same"))
    crossing = F.col("down") + F.col("up")
    return sums.withColumn("style", F.when(crossing == 0, "none").when(F.col("up") <= 0.1 * crossing, "high").when(F.col("up") <= 0.3 * crossing, "medium").otherwise("low"))


def edge_confidence(files: Column, calls: Column, flows: Column) -> Column:
    """Confidence of extracted edges, by calls and flows for each file."""
    c, f = calls / F.greatest(files, F.lit(1)), flows / F.greatest(files, F.lit(1))
    points = F.when(c >= 1, 2.0).when(c >= 0.2, 1.0).otherwise(0.0) + F.when(f >= 0.5, 1.0).when(f >= 0.1, 0.5).otherwise(0.0)
    return F.when(points >= 2.5, "high").when(points >= 1, "medium").otherwise("low")


def gate(metrics: DataFrame, unsupported: Column) -> DataFrame:
    """Adds gate: pass if AST confidence is high (or medium with a second source), imports are captured
    to 60 % and no language that was asked for is unsupported; else fail, with the reasons."""
    checks = F.array(
        F.when(~(F.col("ast_confidence") == "high") & ~((F.col("ast_confidence") == "medium") & F.col("second_source")), F.lit("ast_confidence")),
        F.when(F.coalesce("import_capture_rate", F.lit(1.0)) < 0.6, F.lit("import_capture")),
        F.when(unsupported, F.lit("unsupported_language")),
    )
    reasons = F.filter(checks, lambda r: r.isNotNull())
    return metrics.withColumn("reasons", reasons).withColumn("gate", F.when(F.size("reasons") == 0, "pass").otherwise("fail"))


def component_purpose(tokens: DataFrame, keywords: DataFrame, top: int = 4) -> DataFrame:
    """(component, purpose): the first of a component's `top` most frequent tokens that keywords (token,
    purpose) knows, else its most frequent token. tokens: component, token."""
    counts = tokens.groupBy("component", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("component").orderBy(F.desc("n"), "token")
    ranked = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).join(F.broadcast(keywords), "token", "left")
    return ranked.groupBy("component").agg(F.coalesce(F.min_by("purpose", F.when(F.col("purpose").isNotNull(), F.col("r"))), F.min_by("token", "r")).alias("purpose"))
