"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has the key -ln(u) / w, where u is uniform and a function of the seed and doc_id, and w
is its quality weight; within a source, ascending keys are a weighted random order without replacement.
A source with T tokens and the budget B is taken floor(B / T) times in full, and then the longest
prefix of that order whose tokens fit what is left of B.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.tables import keep, table

BUCKETS = 65536


def n_tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """Share of letters in the text, 0.05 at least (also for null and empty texts)."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))
    share = F.when(F.length(text) > 0, letters.cast("double") / F.length(text))
    return F.greatest(F.lit(0.05), F.coalesce(share, F.lit(0.0)))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def weight_of(weight: str | None) -> Column:
    """The named column, 0.05 at least (also for nulls and NaN); quality_weight of the text without one."""
    if weight is None:
        return quality_weight(F.col("text"))
    given = F.col(f"`{weight}`").cast("double")
    return F.when(given > 0.05, F.nanvl(given, F.lit(0.05))).otherwise(0.05)


def sampling_plan(docs: DataFrame, targets: DataFrame | None, ratio: float, alpha: float, seed: int, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(narrow, plan): narrow has doc_id, source, n_tokens, es_key of every row; plan has for each source
    the epochs and the largest key that is still taken (null: none)."""
    narrow = keep(
        docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), weight_of(weight).alias("w"))
        .select("doc_id", "source", "n_tokens", sampling_key(F.col("doc_id"), F.col("w"), seed).alias("es_key")),
        "keys",
    )
    bucket = F.floor((1 - F.exp(-F.col("es_key"))) * BUCKETS)
    keyed = narrow.withColumn("bucket", bucket)
    hist = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"), F.max("es_key").alias("top"))
    by_source = Window.partitionBy("source")
    hist = hist.withColumns({"upto": F.sum("t").over(by_source.orderBy("bucket")), "all": F.sum("t").over(by_source)})
    hist = keep(hist, "hist")
    sums = hist.groupBy("source").agg(F.max("all").alias("have"))
    if targets is None:
        shares = sums.withColumn("share", F.pow(F.col("have").cast("double"), F.lit(alpha)))
    else:
        shares = sums.join(targets.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("share")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["share"])
    total = shares.agg(F.sum("share").alias("_share"), F.sum("have").alias("_all"))
    budget = F.coalesce(F.floor(F.col("_all") * ratio * F.col("share") / F.nullif(F.col("_share"), F.lit(0.0))), F.lit(0))
    epochs = F.when(F.col("have") > 0, F.floor(budget / F.col("have"))).otherwise(0)
    plan = shares.crossJoin(total).select("source", epochs.cast("bigint").alias("epochs"), (budget - epochs * F.col("have")).cast("bigint").alias("left_over"))
    marked = hist.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    edge = marked.filter(F.col("upto") > F.col("left_over")).groupBy("source").agg(F.min("bucket").alias("bucket"), F.min_by("t", "bucket").alias("t"), F.min_by("upto", "bucket").alias("upto"), F.first("left_over").alias("left_over"))
    inner = keyed.join(edge.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), (F.col("upto") - F.col("t")).alias("before"), "left_over"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    inner = inner.withColumn("cum", F.col("before") + F.sum("n_tokens").over(by_source.orderBy("es_key").rangeBetween(Window.unboundedPreceding, 0)))
    full = marked.filter(F.col("upto") <= F.col("left_over")).select("source", F.col("top").alias("last_key"))
    last = full.unionByName(inner.filter(F.col("cum") <= F.col("left_over")).select("source", F.col("es_key").alias("last_key"))).groupBy("source").agg(F.max("last_key").alias("last_key"))
    plan = plan.join(last.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "epochs", "last_key")
    return narrow, keep(plan, "plan")


def mix_sources(docs: DataFrame, targets: DataFrame | None = None, ratio: float = 1.0, alpha: float = 0.5, seed: int = 7, rows: bool = False, weight: str | None = None) -> DataFrame:
    """Samples documents to a token budget for each source.

    targets has (source, weight), any positive scale; a source without a weight gets nothing (nor does any, if no weight is above 0). Without
    targets a source weighs its token count to the power alpha. The budget of all is ratio times the
    tokens of all, and each source's share is rounded down.

    A document's key is scaled by its quality weight: the column that `weight` names (a probability, say),
    or the share of letters in its text.

    Result: doc_id, source, n_tokens, copies of the documents that are taken (copies > 0); with rows,
    the input's columns instead, each row repeated as often as it is taken.

    Null doc_id: one key that all such rows share. Null source: a source of its own. Null or empty text:
    no tokens, smallest weight; it costs nothing and comes where its key puts it. Texts are counted whole;
    a very long one that doesn't fit ends its source's prefix, as any other does. Null, NaN, negative and
    small weights count as 0.05. Rows with equal keys
    in a source (repeated rows) are taken or left together. Empty table: empty result. Other columns are
    ignored, whatever their names, or passed through with rows. Exact at every size: only sums by
    (source, key bucket) and the one bucket in which a budget ends are ordered.
    """
    narrow, plan = sampling_plan(docs, targets, ratio, alpha, seed, weight)
    plan = plan.select(F.col("source").alias("_plan_source"), F.col("epochs").alias("_plan_epochs"), F.col("last_key").alias("_plan_key"))
    copies = (F.col("_plan_epochs") + F.when(F.col("es_key") <= F.col("_plan_key"), 1).otherwise(0)).cast("bigint")
    if not rows:
        taken = narrow.join(plan, F.col("source").eqNullSafe(F.col("_plan_source")))
        return taken.select("doc_id", "source", "n_tokens", copies.alias("copies")).filter("copies > 0")
    key = sampling_key(F.col("doc_id"), weight_of(weight), seed)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source", key.alias("es_key"))
    taken = whole.join(plan, F.col("source").eqNullSafe(F.col("_plan_source"))).select("_row", F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).alias("_n"))
    return taken.select("_row", F.explode("_n")).select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def oracle_sql(targets: bool = False) -> str:
    """DuckDB SQL of mix_sources over documents, with targets (source, weight) if asked for."""
    share = "coalesce((SELECT max(weight) FROM targets t WHERE t.source IS NOT DISTINCT FROM have.source), 0)" if targets else "sqrt(have)"
    return f"""
WITH base AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS n_tokens,
         greatest(0.05, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g'))::DOUBLE / length(text) ELSE 0.0 END) AS w,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
keyed AS (SELECT doc_id, source, n_tokens, -ln(u) / w AS es_key FROM base),
have AS (SELECT source, sum(n_tokens)::BIGINT AS have FROM keyed GROUP BY source),
shares AS (SELECT source, have, {share} AS share FROM have),
budget AS (SELECT source, have, coalesce(floor(sum(have) OVER () * share / nullif(sum(share) OVER (), 0)), 0)::BIGINT AS b FROM shares),
plan AS (SELECT source, CASE WHEN have > 0 THEN b // have ELSE 0 END AS epochs, CASE WHEN have > 0 THEN b % have ELSE b END AS left_over FROM budget),
cum AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY es_key RANGE UNBOUNDED PRECEDING) AS cum FROM keyed)
SELECT doc_id, cum.source, n_tokens, (epochs + CASE WHEN cum <= left_over THEN 1 ELSE 0 END)::BIGINT AS copies
FROM cum JOIN plan ON cum.source IS NOT DISTINCT FROM plan.source
WHERE epochs + CASE WHEN cum <= left_over THEN 1 ELSE 0 END > 0
"""


ORACLE_SQL = oracle_sql()
