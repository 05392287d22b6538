"""Selections by running sums and ranks within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def budget_prefix(rows: DataFrame, group: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The rows of each group before the first at which the running sum of cost exceeds the budget, with
    the sum as `running`."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).filter(F.col("running") <= budget)


def govern(sections: DataFrame, budget: int) -> DataFrame:
    """sections (section, tokens, drop_order): those that stay when sections are dropped by ascending
    drop_order (null: never) until the rest fits the budget."""
    w = Window.orderBy(F.asc_nulls_last("drop_order"), "section")
    seen = sections.withColumn("before", F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).crossJoin(sections.agg(F.sum("tokens").alias("all")))
    # a section goes if what is left before it is dropped is still too much
    return seen.filter(F.col("drop_order").isNull() | (F.col("all") - F.col("before") <= budget)).select("section", "tokens")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def round_robin(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first of every group, then the second of every group, and so on; `position` from 1."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = rows.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= limit).orderBy("turn", group).limit(limit)
    return ranked.withColumn("position", F.row_number().over(Window.orderBy("turn", group)))


def diverse(rows: DataFrame, kind: str, domain: str, order: list[Column], k: int) -> DataFrame:
    """k rows of each kind: the first of every domain before second ones."""
    w = Window.partitionBy(kind, domain).orderBy(*order)
    again = rows.withColumn("_again", (F.row_number().over(w) > 1).cast("int"))
    return top_per_group(again, [kind], [F.col("_again"), *order], k).drop("_again")


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(rows, key, order, 1).drop("rank")


def select_with_quota(rows: DataFrame, must: str, priority: str, tie: str, limit: int) -> DataFrame:
    """`limit` rows: those that must be kept first, then by priority."""
    return rows.orderBy(F.col(must).desc(), F.col(priority).desc(), F.col(tie)).limit(limit)
