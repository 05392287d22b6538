"""Comparison and upkeep of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, before, after): rows added, removed or changed in any of the fields; nulls are
    values."""
    a = old.select(F.col(key), F.struct(*fields).alias("before"), F.lit(True).alias("_a"))
    b = new.select(F.col(key), F.struct(*fields).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(key, "change", "before", "after")


def prune(edges: DataFrame, changed: DataFrame, removed: DataFrame, source: str = "src", target: str = "dst", either: bool = False) -> DataFrame:
    """The edges without those from changed or removed nodes (column node) and those to removed ones,
    or, with either, to changed ones too."""
    gone = changed.select("node").unionByName(removed.select("node")).distinct()
    left = edges.join(gone, edges[source] == gone["node"], "left_anti")
    ends = gone if either else removed.select("node").distinct()
    return left.join(ends, left[target] == ends["node"], "left_anti")


def replace_provenance(edges: DataFrame, new: DataFrame, replaced: list[str]) -> DataFrame:
    """The edges of other provenances than the replaced ones, and the new ones."""
    return edges.filter(~F.coalesce(F.col("provenance").isin(*replaced), F.lit(False))).unionByName(new)


def symmetric_difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs or that only one side has."""
    a, b = old.select(key, F.col(value).alias("_x"), F.lit(1).alias("_a")), new.select(key, F.col(value).alias("_y"), F.lit(1).alias("_b"))
    return a.join(b, key, "full").filter(~(F.col("_x").eqNullSafe(F.col("_y")) & F.col("_a").eqNullSafe(F.col("_b")))).select(key)


def incremental(snapshot: DataFrame, files: DataFrame, extract) -> DataFrame:
    """The relation that extract(files) gives, when `snapshot` (with path, sha1) holds it for an earlier
    state: only files of new or changed content are extracted again."""
    current = files.withColumn("sha1", F.sha1("content"))
    same = current.select("path", "sha1")
    kept = snapshot.join(same, ["path", "sha1"], "left_semi")
    known = snapshot.select("path", "sha1").distinct()
    fresh = current.join(known, ["path", "sha1"], "left_anti")
    return kept.unionByName(extract(fresh))
