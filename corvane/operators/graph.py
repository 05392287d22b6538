"""Property-graph operators over edge tables (src, dst, w); edges are multisets unless said otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import cut_lineage


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree): counts of the edge multiset."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").cast("bigint").alias("in_degree"), F.sum("o").cast("bigint").alias("out_degree"))


def hubs(edges: DataFrame, top: int = 6) -> DataFrame:
    d = degrees(edges).withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    return d.orderBy(F.desc("degree"), "node").limit(top)


def coupling(edges: DataFrame, top: int = 6) -> DataFrame:
    """(metric, node, n, value): the top of fan_in, fan_out and instability = out / (in + out), the last
    for nodes with two edges or more; ties go to the least node."""
    d = degrees(edges)
    i, o = F.col("in_degree"), F.col("out_degree")
    one = lambda name, n, value, ok: F.when(ok, F.struct(F.lit(name).alias("metric"), n.alias("n"), value.alias("value")))
    metrics = F.array(one("fan_in", i, i.cast("double"), i > 0), one("fan_out", o, o.cast("double"), o > 0), one("instability", i + o, F.round(o / (i + o), 3), i + o >= 2))
    rows = d.select("node", F.explode(F.array_compact(metrics)).alias("m")).select("m.metric", "node", "m.n", "m.value")
    w = Window.partitionBy("metric").orderBy(F.desc("value"), "node")
    return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).drop("r")


def lift(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges of the nodes' groups (node, grp): summed weights, without edges inside a group."""
    a = groups.select(F.col("node").alias("src"), F.col("grp").alias("g1"))
    b = groups.select(F.col("node").alias("dst"), F.col("grp").alias("g2"))
    return edges.join(a, "src").join(b, "dst").filter("g1 != g2").groupBy(F.col("g1").alias("src"), F.col("g2").alias("dst")).agg(F.sum("w").alias("w"))


def risk_flags(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, flag) of groups (grp, n): god_component with at least max(20, 35 % of all members) of
    them; orchestrator and core with a weighted out- or in-degree of max(5, twice the positive median)."""
    god = sizes.crossJoin(sizes.agg(F.sum("n").alias("all"))).filter(F.col("n") >= F.greatest(F.lit(20), F.floor(F.col("all") * 0.35))).select("grp", F.lit("god_component").alias("flag"))
    found = god
    for end, flag in (("src", "orchestrator"), ("dst", "core")):
        sums = edges.groupBy(F.col(end).alias("grp")).agg(F.sum("w").alias("d")).filter("d > 0")
        limit = sums.agg(F.greatest(F.lit(5.0), 2 * F.median("d")).alias("least"))
        found = found.unionByName(sums.crossJoin(limit).filter("d >= least").select("grp", F.lit(flag).alias("flag")))
    return found


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(node, rank): weighted PageRank with a fixed number of synchronous rounds. A source gives each
    edge its share of the source's weights; duplicates count apart; dangling ranks aren't passed on and
    edges from unknown nodes give nothing."""
    spark = nodes.sparkSession
    nodes = nodes.select("node").distinct()
    total = Window.partitionBy("src")
    known = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").withColumn("share", F.col("w") / F.sum("w").over(total))
    # one row for each pair, so that the loop joins as little as possible
    known = cut_lineage(spark, known.groupBy("src", "dst").agg(F.sum("share").alias("share")))
    n = nodes.count()
    base = cut_lineage(spark, nodes)
    ranks = base.withColumn("rank", F.lit(1.0 / max(1, n)))
    for k in range(1, rounds + 1):
        given = ranks.join(known, ranks["node"] == known["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = base.join(given, base["node"] == given["dst"], "left").select("node", (F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % cut_every == 0 and k < rounds:
            ranks = cut_lineage(spark, ranks)
    return ranks


def _directed(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def bfs(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(node, depth): nodes within `depth` steps of the starts, the starts at 0; each at its least."""
    spark = edges.sparkSession
    steps = cut_lineage(spark, _directed(edges, direction)) if depth > 1 else _directed(edges, direction)
    seen = starts.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for k in range(1, depth + 1):
        reached = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k))
        if k < depth:  # else every level would be planned, and computed, again in each later one
            frontier = cut_lineage(spark, frontier)
        seen = seen.unionByName(frontier)
    return seen


def dependencies(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(level, direction, node): at every level the out- and in-neighbours of the last level's nodes of
    both directions; a start may come again."""
    front = starts.select("node").distinct()
    found = None
    for k in range(1, depth + 1):
        out = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        back = front.join(edges, front["node"] == edges["dst"]).select(F.col("src").alias("node")).distinct()
        level = out.select(F.lit(k).alias("level"), F.lit("outbound").alias("direction"), "node").unionByName(back.select(F.lit(k).alias("level"), F.lit("inbound").alias("direction"), "node"))
        found = level if found is None else found.unionByName(level)
        front = level.select("node").distinct()
    return found


def simple_paths(edges: DataFrame, starts: DataFrame, nodes: int, cap: int | None = None) -> DataFrame:
    """(path): the maximal simple paths from each start, of `nodes` nodes at most; a path ends where its
    length does or where there is no edge at all. With a cap, the first by the order of their nodes."""
    steps = edges.select("src", "dst").distinct()
    sources = steps.select("src").distinct()
    paths = starts.select(F.array("node").alias("path")).distinct()
    done = None
    for k in range(nodes):
        last = paths.withColumn("end", F.element_at("path", -1))
        stuck = last.select("path") if k == nodes - 1 else last.join(sources, F.col("end") == F.col("src"), "left_anti").select("path")
        done = stuck if done is None else done.unionByName(stuck)
        if k < nodes - 1:
            paths = last.join(steps, F.col("end") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return done.orderBy("path").limit(cap) if cap else done


def cycles(edges: DataFrame, longest: int = 4) -> DataFrame:
    """(cycle, n): every simple cycle of 2 to `longest` nodes, turned so that its least node is first.
    Paths grow only over nodes above their first one, so each cycle is found once."""
    steps = edges.select("src", "dst").distinct().filter("src != dst")
    paths = steps.filter("dst > src").select(F.array("src", "dst").alias("path"))
    found = None
    for k in range(2, longest + 1):
        closed = paths.join(steps, (F.element_at("path", -1) == F.col("src")) & (F.element_at("path", 1) == F.col("dst"))).select(F.col("path").alias("cycle"), F.lit(k).alias("n"))
        found = closed if found is None else found.unionByName(closed)
        if k < longest:
            paths = paths.join(steps, (F.element_at("path", -1) == F.col("src")) & (F.col("dst") > F.element_at("path", 1))).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return found.distinct()


def greedy_flows(edges: DataFrame, starts: DataFrame, hops: int = 2, top: int | None = None) -> DataFrame:
    """(path): from each start the best next hop (greatest weight, then greatest out-degree, then least
    node), never to a node on the path; paths of one node are left out."""
    sums = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    outs = sums.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("out"))
    ranked = sums.join(outs, "dst", "left").fillna(0, ["out"])
    paths = starts.select(F.array("node").alias("path")).distinct()
    for _ in range(hops):
        open_ends = paths.join(ranked, F.element_at("path", -1) == F.col("src"), "left")
        ok = F.col("dst").isNotNull() & ~F.array_contains("path", F.col("dst"))
        best = F.min(F.when(ok, F.struct((-F.col("w")).alias("w"), (-F.col("out")).alias("o"), F.col("dst").alias("d"))))
        paths = open_ends.groupBy("path").agg(best.alias("b")).select(F.when(F.col("b").isNull(), F.col("path")).otherwise(F.concat("path", F.array("b.d"))).alias("path"))
    paths = paths.filter(F.size("path") > 1).distinct()
    return paths.orderBy("path").limit(top) if top else paths


def best_confidence(sources: list[tuple[DataFrame, int]]) -> DataFrame:
    """(src, dst, confidence): the greatest confidence (an integer for each edge table) of every pair."""
    both = None
    for edges, rank in sources:
        part = edges.select("src", "dst", F.lit(rank).alias("confidence"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def trace_edges(edges: DataFrame, starts: DataFrame, depth: int, limit: int) -> DataFrame:
    """(ordinal, src, dst): edges in the order of breadth-first search from the starts, `limit` at most."""
    reach = bfs(edges, starts, depth - 1)
    out = reach.join(edges.select("src", "dst").distinct(), reach["node"] == F.col("src")).select("depth", "src", "dst")
    w = Window.orderBy("depth", "src", "dst")
    return out.orderBy("depth", "src", "dst").limit(limit).withColumn("ordinal", F.row_number().over(w)).select("ordinal", "src", "dst")


def dependents(edges: DataFrame, changed: DataFrame, scores: DataFrame, depth: int = 2, limit: int = 2000) -> DataFrame:
    """(node, depth): what depends on the changed nodes, by reversed search; of more than `limit` nodes
    the nearest, then those of the greatest score."""
    found = bfs(edges, changed, depth, "in").filter("depth > 0")
    return found.join(scores, "node", "left").orderBy("depth", F.desc_nulls_last("score"), "node").limit(limit).select("node", "depth")
