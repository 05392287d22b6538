"""Point lookups: find, search, neighbours of the best match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import token_estimate


def find(rows: DataFrame, columns: list[str], needle: str, order: list[str], limit: int = 20) -> DataFrame:
    """Rows of which a column holds the needle, in whatever case; the first `limit` by order."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return rows.filter(test).orderBy(*order).limit(limit)


def search(rows: DataFrame, name: str, score: str, needle: str, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(center, neighbour): the best-scored of the matches that find gives, and where its edges lead."""
    center = find(rows, [name], needle, [name, "id"], limit).orderBy(F.desc(score), name, "id").limit(1)
    return edges.join(F.broadcast(center.select(F.col("id").alias("center"))), F.col("src") == F.col("center")).select("center", F.col("dst").alias("neighbour")).distinct()


def resolve(nodes: DataFrame, value: str) -> DataFrame:
    """The one node (id, name, path) that a value means: its id, else the path of a file, else a symbol's
    name if it is unique; no row otherwise."""
    file = nodes.filter(F.col("id").startswith("file:") & (F.col("path") == value))
    named = nodes.filter(F.col("id").startswith("sym:") & (F.col("name") == value)).withColumn("_n", F.count("*").over(Window.partitionBy("name"))).filter("_n = 1").drop("_n")
    ranked = nodes.filter(F.col("id") == value).withColumn("_p", F.lit(0)).unionByName(file.withColumn("_p", F.lit(1))).unionByName(named.withColumn("_p", F.lit(2)))
    return ranked.orderBy("_p", "id").limit(1).drop("_p")


def query(symbols: DataFrame, refs: DataFrame, file_dep: DataFrame, value: str, depth: int = 1, limit: int = 6, most: int = 10) -> DataFrame:
    """(symbol, relation, neighbour): for the symbol that a value means, or the first `limit` whose name or
    signature holds it, the callers and callees, and the files that depend on its file (in) and that it
    depends on (out) within 1 to 3 steps; the least `most` of each."""
    exact = resolve(symbols.select("id", "name", "path"), value).select("id")
    near = find(symbols, ["name", "signature"], value, ["name", "id"], limit).select("id")
    matched = symbols.join(F.broadcast(exact if not exact.isEmpty() else near), "id", "left_semi").select("id", "path")
    ends = refs.select("src", "dst")
    callers = ends.join(F.broadcast(matched), ends["dst"] == matched["id"]).select(F.col("id").alias("symbol"), F.lit("caller").alias("relation"), F.col("src").alias("neighbour"))
    callees = ends.join(F.broadcast(matched), ends["src"] == matched["id"]).select(F.col("id").alias("symbol"), F.lit("callee").alias("relation"), F.col("dst").alias("neighbour"))
    out = callers.unionByName(callees)
    front = matched.select("id", F.col("path").alias("node"), F.lit("").alias("way")).withColumn("way", F.explode(F.array(F.lit("in"), F.lit("out"))))
    steps = file_dep.select(F.col("dst").alias("node"), F.col("src").alias("to"), F.lit("in").alias("way")).unionByName(file_dep.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit("out").alias("way"))).distinct()
    for _ in range(max(1, min(3, depth))):
        front = front.join(steps, ["node", "way"]).select("id", F.col("to").alias("node"), "way").distinct()
        out = out.unionByName(front.select(F.col("id").alias("symbol"), "way", "node").toDF("symbol", "relation", "neighbour"))
    w = Window.partitionBy("symbol", "relation").orderBy("neighbour")
    return out.distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def expand(m: dict[str, DataFrame], value: str, budget: int = 400, include: tuple[str, ...] = ("symbols", "deps", "callers", "callees", "flows")) -> DataFrame:
    """(pos, line): the card of a file or symbol of a code map (relations as codemap.build gives them),
    ended before the first line that the budget of tokens doesn't hold. No row for an unknown value."""
    nodes = m["files"].select("id", F.lit(None).cast("string").alias("name"), "path").unionByName(m["symbols"].select("id", "name", "path"))
    hit = F.broadcast(resolve(nodes, value).select(F.col("id").alias("_id"), F.col("path").alias("_path")))
    file = m["files"].join(hit, F.col("id") == F.col("_id"))
    symbol = m["symbols"].join(hit, F.col("id") == F.col("_id"))
    line = lambda part, df, text, *order: df.select(F.lit(part).alias("part"), F.array(*[F.coalesce(F.col(o).cast("string"), F.lit("")) for o in order]).alias("key"), text.alias("line"))
    parts = [
        line(0, file, F.concat(F.lit("[FILE] "), "path"), "path"), line(1, file.filter("summary_1l != ''"), F.concat(F.lit("summary="), "summary_1l"), "path"), line(2, file, F.concat(F.lit("role="), "role"), "path"),
        line(0, symbol, F.concat(F.lit("[SYMBOL] "), "name"), "id"), line(1, symbol.filter("signature != ''"), F.concat(F.lit("signature="), "signature"), "id"), line(2, symbol, F.concat(F.lit("defined_in="), "path", F.lit(":"), F.col("line").cast("string")), "id"),
    ]
    own = file.select(F.col("path").alias("_file"))
    if "symbols" in include:
        mine = m["symbols"].join(own, F.col("path") == F.col("_file")).orderBy(F.desc("score"), "id").limit(12)
        parts.append(line(3, mine, F.concat(F.lit("+ "), F.coalesce("signature", "name")), "id"))
    listed = lambda part, name, df, col: df.agg(F.array_sort(F.collect_set(col)).alias("l")).filter(F.size("l") > 0).select(F.lit(part).alias("part"), F.array(F.lit(name)).alias("key"), F.concat(F.lit(name + "="), F.array_join(F.slice("l", 1, 10), ",")).alias("line"))
    if "deps" in include:
        parts += [listed(4, "inbound", m["file_dep"].join(own, F.col("dst") == F.col("_file")), "src"), listed(5, "outbound", m["file_dep"].join(own, F.col("src") == F.col("_file")), "dst")]
    chosen = symbol.select("_id")
    if "callers" in include:
        parts.append(listed(6, "callers", m["symbol_ref"].join(chosen, F.col("dst") == F.col("_id")), "src"))
    if "callees" in include:
        parts.append(listed(7, "callees", m["symbol_ref"].join(chosen, F.col("src") == F.col("_id")), "dst"))
    if "flows" in include:
        where = file.select(F.col("path").alias("_file")).unionByName(symbol.select(F.col("path").alias("_file")))
        n = lambda end: m["dataflow"].join(where, F.col(end) == F.col("_file"), "left_semi").agg(F.count("*").alias("n"))
        both = n("to_path").withColumnRenamed("n", "i").crossJoin(n("from_path")).crossJoin(where.limit(1))
        parts.append(both.select(F.lit(8).alias("part"), F.array(F.lit("")).alias("key"), F.concat(F.lit("dataflow_in="), F.col("i").cast("string"), F.lit(" dataflow_out="), F.col("n").cast("string")).alias("line")))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    order = Window.orderBy("part", "key", "line")
    cost = F.sum(token_estimate(F.col("line"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumns({"pos": F.row_number().over(order), "cost": cost}).filter(F.col("cost") <= budget).select("pos", "line")
