"""Token-budgeted reports: sections as DataFrames, dropped and cut to fit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import paths
from corvane.functions.text import compact_signature, identifier_parts, normal_terms, token_estimate
from corvane.operators import codemap, graph, inventory, quality, windows
from corvane.session import cut_lineage
from corvane.sources.files import package_roots

ORDER = ["REPO", "SUMMARY", "TOP_HUBS", "PUBLIC_API", "ENTRYPOINTS", "ENTRYPOINT_GROUPS", "DIR", "COMPONENTS", "COMPONENT_EDGES", "CYCLES", "WARNINGS", "EXTERNALS", "PACKAGES", "CONFIDENCE_GATE", "LIMITS", "FILES", "SYMBOLS", "ENTITIES", "FOREIGN_KEYS", "ROUTES", "ROUTE_GROUPS", "STATIC_TRACES", "FLOWS", "TRACE_GRAPH", "DOCS", "ARCHITECTURE", "LAYERS", "ROLE_EDGES", "PURPOSE", "QUALITY", "DOCS_QUALITY", "TEST_CONFIDENCE", "TRACEABILITY", "TEST_MAPPING", "CHANGE_RISK", "DEAD_CODE", "TYPE_HIERARCHY", "EDGES", "CALL_CHAINS", "DIAGRAM"]
DROPPED_FIRST = ["DIAGRAM", "CALL_CHAINS", "TRACE_GRAPH", "DOCS_QUALITY", "TEST_CONFIDENCE", "CHANGE_RISK", "QUALITY", "LAYERS", "DOCS", "FLOWS"]
#: Words of paths that tell what a component is for.
PURPOSES = {"api": "interface", "auth": "access", "cart": "shopping", "cli": "command line", "db": "storage", "model": "data model", "models": "data model", "routes": "interface", "services": "business rules", "shape": "geometry", "ui": "user interface"}
PROFILES = {"fast": 4_000, "balanced": 20_000, "deep": 80_000}
RATIOS = {"FILES": 0.4, "SYMBOLS": 0.25, "DIR": 0.1, "ENTITIES": 0.15}


#: A line costs a token at least, so that a section has no use for more lines than the largest budget.
MOST_LINES = max(PROFILES.values())


def _section(name: str, rows: DataFrame, line: F.Column, *order: F.Column | str, most: int = MOST_LINES) -> DataFrame:
    """(section, pos, line): the first `most` rows in order, numbered."""
    top = rows.orderBy(*order).limit(most)
    return top.select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("pos"), line.alias("line"))


def sections(m: dict[str, DataFrame], max_files: int = 40) -> list[DataFrame]:
    """The sections (section, pos, line) of a code map."""
    code = m["files"].filter("language != 'unknown'")
    edges = m["file_dep"].select("src", "dst", "w")
    deg = graph.degrees(edges)
    starts = code.filter("entry_role IS NOT NULL").select(F.col("path").alias("node"))
    arrow = lambda c: F.array_join(c, " -> ")
    routed = m["api_contracts"].select("path", F.lit(1.0).alias("routed")).distinct()
    weight = F.coalesce("score", F.lit(0.0)) + F.when(F.col("entry_role").isNotNull(), 2.0).otherwise(0.0) + F.coalesce("routed", F.lit(0.0)) + F.when(F.col("role") == "test", 0.8).otherwise(0.0) - paths.selection_penalty(F.col("path"))
    penalised = code.join(routed, "path", "left").withColumn("priority", weight).drop("routed")
    chosen = windows.select_with_quota(penalised.withColumn("must", F.col("entry_role").isNotNull()), "must", "priority", "path", max_files)
    layers = code.select(F.col("path").alias("node"), "layer")
    tested = m["tests"].select(F.col("target").alias("node")).distinct()
    untested = code.filter("role != 'test'").select(F.col("path").alias("node")).join(tested, "node", "left_anti")
    documented = m["symbols"].join(m["docs"].select("path", F.col("owner").alias("name"), F.transform("params", lambda p: F.substring_index(p, ":", 1)).alias("doc_params"), "summary", F.coalesce("returns", "returns_type").alias("doc_returns")), ["path", "name"], "left").withColumn("doc_params", F.coalesce("doc_params", F.array().cast("array<string>")))
    counters = quality.doc_quality(documented.filter("kind IN ('function', 'component')"))
    out = [
        _section("SUMMARY", code.groupBy("language", "role").agg(F.count("*").alias("n")), F.concat_ws(" ", "language", "role", F.col("n").cast("string")), F.desc("n"), "language", "role"),
        _section("TOP_HUBS", graph.hubs(edges), F.concat_ws(" ", "node", F.concat(F.lit("in="), "in_degree"), F.concat(F.lit("out="), "out_degree")), F.desc("degree"), "node"),
        _section("ENTRYPOINTS", code.filter("entry_role IS NOT NULL"), F.concat_ws(" ", "path", "entry_role"), "path"),
        _section("DIR", codemap.skeleton(code), F.col("line"), "line"),
        _section("COMPONENTS", code.groupBy("component").agg(F.count("*").alias("n")), F.concat_ws(" ", "component", F.col("n").cast("string")), F.desc("n"), "component"),
        _section("FILES", chosen, F.concat_ws(" ", F.col("path"), F.concat(F.lit("["), F.col("role"), F.lit("]")), F.coalesce("summary_1l", F.lit(""))), F.desc("priority"), "path"),
        _section("SYMBOLS", windows.top_per_group(m["symbols"].join(chosen.select("path"), "path", "left_semi"), ["path"], [F.desc("score"), F.col("id")], 4), F.concat_ws(" ", "path", compact_signature(F.col("signature"))), "path", "rank"),
        _section("ENTITIES", m["entities"], F.concat_ws(" ", "name", F.concat(F.lit("("), F.col("kind"), F.lit(")")), F.array_join(F.slice("fields", 1, 8), ", ")), "id"),
        _section("ROUTES", m["api_contracts"], F.concat_ws(" ", "method", "route", "path"), "path", "line", "method"),
        _section("STATIC_TRACES", graph.simple_paths(edges, starts, 4, 12).filter(F.size("path") > 1), arrow("path"), "path"),
        _section("FLOWS", graph.greedy_flows(edges, starts, 3, 6), arrow("path"), "path"),
        _section("TRACE_GRAPH", graph.trace_edges(edges, starts, 3, 24), F.concat_ws(" -> ", "src", "dst"), "ordinal"),
        _section("DOCS", m["docs"].filter("summary != ''"), F.concat_ws(" ", "path", "owner", "summary"), "path", "line", "owner"),
        _section("LAYERS", quality.layer_counts(edges, layers), F.concat_ws(" ", F.concat(F.lit("down="), "down"), F.concat(F.lit("up="), "up"), "style"), "style"),
        _section("DOCS_QUALITY", counters, F.concat_ws(" ", F.concat(F.lit("total="), "total"), F.concat(F.lit("missing="), "missing")), "total"),
        _section("TEST_MAPPING", m["tests"], F.concat_ws(" -> ", "test", "target"), "test", "target", "via"),
        _section("CHANGE_RISK", quality.change_risk(code.select(F.col("path").alias("node")), deg, untested, untested.limit(0)), F.concat_ws(" ", "node", F.format_number("score", 2)), F.desc("score"), "node"),
        _section("DEAD_CODE", codemap.unused(m["symbols"], m["files"]), F.col("id"), "id"),
        _section("TYPE_HIERARCHY", m["type_ref"], F.concat_ws(" ", "from_name", "kind", "to_name"), "from_name", "kind", "to_name", "path", "line"),
        _section("CALL_CHAINS", graph.greedy_flows(m["symbol_ref"].withColumn("w", F.lit(1.0)), m["symbols"].filter("coalesce(refs_in, 0) = 0").select(F.col("id").alias("node")), 3, 6), arrow("path"), "path"),
    ]
    n = lambda c: F.col(c).cast("string")
    nodes, shown = inventory.component_graph(code, edges)
    row = codemap.map_quality(m)
    entries = inventory.entry_inventory(m["api_contracts"], m["nodes"])
    roles = code.select(F.col("path").alias("node"), F.col("layer").alias("role"))
    words = code.select("component", F.explode(normal_terms(identifier_parts(F.regexp_replace("path", "\\.[A-Za-z]+$", "")))).alias("token"))
    keywords = code.sparkSession.createDataFrame(list(PURPOSES.items()), "token string, purpose string")
    tests = code.filter("role = 'test'").select(F.col("path").alias("test"))
    trust = quality.test_confidence(tests, m["tests"].filter("via = 'graph'").select("test", "target"), tests.select("test", F.lit(None).alias("symbol")).limit(0), starts)
    named = code.filter("role = 'library'").select("id", F.regexp_extract("path", "([^/]+)\\.[a-z]+$", 1).alias("name"))
    as_section = lambda df, kind: df.select(F.lit(kind).alias("section"))
    cut = inventory.limits(as_section(code, "files").unionByName(as_section(m["symbols"], "symbols")), as_section(chosen, "files").unionByName(as_section(m["symbols"], "symbols")), as_section(chosen, "files"))
    out += [
        _section("REPO", code.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("language")).alias("l")), F.concat(F.lit("files="), n("n"), F.lit(" languages="), F.array_join("l", ",")), "n"),
        _section("PUBLIC_API", inventory.exported_names(m["symbols"]).join(code.filter("role != 'test'").select("path"), "path", "left_semi"), F.concat("path", F.lit(": "), F.array_join(F.slice("names", 1, 6), ", ")), "path"),
        _section("ENTRYPOINT_GROUPS", entries.groupBy("domain").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("label")), 1, 2).alias("l")), F.concat_ws(" ", "domain", n("n"), F.array_join("l", ",")), F.desc("n"), "domain"),
        _section("COMPONENT_EDGES", shown, F.concat("src", F.lit(" -> "), "dst", F.lit(" "), F.col("w").cast("bigint").cast("string")), F.desc("w"), "src", "dst"),
        _section("CYCLES", graph.cycles(shown).limit(3), arrow("cycle"), "cycle"),
        _section("WARNINGS", m["skipped"], F.concat(F.lit("not parsed, too long: "), "path"), "path", most=6),
        _section("EXTERNALS", inventory.external_groups(m["external_dep"]), F.concat_ws(" ", "category", F.array_join("modules", ",")), F.desc("n"), "category"),
        _section("PACKAGES", inventory.package_stats(code, m["symbols"], package_roots(m["nodes"])), F.concat_ws(" ", "root", n("files"), n("symbols")), F.desc("files"), F.desc("symbols"), "root"),
        _section("CONFIDENCE_GATE", row, F.concat_ws(" ", "gate", F.array_join("reasons", ",")), "gate"),
        _section("LIMITS", cut, F.concat_ws(" ", "section", F.concat(F.lit("available="), n("available")), F.concat(F.lit("omitted="), n("omitted_by_limit"))), "section"),
        _section("FOREIGN_KEYS", codemap.foreign_keys(m["entities"]), F.concat_ws(" ", "id", "field", "dst"), "id", "field", "dst"),
        _section("ROUTE_GROUPS", inventory.route_groups(m["api_contracts"].select(F.lit("api").alias("kind"), "route")), F.concat_ws(" ", "key", n("n")), F.desc("n"), "key"),
        _section("ARCHITECTURE", inventory.architecture(code, m["external_dep"]), F.concat(F.lit("layout="), "layout", F.lit(" frameworks="), F.array_join("frameworks", ","), F.lit(" stores="), F.array_join("stores", ",")), "layout"),
        _section("ROLE_EDGES", inventory.role_edges(edges, roles), F.concat("src_role", F.lit("->"), "dst_role", F.lit(" "), n("n")), F.desc("n"), "src_role", "dst_role"),
        _section("PURPOSE", quality.component_purpose(words, keywords), F.concat_ws(" ", "component", "purpose"), "component"),
        _section("QUALITY", row, F.concat(F.lit("files="), n("files"), F.lit(" calls="), n("calls"), F.lit(" imports="), F.coalesce(n("import_capture_rate"), F.lit("n/a")), F.lit(" confidence="), "ast_confidence"), "files"),
        _section("TEST_CONFIDENCE", trust.groupBy("bucket").agg(F.count("*").alias("n")), F.concat_ws(" ", "bucket", n("n")), F.desc("n"), "bucket"),
        _section("TRACEABILITY", codemap.doc_links(m["files"].filter("path LIKE '%.md'").select("path"), named), F.concat_ws(" -> ", "doc_path", "target"), "doc_path", "target", most=6),
        _section("EDGES", edges.groupBy("src", "dst").agg(F.sum("w").alias("w")), F.concat("src", F.lit(" -> "), "dst"), F.desc("w"), "src", "dst"),
        _section("DIAGRAM", shown, F.concat("src", F.lit(" --> "), "dst"), F.desc("w"), "src", "dst"),
    ]
    return out


def assemble(parts: list[DataFrame], budget: int, margin: float = 1.0, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """(section, pos, line, tokens) in report order within the budget. A section with a ratio is cut at
    the first line that its share doesn't hold; then sections are dropped in DROPPED_FIRST's order
    until the rest fits; and at last the text ends before the first line that is too much."""
    cap = max(1, int(budget * min(1.0, max(0.5, margin))))
    # the lines are needed for the sizes of the sections and for the text
    lines = cut_lineage(parts[0].sparkSession, reduce(DataFrame.unionByName, parts).withColumn("tokens", token_estimate(F.col("line"))))
    place = F.create_map(*[F.lit(x) for i, n in enumerate(ORDER) for x in (n, i)])
    share = F.create_map(*[F.lit(x) for n, r in ratios.items() for x in (n, float(min(1.0, max(0.0, r))))])
    own = Window.partitionBy("section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("running", F.sum("tokens").over(own)).filter(F.col("running") <= F.coalesce(F.try_element_at(share, F.col("section")), F.lit(1.0)) * cap)
    drop = F.create_map(*[F.lit(x) for i, n in enumerate(DROPPED_FIRST) for x in (n, i)])
    sizes = lines.groupBy("section").agg(F.sum("tokens").alias("tokens")).withColumn("drop_order", F.try_element_at(drop, F.col("section")))
    kept = lines.join(F.broadcast(windows.govern(sizes, cap).select("section")), "section", "left_semi").withColumn("o", F.try_element_at(place, F.col("section")))
    total = Window.orderBy("o", "pos").rowsBetween(Window.unboundedPreceding, 0)
    fits = kept.withColumn("all", F.sum("tokens").over(total)).filter(F.col("all") <= cap)
    return fits.orderBy("o", "pos").select("section", "pos", "line", "tokens")


def digest(files: DataFrame, profile: str = "balanced", budget: int | None = None) -> DataFrame:
    """The report of files (path, content)."""
    return assemble(sections(codemap.build(files)), budget or PROFILES[profile])
