"""Queries over the source-tree fixture; their SQL is the expected rows, written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import codemap, quality, report, snapshots
from corvane.operators.extract import extract_facts
from corvane.plans.queries import query
from corvane.session import cut_lineage
from corvane.sources import files as sources
from corvane.sources import fixture

_BUILT: dict[str, dict] = {}


def relations(spark) -> dict:
    """The fixture's code map, built once for a session."""
    app = spark.sparkContext.applicationId
    if app not in _BUILT:
        _BUILT.clear()
        _BUILT[app] = codemap.build(fixture.files(spark), fixture.ALIASES)
    return _BUILT[app]


def _values(names: str, *rows: tuple) -> str:
    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]"
        if isinstance(v, float):
            return f"{v}::DOUBLE"
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


@query(_values("src, dst, kind", ("api/routes.py", "services/cart.py", "import"), ("services/cart.py", "models/item.py", "import"), ("services/cart.py", "services/prices.py", "import"), ("tests/test_cart.py", "services/cart.py", "import"), ("src/index.ts", "src/util.ts", "import"), ("src/index.ts", "src/models.ts", "import"), ("src/lib.rs", "src/shape.rs", "import"), ("src/lib.rs", "src/shape.rs", "import")))
def imports(spark, d):
    return relations(spark)["file_dep"].select("src", "dst", "kind")


@query(_values("src, module", ("api/routes.py", "fastapi"), ("services/prices.py", "math"), ("models/item.py", "pydantic"), ("src/index.ts", "hono"), ("examples/demo.py", "fastapi")))
def external_modules(spark, d):
    return relations(spark)["external_dep"].select("src", "module")


@query(_values("src, dst", ("read_item", "total"), ("create_item", "add_item"), ("add_item", "price_of"), ("add_item", "Item"), ("total", "price_of"), ("test_add", "add_item"), ("greet", "helper"), ("helper", "decorate"), ("run", "area")))
def py_calls(spark, d):
    name = lambda c: F.substring_index(c, ":", -1)
    return relations(spark)["symbol_ref"].select(name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"))


@query(_values("owner, summary, params, returns_type", ("read_item", "Reads an item.", ["item_id:int"], "dict"), ("add_item", "Adds an item.", ["name:"], None), ("helper", "Helps.", ["value:string"], "string"), ("<module>", "HTTP routes of the shop.", [], None), ("<module>", "Cart rules.", [], None)))
def docstrings(spark, d):
    return relations(spark)["docs"].select("owner", "summary", "params", "returns_type")


@query(_values("name, kind, fields, relations", ("Owner", "pydantic", ["id:int", "email:str"], []), ("Item", "pydantic", ["name:str", "cost:float", "owner_id:int", "owner:Owner"], ["Owner"]), ("Base", "interface", ["id:number"], []), ("Account", "interface", ["email:string", "teamId?:number"], []), ("teams", "drizzle", ["id:integer", "name:text"], []), ("orders", "sql", ["id:INTEGER", "item_id:INTEGER", "note:TEXT"], [])))
def entities(spark, d):
    return relations(spark)["entities"].select("name", "kind", "fields", "relations")


@query(_values("src, dst, kind", ("file:models/item.py", "entity:Owner", "defines"), ("file:models/item.py", "entity:Item", "defines"), ("file:src/models.ts", "entity:Base", "defines"), ("file:src/models.ts", "entity:Account", "defines"), ("file:src/models.ts", "entity:teams", "defines"), ("file:schema.sql", "entity:orders", "defines"), ("file:services/cart.py", "entity:Item", "uses"), ("file:src/index.ts", "entity:Account", "uses"), ("entity:Item", "entity:Owner", "relates")))
def entity_edges(spark, d):
    return relations(spark)["entity_use"]


@query(_values("id, field, dst", ("entity:Item", "owner_id", "entity:Owner"), ("entity:Account", "teamId", "entity:teams"), ("entity:orders", "item_id", "entity:Item")))
def foreign_keys(spark, d):
    return codemap.foreign_keys(relations(spark)["entities"])


@query(_values("method, route, path, handler", ("GET", "/items/{item_id}", "api/routes.py", "read_item"), ("POST", "/items", "api/routes.py", "create_item"), ("GET", "/hello/:name", "src/index.ts", "greet")))
def api_contracts(spark, d):
    return relations(spark)["api_contracts"].select("method", "route", "path", "handler")


@query(_values("path, route", ("src/index.ts", "GET /items/{item_id}")))
def client_routes(spark, d):
    m = relations(spark)
    return codemap.client_routes(m["facts"], m["api_contracts"])


@query(_values("from_name, kind, to_name, bound", ("Owner", "extends", "BaseModel", 0), ("Item", "extends", "BaseModel", 0), ("Account", "extends", "Base", 1)))
def type_edges(spark, d):
    return relations(spark)["type_ref"].select("from_name", "kind", "to_name", F.col("to_id").isNotNull().cast("int").alias("bound"))


@query(_values("test, target, via", ("tests/test_cart.py", "services/cart.py", "graph"), ("tests/test_prices.py", "services/prices.py", "name")))
def test_targets(spark, d):
    return relations(spark)["tests"]


@query(_values("path, role, entry_role", ("api/routes.py", "entrypoint", "server"), ("src/index.ts", "entrypoint", "server"), ("services/cart.py", "library", None), ("services/prices.py", "library", None), ("services/__init__.py", "library", None), ("models/item.py", "library", None), ("tests/test_cart.py", "test", None), ("tests/test_prices.py", "test", None), ("src/util.ts", "library", None), ("src/models.ts", "library", None), ("src/lib.rs", "library", None), ("src/shape.rs", "library", None), ("examples/demo.py", "library", None), ("schema.sql", "library", None), ("docs/cart.md", "library", None), ("package.json", "config", None)))
def file_roles(spark, d):
    return relations(spark)["files"].select("path", "role", "entry_role")


@query(_values("path, name, from_line, to_line", ("api/routes.py", "app", 6, 9), ("api/routes.py", "app", 6, 23), ("api/routes.py", "item_id", 10, 19), ("api/routes.py", "amount", 19, 20), ("api/routes.py", "name", 24, 25), ("services/cart.py", "name", 6, 12), ("services/cart.py", "name", 6, 13), ("services/cart.py", "cost", 12, 13), ("services/cart.py", "ids", 16, 17), ("services/cart.py", "result", 17, 18), ("services/prices.py", "name", 4, 5), ("src/index.ts", "app", 5, 6), ("src/index.ts", "app", 5, 7), ("src/index.ts", "text", 10, 11), ("src/lib.rs", "y", 5, 6)))
def dataflow(spark, d):
    return relations(spark)["facts"].filter("fact = 'flow'").select("path", "name", F.col("line").alias("from_line"), F.col("end_line").alias("to_line"))


@query(_values("id", ("sym:models/item.py#L4:Owner",), ("sym:src/lib.rs#L4:run",), ("sym:src/models.ts#L10:teams",), ("sym:src/models.ts#L1:Base",), ("sym:src/models.ts#L5:Account",)))
def unused_symbols(spark, d):
    m = relations(spark)
    return codemap.unused(m["symbols"], m["files"])


_EDGES = [("api/routes.py", "services/cart.py"), ("services/cart.py", "models/item.py"), ("services/cart.py", "services/prices.py"), ("tests/test_cart.py", "services/cart.py"), ("src/index.ts", "src/util.ts"), ("src/index.ts", "src/models.ts"), ("src/lib.rs", "src/shape.rs"), ("src/lib.rs", "src/shape.rs")]
#: path, public symbols, entrypoint, calls into the file, calls out of it
_NODES = [("api/routes.py", 2, 1, 0, 2), ("services/cart.py", 2, 0, 3, 3), ("services/prices.py", 1, 0, 2, 0), ("services/__init__.py", 0, 0, 0, 0), ("models/item.py", 2, 0, 1, 0), ("tests/test_cart.py", 1, 0, 0, 1), ("tests/test_prices.py", 1, 0, 0, 0), ("src/index.ts", 2, 1, 0, 1), ("src/util.ts", 1, 0, 1, 0), ("src/models.ts", 3, 0, 0, 0), ("src/lib.rs", 1, 0, 0, 1), ("src/shape.rs", 1, 0, 1, 0), ("examples/demo.py", 0, 0, 0, 0)]
_SCORE_SQL = f"""WITH n AS ({_values("node, exports, entry, i, o", *_NODES)}), e AS ({_values("src, dst", *_EDGES)}), s AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM e GROUP BY 1, 2), r0 AS (SELECT node, 1.0::DOUBLE / 13 AS r FROM n)""" + "".join(f", r{k} AS (SELECT n.node, 0.15::DOUBLE / 13 + 0.85::DOUBLE * coalesce(sum(r.r * s.share), 0) AS r FROM n LEFT JOIN s ON s.dst = n.node LEFT JOIN r{k - 1} r ON r.node = s.src GROUP BY 1)" for k in range(1, 21))


@query(_SCORE_SQL + " SELECT node AS path, round(0.6 * r + 0.2 * exports / 3 + 0.1 * 0.2 * entry + 0.1 * (i + o) / 3, 6) AS score FROM n JOIN r20 USING (node)")
def code_scores(spark, d):
    return relations(spark)["files"].filter("score IS NOT NULL").select("path", F.round("score", 6).alias("score"))


@query(_values("doc_path, target, score", ("docs/cart.md", "file:services/cart.py", 0.5)))
def doc_links(spark, d):
    files = relations(spark)["files"]
    targets = files.filter("language != 'unknown' AND role = 'library'").select("id", F.regexp_extract("path", "([^/]+)\\.[a-z]+$", 1).alias("name"))
    return codemap.doc_links(files.filter("path LIKE '%.md'").select("path"), targets)


@query(_values("line", ("api/",), ("api/routes.py",), ("docs/",), ("docs/cart.md",), ("examples/",), ("examples/demo.py",), ("models/",), ("models/item.py",), ("services/",), ("services/__init__.py",), ("services/cart.py",), ("services/prices.py",), ("src/",), ("src/index.ts",), ("src/lib.rs",), ("src/models.ts",), ("src/shape.rs",), ("src/util.ts",), ("tests/",), ("tests/test_cart.py",), ("tests/test_prices.py",), ("package.json",), ("schema.sql",)))
def skeleton(spark, d):
    return codemap.skeleton(fixture.files(spark))


@query(_values("files, calls, import_capture_rate, ast_confidence, gate", (13, 9, 0.615, "medium", "fail")))
def map_quality(spark, d):
    return codemap.map_quality(relations(spark)).select("files", "calls", "import_capture_rate", "ast_confidence", "gate")


@query(_values("test, bucket", ("tests/test_cart.py", "weak"), ("tests/test_prices.py", "theatrical")))
def test_confidence(spark, d):
    m = relations(spark)
    tests = m["files"].filter("role = 'test'").select(F.col("path").alias("test"))
    targets = m["tests"].filter("via = 'graph'").select("test", "target")
    entries = m["files"].filter("entry_role IS NOT NULL").select(F.col("path").alias("node"))
    return quality.test_confidence(tests, targets, tests.select("test", F.lit(None).alias("symbol")).limit(0), entries)


@query(_values("node, score", ("src/index.ts", 6.5), ("src/lib.rs", 6.5), ("src/shape.rs", 5.0), ("models/item.py", 4.5), ("src/models.ts", 4.5), ("src/util.ts", 4.5), ("api/routes.py", 3.75), ("examples/demo.py", 3.0)))
def change_risk(spark, d):
    from corvane.operators import graph

    m = relations(spark)
    code = m["files"].filter("language != 'unknown' AND role != 'test'").select(F.col("path").alias("node"))
    untested = code.join(m["tests"].select(F.col("target").alias("node")), "node", "left_anti")
    return quality.change_risk(code, graph.degrees(m["file_dep"].select("src", "dst")), untested, untested.limit(0)).select("node", "score")


@query()
def digest(spark, d):
    return report.assemble(report.sections(relations(spark)), 600)


_FILES = [*(n[0] for n in _NODES), "schema.sql", "docs/cart.md", "package.json"]


@query("""WITH h(k, line) AS (VALUES ('0', '<?xml version="1.0" encoding="UTF-8"?>'), ('0', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), ('0', '<key id="kind" for="all" attr.name="kind" attr.type="string"/>'), ('0', '<key id="label" for="node" attr.name="label" attr.type="string"/>'), ('0', '<graph edgedefault="directed">'), ('3', '</graph>'), ('3', '</graphml>'))
SELECT line FROM h UNION ALL SELECT '<node id="file:' || p || '"><data key="kind">file</data><data key="label">' || p || '</data></node>' FROM (""" + _values("p", *((f,) for f in _FILES)) + """) UNION ALL SELECT '<edge source="file:' || src || '" target="file:' || dst || '"><data key="kind">import</data></edge>' FROM (""" + _values("src, dst", *_EDGES) + ")")
def graphml(spark, d):
    m = relations(spark)
    nodes = m["files"].select("id", F.lit("file").alias("kind"), F.col("path").alias("label"))
    edges = m["file_dep"].select(codemap.file_id(F.col("src")).alias("src"), codemap.file_id(F.col("dst")).alias("dst"), "kind")
    return sources.graphml(nodes, edges)


@query(_values("path, n", ("services/prices.py", 4), ("src/shape.rs", 1)))
def incremental_facts(spark, d):
    """Two files change; only they are extracted again, and the facts equal a full run's."""
    old = fixture.files(spark)
    changed = F.when(F.col("path") == "services/prices.py", F.concat("content", F.lit("\n\ndef added():\n    return 2\n"))).when(F.col("path") == "src/shape.rs", F.concat("content", F.lit("// end\n"))).otherwise(F.col("content"))
    new = old.withColumn("content", changed)
    facts_with = lambda f: extract_facts(f).join(f.select("path", F.sha1("content").alias("sha1")), "path").select("path", "sha1", "fact", "name", "line")
    before = cut_lineage(spark, facts_with(old))
    after = snapshots.incremental(before, new, facts_with)
    return after.join(before.select("path", "sha1"), ["path", "sha1"], "left_anti").filter("fact = 'symbol' OR fact = 'import'").groupBy("path").agg(F.count("*").alias("n"))
