"""A source tree on disk, configuration, and the helpers that read it."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from corvane.functions import predicates as P
from corvane.operators import inventory, joins, lookup, project, snapshots
from corvane.sources import config, files, fixture


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("shop")
    extra = {
        "node_modules/x/i.js": "x", "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}} // c\n}', "src/long.ts": "const a = 1;\n" * 20_000,
        "repomap.json": '{"docs_globs": ["notes/*"], "docs_exclude_globs": "docs/*", "routes": {"mode": " fastapi ", "globs": ["api/*"]}, "entrypoints": {"max_items": 5, "details": {"limit": 2}}}',
        "notes/a.txt": "n", "src/bad.ts": b"const ok = 1; // \xff\xfe\n",
    }
    for path, text in (fixture.FILES | extra).items():
        os.makedirs(os.path.dirname(f"{top}/{path}"), exist_ok=True)
        with open(f"{top}/{path}", "wb") as out:
            out.write(text if isinstance(text, bytes) else text.encode())
    return str(top)


def test_load(spark, root):
    found = project.load(spark, root)
    paths = {r["path"] for r in found["files"].select("path").collect()}
    assert "src/bad.ts" in paths and not any(p.startswith("node_modules") for p in paths)
    assert found["files"].filter("path = 'src/bad.ts'").head()["content"] == "const ok = 1; // \n"
    assert found["framework"] == "hono" and not found["is_monorepo"] and found["aliases"] == [("@/*", "src/*", ".")]
    assert [tuple(r) for r in found["manifest"].collect()] == [("src/index.ts", "main")]
    assert found["config"]["routes_mode"] == "fastapi" and found["config"]["routes_globs"] == ["api/*"] and found["config"]["entrypoints"]["details_limit"] == 2
    kinds = {k: {r["path"] for r in v.collect()} for k, v in project.chosen(found["files"], found["config"]).items()}
    assert kinds["docs"] == {"notes/a.txt"} and kinds["tests"] == {"tests/test_cart.py", "tests/test_prices.py"}
    assert {r["path"]: (r["name"], r["main"], r["scripts"]) for r in config.package_rows(found["files"]).collect()} == {"package.json": ("shop", "src/index.ts", [])}
    assert config.auto_flags(found["files"]) == {"parse": True, "flows": True} and config.auto_flags(found["files"], 3) == {"parse": False, "flows": False}


def test_code_map_of_a_folder(spark, root, tmp_path):
    m = project.code_map(spark, root)
    assert [tuple(r) for r in m["skipped"].collect()] == [("src/long.ts", 260_000)]
    assert {r["path"]: r["entry_role"] for r in m["nodes"].filter("entry_role IS NOT NULL").collect()} == {"api/routes.py": "server", "src/index.ts": "main"}
    assert m["file_dep"].filter("src = 'src/index.ts' AND dst = 'src/models.ts'").count() == 1
    lines = [r["line"] for r in project.summary(m).collect()]
    assert "language py=7" in lines or "language py=6" in lines
    card = [r["line"] for r in lookup.expand(m, "services/cart.py").orderBy("pos").collect()]
    assert card[0] == "[FILE] services/cart.py" and "inbound=api/routes.py,tests/test_cart.py" in card and "outbound=models/item.py,services/prices.py" in card and card[-1].startswith("dataflow_in=")
    card = [r["line"] for r in lookup.expand(m, "add_item").orderBy("pos").collect()]
    assert card[0] == "[SYMBOL] add_item" and any(c.startswith("callers=") and "create_item" in c for c in card)
    assert lookup.expand(m, "no such thing").collect() == [] and len(lookup.expand(m, "services/cart.py", budget=8).collect()) < 4
    project.write_artefacts(m, str(tmp_path), "minimal")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/tests").count() == 2


def test_configuration():
    warnings: list[str] = []
    assert config.project_config({}) == {} and config.project_config({".repomap.json": "{"}, warnings) == {} and len(warnings) == 1
    assert config.project_config({"repomap.json": "[]"}, warnings) == {} and len(warnings) == 2
    weights = config.evidence_weights("# x\nroute\thigh\t3.5\nbad line\nnew\tast\tx\n")
    assert config.domain_weights(weights, "route") == {"ast": 3.0, "config": 3.0, "graph": 2.0, "lexical": 1.0, "high": 3.5, "medium": 2.0}
    ratios, said = config.section_ratios({"files": "2", "SYMBOLS": 0, "none": 1, "Dir": "x"}, {"FILES": 0.4, "SYMBOLS": 0.2, "DIR": 0.1})
    assert ratios == {"FILES": 1.0, "SYMBOLS": 0.2, "DIR": 0.1} and len(said) == 3
    assert config.fingerprint({"a": 1, "b": 2}) == config.fingerprint({"b": 2, "a": 1}) != config.fingerprint({"a": 2}) and config.fingerprint({}) == ""
    assert config.index_signature({"x": 1}, {}) != config.index_signature({"x": 2}, {})
    assert files.merged_aliases({"a/tsconfig.json": '{"compilerOptions": {"paths": {"~/*": ["s/*"]}}}', "tsconfig.json": "{}"}) == [("~/*", "s/*", "a/.")]


def test_contents(spark):
    rows = [("a.py", "@app.get('/x')", True), ("a.py", "x = 1", False), ("b.ts", "export async function GET(r) {}", True), ("c.rs", '#[get("/x")]', True), ("d.go", 'mux.HandleFunc("/x", f)', True), ("e.txt", "app.get('/x')", False), ("f.py", None, False)]
    got = spark.createDataFrame(rows, "path string, content string, want boolean").select("want", P.route_signal(F.col("path"), F.col("content")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    actions = spark.createDataFrame([("'use server';", True), ("export async function loader() {}", True), ("server", False), (None, False)], "content string, want boolean")
    assert all(r[0] == r[1] for r in actions.select("want", P.is_server_action(F.col("content"))).collect())


def test_entry_inventory(spark):
    contracts = spark.createDataFrame([("GET", "/hello", "a.ts"), ("POST", "/hello", "a.ts")], "method string, route string, path string")
    nodes = spark.createDataFrame([("a.ts", "x", "server"), ("b.ts", "export default { async scheduled(e) {} }", None), ("c.py", "", "cli"), ("d.ts", "'use server'", None)], "path string, content string, entry_role string")
    got = {(r["kind"], r["label"], r["path"], r["domain"]) for r in inventory.entry_inventory(contracts, nodes).collect()}
    assert got == {("http", "get:/hello", "a.ts", "http"), ("http", "post:/hello", "a.ts", "http"), ("job", "scheduled", "b.ts", "job"), ("rpc", "action", "d.ts", "rpc"), ("entry", "cli", "c.py", "entry")}


def test_overlap_bound_is_exact(spark):
    """Pairs by plain sets, with tokens that are in almost every row."""
    import random

    rng = random.Random(3)
    rows = lambda n: [(i, [f"c{rng.randrange(3)}" for _ in range(4)] + [f"t{rng.randrange(40)}" for _ in range(rng.randrange(12))]) for i in range(n)]
    a, b = rows(40), rows(60)
    frame = lambda x: spark.createDataFrame(x, "id long, tokens array<string>")
    for least in (0.2, 0.5, 1.0):
        got = {(r["id"], r["other"], r["common"]) for r in joins.name_overlap(frame(a), "id", frame(b).withColumnRenamed("id", "other"), "other", least, 1000).collect()}
        assert got == {(i, j, len({*x} & {*y})) for i, x in a for j, y in b if {*x} & {*y} and len({*x} & {*y}) / len({*x}) >= least}


def test_prune_keeps_other_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    left = snapshots.prune(edges, spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("c",)], "node string"))
    assert left.collect() == []


def test_unused_reexports(spark):
    from corvane.operators import codemap

    dep = spark.createDataFrame([("a.ts", "x.ts", "reexport"), ("b.ts", "x.ts", "reexport"), ("c.ts", "b.ts", "import")], "src string, dst string, kind string")
    assert [r["path"] for r in codemap.unused_reexports(dep).collect()] == ["a.ts"]
