"""Operators against plain Python on small random inputs, and their edge cases."""

from __future__ import annotations

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from corvane.functions import paths
from corvane.functions import text as T
from corvane.operators import graph, joins, snapshots, windows
from corvane.operators.extract import facts_of, parse_docstring, parse_jsdoc
from corvane.sources import files as sources


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src int, dst int, w double")


@pytest.fixture(scope="module")
def random_edges():
    rng = random.Random(3)
    return [(rng.randrange(6), rng.randrange(7), float(rng.randint(1, 4))) for _ in range(16)]


def test_pagerank_matches_plain_loop(spark, random_edges):
    nodes = list(range(8))  # node 7 is isolated, 6 is dangling
    sums = {n: sum(w for s, _, w in random_edges if s == n) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / 8)
    for _ in range(20):
        got = dict.fromkeys(nodes, 0.0)
        for s, d, w in random_edges:
            got[d] += rank[s] * w / sums[s]
        rank = {n: 0.15 / 8 + 0.85 * got[n] for n in nodes}
    found = graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "node int"), edges_of(spark, random_edges)).collect()
    assert {r["node"]: pytest.approx(r["rank"]) for r in found} == rank


def test_cycles_match_permutations(spark, random_edges):
    pairs = {(s, d) for s, d, _ in random_edges}
    want = set()
    for n in (2, 3, 4):
        for p in permutations(range(7), n):
            if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in pairs for i in range(n)):
                want.add(p)
    assert {tuple(r["cycle"]) for r in graph.cycles(edges_of(spark, random_edges)).collect()} == want


def test_simple_paths_match_search(spark, random_edges):
    out = {n: sorted({d for s, d, _ in random_edges if s == n}) for n in range(8)}
    want = []

    def walk(path):
        if len(path) == 4 or not out[path[-1]]:
            want.append(path)
            return
        for d in out[path[-1]]:
            if d not in path:
                walk((*path, d))

    walk((0,))
    got = graph.simple_paths(edges_of(spark, random_edges), spark.createDataFrame([(0,)], "node int"), 4).collect()
    assert sorted(tuple(r["path"]) for r in got) == sorted(want)


def test_budget_prefix_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 1), ("b", 1, 3)], "g string, pos int, cost int")
    got = windows.budget_prefix(rows, ["g"], [F.col("pos")], "cost", 10).collect()
    assert sorted((r["g"], r["pos"]) for r in got) == [("a", 1), ("b", 1)]


def test_govern_drops_in_order(spark):
    rows = spark.createDataFrame([("keep", 50, None), ("first", 30, 0), ("second", 30, 1), ("third", 5, 2)], "section string, tokens int, drop_order int")
    assert {r["section"] for r in windows.govern(rows, 85).collect()} == {"keep", "second", "third"}
    assert {r["section"] for r in windows.govern(rows, 10).collect()} == {"keep"}


def test_asof_inclusive_and_strict(spark):
    left = spark.createDataFrame([("f", 5), ("f", 1), ("g", 5)], "by string, at int")
    right = spark.createDataFrame([("f", 5, "x"), ("f", 2, "y")], "by string, at int, v string")
    assert {(r["by"], r["at"]): r["v"] for r in joins.asof(left, right, "by", "at", "v").collect()} == {("f", 5): "x", ("f", 1): None, ("g", 5): None}
    assert {(r["by"], r["at"]): r["v"] for r in joins.asof(left, right, "by", "at", "v", strict=True).collect()}[("f", 5)] == "y"


def test_innermost_range_prefers_short_spans(spark):
    points = spark.createDataFrame([("f", 10), ("f", 99)], "by string, at int")
    spans = spark.createDataFrame([("f", 0, 50, "outer"), ("f", 8, 12, "inner")], "by string, s int, e int, n string")
    assert {r["at"]: r["n"] for r in joins.innermost_range(points, spans, "by", "at", "s", "e", "n", 7).collect()} == {10: "inner", 99: None}


def test_calls_prefer_local_definitions(spark):
    sites = spark.createDataFrame([(1, "a", "f"), (2, "b", "f")], "site int, file string, name string")
    defs = spark.createDataFrame([(i, "a" if i == 9 else f"x{i}", "f", i) for i in range(5, 10)], "target int, file string, name string, ordinal int")
    assert sorted((r["site"], r["target"]) for r in joins.resolve_calls(sites, defs).collect()) == [(1, 9), (2, 5), (2, 6), (2, 7)]


def test_diff_knows_nulls(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, "c"), (4, "d")], "k int, v string")
    assert {r["k"]: r["change"] for r in snapshots.diff(old, new, "k", ["v"]).collect()} == {2: "changed", 3: "removed", 4: "added"}


def test_prune_rules(spark):
    e = edges_of(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 1.0)])
    one = lambda *n: spark.createDataFrame([(x,) for x in n], "node int")
    assert sorted((r["src"], r["dst"]) for r in snapshots.prune(e, one(1), one(3)).collect()) == [(4, 1)]
    assert not snapshots.prune(e, one(1), one(3), either=True).collect()


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c", "a/c"), ("../x", "../x"), ("a/../../b", "../b"), ("", ""), ("a//b/", "a/b")])
def test_normal_path(spark, path, want):
    assert spark.range(1).select(T.normal_path(F.lit(path)).alias("p")).head()["p"] == want


def test_scalar_functions(spark):
    cells = {
        "tokens": T.token_estimate(F.lit("a_b = 2;")), "empty": T.token_estimate(F.lit("")), "null": T.token_estimate(F.lit(None).cast("string")),
        "parts": T.identifier_parts(F.lit("HTTPServer_idV2")), "route": T.file_route(F.lit("src/app/(shop)/items/[id]/[...rest]/page.tsx")),
        "pattern": T.route_pattern(F.lit("/a.b/:id/{x}")), "url": T.url_path(F.lit("https://h.example/a/b/?q#f")), "root": T.url_path(F.lit("https://h.example")),
        "hash": T.semantic_hash(F.lit("x = 1  # note\n"), F.lit("py")), "same": T.semantic_hash(F.lit("x=1\n"), F.lit("py")),
        "short": T.ellipsis(F.lit("abcdefghij"), 8), "line": T.line_of(F.lit("a\nb\nc"), F.lit(4)),
        "role": paths.role(F.lit("tests/test_a.py"), F.lit(True)), "lang": paths.language(F.lit("a/b.mjs")),
    }
    r = spark.range(1).select(*[c.alias(n) for n, c in cells.items()]).head()
    assert (r["tokens"], r["empty"], r["null"]) == (4, 1, 1)
    assert r["parts"] == ["http", "server", "id", "2"]  # a capital before a digit is in no part
    assert r["route"] == "/items/:id/*rest" and r["pattern"] == "^/a\\.b/[^/]+/[^/]+$"
    assert (r["url"], r["root"]) == ("/a/b", "/") and r["hash"] == r["same"]
    assert (r["short"], r["line"], r["role"], r["lang"]) == ("abcde...", 3, "test", "js")


def test_globs():
    import re

    assert re.search(T.glob_regex("src/*.ts"), "src/deep/a.ts") and re.search(T.glob_regex("conf"), "my/config") and not re.search(T.glob_regex("*.py"), "a.pyc")


def test_parameters_and_json():
    assert T.split_parameters("a: Dict[str, int], b=(1, 2), c='x,y'") == ["a: Dict[str, int]", "b=(1, 2)", "c='x,y'"]
    assert sources.load_config('{"a": "//x", /* c */ "b": [1,], // d\n}') == {"a": "//x", "b": [1]}
    assert sources.framework(pyproject='[project]\ndependencies = ["fastapi>=0.1"]') == "fastapi"
    assert sources.framework(pyproject='[tool.poetry.dependencies]\ndjango = "4"') == "django"
    assert sources.manifest_roles("web/package.json", '{"bin": {"x": "./cli.js"}, "scripts": {"dev": "tsx src/a.ts"}}') == [("web/cli.js", "cli"), ("web/src/a.ts", "main")]
    assert sources.manifest_roles("Dockerfile", 'CMD ["python", "serve.py"]') == [("serve.py", "server")]


def test_documentation_forms():
    google = parse_docstring("Adds.\n\nArgs:\n    x (int): one\n\nReturns:\n    str: text\n\nRaises:\n    ValueError: never")
    assert google["params"] == {"x": ("int", "one")} and google["returns_type"] == "str" and google["raises"] == ["ValueError"]
    numpy = parse_docstring("Adds.\n\nParameters\n----------\nx : int\n    one\n")
    assert numpy["params"]["x"][0] == "int"
    assert parse_jsdoc("\n * Helps.\n * @param {number} [n=1] - count\n * @returns {number} sum\n") == {"summary": "Helps.", "params": {"n": ("number", "count")}, "returns": "sum", "returns_type": "number", "raises": []}


def test_extractors_survive_odd_input():
    assert facts_of("a.py", "def broken(:") == [] and facts_of("a.py", None) == [] and facts_of("noext", "x") == []
    rust = facts_of("a.rs", 'fn f(x: i32) {\n    g(x);\n}\nfn g(y: i32) {}\n#[get("/r")]\n')
    assert [(f[1], f[2]) for f in rust if f[1] in ("call", "route")] == [("call", "g"), ("route", "/r")]
    go = facts_of("m.go", 'func main() {}\nr.GET("/x", handler)\n')
    assert ("route", "/x") in {(f[1], f[2]) for f in go}
    proto = facts_of("s.proto", "service S {\n  rpc Do (In) returns (Out);\n}")
    assert [f[2] for f in proto] == ["Do"]


def test_incremental_equals_full(spark, tmp_path):
    from corvane.streaming.incremental import latest, watch

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a.py", "def f():\n    return 1\n"), ("b.py", "import os\n")], "path string, content string").write.parquet(f"{source}/1")
    import os
    import shutil

    os.makedirs(f"{source}-flat")
    for k, rows in enumerate([[("a.py", "def f():\n    return 1\n"), ("b.py", "import os\n")], [("a.py", "def g():\n    return 1\n")]]):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.parquet(f"{source}-{k}")
        for name in os.listdir(f"{source}-{k}"):
            if name.endswith(".parquet"):
                shutil.copy(f"{source}-{k}/{name}", f"{source}-flat/{k}-{name}")
        query = watch(spark, f"{source}-flat", target, str(tmp_path / "check"))
        query.awaitTermination(120)
    got = {(r["path"], r["fact"], r["name"]) for r in latest(spark, target).collect()}
    assert got == {("a.py", "symbol", "g"), ("b.py", "import", "os")}
