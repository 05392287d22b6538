"""The code map: from a table of files to the relations of its property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import paths
from corvane.functions.text import clean_type, identifier_parts, normal_path, normal_terms
from corvane.operators import graph, joins, quality, rank
from corvane.operators.extract import extract_facts
from corvane.session import cut_lineage
from corvane.sources.files import classify, code_files, oversized, summary_line

_TS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path: Column, line: Column, name: Column) -> Column:
    return F.concat(F.lit("sym:"), path, F.lit("#L"), F.coalesce(line, F.lit(0)).cast("string"), F.lit(":"), name)


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]+$", "")


def _joined(base: Column, tail: Column) -> Column:
    return normal_path(F.when(base == "", tail).otherwise(F.concat(base, F.lit("/"), tail)))


def import_candidates(aliases: list[tuple[str, str, str]]) -> Column:
    """The paths that an import (path, language, name as module, level, items) may mean, best first."""
    module, here = F.col("module"), _directory(F.col("path"))
    relative = module.rlike("^\\.{1,2}(?:/|$)")
    based = F.when(relative, _joined(here, module))
    for pattern, target, base in aliases:
        head, tail = pattern.rstrip("*"), normal_path(F.lit(f"{base}/{target}".replace("*", "")))
        based = F.coalesce(based, F.when(module.startswith(head), _joined(tail, F.substring(module, F.lit(len(head) + 1), F.length(module)))))
    for base in sorted({b for _, _, b in aliases}) or ["."]:
        based = F.coalesce(based, _joined(normal_path(F.lit(base)), module))
    script = F.array(*[F.concat(based, F.lit(x)) for x in _TS])
    # an import may name .js where the source is .ts
    script = F.concat(script, F.array(F.regexp_replace(based, "\\.jsx?$", ".ts"), F.regexp_replace(based, "\\.jsx?$", ".tsx")))
    dotted = F.replace(module, F.lit("."), F.lit("/"))
    up = F.array_join(F.slice(F.split(here, "/"), F.lit(1), F.greatest(F.size(F.split(here, "/")) - F.col("level") + 1, F.lit(0))), "/")
    root = F.when(F.col("level") > 0, up).otherwise(F.lit(""))
    stem = F.when(module == "", root).otherwise(_joined(root, dotted))
    own = _joined(here, dotted)
    named = F.flatten(F.transform("items", lambda n: F.array(F.concat(stem, F.lit("/"), n, F.lit(".py")), F.concat(stem, F.lit("/"), n, F.lit("/__init__.py")))))
    tries = F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")), F.concat(F.lit("src/"), stem, F.lit(".py")), F.concat(F.lit("src/"), stem, F.lit("/__init__.py")))
    python = F.concat(F.when(F.col("level") > 0, named).otherwise(F.array().cast("array<string>")), tries, named, F.when(F.col("level") == 0, F.array(F.concat(own, F.lit(".py")), F.concat(own, F.lit("/__init__.py")))).otherwise(F.array().cast("array<string>")))
    crate = F.regexp_replace(F.replace(F.regexp_replace(module, "^(?:crate|self|super)::", ""), F.lit("::"), F.lit("/")), "/(?:\\{.*|[A-Z]\\w*)$", "")
    parent = F.regexp_replace(crate, "/[^/]+$", "")
    rust = F.array(*[F.concat(p, c, F.lit(e)) for c in (crate, parent) for p in (F.lit("src/"), F.when(here == "", F.lit("")).otherwise(F.concat(here, F.lit("/")))) for e in (".rs", "/mod.rs")])
    return F.when(F.col("language") == "py", python).when(F.col("language") == "rs", rust).otherwise(script)


def resolve_imports(facts: DataFrame, files: DataFrame, aliases: list[tuple[str, str, str]] = ()) -> tuple[DataFrame, DataFrame]:
    """(file_dep: src, dst, w, kind, provenance; external_dep: src, module, kind)."""
    sites = facts.filter("fact = 'import'").join(files.select("path", "language"), "path").select("path", "language", "line", F.col("name").alias("module"), "items", F.col("attrs")["kind"].alias("kind"), F.col("attrs")["level"].cast("int").alias("level"))
    sites = sites.withColumn("site", F.row_number().over(Window.partitionBy("path").orderBy("line", "module", "kind")))
    found = joins.first_candidate(sites, ["path", "site"], import_candidates(list(aliases)), files, "path")
    inside = found.filter("resolved IS NOT NULL").select(F.col("path").alias("src"), F.col("resolved").alias("dst"), F.lit(1.0).alias("w"), "kind", F.lit("ast").alias("provenance"))
    outside = found.filter("resolved IS NULL").select(F.col("path").alias("src"), "module", "kind")
    return inside, outside


def symbols_of(facts: DataFrame) -> DataFrame:
    """(id, name, kind, signature, visibility, path, line, end_line, params, returns_value), one row for an id."""
    s = facts.filter("fact = 'symbol'").select(symbol_id(F.col("path"), F.col("line"), F.col("name")).alias("id"), "name", F.col("attrs")["kind"].alias("kind"), F.col("attrs")["signature"].alias("signature"), F.col("attrs")["visibility"].alias("visibility"), "path", "line", "end_line", F.col("items").alias("params"), (F.col("attrs")["returns_value"] == "True").alias("returns_value"))
    return s.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("kind", "signature"))).filter("_r = 1").drop("_r")


def resolve_symbol_calls(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, kind, provenance): calls from the symbol around them to the symbols that the name means."""
    calls = facts.filter("fact = 'call'").select("path", "line", F.col("name").alias("callee"))
    callables = symbols.filter("kind IN ('function', 'component', 'class')")
    spans = symbols.filter("kind IN ('function', 'component')").select("path", F.col("line").alias("s"), F.col("end_line").alias("e"), F.col("id").alias("caller"))
    scoped = joins.innermost_range(calls, spans, "path", "line", "s", "e", "caller", 200).filter("caller IS NOT NULL")
    sites = scoped.select(F.concat_ws("|", "caller", "callee").alias("site"), F.col("path").alias("file"), F.col("callee").alias("name")).distinct()
    defs = callables.select(F.col("id").alias("target"), F.col("path").alias("file"), "name", F.concat_ws("#", F.col("path"), F.lpad(F.col("line").cast("string"), 9, "0")).alias("ordinal"))
    found = joins.resolve_calls(sites, defs)
    return found.select(F.substring_index("site", "|", 1).alias("src"), F.col("target").alias("dst"), F.lit("call").alias("kind"), F.lit("ast").alias("provenance")).filter("src != dst")


def type_edges(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_id, from_name, to_id, to_name, kind, path, line, ambiguous): both ends bound by path and
    name, else by a name that is unique."""
    t = facts.filter("fact = 'type'").select("path", "line", F.col("name").alias("from_name"), clean_type(F.col("target")).alias("to_name"), F.col("attrs")["kind"].alias("kind")).distinct()
    unique = symbols.groupBy(F.col("name").alias("_n")).agg(F.count("*").alias("_c"), F.min("id").alias("_u"))
    local = symbols.groupBy(F.col("path").alias("_p"), F.col("name").alias("_m")).agg(F.min("id").alias("_l"))
    out = t
    for end in ("from", "to"):
        l = local.select(F.col("_p"), F.col("_m"), F.col("_l").alias(f"_l_{end}"))  # noqa: E741
        u = unique.select(F.col("_n"), F.col("_c").alias(f"_c_{end}"), F.col("_u").alias(f"_u_{end}"))
        out = out.join(l, (F.col("path") == F.col("_p")) & (F.col(f"{end}_name") == F.col("_m")), "left").drop("_p", "_m")
        out = out.join(u, F.col(f"{end}_name") == F.col("_n"), "left").drop("_n")
        out = out.withColumn(f"{end}_id", F.coalesce(f"_l_{end}", F.when(F.col(f"_c_{end}") == 1, F.col(f"_u_{end}"))))
    return out.select("from_id", "from_name", "to_id", "to_name", "kind", "path", "line", (F.col("to_id").isNull() & (F.coalesce("_c_to", F.lit(0)) > 1)).alias("ambiguous"))


def entities_of(facts: DataFrame, limit: int = 50) -> DataFrame:
    """(id, name, kind, path, fields, relations): entities outside noise paths, taken from the components
    in turn; names that come again get #2, #3 and so on. relations are other entities in field types."""
    e = facts.filter("fact = 'entity'").filter(~paths.is_noise(F.col("path"))).select("name", F.col("attrs")["kind"].alias("kind"), "path", "line", F.col("items").alias("fields"), paths.component(F.col("path")).alias("component"))
    e = e.withColumn("_k", F.row_number().over(Window.partitionBy("path", "name").orderBy("line", "kind"))).filter("_k = 1").drop("_k")
    turn = Window.partitionBy("component").orderBy(F.desc(F.size("fields")), "path", "line")
    e = e.withColumn("_t", F.row_number().over(turn)).orderBy("_t", "component").limit(limit)
    nth = F.row_number().over(Window.partitionBy("name").orderBy("_t", "component", "path"))
    e = e.withColumn("_n", nth).withColumn("id", F.concat(F.lit("entity:"), F.col("name"), F.when(F.col("_n") > 1, F.concat(F.lit("#"), F.col("_n").cast("string"))).otherwise(F.lit(""))))
    names = e.select(F.collect_set("name").alias("_all"))
    used = F.flatten(F.transform("fields", lambda f: F.regexp_extract_all(F.substring_index(f, ":", -1), F.lit("([A-Z][A-Za-z0-9]*)"), F.lit(1))))
    return e.crossJoin(F.broadcast(names)).select("id", "name", "kind", "path", "fields", F.slice(F.array_sort(F.array_except(F.array_intersect(used, "_all"), F.array("name"))), 1, 4).alias("relations"))


def entity_edges(entities: DataFrame, files: DataFrame, file_dep: DataFrame) -> DataFrame:
    """(src, dst, kind): defines (file to entity), uses (a file that imports the defining one and holds
    the name), relates (entity to entity, if the name is unique)."""
    defines = entities.select(file_id(F.col("path")).alias("src"), F.col("id").alias("dst"), F.lit("defines").alias("kind"))
    importers = file_dep.select(F.col("src").alias("_user"), F.col("dst").alias("path")).distinct().join(entities.select("path", "id", "name"), "path")
    text = files.select(F.col("path").alias("_user"), "content")
    uses = importers.join(text, "_user").filter(F.expr("content rlike concat('(?<![A-Za-z0-9_])', name, '(?![A-Za-z0-9_])')")).select(file_id(F.col("_user")).alias("src"), F.col("id").alias("dst"), F.lit("uses").alias("kind"))
    only = entities.groupBy(F.col("name").alias("_n")).agg(F.min("id").alias("dst"), F.count("*").alias("_c")).filter("_c = 1")
    relates = entities.select("id", F.explode("relations").alias("_n")).join(only, "_n").select(F.col("id").alias("src"), "dst", F.lit("relates").alias("kind"))
    return defines.unionByName(uses).unionByName(relates).distinct()


def foreign_keys(entities: DataFrame) -> DataFrame:
    """(id, field, dst): fields such as teamId or team_id that name another entity."""
    f = entities.select("id", F.explode("fields").alias("f")).withColumn("field", F.regexp_replace(F.substring_index("f", ":", 1), "\\?$", ""))
    base = F.lower(F.regexp_extract("field", "^(.+?)_?[iI]d$", 1))
    targets = entities.select(F.lower(F.regexp_replace("name", "s$", "")).alias("_b"), F.col("id").alias("dst"))
    return f.withColumn("_b", base).filter("_b != ''").join(targets, "_b").filter("id != dst").select("id", "field", "dst")


def api_contracts(facts: DataFrame) -> DataFrame:
    """(method, route, path, line, handler): the first of equal contracts of a file; use calls aren't any."""
    r = facts.filter("fact = 'route'").select(F.col("attrs")["method"].alias("method"), F.col("name").alias("route"), "path", "line", F.col("target").alias("handler")).filter("method != 'USE'")
    return r.withColumn("_r", F.row_number().over(Window.partitionBy("path", "method", "route").orderBy("line"))).filter("_r = 1").drop("_r")


def test_targets(files: DataFrame, file_dep: DataFrame, symbol_ref: DataFrame, symbols: DataFrame) -> DataFrame:
    """(test, target, via): what test files import or call, and, for tests without either, files of the
    tested name; never the test itself."""
    tests = files.filter("role = 'test'").select(F.col("path").alias("test"))
    code = files.filter("role != 'test' AND language != 'unknown'").select(F.col("path").alias("target"))
    by_import = file_dep.select(F.col("src").alias("test"), F.col("dst").alias("target"))
    where = symbols.select("id", "path")
    by_call = symbol_ref.join(where.select(F.col("id").alias("src"), F.col("path").alias("test")), "src").join(where.select(F.col("id").alias("dst"), F.col("path").alias("target")), "dst").select("test", "target")
    direct = by_import.unionByName(by_call).join(tests, "test", "left_semi").join(code, "target", "left_semi").filter("test != target").select("test", "target").distinct()
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, "([^/]+)\\.[A-Za-z]+$", 1), "^test_|_test$|\\.test$|\\.spec$", ""))
    named = tests.withColumn("_s", stem(F.col("test"))).join(code.withColumn("_s", stem(F.col("target"))), "_s").select("test", "target")
    fallback = named.join(direct.select("test").distinct(), "test", "left_anti")
    return direct.withColumn("via", F.lit("graph")).unionByName(fallback.withColumn("via", F.lit("name")))


def entry_signals(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(path, entry_role): the best signal wins: manifests, then content, then the name."""
    p, c = F.col("path"), F.col("content")
    ok = paths.is_runtime(p) & ~paths.is_test(p) & (F.col("language") != "unknown")
    found = files.filter(ok).select("path", F.explode(F.array(F.struct(F.lit(2).alias("s"), paths.content_role(c).alias("r")), F.struct(F.lit(1).alias("s"), paths.entry_role(p).alias("r")))).alias("x")).select("path", "x.s", "x.r")
    if manifest is not None:
        found = found.unionByName(manifest.join(files.filter(ok).select("path"), "path", "left_semi").select("path", F.lit(3).alias("s"), F.col("role").alias("r")))
    order = F.array(*[F.lit(x) for x in ("cli", "server", "worker", "app", "main")])
    return found.filter("r IS NOT NULL").groupBy("path").agg(F.min_by("r", F.struct(-F.col("s"), F.array_position(order, F.col("r")))).alias("entry_role"))


def build(files: DataFrame, aliases: list[tuple[str, str, str]] = (), manifest: DataFrame | None = None) -> dict[str, DataFrame]:
    """All relations of the code map of files (path, content). Facts are extracted once and kept; code
    files that are too long to be parsed are listed in skipped. manifest (path, role) names entrypoints."""
    spark = files.sparkSession
    nodes = classify(files)
    if manifest is not None:
        nodes = nodes.drop("entry_role", "role").join(entry_signals(nodes, manifest), "path", "left")
        nodes = nodes.withColumn("role", paths.role(F.col("path"), F.col("entry_role").isNotNull()))
    facts = cut_lineage(spark, extract_facts(code_files(nodes).unionByName(nodes.filter((F.col("language") == "unknown") & F.col("path").rlike("\\.(?:sql|prisma|graphql|gql|proto)$")))))
    file_dep, external = resolve_imports(facts, nodes.filter("language != 'unknown'"), aliases)
    file_dep = cut_lineage(spark, file_dep)
    symbols = cut_lineage(spark, symbols_of(facts))
    refs = cut_lineage(spark, resolve_symbol_calls(facts, symbols))
    lifted = refs.join(symbols.select(F.col("id").alias("src"), F.col("path").alias("a")), "src").join(symbols.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst").filter("a != b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    exports = symbols.filter("visibility = 'public'").groupBy(F.col("path").alias("node")).agg(F.count("*").alias("exports"))
    entry = nodes.filter("language != 'unknown'").select(F.col("path").alias("node"), F.col("entry_role").isNotNull().alias("is_entry"))
    scores = rank.file_scores(entry, file_dep, exports, lifted)
    symbol_scores = rank.symbol_scores(symbols.select(F.col("id").alias("symbol"), "kind", "visibility"), refs)
    entities = cut_lineage(spark, entities_of(facts))
    docs = facts.filter("fact = 'doc'").select("path", F.col("name").alias("owner"), "line", F.col("attrs")["summary"].alias("summary"), F.col("items").alias("params"), F.col("attrs")["returns_type"].alias("returns_type"), F.col("attrs")["returns"].alias("returns"), F.col("attrs")["raises"].alias("raises"))
    file_nodes = nodes.withColumn("summary_1l", summary_line()).join(scores.withColumnRenamed("node", "path"), "path", "left").select(file_id(F.col("path")).alias("id"), "path", "language", "role", "entry_role", "layer", "component", "sha1", "summary_1l", "score")
    # what reports read many times is computed once
    file_nodes = cut_lineage(spark, file_nodes)
    scored = symbols.join(symbol_scores.select(F.col("symbol").alias("id"), "refs_in", "refs_out", "score"), "id", "left")
    scored, external = cut_lineage(spark, scored), cut_lineage(spark, external)
    tests, contracts = cut_lineage(spark, test_targets(nodes, file_dep, refs, symbols)), cut_lineage(spark, api_contracts(facts))
    return {
        "facts": facts, "files": file_nodes, "symbols": scored, "file_dep": file_dep, "external_dep": external, "symbol_ref": refs, "call_lift": lifted,
        "dataflow": facts.filter("fact = 'flow'").select(F.col("path").alias("from_path"), F.col("line").alias("from_line"), F.col("path").alias("to_path"), F.col("end_line").alias("to_line"), F.col("attrs")["kind"].alias("kind"), F.lit("ast").alias("provenance")),
        "type_ref": type_edges(facts, symbols), "entities": entities, "entity_use": entity_edges(entities, nodes, file_dep), "api_contracts": contracts, "docs": docs,
        "tests": tests, "nodes": nodes, "skipped": oversized(nodes),
    }


def client_routes(facts: DataFrame, contracts: DataFrame) -> DataFrame:
    """(path, route, handler): client calls and the server routes that they reach."""
    from corvane.functions.text import route_pattern, url_path

    calls = facts.filter("fact = 'client'").select(F.concat_ws("#", "path", "line", "name").alias("call"), F.col("attrs")["method"].alias("method"), url_path(F.col("name")).alias("path"))
    routes = contracts.select(F.concat_ws(" ", "method", "route").alias("route"), "method", route_pattern(F.col("route")).alias("pattern")).distinct()
    return joins.match_routes(calls, routes).select(F.substring_index("call", "#", 1).alias("path"), "route")


def unused(symbols: DataFrame, files: DataFrame, limit: int = 8) -> DataFrame:
    """(id): public symbols of library files that nothing refers to, the first by id."""
    library = files.filter("role = 'library'").select("path")
    return symbols.filter("visibility = 'public' AND coalesce(refs_in, 0) = 0").join(library, "path", "left_semi").select("id").orderBy("id").limit(limit)


def unused_reexports(file_dep: DataFrame, limit: int = 8) -> DataFrame:
    """(path): files that pass names on (kind reexport) and that no file imports, the first by path."""
    passing = file_dep.filter("kind = 'reexport'").select(F.col("src").alias("path")).distinct()
    return passing.join(file_dep.select(F.col("dst").alias("path")), "path", "left_anti").orderBy("path").limit(limit)


def doc_links(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_path, target, score): documents and the names that they share most terms with. docs: path;
    targets: id, name."""
    a = docs.select("path", normal_terms(identifier_parts(F.regexp_replace("path", "\\.[A-Za-z]+$", ""))).alias("tokens")).filter(F.size("tokens") > 0)
    b = targets.select("id", normal_terms(identifier_parts(F.col("name"))).alias("tokens"))
    return joins.name_overlap(a, "path", b, "id").select(F.col("path").alias("doc_path"), F.col("id").alias("target"), F.round("score", 3).alias("score"))


def skeleton(files: DataFrame, depth: int = 3, most: int = 12) -> DataFrame:
    """(line): the directory tree to a depth, `most` files of a directory, directories first."""
    parts = F.split("path", "/")
    dirs = files.select(F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).alias("k"), parts.alias("p"), F.size(parts).alias("n")).filter((F.col("k") < F.col("n")) & (F.col("k") <= depth))
    dirs = dirs.select(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("d")).distinct().select(F.concat("d", F.lit("/")).alias("line"), F.concat(F.regexp_replace("d", "/", "/0"), F.lit("/")).alias("key"))
    own = files.filter(F.size(parts) <= depth + 1).select("path", F.regexp_replace("path", "/?[^/]+$", "").alias("d"))
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy("path"))).withColumn("n", F.count("*").over(Window.partitionBy("d")))
    head = F.when(F.col("d") == "", F.lit("")).otherwise(F.concat(F.regexp_replace("d", "/", "/0"), F.lit("/")))
    shown = ranked.filter(F.col("r") <= most).select(F.col("path").alias("line"), F.concat(head, F.lit("1"), F.substring_index("path", "/", -1)).alias("key"))
    more = ranked.filter(F.col("r") == most + 1).select(F.concat(F.col("d"), F.lit("/... "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("line"), F.concat(head, F.lit("2")).alias("key"))
    return dirs.unionByName(shown).unionByName(more).orderBy("key").select("line")


def map_quality(relations: dict[str, DataFrame]) -> DataFrame:
    """One row: files, symbols, calls and flows for each file, import_capture_rate, ast_confidence, gate."""
    files = relations["files"].filter("language != 'unknown'").agg(F.count("*").alias("files"), F.count(F.when(F.col("language") == "go", 1)).alias("bare"))
    n = lambda name, alias: relations[name].agg(F.count("*").alias(alias))
    row = files.crossJoin(n("symbols", "symbols")).crossJoin(n("symbol_ref", "calls")).crossJoin(n("dataflow", "flows")).crossJoin(n("file_dep", "inside")).crossJoin(n("external_dep", "outside"))
    row = row.withColumn("import_capture_rate", F.when(F.col("inside") + F.col("outside") > 0, F.round(F.col("inside") / (F.col("inside") + F.col("outside")), 3)))
    row = row.withColumns({"ast_confidence": quality.edge_confidence(F.col("files"), F.col("calls"), F.col("flows")), "second_source": F.lit(False)})
    return quality.gate(row, F.lit(False))
