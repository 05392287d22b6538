"""Queries of the predicates, the inventory and the lookups, over paths, modules and graphs that the
tables give, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import predicates as P
from corvane.functions import text as T
from corvane.operators import codemap, inventory, lookup
from corvane.plans.queries import TOKENS_SQL, URL_PATH_SQL, query
from corvane.plans.tables import TOP_SQL, nations, table, top_trade

_DIRS = ["src", "tests", "packages/web/src/routes/api", "db/migrations", "apps/shop/src/server/actions", "config", "lib/test", "src/schemas", "api", "src/routers", "src/services", "x/tmp"]
_ENDS = [".ts", ".tsx", ".py", ".test.ts", ".yaml", ".sql", ".prisma", ".spec.js", ".rs", ".config.js"]
_MODULES = ["react-dom", "@nestjs/typeorm", "express", "./local/file", "@/lib/db", "crate::shape", "src/util", "next/router", "pg-redis", "left-pad", "super::up", "~/rpc/users", "packages/web/routes/v1/api/x", "pytest.mock"]
_pick = lambda items, index: F.element_at(F.array(*map(F.lit, items)), index.cast("int"))
_sql_list = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"

PATHS_SQL = f"""paths AS (SELECT p_partkey AS id, p_brand AS brand, {_sql_list(_DIRS)}[p_partkey % {len(_DIRS)} + 1] || '/' || split_part(p_name, ' ', 1) || {_sql_list(_ENDS)}[p_size % {len(_ENDS)} + 1] AS path FROM part)"""
MODULES_SQL = f"modules AS (SELECT s_suppkey AS id, {_sql_list(_MODULES)}[s_suppkey % {len(_MODULES)} + 1] AS module FROM supplier)"


def code_paths(spark, d) -> DataFrame:
    """(id, brand, path): file paths made of the parts' columns."""
    path = F.concat(_pick(_DIRS, F.col("p_partkey") % len(_DIRS) + 1), F.lit("/"), F.substring_index("p_name", " ", 1), _pick(_ENDS, F.col("p_size") % len(_ENDS) + 1))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), path.alias("path"))


def modules(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), _pick(_MODULES, F.col("s_suppkey") % len(_MODULES) + 1).alias("module"))


# --- predicates ---------------------------------------------------------------------------------


@query(f"""WITH {PATHS_SQL} SELECT id,
  ends_with(path, '.yaml') OR ends_with(path, '.config.js') AS is_config,
  ends_with(path, '.sql') OR ends_with(path, '.prisma') OR contains(path, '/schema') OR contains(path, '/migrations/') AS is_schema,
  ends_with(path, '.test.ts') OR contains(path, '.spec.') AS is_trace_test,
  NOT (starts_with(path, 'tests/') OR contains(path, '/test/') OR contains(path, '/tmp/')) AS is_edge_path,
  CASE WHEN contains(path, '/routes/') OR contains(path, '/routers/') THEN 2 WHEN contains(path, '/api/') THEN 1 ELSE 0 END AS route_confidence,
  CASE WHEN starts_with(path, 'packages/web/') THEN 'packages/web' WHEN starts_with(path, 'apps/shop/') THEN 'apps/shop' ELSE split_part(path, '/', 1) END AS package FROM paths""")
def path_predicates(spark, d):
    p = F.col("path")
    return code_paths(spark, d).select("id", P.is_config_file(p).alias("is_config"), P.is_schema_file(p).alias("is_schema"), P.is_trace_test(p).alias("is_trace_test"), P.is_edge_path(p).alias("is_edge_path"), P.route_path_confidence(p).alias("route_confidence"), P.package_folder(p).alias("package"))


@query(f"""WITH {MODULES_SQL} SELECT id, CASE module WHEN 'react-dom' THEN 'frontend' WHEN 'next/router' THEN 'frontend' WHEN 'express' THEN 'web' WHEN '@nestjs/typeorm' THEN 'orm' WHEN 'pg-redis' THEN 'db' WHEN 'pytest.mock' THEN 'test' ELSE 'other' END AS category,
  module IN ('./local/file', '@/lib/db', 'src/util', 'super::up', '~/rpc/users', 'packages/web/routes/v1/api/x') AS is_internal, module IN ('~/rpc/users', 'packages/web/routes/v1/api/x') AS is_rpc FROM modules""")
def module_predicates(spark, d):
    m = F.col("module")
    return modules(spark, d).select("id", P.external_category(m).alias("category"), P.is_internal_module(m, F.array(F.lit("packages"))).alias("is_internal"), P.is_rpc_module(m).alias("is_rpc"))


@query("""WITH t AS (SELECT s_suppkey AS id, ['str', 'typing.List[int]', ' Bool | None', 'Map<string, x>', '', 'my.pkg.Integer', '???', 'Order'][s_suppkey % 8 + 1] AS t, ['userRouter', 'Router', 'HTTPRouter', 'plain'][s_suppkey % 4 + 1] AS r FROM supplier)
SELECT id, ['string', 'list', 'boolean', 'dict', '', 'int', '', 'order'][id % 8 + 1] AS type, ['user', 'Router', 'hTTP', 'plain'][id % 4 + 1] AS router FROM t""")
def normal_names(spark, d):
    types = ["str", "typing.List[int]", " Bool | None", "Map<string, x>", "", "my.pkg.Integer", "???", "Order"]
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), P.normal_type(_pick(types, k % 8 + 1)).alias("type"), P.router_name(_pick(["userRouter", "Router", "HTTPRouter", "plain"], k % 4 + 1)).alias("router"))


@query(f"""WITH {PATHS_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'http' WHEN contains(path, '/routers/') THEN split_part(split_part(path, '/', 3), '.', 1) || CASE WHEN ends_with(path, '.test.ts') THEN '.test' WHEN ends_with(path, '.spec.js') THEN '.spec' WHEN ends_with(path, '.config.js') THEN '.config' ELSE '' END
  WHEN contains(path, '/services/') THEN regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', '') WHEN id % 5 = 1 THEN brand ELSE 'rpc' END AS domain FROM paths""")
def entry_domains(spark, d):
    k = F.col("id") % 5
    kind, label = F.when(k == 0, "http").otherwise("rpc"), F.when(k == 1, F.concat("brand", F.lit(".list"))).otherwise("list")
    return code_paths(spark, d).select("id", P.entry_domain(kind, label, F.col("path")).alias("domain"))


# --- inventory ----------------------------------------------------------------------------------


@query(f"""WITH {PATHS_SQL}, r(root) AS (VALUES ('packages/web'), ('apps/shop'), ('src'), ('src/services'), ('none/here')), f AS (SELECT CASE WHEN starts_with(path, 'src/services/') THEN 'src/services' WHEN starts_with(path, 'src/') THEN 'src' WHEN starts_with(path, 'packages/web/') THEN 'packages/web' WHEN starts_with(path, 'apps/shop/') THEN 'apps/shop' END AS root, id FROM paths)
SELECT root, count(id)::BIGINT AS files, count(CASE WHEN id % 3 = 0 THEN 1 END)::BIGINT AS symbols FROM r LEFT JOIN f USING (root) GROUP BY root""")
def package_stats(spark, d):
    files = code_paths(spark, d)
    roots = spark.createDataFrame([("packages/web",), ("apps/shop",), ("src",), ("src/services",), ("none/here",), ("",)], "root string")
    return inventory.package_stats(files, files.filter("id % 3 = 0"), roots)


@query(f"""WITH {MODULES_SQL}, c AS (SELECT module, count(*) AS n, CASE module WHEN 'react-dom' THEN 'frontend' WHEN 'next/router' THEN 'frontend' WHEN 'express' THEN 'web' WHEN '@nestjs/typeorm' THEN 'orm' WHEN 'pg-redis' THEN 'db' WHEN 'pytest.mock' THEN 'test' END AS category FROM modules GROUP BY module)
SELECT category, sum(n)::BIGINT AS n, list(module ORDER BY n DESC, module)[1:2] AS modules FROM c WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category LIMIT 5""")
def external_groups(spark, d):
    return inventory.external_groups(modules(spark, d))


_ROLE_SQL = "CASE n_nationkey % 4 WHEN 0 THEN 'services' WHEN 1 THEN 'data' WHEN 2 THEN 'routes' ELSE 'other' END"


def _roles(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), _pick(["services", "data", "routes", "other"], F.col("n_nationkey") % 4 + 1).alias("role"))


@query(f"""WITH {TOP_SQL}, r AS (SELECT n_nationkey AS node, {_ROLE_SQL} AS role FROM nation)
SELECT a.role AS src_role, b.role AS dst_role, count(*)::BIGINT AS n FROM top2 JOIN r a ON src = a.node JOIN r b ON dst = b.node WHERE NOT (a.role = 'other' AND b.role = 'other') GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 6""")
def role_edges(spark, d):
    return inventory.role_edges(top_trade(spark, d), _roles(spark, d))


@query(f"""WITH p AS (SELECT page_id, {URL_PATH_SQL} AS route FROM pages), k AS (SELECT route, CASE WHEN page_id % 2 = 0 AND split_part(route, '/', 3) <> '' THEN '/' || split_part(route, '/', 2) || '/' || split_part(route, '/', 3) ELSE '/' || split_part(route, '/', 2) END AS key FROM p)
SELECT key, count(*)::BIGINT AS n, list_slice(list_sort(list_distinct(list(route))), 1, 2) AS samples FROM k GROUP BY key ORDER BY n DESC, key LIMIT 6""")
def route_groups(spark, d):
    kind = F.when(F.col("page_id") % 2 == 0, "api").otherwise("ui")
    return inventory.route_groups(table(spark, d, "pages").select(kind.alias("kind"), T.url_path(F.col("url")).alias("route")))


@query(f"""WITH {PATHS_SQL}, f AS (SELECT path FROM paths), k AS (SELECT path, 0 AS r, path AS key FROM f UNION ALL SELECT path, 1, regexp_replace(path, '\\.(ts|tsx|js)$', '') FROM f
  UNION ALL SELECT path, 3, split_part(path, '/src/', 2) FROM f WHERE contains(path, '/src/') UNION ALL SELECT path, 4, regexp_replace(split_part(path, '/src/', 2), '\\.(ts|tsx|js)$', '') FROM f WHERE contains(path, '/src/'))
SELECT key, arg_min(path, (r, path)) AS path FROM k GROUP BY key""")
def path_index(spark, d):
    return inventory.path_index(code_paths(spark, d).select("path"))


@query("SELECT p_brand AS path, list_sort(list_distinct(list(p_name))) AS names FROM part WHERE p_partkey % 4 <> 0 GROUP BY p_brand")
def exported_names(spark, d):
    return inventory.exported_names(table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 4 != 0, "public").otherwise("internal").alias("visibility")))


@query("""SELECT l_suppkey * 7 AS id, min(l_partkey) AS name, 'function' AS kind, 'internal' AS visibility FROM lineitem WHERE l_suppkey * 7 NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""")
def synthetic_symbols(spark, d):
    calls = table(spark, d, "lineitem").select((F.col("l_suppkey") * 7).alias("id"), F.col("l_partkey").alias("name"), F.lit("p").alias("path"), F.col("l_linenumber").alias("line"))
    return inventory.synthetic_symbols(calls, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))).select("id", "name", "kind", "visibility")


@query(f"""WITH {PATHS_SQL}, f AS (SELECT DISTINCT path, CASE WHEN starts_with(path, 'packages/web/') THEN 'packages/web' WHEN starts_with(path, 'apps/shop/') THEN 'apps/shop' ELSE split_part(path, '/', 1) END AS root, id FROM paths),
c AS (SELECT DISTINCT path AS client, root FROM f WHERE id % 40 = 2 OR id % 60 = 8), s AS (SELECT DISTINCT path AS server, root FROM f WHERE id % 36 IN (2, 4))
SELECT client, server FROM c JOIN s USING (root) WHERE client <> server UNION ALL SELECT client, server FROM c, s WHERE c.root NOT IN (SELECT root FROM s) AND client <> server""")
def rpc_matches(spark, d):
    p = code_paths(spark, d)
    return inventory.rpc_matches(p.filter("id % 40 = 2 OR id % 60 = 8"), p.filter("id % 36 IN (2, 4)"))


@query(f"""WITH {TOP_SQL}, r AS (SELECT n_nationkey AS node, {_ROLE_SQL} AS role FROM nation), e AS (SELECT src, dst, role, w FROM top2 JOIN r ON dst = node),
s AS (SELECT src, arg_min(dst, (-w, dst)) AS service FROM e WHERE role = 'services' GROUP BY 1), t AS (SELECT src, arg_min(dst, (-w, dst)) AS data FROM e WHERE role = 'data' GROUP BY 1),
m AS (SELECT '/' || lower(n_name) AS route, s.service, coalesce(deep.data, t.data) AS data FROM nation LEFT JOIN s ON n_nationkey = s.src LEFT JOIN t ON n_nationkey = t.src LEFT JOIN t deep ON s.service = deep.src)
SELECT CASE WHEN service IS NULL THEN 'routes->data' WHEN data IS NULL THEN 'routes->services' ELSE 'routes->services->data' END AS signature, service, data, count(*)::BIGINT AS n, list_slice(list_sort(list_distinct(list(route))), 1, 2) AS samples
FROM m WHERE service IS NOT NULL OR data IS NOT NULL GROUP BY ALL ORDER BY n DESC, signature, service NULLS FIRST, data NULLS FIRST LIMIT 4""")
def route_archetypes(spark, d):
    routes = table(spark, d, "nation").select(F.concat(F.lit("/"), F.lower("n_name")).alias("route"), F.col("n_nationkey").alias("path"))
    return inventory.route_archetypes(routes, top_trade(spark, d).withColumn("ordinal", -F.col("w")), _roles(spark, d))


@query("""SELECT p_partkey, 'F' || row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS alias FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40""")
def alias_numbers(spark, d):
    return inventory.numbered(table(spark, d, "part").select("p_partkey", "p_retailprice"), "F", [F.desc("p_retailprice"), "p_partkey"], 40).select("p_partkey", "alias")


@query("""SELECT p_brand AS section, count(*)::BIGINT AS available, count(CASE WHEN p_size > 5 THEN 1 END)::BIGINT AS selected, count(CASE WHEN p_size > 30 THEN 1 END)::BIGINT AS included,
  count(CASE WHEN p_size <= 5 THEN 1 END)::BIGINT AS omitted_by_limit, count(CASE WHEN p_size > 5 AND p_size <= 30 THEN 1 END)::BIGINT AS omitted_by_budget, count(CASE WHEN p_size <= 30 THEN 1 END) > 0 AS truncated FROM part GROUP BY p_brand""")
def limits(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("section"), "p_size")
    return inventory.limits(p, p.filter("p_size > 5"), p.filter("p_size > 30"))


_GRAPH_SQL = f"""WITH {TOP_SQL}, b AS (SELECT x.n_regionkey AS src, y.n_regionkey AS dst, sum(w)::BIGINT AS w FROM top2 JOIN nation x ON src = x.n_nationkey JOIN nation y ON dst = y.n_nationkey WHERE x.n_regionkey <> y.n_regionkey GROUP BY 1, 2),
g AS (SELECT component, sum(w)::BIGINT AS degree FROM (SELECT src AS component, w FROM b UNION ALL SELECT dst, w FROM b) GROUP BY 1),
n AS (SELECT n_regionkey AS component, count(*)::BIGINT AS files, coalesce(any_value(degree), 0)::BIGINT AS degree FROM nation LEFT JOIN g ON n_regionkey = component GROUP BY 1 ORDER BY degree DESC, files DESC, component LIMIT 3)"""


def _diagram(spark, d):
    return inventory.component_graph(nations(spark, d).select(F.col("node").alias("path"), F.col("grp").alias("component")), top_trade(spark, d), 3)


@query(_GRAPH_SQL + " SELECT component, files, degree FROM n")
def diagram_nodes(spark, d):
    return _diagram(spark, d)[0]


@query(_GRAPH_SQL + " SELECT src, dst, w FROM b WHERE src IN (SELECT component FROM n) AND dst IN (SELECT component FROM n)")
def diagram_edges(spark, d):
    return _diagram(spark, d)[1]


@query("""WITH l AS (SELECT lang AS language, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT language, count(*)::BIGINT AS n FROM l WHERE (language = 'en' AND regexp_matches(line, '^[A-Z]')) OR (language = 'de' AND regexp_matches(line, '[0-9]')) GROUP BY language""")
def match_counts(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("language"), F.col("text").alias("content"))
    return inventory.match_counts(docs, {"en": "^[A-Z]", "de": "[0-9]"})


@query("""WITH u AS (SELECT ['java', 'kotlin', 'ruby', 'c', 'Python'][p_partkey % 5 + 1] AS language, count(*)::BIGINT AS n FROM part GROUP BY 1) SELECT language, n FROM u WHERE language IN ('java', 'kotlin', 'Python')""")
def unsupported_targets(spark, d):
    u = table(spark, d, "part").groupBy(_pick(["java", "kotlin", "ruby", "c", "Python"], F.col("p_partkey") % 5 + 1).alias("language")).agg(F.count("*").alias("n"))
    return inventory.unsupported_targets(u, ["JVM", " py "])


@query(f"""WITH {PATHS_SQL}, f AS (SELECT path, split_part(path, '/', 1) AS root, min(id) AS id, CASE WHEN contains(path, '/routes/') OR contains(path, '/routers/') THEN 2 WHEN contains(path, '/api/') THEN 1 ELSE 0 END AS bonus FROM paths GROUP BY path),
h AS (SELECT *, id % 2 = 0 AND regexp_matches(path, '\\.(ts|tsx|js)$') AS hit FROM f), g AS (SELECT path, root, (id % 7 + bonus + CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END + 3 * hit::INT + (bonus > 0)::INT)::DOUBLE AS weight FROM h WHERE hit OR bonus = 2),
r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY weight DESC, path) AS turn, max(weight) OVER (PARTITION BY root) AS best FROM g)
SELECT path, weight, turn::INT AS turn FROM r ORDER BY turn, best DESC, root LIMIT 80""")
def route_candidates(spark, d):
    k = F.col("id")
    files = code_paths(spark, d).groupBy("path").agg(F.min("id").alias("id"))
    content = F.when(k % 2 == 0, "app.get('/x', run)").otherwise("plain")
    return inventory.route_candidates(files.select("path", content.alias("content"), (k % 7).cast("double").alias("score"), F.when(k % 3 == 0, "server").alias("entry_role")))


# --- lookups ------------------------------------------------------------------------------------


def _symbols(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as symbols of the files that their regions are, the trade graph as calls, and lifted to files."""
    n = table(spark, d, "nation")
    sid = lambda c: F.concat(F.lit("sym:"), F.col(c).cast("string"))
    symbols = n.select(sid("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat("n_name", F.lit("()")).alias("signature"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path"))
    t = top_trade(spark, d)
    refs = t.select(sid("src").alias("src"), sid("dst").alias("dst"))
    where = symbols.select(F.col("id"), F.col("path"))
    dep = refs.join(where.toDF("src", "a"), "src").join(where.toDF("dst", "b"), "dst").filter("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return symbols, refs, dep


@query(f"""WITH {TOP_SQL}, s AS (SELECT n_nationkey AS k, n_name AS name, 'r' || n_regionkey AS path FROM nation), hit AS (SELECT * FROM s WHERE contains(lower(name), '1') ORDER BY name, 'sym:' || k LIMIT 6),
dep AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM top2 JOIN s a ON src = a.k JOIN s b ON dst = b.k WHERE a.path <> b.path),
o AS (SELECT 'sym:' || k AS symbol, 'caller' AS relation, 'sym:' || src AS neighbour FROM top2 JOIN hit ON dst = k UNION SELECT 'sym:' || k, 'callee', 'sym:' || dst FROM top2 JOIN hit ON src = k
  UNION SELECT 'sym:' || k, 'in', src FROM dep JOIN hit ON dst = path UNION SELECT 'sym:' || k, 'out', dst FROM dep JOIN hit ON src = path)
SELECT symbol, relation, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY symbol, relation ORDER BY neighbour) AS r FROM o) WHERE r <= 10""")
def symbol_query(spark, d):
    symbols, refs, dep = _symbols(spark, d)
    return lookup.query(symbols, refs, dep, "1")


@query("""SELECT 'file:r1' AS id, 'by path' AS how UNION ALL SELECT 'sym:' || n_nationkey, 'by name' FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'sym:4', 'by id'""")
def resolve_node(spark, d):
    symbols, _, _ = _symbols(spark, d)
    nodes = symbols.select("id", "name", "path").unionByName(symbols.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit(None).cast("string").alias("name"), "path").distinct())
    name = table(spark, d, "nation").filter("n_nationkey = 3").head()["n_name"]
    tried = [("r1", "by path"), (name, "by name"), ("sym:4", "by id"), ("nothing", "not at all")]
    out = None
    for value, how in tried:
        row = lookup.resolve(nodes, value).select("id", F.lit(how).alias("how"))
        out = row if out is None else out.unionByName(row)
    return out


# --- code-map operators over the tables ---------------------------------------------------------


@query("""WITH s AS (SELECT d.doc_id AS id, d.source AS path, count(l.doc_id) AS refs FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang = 'en' GROUP BY 1, 2) SELECT id FROM s WHERE refs = 0 AND NOT ends_with(path, '1') ORDER BY id LIMIT 8""")
def dead_code(spark, d):
    docs = table(spark, d, "documents")
    refs = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("refs_in"))
    symbols = docs.join(refs, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), "refs_in", F.when(F.col("lang") == "en", "public").otherwise("internal").alias("visibility"))
    files = docs.select(F.col("source").alias("path"), F.when(F.col("source").endswith("1"), "test").otherwise("library").alias("role")).distinct()
    return codemap.unused(symbols, files)


@query("""WITH s AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS path, 'k' || (s_suppkey % 90) AS name FROM supplier), t AS (SELECT DISTINCT c_custkey AS line, 'n' || c_nationkey AS path, 'k' || (c_custkey % 90) AS from_name, 'k' || (c_custkey % 130) AS to_name FROM customer),
l AS (SELECT path, name, min(id) AS id FROM s GROUP BY 1, 2), u AS (SELECT name, count(*) AS c, min(id) AS id FROM s GROUP BY 1)
SELECT t.line, coalesce(lf.id, CASE WHEN uf.c = 1 THEN uf.id END) AS from_id, coalesce(lt.id, CASE WHEN ut.c = 1 THEN ut.id END) AS to_id, coalesce(lt.id, CASE WHEN ut.c = 1 THEN ut.id END) IS NULL AND coalesce(ut.c, 0) > 1 AS ambiguous
FROM t LEFT JOIN l lf ON lf.path = t.path AND lf.name = t.from_name LEFT JOIN u uf ON uf.name = t.from_name LEFT JOIN l lt ON lt.path = t.path AND lt.name = t.to_name LEFT JOIN u ut ON ut.name = t.to_name""")
def type_binding(spark, d):
    k = F.col("s_suppkey")
    symbols = table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("path"), F.concat(F.lit("k"), k % 90).alias("name"))
    c = F.col("c_custkey")
    facts = table(spark, d, "customer").select(F.lit("type").alias("fact"), F.concat(F.lit("n"), "c_nationkey").alias("path"), c.alias("line"), F.concat(F.lit("k"), c % 90).alias("name"), F.concat(F.lit("k"), c % 130).alias("target"), F.create_map(F.lit("kind"), F.lit("extends")).alias("attrs"))
    return codemap.type_edges(facts, symbols).select("line", "from_id", "to_id", "ambiguous")


@query(f"SELECT doc_id, {TOKENS_SQL.format('text')} AS tokens FROM documents WHERE length(text) > 10")
def registered_functions(spark, d):
    """The text functions as SQL functions of the session."""
    from corvane.functions import register

    register.register_functions(spark)
    table(spark, d, "documents").createOrReplaceTempView("corvane_documents")
    return spark.sql("SELECT doc_id, token_estimate(text) AS tokens FROM corvane_documents WHERE length(text) > 10")
