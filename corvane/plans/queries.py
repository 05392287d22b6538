"""Registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as T
from corvane.operators import cluster, graph, joins, snapshots, windows
from corvane.plans.tables import TOP_SQL, TRADE_SQL, nations, table, top_trade, trade

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(run: Callable) -> Callable:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


TOKENS_SQL = "greatest(len(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]+|[^ \\t\\n\\r\\f\\x0BA-Za-z0-9_]')), 1)::BIGINT"


def words():
    return F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")


WORDS_SQL = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')"


# --- text and budgets ---------------------------------------------------------------------------


@query(f"SELECT doc_id, {TOKENS_SQL.format('text')} AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT lang, doc_id, n_chars, running FROM (
  SELECT lang, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents)
WHERE running <= 200000""")
def budget_prefix(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return windows.budget_prefix(docs, ["lang"], [F.desc("n_chars"), F.col("doc_id")], "n_chars", 200_000)


@query("""WITH s AS (SELECT p_brand AS section, count(*)::BIGINT AS tokens, CASE WHEN p_brand < 'Brand#3' THEN dense_rank() OVER (ORDER BY p_brand) END AS drop_order FROM part GROUP BY p_brand),
o AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY drop_order NULLS LAST, section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(tokens) OVER () AS total FROM s)
SELECT section, tokens FROM o WHERE drop_order IS NULL OR total - before <= (SELECT sum(tokens) * 7 // 10 FROM s)""")
def section_governor(spark, d):
    parts = table(spark, d, "part").groupBy(F.col("p_brand").alias("section")).agg(F.count("*").alias("tokens"))
    order = F.when(F.col("section") < "Brand#3", F.dense_rank().over(Window.orderBy("section")))
    budget = int(table(spark, d, "part").count() * 7 // 10)
    return windows.govern(parts.withColumn("drop_order", order), budget)


@query("SELECT part.p_partkey, list_transform(list_filter(string_split_regex(p_name, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: lower(x)) AS parts FROM part")
def identifier_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", T.identifier_parts(F.col("p_name")).alias("parts"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(substr(text, 1, 77), ' ') || '...' END AS label,
  sha1(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', '', 'g')) AS hash,
  replace(replace(replace(replace(replace(substr(text, 1, 120), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM documents""")
def semantic_hash(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.ellipsis(text, 80).alias("label"), T.semantic_hash(text).alias("hash"), T.xml_escape(F.substring(text, 1, 120)).alias("xml"))


URL_PATH_SQL = """(SELECT CASE WHEN length(r) > 1 THEN regexp_replace(r, '/+$', '') ELSE r END FROM (SELECT CASE WHEN starts_with(b, '/') THEN b ELSE '/' || b END AS r
  FROM (SELECT regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS b)))"""


@query(f"SELECT page_id, {URL_PATH_SQL} AS path FROM pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_path(F.col("url")).alias("path"))


@query("""SELECT page_id, (generate_subscripts(l, 1) - 1)::INT AS ordinal, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)""")
def link_extract(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("ordinal", "href"))


@query("""SELECT doc_id, n, strpos(text, chr(10)) AS first_break FROM (SELECT doc_id, text, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n FROM documents)""")
def line_numbers(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.line_of(text, F.length(text)).cast("bigint").alias("n"), F.instr(text, "\n").cast("bigint").alias("first_break"))


# --- graph --------------------------------------------------------------------------------------


def _part_supplier(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"))


@query("""WITH e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem),
d AS (SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node)
SELECT node, in_degree, out_degree, in_degree + out_degree AS degree FROM d ORDER BY degree DESC, node LIMIT 6""")
def degree_hubs(spark, d):
    return graph.hubs(_part_supplier(spark, d))


@query(f"""WITH {TOP_SQL}, d AS (SELECT node, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (SELECT src AS node, 0 AS i, 1 AS o FROM top2 UNION ALL SELECT dst, 1, 0 FROM top2) GROUP BY node),
m AS (SELECT 'fan_in' AS metric, node, i AS n, i::DOUBLE AS value FROM d WHERE i > 0 UNION ALL SELECT 'fan_out', node, o, o::DOUBLE FROM d WHERE o > 0
  UNION ALL SELECT 'instability', node, i + o, round(o::DOUBLE / (i + o), 3) FROM d WHERE i + o >= 2)
SELECT metric, node, n, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, node) AS r FROM m) WHERE r <= 6""")
def coupling(spark, d):
    return graph.coupling(top_trade(spark, d))


@query(f"""WITH {TRADE_SQL} SELECT a.n_regionkey AS src, b.n_regionkey AS dst, sum(w)::BIGINT AS w FROM trade JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey
WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2""")
def component_edges(spark, d):
    return graph.lift(trade(spark, d), nations(spark, d).select("node", "grp"))


@query(f"""WITH {TOP_SQL}, n AS (SELECT CASE WHEN c_nationkey < 10 THEN 0 ELSE c_nationkey END AS grp, count(*) AS n FROM customer GROUP BY 1),
o AS (SELECT src AS grp, sum(w) AS d FROM top2 GROUP BY 1), i AS (SELECT dst AS grp, sum(w) AS d FROM top2 GROUP BY 1)
SELECT grp, 'god_component' AS flag FROM n WHERE n >= (SELECT greatest(20, floor(sum(n) * 0.35)) FROM n)
UNION ALL SELECT grp, 'orchestrator' FROM o WHERE d >= (SELECT greatest(5, 2 * median(d)) FROM o)
UNION ALL SELECT grp, 'core' FROM i WHERE d >= (SELECT greatest(5, 2 * median(d)) FROM i)""")
def risk_flags(spark, d):
    grp = F.when(F.col("c_nationkey") < 10, 0).otherwise(F.col("c_nationkey"))
    sizes = table(spark, d, "customer").groupBy(grp.alias("grp")).agg(F.count("*").alias("n"))
    return graph.risk_flags(top_trade(spark, d), sizes)


def _pagerank_sql(rounds: int = 20) -> str:
    steps = [f"WITH {TRADE_SQL}, nodes AS (SELECT n_nationkey AS node FROM nation), e AS (SELECT src, dst, w::DOUBLE / sum(w) OVER (PARTITION BY src) AS share FROM trade)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * coalesce(sum(p.rank * e.share), 0) AS rank FROM nodes n LEFT JOIN e ON e.dst = n.node LEFT JOIN r{k - 1} p ON p.node = e.src GROUP BY n.node)")
    return ", ".join(steps)


@query(_pagerank_sql() + " SELECT node, round(rank, 9) AS rank FROM r20")
def pagerank(spark, d):
    return graph.pagerank(nations(spark, d).select("node"), trade(spark, d)).select("node", F.round("rank", 9).alias("rank"))


@query(_pagerank_sql() + """, x AS (SELECT s_nationkey AS node, count(*) AS exports FROM supplier GROUP BY 1), c AS (SELECT node, sum(i) AS i, sum(o) AS o FROM (SELECT src AS node, 0 AS i, w AS o FROM trade UNION ALL SELECT dst, w, 0 FROM trade) GROUP BY node)
SELECT r.node, round(0.6 * rank + 0.2 * coalesce(exports, 0)::DOUBLE / greatest((SELECT max(exports) FROM x), 1) + 0.1 * CASE WHEN r.node % 5 = 0 THEN 0.2 ELSE 0 END
  + 0.1 * (coalesce(i, 0) + coalesce(o, 0))::DOUBLE / greatest((SELECT max(greatest(i, o)) FROM c), 1), 9) AS score
FROM r20 r LEFT JOIN x ON x.node = r.node LEFT JOIN c ON c.node = r.node""")
def file_score(spark, d):
    from corvane.operators import rank

    edges = trade(spark, d)
    exports = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.count("*").alias("exports"))
    n = nations(spark, d).select("node", (F.col("node") % 5 == 0).alias("is_entry"))
    return rank.file_scores(n, edges, exports, edges).select("node", F.round("score", 9).alias("score"))


@query("""WITH r AS (SELECT l_partkey, count(*) AS refs FROM lineitem GROUP BY 1)
SELECT p_partkey AS symbol, coalesce(refs, 0)::BIGINT AS refs_in, round(CASE WHEN p_size <= 10 THEN 1.2 WHEN p_size <= 25 THEN 1.0 WHEN p_size <= 40 THEN 0.9 ELSE 0.8 END
  + CASE WHEN p_retailprice > 1500 THEN 0.3 ELSE 0 END + 0.2 * coalesce(refs, 0)::DOUBLE / (SELECT greatest(max(refs), 1) FROM r), 9) AS score
FROM part LEFT JOIN r ON p_partkey = l_partkey""")
def symbol_score(spark, d):
    from corvane.operators import rank

    kind = F.when(F.col("p_size") <= 10, "class").when(F.col("p_size") <= 25, "function").when(F.col("p_size") <= 40, "interface").otherwise("variable")
    symbols = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), kind.alias("kind"), F.when(F.col("p_retailprice") > 1500, "public").otherwise("internal").alias("visibility"))
    refs = table(spark, d, "lineitem").select(F.lit(None).cast("bigint").alias("src"), F.col("l_partkey").alias("dst"))
    return rank.symbol_scores(symbols, refs).select("symbol", "refs_in", F.round("score", 9).alias("score"))


@query(f"""WITH RECURSIVE {TOP_SQL}, walk AS (SELECT 0 AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM walk JOIN top2 ON src = node WHERE depth < 4)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def bfs(spark, d):
    edges = top_trade(spark, d)
    return graph.bfs(edges, nations(spark, d).filter("node = 0"), 4)


@query(f"""WITH {TOP_SQL}, n0 AS (SELECT 3 AS node), o1 AS (SELECT DISTINCT dst AS node FROM top2 JOIN n0 ON src = node), i1 AS (SELECT DISTINCT src AS node FROM top2 JOIN n0 ON dst = node),
n1 AS (SELECT node FROM o1 UNION SELECT node FROM i1), o2 AS (SELECT DISTINCT dst AS node FROM top2 JOIN n1 ON src = node), i2 AS (SELECT DISTINCT src AS node FROM top2 JOIN n1 ON dst = node)
SELECT 1 AS level, 'outbound' AS direction, node FROM o1 UNION ALL SELECT 1, 'inbound', node FROM i1 UNION ALL SELECT 2, 'outbound', node FROM o2 UNION ALL SELECT 2, 'inbound', node FROM i2""")
def deps(spark, d):
    return graph.dependencies(top_trade(spark, d), nations(spark, d).filter("node = 3"), 2)


@query(f"""WITH RECURSIVE {TOP_SQL}, both_ways AS (SELECT src, dst FROM top2 UNION SELECT dst, src FROM top2), walk AS (SELECT n_nationkey AS node, 0 AS depth FROM nation WHERE contains(lower(n_name), '1') UNION ALL SELECT dst, depth + 1 FROM walk JOIN both_ways ON src = node WHERE depth < 1)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def focus(spark, d):
    starts = nations(spark, d).filter(F.lower("name").contains("1"))
    return graph.bfs(top_trade(spark, d), starts, 1, "both")


@query(f"""WITH RECURSIVE {TRADE_SQL}, e AS (SELECT DISTINCT a.n_regionkey AS src, b.n_regionkey AS dst FROM trade JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey),
walk AS (SELECT [0] AS path UNION ALL SELECT list_append(path, dst) FROM walk JOIN e ON src = path[-1] WHERE len(path) < 4 AND NOT list_contains(path, dst))
SELECT path FROM walk WHERE len(path) = 4 OR NOT EXISTS (SELECT 1 FROM e WHERE src = path[-1])""")
def simple_paths(spark, d):
    edges = graph.lift(trade(spark, d), nations(spark, d).select("node", "grp"))
    return graph.simple_paths(edges, edges.select(F.col("src").alias("node")).filter("node = 0"), 4)


@query(f"""WITH RECURSIVE {TOP_SQL}, walk AS (SELECT [src, dst] AS path FROM top2 WHERE dst > src UNION ALL SELECT list_append(path, dst) FROM walk JOIN top2 ON src = path[-1] WHERE len(path) < 4 AND dst > path[1] AND NOT list_contains(path, dst))
SELECT DISTINCT path AS cycle, len(path)::INT AS n FROM walk JOIN top2 ON src = path[-1] AND dst = path[1]""")
def cycles(spark, d):
    return graph.cycles(top_trade(spark, d))


@query(f"""WITH {TOP_SQL}, outs AS (SELECT src, count(*) AS o FROM top2 GROUP BY 1), r AS (SELECT t.src, t.dst, t.w, coalesce(o, 0) AS o FROM top2 t LEFT JOIN outs ON outs.src = t.dst),
h1 AS (SELECT [src, dst] AS path FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, o DESC, dst) AS k FROM r) WHERE k = 1),
h2 AS (SELECT path, dst, row_number() OVER (PARTITION BY path ORDER BY w DESC, o DESC, dst) AS k FROM h1 JOIN r ON src = path[-1] AND NOT list_contains(path, dst))
SELECT CASE WHEN dst IS NULL THEN h1.path ELSE list_append(h1.path, dst) END AS path FROM h1 LEFT JOIN h2 ON h1.path = h2.path AND k = 1""")
def greedy_flow(spark, d):
    return graph.greedy_flows(top_trade(spark, d), nations(spark, d), 2)


@query("""SELECT src, dst, max(c)::INT AS confidence FROM (
  SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 1 AS c FROM lineitem UNION ALL SELECT l_partkey, l_suppkey, 2 FROM lineitem WHERE l_quantity > 25 UNION ALL SELECT l_partkey, l_suppkey, 3 FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1, 2""")
def best_edge_conf(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_quantity", "l_returnflag")
    return graph.best_confidence([(e, 1), (e.filter("l_quantity > 25"), 2), (e.filter("l_returnflag = 'R'"), 3)])


@query(f"""WITH RECURSIVE {TOP_SQL}, walk AS (SELECT 0 AS node, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM walk JOIN top2 ON src = node WHERE depth < 2),
near AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), e AS (SELECT depth, src, dst FROM near JOIN top2 ON src = node)
SELECT row_number() OVER (ORDER BY depth, src, dst)::INT AS ordinal, src, dst FROM e ORDER BY depth, src, dst LIMIT 12""")
def trace_graph(spark, d):
    return graph.trace_edges(top_trade(spark, d), nations(spark, d).filter("node = 0"), 3, 12)


@query(f"""WITH RECURSIVE {TOP_SQL}, walk AS (SELECT n_nationkey AS node, 0 AS depth FROM nation WHERE n_nationkey IN (1, 2) UNION ALL SELECT src, depth + 1 FROM walk JOIN top2 ON dst = node WHERE depth < 2)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node HAVING min(depth) > 0""")
def incremental_dependents(spark, d):
    n = nations(spark, d)
    return graph.dependents(top_trade(spark, d), n.filter("node IN (1, 2)"), n.select("node", F.col("node").cast("double").alias("score")))


# --- joins --------------------------------------------------------------------------------------


@query("""SELECT e.event_id, e.user_id, s.event_id AS signup_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1, 2) s
ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_scope(spark, d):
    e = table(spark, d, "events")
    signups = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return joins.asof(e.select("event_id", "user_id", "ts"), signups, "user_id", "ts", "signup_id", tie="signup_id").select("event_id", "user_id", "signup_id")


@query("""WITH s AS (SELECT user_id, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + 86400 * (1 + event_id % 5) AS b, event_id AS span FROM events WHERE event_type = 'purchase'),
m AS (SELECT e.event_id, s.span, row_number() OVER (PARTITION BY e.event_id ORDER BY s.b - s.a, s.a DESC, s.span) AS r FROM events e JOIN s ON e.user_id = s.user_id AND epoch(e.ts)::BIGINT BETWEEN s.a AND s.b)
SELECT e.event_id, m.span FROM events e LEFT JOIN m ON e.event_id = m.event_id AND r = 1""")
def range_innermost(spark, d):
    # whole seconds as the SQL has them: rounded, halves to the even one
    e = table(spark, d, "events").withColumn("at", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint"))
    spans = e.filter("event_type = 'purchase'").select("user_id", F.col("at").alias("a"), (F.col("at") + 86400 * (1 + F.col("event_id") % 5)).alias("b"), F.col("event_id").alias("span"))
    return joins.innermost_range(e.select("event_id", "user_id", "at"), spans, "user_id", "at", "a", "b", "span", 86400, key="event_id").select("event_id", "span")


@query(f"""WITH l AS (SELECT page_id, (generate_subscripts(h, 1) - 1)::INT AS ordinal, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
u AS (SELECT DISTINCT {URL_PATH_SQL} AS path FROM pages), c AS (SELECT page_id, ordinal, 0 AS p, href AS c FROM l UNION ALL SELECT page_id, ordinal, 1, href || '.html' FROM l UNION ALL SELECT page_id, ordinal, 2, rtrim(href, '/') || '/index' FROM l
  UNION ALL SELECT page_id, ordinal, 3, '/en' || href FROM l),
m AS (SELECT page_id, ordinal, arg_min(c, p) AS resolved FROM c JOIN u ON c = path GROUP BY 1, 2)
SELECT l.page_id, l.ordinal, l.href, m.resolved FROM l LEFT JOIN m ON l.page_id = m.page_id AND l.ordinal = m.ordinal""")
def first_candidate(spark, d):
    links = link_extract(spark, d)
    urls = table(spark, d, "pages").select(T.url_path(F.col("url")).alias("path"))
    h = F.col("href")
    tried = F.array(h, F.concat(h, F.lit(".html")), F.concat(F.regexp_replace(h, "/+$", ""), F.lit("/index")), F.concat(F.lit("/en"), h))
    return joins.first_candidate(links, ["page_id", "ordinal"], tried, urls, "path")


@query("""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS site, l_orderkey % 50 AS file, l_partkey AS name FROM lineitem WHERE l_orderkey % 20 = 0),
f AS (SELECT l_orderkey * 10 + l_linenumber AS target, l_orderkey % 50 AS file, l_partkey AS name FROM lineitem WHERE l_orderkey % 3 = 0),
m AS (SELECT site, target, s.file = f.file AS loc FROM s JOIN f USING (name)), a AS (SELECT *, max(loc::INT) OVER (PARTITION BY site) = 1 AS any_loc FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY target) AS r FROM a WHERE NOT any_loc OR loc) SELECT DISTINCT site, target FROM k WHERE any_loc OR r <= 3""")
def call_resolution(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey", (F.col("l_orderkey") % 50).alias("file"), F.col("l_partkey").alias("name"))
    sites = l.filter("l_orderkey % 20 = 0").select(F.col("id").alias("site"), "file", "name")
    defs = l.filter("l_orderkey % 3 = 0").select(F.col("id").alias("target"), "file", "name", F.col("id").alias("ordinal"))
    return joins.resolve_calls(sites, defs)


@query(f"""WITH p AS (SELECT page_id AS call, {URL_PATH_SQL} AS path FROM pages) SELECT call, route FROM p JOIN (VALUES ('/en/:id', '^/en/[^/]+$'), ('/:lang/:id', '^/[^/]+/[^/]+$'), ('/fr/:id', '^/fr/[^/]+$'), ('/', '^/$')) r(route, pattern) ON regexp_matches(path, pattern)""")
def route_match(spark, d):
    routes = spark.createDataFrame([("/en/:id", "GET"), ("/:lang/:id", "ALL"), ("/fr/:id", "ROUTE"), ("/", "GET")], "route string, method string")
    routes = routes.withColumn("pattern", T.route_pattern(F.col("route")))
    calls = table(spark, d, "pages").select(F.col("page_id").alias("call"), F.lit("GET").alias("method"), T.url_path(F.col("url")).alias("path"))
    return joins.match_routes(calls, routes)


@query(f"""WITH p AS (SELECT page_id, {URL_PATH_SQL} AS path FROM pages), k AS (SELECT DISTINCT '/' || split_part(path, '/', 2) AS prefix FROM p WHERE page_id % 2 = 0 UNION SELECT DISTINCT path FROM p WHERE page_id % 10 = 0)
SELECT page_id, path, arg_max(prefix, length(prefix)) AS prefix FROM p LEFT JOIN k ON path = prefix OR starts_with(path, prefix || '/') GROUP BY 1, 2""")
def longest_prefix(spark, d):
    p = table(spark, d, "pages").select("page_id", T.url_path(F.col("url")).alias("path"))
    known = p.filter("page_id % 2 = 0").select(F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2)).alias("prefix")).union(p.filter("page_id % 10 = 0").select("path"))
    return joins.longest_prefix(p, "path", known, "prefix")


@query(f"""WITH a AS (SELECT item_id, list_distinct({WORDS_SQL}) AS t FROM benchmark), b AS (SELECT doc_id, unnest(list_distinct({WORDS_SQL})) AS w FROM documents), x AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM a),
m AS (SELECT item_id, doc_id, n, count(*)::BIGINT AS common FROM x JOIN b USING (w) GROUP BY 1, 2, 3)
SELECT item_id, doc_id, common, score FROM (SELECT *, round(common::DOUBLE / n, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(common::DOUBLE / n, 6) DESC, doc_id) AS r FROM m WHERE common::DOUBLE / n >= 0.2) WHERE r <= 2""")
def name_overlap(spark, d):
    a = table(spark, d, "benchmark").select("item_id", words().alias("tokens"))
    b = table(spark, d, "documents").select("doc_id", words().alias("tokens"))
    return joins.name_overlap(a, "item_id", b, "doc_id")


@query("""WITH direct AS (SELECT DISTINCT doc_id, quality AS target FROM labels), named AS (SELECT d.doc_id, min(l.quality) AS target FROM documents d JOIN documents o ON d.source = o.source JOIN labels l ON o.doc_id = l.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM direct) GROUP BY 1)
SELECT doc_id, target, 'direct' AS via FROM direct UNION ALL SELECT doc_id, target, 'name' FROM named""")
def test_mapping(spark, d):
    from corvane.operators import quality

    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", F.col("quality").alias("target")).distinct()
    by_source = docs.join(labels, "doc_id").groupBy("source").agg(F.min("target").alias("target"))
    return quality.with_fallback(docs.select("doc_id"), "doc_id", labels, docs.join(by_source, "source").select("doc_id", "target"))


# --- sets and snapshots -------------------------------------------------------------------------


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 < 8), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 >= 2)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change, a.o_orderstatus AS before_status, b.o_orderstatus AS after_status
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus""")
def snapshot_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.filter("o_orderkey % 10 >= 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    found = snapshots.diff(o.filter("o_orderkey % 10 < 8"), new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    return found.select("o_orderkey", "change", F.col("before.o_orderstatus").alias("before_status"), F.col("after.o_orderstatus").alias("after_status"))


@query("""SELECT l_partkey AS src, l_suppkey AS dst, l_linenumber AS n FROM lineitem WHERE l_partkey % 5 NOT IN (0, 1) AND l_suppkey % 5 <> 1""")
def prune(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("n"))
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node")).union(table(spark, d, "supplier").select("s_suppkey")).distinct()
    return snapshots.prune(e, nodes.filter("node % 5 = 0"), nodes.filter("node % 5 = 1"))


@query("""SELECT p_partkey, p_brand, 'new' AS provenance FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p_brand, 'config' FROM part WHERE p_size % 2 = 0""")
def provenance_union(spark, d):
    p = table(spark, d, "part")
    old = p.select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, "config").otherwise("ast").alias("provenance"))
    return snapshots.replace_provenance(old, p.filter("p_size > 25").select("p_partkey", "p_brand", F.lit("new").alias("provenance")), ["ast"])


@query("""WITH a AS (SELECT c_custkey, c_mktsegment AS s FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NONE' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.s IS DISTINCT FROM b.s""")
def changed_entrypoints(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("s"))
    new = c.filter("c_custkey % 5 != 0").withColumn("s", F.when(F.col("c_custkey") % 4 == 0, "NONE").otherwise(F.col("s")))
    return snapshots.symmetric_difference(c.filter("c_custkey % 3 != 0"), new, "c_custkey", "s")


# --- windows ------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part),
t AS (SELECT * FROM r ORDER BY turn, p_brand LIMIT 50) SELECT p_partkey, p_brand, turn::INT AS turn, row_number() OVER (ORDER BY turn, p_brand)::INT AS "position" FROM t""")
def round_robin(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return windows.round_robin(p, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 50).drop("p_retailprice")


@query("""SELECT p_brand, p_partkey, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 4""")
def top_symbols(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return windows.top_per_group(p, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 4).drop("p_retailprice")


@query("""WITH a AS (SELECT p_partkey, p_brand, p_type, (row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) > 1)::INT AS again FROM part)
SELECT p_partkey, p_brand, p_type, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY again, p_partkey) AS rank FROM a) WHERE rank <= 6""")
def diverse_pick(spark, d):
    return windows.diverse(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "p_brand", "p_type", [F.col("p_partkey")], 6)


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def keep_first(spark, d):
    return windows.keep_first(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


@query("""SELECT p_partkey, priority FROM (SELECT p_partkey, p_size >= 49 AS must, round(p_retailprice / 1000 + CASE WHEN p_size < 5 THEN 2 WHEN p_size < 10 THEN 1.5 ELSE 0 END, 6) AS priority FROM part) ORDER BY must DESC, priority DESC, p_partkey LIMIT 100""")
def priority_quota(spark, d):
    priority = F.round(F.col("p_retailprice") / 1000 + F.when(F.col("p_size") < 5, 2.0).when(F.col("p_size") < 10, 1.5).otherwise(0.0), 6)
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") >= 49).alias("must"), priority.alias("priority"))
    return windows.select_with_quota(p, "must", "priority", "p_partkey", 100).drop("must")


# --- text mining and evidence -------------------------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents WHERE lang = 'en'), tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n FROM documents WHERE lang = 'en') SELECT doc_id, term, tf, df, round(tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1), 6) AS weight FROM tf JOIN df USING (term), n WHERE df >= 20""")
def tfidf(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "text")
    return cluster.tfidf(docs, "doc_id", words(), least=20).withColumn("weight", F.round("weight", 6))


@query(f"""WITH t AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents WHERE lang = 'en'), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n FROM documents WHERE lang = 'en'), v AS (SELECT doc_id, term, tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), n), z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM v GROUP BY 1)
SELECT a.doc_id, b.doc_id AS other, round(sum(a.w * b.w) / (any_value(y.z) * any_value(x.z)), 6) AS cosine FROM v a JOIN v b ON a.term = b.term AND b.doc_id < 20 JOIN z y ON y.doc_id = a.doc_id JOIN z x ON x.doc_id = b.doc_id GROUP BY 1, 2""")
def cosine(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "text")
    some = [r[0] for r in docs.filter("doc_id < 20").select("doc_id").distinct().collect()]
    return cluster.cosine(docs, "doc_id", words(), some, "other").withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH docs AS (SELECT * FROM documents WHERE lang = 'en'), t AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM docs), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n FROM docs), v AS (SELECT doc_id, term, tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), n), z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM v GROUP BY 1),
anchors AS (SELECT doc_id AS anchor FROM docs ORDER BY n_chars DESC, doc_id LIMIT (SELECT least(12, greatest(3, floor(sqrt(n))))::BIGINT FROM n)),
s AS (SELECT a.doc_id, b.doc_id AS anchor, round(sum(a.w * b.w) / (any_value(y.z) * any_value(x.z)), 9) AS s FROM v a JOIN v b ON a.term = b.term JOIN anchors ON b.doc_id = anchor JOIN z y ON y.doc_id = a.doc_id JOIN z x ON x.doc_id = b.doc_id GROUP BY 1, 2),
best AS (SELECT doc_id, max(s) AS s, arg_min(anchor, (-s, anchor)) AS anchor FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN s >= 0.12 THEN 'anchor:' || anchor ELSE 'path:' || source END AS cluster FROM docs LEFT JOIN best USING (doc_id)""")
def semantic_cluster(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "text", "source", "n_chars")
    return cluster.anchor_clusters(docs, "doc_id", words(), docs.select("doc_id", F.col("n_chars").cast("double").alias("score")), docs.select("doc_id", F.col("source").alias("component")))


CAPABILITIES = [("licensing", "licen[cs]e"), ("secrets", "token = "), ("contact", "@mail[0-9]"), ("network", "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+"), ("tables", " \\| ")]


@query("WITH r(capability, re) AS (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in CAPABILITIES) + """), h AS (SELECT capability, doc_id, 1 + (contains(source, '1'))::INT AS score FROM documents, r WHERE regexp_matches(text, re))
SELECT capability, count(h.doc_id)::BIGINT AS hits, coalesce(max(score), 0)::INT AS top, CASE WHEN max(score) >= 2 THEN 'exists/high' WHEN count(h.doc_id) >= 2 THEN 'exists/medium' WHEN count(h.doc_id) = 1 THEN 'uncertain' ELSE 'missing' END AS status FROM r LEFT JOIN h USING (capability) GROUP BY 1""")
def capability(spark, d):
    from corvane.operators import quality

    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").contains("1").cast("int").alias("bonus"))
    return quality.capabilities(docs, "text", CAPABILITIES, F.lit(1) + F.col("bonus"))


@query("""WITH s AS (SELECT d.doc_id, (3 * (l.quality = 1)::INT + 3 * (d.n_chars > 2000)::INT + 2 * (d.lang = 'en')::INT + 1 * contains(d.text, 'the')::INT)::INT AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT d.doc_id, (coalesce((l.quality = 1), false)::INT * 3 + (n_chars > 2000)::INT * 3 + (lang = 'en')::INT * 2 + contains(text, 'the')::INT)::INT AS score,
CASE WHEN coalesce((l.quality = 1), false)::INT * 3 + (n_chars > 2000)::INT * 3 + (lang = 'en')::INT * 2 + contains(text, 'the')::INT >= 5 THEN 'high' WHEN coalesce((l.quality = 1), false)::INT * 3 + (n_chars > 2000)::INT * 3 + (lang = 'en')::INT * 2 + contains(text, 'the')::INT >= 2 THEN 'medium' ELSE 'low' END AS confidence
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def evidence_score(spark, d):
    from corvane.operators import quality

    labels = table(spark, d, "labels").select("doc_id", "quality")
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    score = quality.evidence({"ast": F.col("quality") == 1, "config": F.col("n_chars") > 2000, "graph": F.col("lang") == "en", "lexical": F.col("text").contains("the")})
    return docs.select("doc_id", score.alias("score"), quality.confidence(score).alias("confidence"))


# --- lookups and exports ------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_name, p_partkey LIMIT 20")
def find(spark, d):
    from corvane.operators import lookup

    return lookup.find(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name"], "AN", ["p_name", "p_partkey"], 20)


@query("""WITH f AS (SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(lower(p_name), 'an') ORDER BY p_name, p_partkey LIMIT 20), c AS (SELECT p_partkey FROM f ORDER BY p_retailprice DESC, p_name, p_partkey LIMIT 1)
SELECT DISTINCT l_partkey AS center, l_suppkey AS neighbour FROM lineitem JOIN c ON l_partkey = p_partkey""")
def search(spark, d):
    from corvane.operators import lookup

    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return lookup.search(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_retailprice"), "p_name", "p_retailprice", "AN", edges, 20)


@query("""SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation""")
def export_nodes(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey")).alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("label"))
    return r.unionByName(table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("label")))


@query(f"""WITH {TOP_SQL} SELECT 'nation:' || src AS src, 'nation:' || dst AS dst, 'trade' AS kind FROM top2 UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'member' FROM nation""")
def export_edges(spark, d):
    t = top_trade(spark, d).select(F.concat(F.lit("nation:"), F.col("src")).alias("src"), F.concat(F.lit("nation:"), F.col("dst")).alias("dst"), F.lit("trade").alias("kind"))
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("region:"), F.col("n_regionkey")).alias("dst"), F.lit("member").alias("kind"))
    return t.unionByName(n)
