"""What a code map holds, counted and listed: packages, externals, roles, routes, entries, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import predicates as P
from corvane.operators import joins


def package_stats(files: DataFrame, symbols: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, files, symbols): files and symbols (both with path) by their longest package root; roots
    below the top count if there are any, else the top ('.')."""
    below = roots.filter("root NOT IN ('', '.')").select("root").distinct()
    counted = lambda rows, name: joins.longest_prefix(rows.select("path"), "path", below, "root").filter("root IS NOT NULL").groupBy("root").agg(F.count("*").alias(name))
    return below.join(counted(files, "files"), "root", "left").join(counted(symbols, "symbols"), "root", "left").fillna(0, ["files", "symbols"])


def external_groups(externals: DataFrame, groups: int = 5, items: int = 2) -> DataFrame:
    """(category, n, modules): external modules (module) by category, other left out; the `groups` most
    frequent, with their `items` most frequent modules."""
    n = externals.groupBy("module").agg(F.count("*").alias("n")).withColumn("category", P.external_category(F.col("module"))).filter("category != 'other'")
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "module")))
    shown = F.array_sort(F.collect_list(F.when(F.col("r") <= items, F.struct("r", "module"))))
    return ranked.groupBy("category").agg(F.sum("n").alias("n"), shown.alias("m")).orderBy(F.desc("n"), "category").limit(groups).select("category", "n", F.col("m.module").alias("modules"))


def role_edges(edges: DataFrame, roles: DataFrame, top: int = 6) -> DataFrame:
    """(src_role, dst_role, n): edges (src, dst) between nodes by role (node, role); pairs of other and
    other only if there is nothing else."""
    a, b = (roles.select(F.col("node").alias(end), F.col("role").alias(f"{end}_role")) for end in ("src", "dst"))
    n = edges.join(a, "src").join(b, "dst").groupBy("src_role", "dst_role").agg(F.count("*").alias("n"))
    plain = (F.col("src_role") == "other") & (F.col("dst_role") == "other")
    some = n.withColumn("_told", F.max((~plain).cast("int")).over(Window.partitionBy(F.lit(1))))
    return some.filter(~plain | (F.col("_told") == 0)).orderBy(F.desc("n"), "src_role", "dst_role").limit(top).drop("_told")


def route_groups(routes: DataFrame, top: int = 6, samples: int = 2) -> DataFrame:
    """(key, n, samples): routes (kind, route) that begin with a slash by their first segment, or their
    first two if the kind is api; the least `samples` routes of each."""
    parts = F.filter(F.split("route", "/"), lambda p: p != "")
    key = F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, F.when((F.col("kind") == "api") & (F.size(parts) >= 2), 2).otherwise(1)), "/"))
    grouped = routes.filter("startswith(route, '/')").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("route")), 1, samples).alias("samples"))
    return grouped.orderBy(F.desc("n"), "key").limit(top)


def path_index(files: DataFrame) -> DataFrame:
    """(key, path): the names under which a file is imported: its path, its path without the extension,
    the folder of an index file, and what follows /src/. The first by rank, then path, has the key."""
    norm = F.regexp_replace("path", "^[./]+", "")
    stem = F.regexp_replace(norm, "\\.(?:tsx?|jsx?|mjs|cjs)$", "")
    folder = F.when(norm.rlike("/index\\.(?:ts|tsx|js|jsx)$"), F.regexp_replace(stem, "/index$", ""))
    tail = F.when(norm.contains("/src/"), F.regexp_extract(norm, "^.*?/src/(.*)$", 1))
    keys = [norm, stem, folder, tail, F.regexp_replace(tail, "\\.(?:tsx?|jsx?|mjs|cjs)$", "")]
    named = files.select("path", F.posexplode(F.array(*keys)).alias("rank", "key")).filter("key != ''")
    return named.groupBy("key").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def exported_names(symbols: DataFrame) -> DataFrame:
    """(path, names): the public names that a file defines, in order."""
    return symbols.filter("visibility = 'public'").groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names"))


def synthetic_symbols(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, name, path, line, kind, visibility): internal functions for the ends of calls (id, name, path,
    line) that no symbol (id) has; one for an id, the least of its rows."""
    unknown = calls.filter("id IS NOT NULL").join(symbols.select("id"), "id", "left_anti")
    first = F.min(F.struct("name", "path", "line")).alias("s")
    return unknown.groupBy("id").agg(first).select("id", "s.name", "s.path", "s.line", F.lit("function").alias("kind"), F.lit("internal").alias("visibility"))


def rpc_matches(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """(client, server): files that call over the wire (path) and those that answer (path), of the same
    package folder; a client whose folder has no server meets all of them."""
    c = clients.select(F.col("path").alias("client"), P.package_folder(F.col("path")).alias("root")).distinct()
    s = servers.select(F.col("path").alias("server"), P.package_folder(F.col("path")).alias("root")).distinct()
    own = c.join(s, "root")
    lost = c.join(s.select("root").distinct(), "root", "left_anti").drop("root").crossJoin(s.select("server"))
    return own.select("client", "server").unionByName(lost.select("client", "server")).filter("client != server")


def route_archetypes(routes: DataFrame, edges: DataFrame, roles: DataFrame, top: int = 4) -> DataFrame:
    """(signature, service, data, n, samples): routes (route, path) by the first service that their file
    depends on, and the first data file that the service, or else the file, depends on. edges: src, dst,
    ordinal; roles: node, role (services and data count)."""
    told = edges.join(roles.select(F.col("node").alias("dst"), "role"), "dst")
    first = lambda role, name: told.filter(F.col("role") == role).groupBy("src").agg(F.min_by("dst", F.struct("ordinal", "dst")).alias(name))
    service, data = first("services", "service"), first("data", "data")
    met = routes.filter("startswith(route, '/')").join(service.withColumnRenamed("src", "path"), "path", "left").join(data.withColumnRenamed("src", "path"), "path", "left")
    met = met.join(data.select(F.col("src").alias("service"), F.col("data").alias("deep")), "service", "left").withColumn("data", F.coalesce("deep", "data"))
    met = met.filter("service IS NOT NULL OR data IS NOT NULL")
    signature = F.concat_ws("->", F.lit("routes"), F.when(F.col("service").isNotNull(), "services"), F.when(F.col("data").isNotNull(), "data"))
    out = met.groupBy(signature.alias("signature"), "service", "data").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("route")), 1, 2).alias("samples"))
    return out.orderBy(F.desc("n"), "signature", F.asc_nulls_first("service"), F.asc_nulls_first("data")).limit(top)


def route_candidates(files: DataFrame, limit: int = 80) -> DataFrame:
    """(path, weight, turn): files (path, content, score, entry_role) that may hold routes, weighed by
    score, path, role and content, taken in turn from their top folders, the best folder first."""
    p = F.col("path")
    bonus = P.route_path_confidence(p)
    signal = P.route_signal(p, F.col("content"))
    http = F.coalesce(F.col("entry_role").isin("server", "app"), F.lit(False))
    evidence = 3.0 * signal.cast("int") + 1.0 * (bonus > 0).cast("int")
    weighed = files.filter(signal | (bonus == 2)).select("path", (F.coalesce("score", F.lit(0.0)) + bonus + 2.0 * http.cast("int") + evidence).alias("weight"), F.substring_index("path", "/", 1).alias("root"))
    mine = Window.partitionBy("root")
    ranked = weighed.withColumns({"turn": F.row_number().over(mine.orderBy(F.desc("weight"), "path")), "best": F.max("weight").over(mine)})
    return ranked.orderBy("turn", F.desc("best"), "root").limit(limit).select("path", "weight", "turn")


def entry_inventory(contracts: DataFrame, files: DataFrame, per_group: int = 24) -> DataFrame:
    """(kind, label, path, domain): entries of a code map: routes (method:route), scheduled and queue
    handlers and server actions by content, and, where there is none of these, files with an entry role."""
    routes = contracts.select(F.lit("http").alias("kind"), F.concat(F.lower("method"), F.lit(":"), "route").alias("label"), "path")
    c = F.col("content")
    kind = lambda test, kind, label: F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label")))
    found = F.array(kind(c.rlike("\\basync\\s+scheduled\\s*\\(|\\bscheduled\\s*[:(]"), "job", "scheduled"), kind(c.rlike("\\basync\\s+queue\\s*\\("), "job", "queue"), kind(P.is_server_action(c), "rpc", "action"))
    special = files.select("path", F.explode(F.array_compact(found)).alias("e")).select("e.kind", "e.label", "path")
    told = routes.unionByName(special)
    rest = files.filter("entry_role IS NOT NULL").join(told.select("path").distinct(), "path", "left_anti").select(F.lit("entry").alias("kind"), F.col("entry_role").alias("label"), "path")
    out = told.unionByName(rest).distinct().withColumn("domain", P.entry_domain(F.col("kind"), F.col("label"), F.col("path")))
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("domain").orderBy("path", "label"))).filter(F.col("_r") <= per_group).drop("_r")


def numbered(rows: DataFrame, prefix: str, order: list[Column | str], most: int) -> DataFrame:
    """The first `most` rows in order, with alias = prefix and number."""
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("alias", F.concat(F.lit(prefix), F.row_number().over(Window.orderBy(*order)).cast("string")))


def limits(available: DataFrame, selected: DataFrame, included: DataFrame) -> DataFrame:
    """(section, available, selected, included, omitted_by_limit, omitted_by_budget, truncated) from three
    tables of section; never negative."""
    n = lambda df, name: df.groupBy("section").agg(F.count("*").alias(name))
    row = n(available, "available").join(n(selected, "selected"), "section", "left").join(n(included, "included"), "section", "left").fillna(0)
    by_limit, by_budget = F.greatest(F.lit(0), F.col("available") - F.col("selected")), F.greatest(F.lit(0), F.col("selected") - F.col("included"))
    return row.withColumns({"omitted_by_limit": by_limit, "omitted_by_budget": by_budget}).withColumn("truncated", (F.col("omitted_by_limit") + F.col("omitted_by_budget")) > 0)


def component_graph(files: DataFrame, edges: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """Diagram of components: nodes (component, files, degree), the `most` of the greatest degree, and the
    edges (src, dst, w) between them. files: path, component; edges: src, dst, w of paths."""
    a, b = (files.select(F.col("path").alias(end), F.col("component").alias(name)) for end, name in (("src", "c1"), ("dst", "c2")))
    between = edges.join(a, "src").join(b, "dst").filter("c1 != c2").groupBy(F.col("c1").alias("src"), F.col("c2").alias("dst")).agg(F.sum("w").alias("w"))
    degree = between.select(F.explode(F.array("src", "dst")).alias("component"), "w").groupBy("component").agg(F.sum("w").alias("degree"))
    nodes = files.groupBy("component").agg(F.count("*").alias("files")).join(degree, "component", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), F.desc("files"), "component").limit(most)
    kept = nodes.select("component")
    shown = between.join(kept.withColumnRenamed("component", "src"), "src", "left_semi").join(kept.withColumnRenamed("component", "dst"), "dst", "left_semi")
    return nodes, shown.select("src", "dst", "w")


def match_counts(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(language, n): lines of the files (language, content) that match their language's pattern."""
    by = F.create_map(*[F.lit(x) for kv in patterns.items() for x in kv])
    lines = files.select("language", F.try_element_at(by, F.col("language")).alias("re"), F.explode(F.split("content", "\n")).alias("line")).filter("re IS NOT NULL")
    return lines.filter("line rlike re").groupBy("language").agg(F.count("*").alias("n"))


STACKS = {"js": ("js", "javascript", "jsx"), "ts": ("ts", "tsx", "typescript"), "py": ("py", "python"), "jvm": ("java", "kotlin", "scala"), "c": ("c", "cpp")}


def unsupported_targets(unsupported: DataFrame, targets: list[str]) -> DataFrame:
    """(language, n): unsupported languages (language, n) that the target stacks mean."""
    wanted = sorted({a for t in targets for a in STACKS.get(t.strip().lower(), (t.strip().lower(),))})
    return unsupported.filter(F.lower("language").isin(wanted) & (F.col("n") > 0))


def architecture(files: DataFrame, externals: DataFrame) -> DataFrame:
    """One row: frameworks and orms among the external modules, and the layout that folders tell."""
    tokens = F.split(F.lower("module"), "[^a-z0-9]+")
    kind = P.external_category(F.col("module"))
    named = externals.select(kind.alias("kind"), F.element_at(F.filter(tokens, lambda t: t != ""), 1).alias("name"))
    of = lambda *kinds: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("name"))))
    folder = lambda re: F.coalesce(F.bool_or(F.concat(F.lit("/"), F.lower("path")).rlike(re)), F.lit(False))
    flags = files.agg(folder("/(?:apps|packages)/").alias("mono"), folder("/(?:domain|ports|adapters)/").alias("hexagonal"), folder("/(?:services?|controllers?)/").alias("layered"))
    layout = F.when(F.col("mono"), "monorepo").when(F.col("hexagonal"), "hexagonal").when(F.col("layered"), "layered").otherwise("flat")
    return named.agg(of("web", "frontend").alias("frameworks"), of("orm", "db").alias("stores")).crossJoin(flags.select(layout.alias("layout")))
