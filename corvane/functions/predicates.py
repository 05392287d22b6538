"""Predicates and names over paths, modules and contents of source files, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Category of an external module by its tokens; the first that applies.
CATEGORIES = {
    "frontend": ("angular", "next", "nextjs", "react", "svelte", "vue"),
    "web": ("django", "express", "fastapi", "fastify", "flask", "hapi", "koa"),
    "orm": ("knex", "orm", "prisma", "sequelize", "sqlalchemy", "typeorm"),
    "db": ("asyncpg", "mongodb", "mysql", "postgres", "psycopg", "redis", "sqlite"),
    "test": ("cypress", "jest", "mocha", "playwright", "pytest", "unittest", "vitest"),
    "log": ("logging", "loguru", "pino", "structlog", "winston"),
    "validation": ("joi", "pydantic", "validator", "yup", "zod"),
    "build": ("babel", "esbuild", "rollup", "ts", "typescript", "vite", "webpack"),
    "http": ("axios", "fetch", "httpx", "requests"),
}


def external_category(module: Column) -> Column:
    """Category of a module's tokens; other for none, null for null."""
    tokens = F.split(F.lower(module), "[^a-z0-9]+")
    found = F.lit("other")
    for name, words in reversed(CATEGORIES.items()):
        found = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), name).otherwise(found)
    return F.when(module.isNotNull(), found)


def _name(path: Column) -> Column:
    return F.substring_index(F.lower(path), "/", -1)


def is_config_file(path: Column) -> Column:
    """Manifests, settings and tool configuration by name."""
    known = "dockerfile|makefile|pipfile|docker-compose\\.yml|lerna\\.json|turbo\\.json|package\\.json|tsconfig\\.json|pipfile\\.lock|poetry\\.lock|requirements\\.txt|setup\\.py"
    return _name(path).rlike(f"^(?:{known})$|^\\.env|\\.config\\.|\\.(?:cfg|conf|ini|toml|yaml|yml)$")


def is_schema_file(path: Column) -> Column:
    return _name(path).rlike("\\.(?:gql|graphql|prisma|sql)$") | F.lower(path).rlike("/schema|/migrations/")


def is_trace_test(path: Column) -> Column:
    """Tests as the traces see them: test folders below the top, test and spec files of scripts."""
    return F.lower(path).rlike("/(?:__tests__|tests)/|\\.test\\.[jt]sx?$|\\.spec\\.")


def is_edge_path(path: Column) -> Column:
    """Whether call edges are taken from the file: not from tests or temporary folders."""
    low = F.concat(F.lit("/"), F.regexp_replace(F.lower(path), "^/+", ""))
    return ~low.rlike("/tests?/|/(?:tmp|temp|\\.tmp|\\.cache)/")


def route_path_confidence(path: Column) -> Column:
    """2 for a routing folder or file, 1 for a folder that often holds handlers, else 0."""
    low = F.lower(path)
    return F.when(low.rlike("/(?:routes|router|routers)/") | _name(path).rlike("^(?:(?:routes|router)\\.(?:py|ts|js|go|rs)|urls\\.py)$"), 2).when(low.rlike("/(?:api|controllers|endpoints|handlers|pages)/"), 1).otherwise(0)


_VERBS = "get|post|put|patch|delete"


def route_signal(path: Column, content: Column) -> Column:
    """Whether the content declares routes, by the rules of the file's language."""
    ext = F.lower(F.regexp_extract(path, "(\\.[A-Za-z]+)$", 1))
    python = content.rlike(f"@(?:app|api_router|blueprint|bp|router)\\.(?:{_VERBS}|route)\\(") | content.rlike("\\b(?:path|re_path|url)\\(\\s*[\"']")
    script = content.rlike(f"\\b(?:app|fastify|router|server)\\.(?:{_VERBS}|use|all)\\(") | content.rlike("create(?:Lazy)?FileRoute\\(") | content.rlike("export\\s+(?:async\\s+)?function\\s+(?:GET|POST|PUT|PATCH|DELETE)\\b")
    rust = content.rlike(f"#\\[(?:{_VERBS})\\s*\\([\"']") | content.rlike("\\.route\\(\\s*[\"']") | content.rlike(f"\\b(?:web|routing)::(?:{_VERBS}|resource)\\b")
    go = content.rlike("\\b(?:HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE|Path|PathPrefix)\\s*\\(\\s*[\"']")
    hit = F.when(ext == ".py", python).when(ext.isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), script).when(ext == ".rs", rust).when(ext == ".go", go).otherwise(False)
    return F.coalesce(hit, F.lit(False))


def is_internal_module(module: Column, roots: Column | None = None) -> Column:
    """Relative, rooted and aliased modules, and those whose first segment is among roots (an array)."""
    m = F.regexp_replace(F.trim(module), "^['\"]+|['\"]+$", "")
    m = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "^crate::", ""), "^self::", "./"), "^super::", "../")
    m = F.replace(F.replace(m, F.lit("::"), F.lit("/")), F.lit("//"), F.lit("/"))
    inside = m.rlike("^(?:\\.|/|@/|~/|src/|app/|lib/)")
    if roots is not None:
        inside = inside | (m.contains("/") & F.array_contains(roots, F.substring_index(m, "/", 1)))
    return F.coalesce((m != "") & inside, F.lit(False))


def is_server_action(content: Column) -> Column:
    return F.coalesce(F.lower(content).rlike("[\"']use server[\"']") | content.rlike("export\\s+async\\s+function\\s+(?:action|loader)\\b"), F.lit(False))


def is_rpc_module(module: Column) -> Column:
    """Modules that calls over the wire are imported from."""
    return F.coalesce(F.lower(module).rlike("(?:^|/)routes/api/|/routes/.*/api/|/actions|/rpc/|[to]rpc"), F.lit(False))


def package_folder(path: Column) -> Column:
    """The first folder, or the first two below apps, packages and workers."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first = F.try_element_at(parts, F.lit(1))
    return F.when(first.isin("apps", "packages", "workers") & (F.size(parts) > 1), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.coalesce(first, F.lit("")))


def router_name(name: Column) -> Column:
    """userRouter and UserRouter become user; a bare Router stays."""
    base = F.regexp_replace(name, "Router$", "")
    cut = F.concat(F.lower(F.left(base, F.lit(1))), F.right(base, F.greatest(F.length(base) - 1, F.lit(0))))
    return F.when(name.endswith("Router") & (base != ""), cut).otherwise(name)


def entry_domain(kind: Column, label: Column, path: Column) -> Column:
    """The domain that an entry belongs to: its kind for http, ui and jobs, else its router, service or
    label, else its kind."""
    low = F.lower(path)
    stem = F.regexp_replace(_name(path), "\\.[^.]*$", "")
    router = F.regexp_replace(F.regexp_replace(stem, "[-_]router", ""), "router$", "")
    base = F.replace(F.substring_index(label, ".", 1), F.lit("Router"), F.lit(""))
    return (
        F.when(kind.isin("http", "ui", "job"), kind)
        .when(low.contains("/routers/index."), "rpc")
        .when(low.contains("/routers/"), F.when(router == "", "rpc").otherwise(router))
        .when(low.contains("/services/"), stem)
        .when(low.contains("/jobs/"), "jobs")
        .when(label.contains("."), F.when(base == "", "rpc").otherwise(base))
        .otherwise(F.coalesce(F.nullif(kind, F.lit("")), F.lit("entry")))
    )


TYPE_NAMES = {"str": "string", "bool": "boolean", "integer": "int", "map": "dict"}


def normal_type(name: Column) -> Column:
    """The last part of a type's first name in lower case, synonyms made one; '' for none."""
    token = F.substring_index(F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), "([a-z_][a-z0-9_.]*)", 1), ".", -1)
    pairs = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, token), token)
