"""Source trees and their configuration files as DataFrames, and the sinks for results."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import paths
from corvane.functions.text import strip_json_comments, xml_escape

MAX_CHARS = 200_000
EXCLUDED = ("node_modules", ".git", ".hg", ".venv", "venv", "__pycache__", "dist", "build", "target", ".next", "coverage")


def read_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, length, content): the files below root, by relative path; text is decoded as UTF-8 and what
    can't be is left out. content is only read if it is used."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "file:" + root.rstrip("/") + "/" if "://" not in root and not root.startswith("file:") else root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^" + base.replace(".", "\\."), "")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    files = raw.select(path.alias("path"), "length", text.alias("content"))
    dirs = "|".join(d.replace(".", "\\.") for d in exclude)
    return files.filter(~F.col("path").rlike(f"(?:^|/)(?:{dirs})/") & ~paths.is_generated(F.col("path")))


def classify(files: DataFrame) -> DataFrame:
    """Adds language, role, entry_role, layer, component, sha1 to (path, content)."""
    p, c = F.col("path"), F.col("content")
    code = paths.language(p) != "unknown"
    entry = F.when(code & paths.is_runtime(p) & ~paths.is_test(p), F.coalesce(paths.content_role(c), paths.entry_role(p)))
    out = files.withColumns({"language": paths.language(p), "entry_role": entry, "layer": paths.layer(p), "component": paths.component(p), "sha1": F.sha1("content")})
    return out.withColumn("role", paths.role(p, F.col("entry_role").isNotNull()))


def code_files(files: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    return files.filter((F.col("language") != "unknown") & (F.length("content") <= limit))


def oversized(files: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """(path, n_chars): the code files that code_files leaves out."""
    return files.filter((F.col("language") != "unknown") & (F.length("content") > limit)).select("path", F.length("content").alias("n_chars"))


def summary_line() -> F.Column:
    """The first comment or docstring line among a file's first 40 lines, if nothing else comes first."""
    lines = F.transform(F.slice(F.split("content", "\n"), 1, 40), lambda x: F.trim(x))
    first = F.try_element_at(F.filter(lines, lambda x: (x != "") & ~x.startswith("#!")), F.lit(1))
    mark = "^(?:///?|/\\*\\*?|#+|\\*|\"\"\"|''')\\s*"
    return F.when(first.rlike(mark), F.substring(F.trim(F.regexp_replace(F.regexp_replace(first, mark, ""), "(?:\\*/|\"\"\"|''')\\s*$", "")), 1, 160))


def load_config(text: str | None) -> dict:
    """A JSON configuration with comments; anything unusable gives an empty one."""
    try:
        found = json.loads(strip_json_comments(text or "{}"))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def path_aliases(tsconfig: str | None) -> list[tuple[str, str, str]]:
    """(pattern, target, base) of a tsconfig's paths."""
    options = load_config(tsconfig).get("compilerOptions", {})
    base = options.get("baseUrl", ".")
    return [(pattern, target, base) for pattern, targets in options.get("paths", {}).items() for target in targets]


def merged_aliases(tsconfigs: dict[str, str]) -> list[tuple[str, str, str]]:
    """The aliases of tsconfigs (path: text): of the top one if it has any, else of all nested ones, each
    with its folder before the base."""
    top = path_aliases(tsconfigs.get("tsconfig.json"))
    if top:
        return top
    out = []
    for path, text in sorted(tsconfigs.items()):
        folder = path.rpartition("/")[0] or "."
        out += [(pattern, target, f"{folder}/{base}") for pattern, target, base in path_aliases(text)]
    return out


FRAMEWORKS = [("next", "next"), ("@nestjs/core", "nestjs"), ("hono", "hono"), ("fastify", "fastify"), ("express", "express"), ("react", "react"), ("vue", "vue"), ("svelte", "svelte"), ("fastapi", "fastapi"), ("django", "django"), ("flask", "flask"), ("starlette", "starlette"), ("axum", "axum"), ("actix-web", "actix")]


def framework(package_json: str | None = None, pyproject: str | None = None, cargo: str | None = None) -> str | None:
    """The first known framework among the dependencies of the manifests."""
    names: set[str] = set()
    package = load_config(package_json)
    for key in ("dependencies", "devDependencies", "peerDependencies"):
        names |= set(package.get(key) or {})
    for text in (pyproject, cargo):
        try:
            data = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            continue
        listed = list(data.get("project", {}).get("dependencies", []))
        listed += list(data.get("tool", {}).get("poetry", {}).get("dependencies", {})) + list(data.get("dependencies", {}))
        names |= {"".join(c if c.isalnum() or c in "-_" else " " for c in n).split()[0].lower() for n in listed if n.strip()}
    return next((label for name, label in FRAMEWORKS if name in names), None)


def manifest_roles(path: str, text: str) -> list[tuple[str, str]]:
    """(file, role) of the entrypoints that a manifest names: package.json main, bin and scripts,
    pyproject scripts, Dockerfile CMD and ENTRYPOINT."""
    import re

    name = path.rsplit("/", 1)[-1]
    base = path[: -len(name)]
    found: list[tuple[str, str]] = []
    if name == "package.json":
        data = load_config(text)
        bins = data.get("bin") or {}
        found += [(v, "cli") for v in ([bins] if isinstance(bins, str) else bins.values())]
        found += [(data["main"], "main")] if isinstance(data.get("main"), str) else []
        for script in (data.get("scripts") or {}).values():
            found += [(m, "main") for m in re.findall(r"(?:node|tsx|ts-node|bun|deno run)\s+(?:-\S+\s+)*(\S+\.[mc]?[jt]sx?)", str(script))]
    elif name == "pyproject.toml":
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            data = {}
        scripts = {**data.get("project", {}).get("scripts", {}), **data.get("tool", {}).get("poetry", {}).get("scripts", {})}
        found += [(str(v).split(":")[0].replace(".", "/") + ".py", "cli") for v in scripts.values()]
    elif name.lower().startswith("dockerfile"):
        for line in re.findall(r"(?im)^\s*(?:CMD|ENTRYPOINT)\s+(.*)$", text):
            found += [(m, "server") for m in re.findall(r"[\w./-]+\.(?:py|[mc]?[jt]s)\b", line)]
    return [(base + f.removeprefix("./"), role) for f, role in found]


MANIFESTS = {"package.json": "npm", "pyproject.toml": "python", "Cargo.toml": "rust", "go.mod": "go"}


def package_roots(files: DataFrame) -> DataFrame:
    """(root, kind): the directories of package manifests ('' for the top)."""
    name = F.substring_index("path", "/", -1)
    kind = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    root = F.regexp_replace("path", "/?[^/]+$", "")
    return files.select(root.alias("root"), F.try_element_at(kind, name).alias("kind")).filter("kind IS NOT NULL").groupBy("root").agg(F.min("kind").alias("kind"))


def is_monorepo(files: DataFrame) -> bool:
    """Whether there is a workspace marker, or two packages below the top."""
    markers = files.filter(F.col("path").isin("pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json", "rush.json")).limit(1).count()
    return bool(markers) or package_roots(files).filter("root != ''").limit(2).count() >= 2


def write_relations(relations: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """One table for each relation: parquet, json, or tsv (flat columns only)."""
    for name, df in relations.items():
        out = df.write.mode("overwrite")
        if form == "tsv":
            flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
            flat.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/{name}")
        elif form == "json":
            out.json(f"{path}/{name}")
        else:
            out.parquet(f"{path}/{name}")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a GraphML document of nodes (id, kind, label) and edges (src, dst, kind), in order."""
    head = ["<?xml version=\"1.0\" encoding=\"UTF-8\"?>", "<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">", "<key id=\"kind\" for=\"all\" attr.name=\"kind\" attr.type=\"string\"/>", "<key id=\"label\" for=\"node\" attr.name=\"label\" attr.type=\"string\"/>", "<graph edgedefault=\"directed\">"]
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(0, "", i, x) for i, x in enumerate(head)] + [(3, "", 0, "</graph>"), (3, "", 1, "</graphml>")], "part int, key string, sub int, line string")
    e = lambda c: xml_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.lit(0).alias("sub"), F.concat(F.lit("<node id=\""), e("id"), F.lit("\"><data key=\"kind\">"), e("kind"), F.lit("</data><data key=\"label\">"), e("label"), F.lit("</data></node>")).alias("line"))
    g = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "src", "dst", "kind").alias("key"), F.lit(0).alias("sub"), F.concat(F.lit("<edge source=\""), e("src"), F.lit("\" target=\""), e("dst"), F.lit("\"><data key=\"kind\">"), e("kind"), F.lit("</data></edge>")).alias("line"))
    return fixed.unionByName(n).unionByName(g).orderBy("part", "key", "sub").select("line")


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Six-column CSV of dataflow edges from another analyser; short rows and bad numbers are mended."""
    schema = "from_path string, from_line string, to_path string, to_line string, kind string, provenance string"
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(path)
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS int)"), F.lit(0)).alias(c)
    return raw.filter("from_path IS NOT NULL AND to_path IS NOT NULL").select("from_path", number("from_line"), "to_path", number("to_line"), "kind", "provenance")
