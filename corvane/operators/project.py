"""A source tree from its folder to its code map and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import paths
from corvane.operators import codemap, report
from corvane.sources import config as settings
from corvane.sources import files as sources

_SETTINGS = "(?:^|/)(?:tsconfig[^/]*\\.json|package\\.json|pyproject\\.toml|Cargo\\.toml|[Dd]ockerfile[^/]*)$|^\\.?repomap\\.json$"


def load(spark: SparkSession, root: str) -> dict:
    """What a folder holds: files (path, content), settings by path (small files, read by the driver), the
    project's configuration, aliases, manifest roles, framework, whether it is a monorepo, warnings."""
    files = sources.read_files(spark, root).select("path", "content")
    texts = {r["path"]: r["content"] for r in files.filter(F.col("path").rlike(_SETTINGS)).collect()}
    warnings: list[str] = []
    roles = [(f, role) for path, text in texts.items() for f, role in sources.manifest_roles(path, text)]
    return {
        "files": files, "settings": texts, "config": settings.project_config(texts, warnings), "warnings": warnings,
        "aliases": sources.merged_aliases({p: t for p, t in texts.items() if p.rpartition("/")[2].startswith("tsconfig")}),
        "manifest": spark.createDataFrame(roles, "path string, role string"),
        "framework": sources.framework(texts.get("package.json"), texts.get("pyproject.toml"), texts.get("Cargo.toml")), "is_monorepo": sources.is_monorepo(files),
    }


def chosen(files: DataFrame, config: dict) -> dict[str, DataFrame]:
    """(path) of the docs, tests and configs among files: excluding globs win, then including ones, then
    the path."""
    p = F.col("path")
    rules = {"docs": paths.is_doc(p), "tests": paths.is_test(p), "configs": paths.is_config(p)}
    return {kind: files.filter(paths.selected(p, rule, config.get(f"{kind}_globs"), config.get(f"{kind}_exclude_globs"))).select("path").distinct() for kind, rule in rules.items()}


def code_map(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The relations of the code map of a folder."""
    found = load(spark, root)
    return codemap.build(found["files"], found["aliases"], found["manifest"])


def digest(spark: SparkSession, root: str, profile: str = "balanced", budget: int | None = None, ratios: dict | None = None) -> DataFrame:
    """The report of a folder; ratios are shares of the budget by section, in any case."""
    shares, _ = settings.section_ratios(ratios or {}, {n: report.RATIOS.get(n, 1.0) for n in report.ORDER})
    return report.assemble(report.sections(code_map(spark, root)), budget or report.PROFILES[profile], ratios=shares)


def summary(m: dict[str, DataFrame], form: str = "text") -> DataFrame:
    """(line): counts by language and role, of symbols, edges and externals; as text or as one JSON line."""
    code = m["files"].filter("language != 'unknown'")
    rows = code.groupBy(F.lit("language").alias("what"), F.col("language").alias("name")).agg(F.count("*").alias("n"))
    rows = rows.unionByName(code.groupBy(F.lit("role").alias("what"), F.col("role").alias("name")).agg(F.count("*").alias("n")))
    for name in ("symbols", "file_dep", "external_dep", "symbol_ref", "entities", "skipped"):
        rows = rows.unionByName(m[name].select(F.lit("total").alias("what"), F.lit(name).alias("name")).groupBy("what", "name").agg(F.count("*").alias("n")))
    if form == "json":
        return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct("what", "name", "n")))).alias("line"))
    return rows.orderBy("what", F.desc("n"), "name").select(F.concat_ws(" ", "what", F.concat("name", F.lit("="), F.col("n").cast("string"))).alias("line"))


#: Relations of each set of TSV artefacts.
ARTEFACTS = {"minimal": ("files", "tests"), "standard": ("files", "tests", "file_dep", "external_dep", "symbols"), "full": ("files", "tests", "file_dep", "external_dep", "symbols", "symbol_ref", "dataflow", "type_ref", "docs", "entities", "entity_use", "api_contracts")}


def write_artefacts(m: dict[str, DataFrame], path: str, level: str = "standard") -> None:
    """The relations of ARTEFACTS[level] as TSV."""
    sources.write_relations({n: m[n] for n in ARTEFACTS[level]}, path, "tsv")
