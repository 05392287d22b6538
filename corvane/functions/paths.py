"""Classification of file paths: language, role, layer, noise, and the filters built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import matches_glob

LANGUAGES = {"ts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "cjs": "js", "jsx": "jsx", "py": "py", "go": "go", "rs": "rs"}
UNSUPPORTED = {"java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "swift": "swift", "scala": "scala", "dart": "dart", "ex": "elixir", "exs": "elixir", "lua": "lua"}


def _mapped(key: Column, table: dict[str, str], default: str | None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    return _mapped(extension(path), LANGUAGES, "unknown")


def unsupported_language(path: Column) -> Column:
    """Name of a language that has no extractor; null for others."""
    return _mapped(extension(path), UNSUPPORTED, None)


def is_generated(path: Column) -> Column:
    """Lock files, caches, build information, generated declarations."""
    name = F.substring_index(path, "/", -1)
    return name.rlike("^(?:next-env\\.d\\.ts|install-state\\.gz|\\.DS_Store|Thumbs\\.db)$") | name.rlike("\\.(?:tsbuildinfo|pyc|pyo|min\\.js|min\\.css|map|snap|lock)$") | path.rlike("\\.egg-info(?:/|$)")


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike("(?:^|/)(?:tests?|__tests__|specs?|e2e)/") | low.rlike("(?:^|/)(?:test_[^/]*|[^/]*_test|[^/]*\\.(?:test|spec))\\.[a-z]+$|(?:^|/)conftest\\.py$")


def is_config(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike("\\.(?:ya?ml|toml|ini|cfg|conf|env|properties)$") | low.rlike("(?:^|/)(?:package|tsconfig[^/]*|jsconfig|composer)\\.json$") | low.rlike("(?:^|/)(?:dockerfile|makefile|\\.env[^/]*|[^/]*\\.config\\.[a-z]+)$")


def is_doc(path: Column) -> Column:
    low = F.lower(path)
    return low.rlike("\\.(?:md|mdx|rst|adoc)$") | low.rlike("(?:^|/)docs?/[^/]*\\.txt$")


def selected(path: Column, heuristic: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Excluding globs win, then including ones, then the heuristic."""
    return F.when(matches_glob(path, exclude or []), F.lit(False)).when(matches_glob(path, include or []), F.lit(True)).otherwise(heuristic)


def is_noise(path: Column) -> Column:
    return F.lower(path).rlike("(?:^|/)(?:node_modules|dist|build|vendor|coverage|__pycache__|\\.git|generated|migrations|fixtures|mocks?|stubs?)/") | is_test(path)


def is_runtime(path: Column) -> Column:
    """Not an example, fixture, benchmark or the like."""
    return ~F.lower(path).rlike("(?:^|/)(?:examples?|samples?|demos?|fixtures?|bench(?:marks?)?|playground|templates?|docs?)/")


ENTRY_NAMES = {"main": "main", "__main__": "main", "cli": "cli", "server": "server", "app": "app", "worker": "worker", "index": "app", "manage": "cli", "wsgi": "server", "asgi": "server", "lambda": "worker", "handler": "worker"}


def entry_role(path: Column) -> Column:
    """Role that the file's name suggests; null outside runtime paths."""
    stem = F.lower(F.regexp_extract(path, "([^/.]+)\\.[A-Za-z0-9]+$", 1))
    return F.when(is_runtime(path) & ~is_test(path), _mapped(stem, ENTRY_NAMES, None))


def content_role(text: Column) -> Column:
    """Role that the content shows; first match wins."""
    return (
        F.when(text.rlike("(?:argparse|@click\\.|typer\\.Typer|commander|yargs|clap::Parser)"), "cli")
        .when(text.rlike("(?:airflow|@celery|Celery\\(|BackgroundTasks|rq\\.Queue|\\bDAG\\()"), "worker")
        .when(text.rlike("(?:FastAPI\\(|Flask\\(|express\\(\\)|new Hono|http\\.ListenAndServe|axum::Router)"), "server")
        .when(text.rlike("if __name__ == [\"']__main__[\"']|func main\\(\\)|fn main\\(\\)"), "main")
    )


def role(path: Column, is_entry: Column) -> Column:
    return F.when(is_test(path), "test").when(is_config(path), "config").when(is_entry, "entrypoint").otherwise("library")


def layer(path: Column) -> Column:
    """presentation, application, domain or data, by the first directory name that tells; else other."""
    low = F.concat(F.lit("/"), F.lower(path))
    return (
        F.when(low.rlike("/(?:routes?|controllers?|api|pages|views?|components?|ui|handlers?)/"), "presentation")
        .when(low.rlike("/(?:services?|usecases?|application|workers?|jobs?)/"), "application")
        .when(low.rlike("/(?:domain|models?|entities|core)/"), "domain")
        .when(low.rlike("/(?:repositor(?:y|ies)|db|database|data|dao|storage|persistence|infra(?:structure)?)/"), "data")
        .otherwise("other")
    )


def component(path: Column, depth: int = 2) -> Column:
    """The first directories of the path: below packages, apps, libs or services, the next one too."""
    parts = F.split(path, "/")
    nested = F.element_at(parts, 1).isin("packages", "apps", "libs", "services", "src")
    return F.when(F.size(parts) == 1, "root").when(nested & (F.size(parts) > depth), F.array_join(F.slice(parts, 1, depth), "/")).otherwise(F.element_at(parts, 1))


def selection_penalty(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(is_test(path) & low.rlike("(?:test_|_test\\.|\\.test\\.|\\.spec\\.)"), 3.0)
        .when(low.rlike("(?:^|/)(?:build|dist|scripts?|tools?)/"), 2.5)
        .when(is_test(path), 2.0)
        .when(low.contains("test"), 1.5)
        .when(is_config(path), 1.0)
        .otherwise(0.0)
    )


def visibility(name: Column, exported: Column) -> Column:
    return F.when(name.startswith("_"), "private").when(exported, "public").otherwise("internal")
