"""Configuration of a code map: project settings, evidence weights, section budgets, fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.files import load_config

NAMES = ("repomap.json", ".repomap.json")
_GLOBS = ("docs_globs", "docs_exclude_globs", "tests_globs", "tests_exclude_globs", "configs_globs", "configs_exclude_globs", "routes_globs", "routes_names", "routes_exclude_globs")
WEIGHTS = {"default": {"ast": 3.0, "config": 3.0, "graph": 2.0, "lexical": 1.0, "high": 5.0, "medium": 2.0}, "entrypoint": {"high": 4.0}, "route": {"high": 4.0}}


def _strings(value: object) -> list[str]:
    given = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    return [v.strip() for v in given if isinstance(v, str) and v.strip()]


def project_config(files: dict[str, str], warnings: list[str] | None = None) -> dict:
    """Settings of the first of NAMES among files (path: text): lists of globs, the routes mode, caps of
    entries. Anything that can't be read gives {} and a warning."""
    warnings = warnings if warnings is not None else []
    name = next((n for n in NAMES if n in files), None)
    if name is None:
        return {}
    try:
        data = json.loads(files[name])
    except json.JSONDecodeError as wrong:
        warnings.append(f"{name}: {wrong}")
        return {}
    if not isinstance(data, dict):
        warnings.append(f"{name}: not an object")
        return {}
    part = lambda d, k: d.get(k) if isinstance(d.get(k), dict) else {}
    routes, entries = part(data, "routes"), part(data, "entrypoints")
    out: dict = {k: _strings(data.get(k)) for k in _GLOBS}
    for own, keys in (("routes_globs", ("globs", "paths")), ("routes_names", ("names",)), ("routes_exclude_globs", ("exclude_globs",))):
        for k in keys:
            out[own] += _strings(routes.get(k))
    modes = [m.strip() for m in (routes.get("mode"), data.get("routes_mode")) if isinstance(m, str) and m.strip()]
    number = lambda v: v if isinstance(v, int) and not isinstance(v, bool) else None
    detail = part(entries, "details")
    caps = {k: number(entries.get(k)) for k in ("max_items", "max_per_group")}
    caps |= {f"details_{k}": number(entries.get(f"details_{k}") or detail.get(k)) for k in ("limit", "per_kind")}
    return out | {"routes_mode": modes[0] if modes else "auto", "entrypoints": {"frameworks": _strings(entries.get("frameworks")), "include_middleware": entries.get("include_middleware")} | caps}


def evidence_weights(text: str = "") -> dict[str, dict[str, float]]:
    """WEIGHTS with what lines of domain, key and value (tab-separated) change; other lines are passed over."""
    out = {k: dict(v) for k, v in WEIGHTS.items()}
    for line in text.splitlines():
        cells = [c.strip() for c in line.split("\t")]
        if line.lstrip().startswith("#") or len(cells) != 3:
            continue
        try:
            out.setdefault(cells[0], {})[cells[1]] = float(cells[2])
        except ValueError:
            continue
    return out


def domain_weights(weights: dict[str, dict[str, float]], domain: str) -> dict[str, float]:
    return weights.get("default", {}) | weights.get(domain, {})


def section_ratios(given: dict, known: dict[str, float]) -> tuple[dict[str, float], list[str]]:
    """(ratios, warnings): known with the given ones, whose names may be in any case; ratios above 1 are
    1, unknown names and ratios of 0 and less or without a number are left out with a warning."""
    out, warnings = dict(known), []
    for key, value in given.items():
        name = str(key).strip().upper()
        if name not in known:
            warnings.append(f"unknown section: {key}")
            continue
        try:
            ratio = float(value)
        except (TypeError, ValueError):
            ratio = 0.0
        if ratio > 0:
            out[name] = min(1.0, ratio)
        else:
            warnings.append(f"no ratio for {key}: {value}")
    return out, warnings


def fingerprint(config: dict) -> str:
    """SHA-1 of a configuration, whatever the order of its keys; '' for none."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest() if config else ""


def index_signature(options: dict, config: dict, version: int = 1) -> str:
    """What an index depends on beside the files: an incremental run needs an equal one."""
    return fingerprint({"version": version, "options": options, "config": fingerprint(config)})


def auto_flags(files: DataFrame, most_files: int = 20_000, most_mb: int = 200) -> dict[str, bool]:
    """Whether parsing, and the dearer flow analysis, are on for files (path, content) of this number and size."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).head()
    return {"parse": n <= most_files, "flows": n <= most_files * 3 // 10 and size <= most_mb << 20}


def package_rows(files: DataFrame) -> DataFrame:
    """(path, name, scripts, main, type) of the package.json files among files (path, content)."""
    c = F.col("content")
    text = lambda k: F.get_json_object(c, f"$.{k}").alias(k)
    scripts = F.coalesce(F.array_sort(F.json_object_keys(F.get_json_object(c, "$.scripts"))), F.array().cast("array<string>"))
    return files.filter("path = 'package.json' OR endswith(path, '/package.json')").select("path", text("name"), scripts.alias("scripts"), text("main"), text("type"))


__all__ = ["load_config", "project_config", "evidence_weights", "domain_weights", "section_ratios", "fingerprint", "index_signature", "auto_flags", "package_rows"]
