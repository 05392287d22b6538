"""The scalar functions as temporary SQL functions of a session: expressions, not Python calls."""

from __future__ import annotations

from pyspark.sql import SparkSession

_ESTIMATE = r"CAST(greatest(regexp_count(coalesce(s, ''), '[A-Za-z0-9_]+|[^ \\t\\n\\r\\f\\x0BA-Za-z0-9_]'), 1) AS BIGINT)"
_URL = r"regexp_replace(regexp_replace(s, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"
FUNCTIONS = {
    "token_estimate": ("s STRING", "BIGINT", _ESTIMATE),
    "ellipsis": ("s STRING, n INT", "STRING", "CASE WHEN length(s) <= n THEN s ELSE concat(rtrim(substring(s, 1, n - 3)), '...') END"),
    "url_path": ("s STRING", "STRING", f"(SELECT CASE WHEN length(r) > 1 THEN regexp_replace(r, '/+$', '') ELSE r END FROM (SELECT CASE WHEN startswith(b, '/') THEN b ELSE concat('/', b) END AS r FROM (SELECT {_URL} AS b)))"),
    "xml_escape": ("s STRING", "STRING", "replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\'', '&apos;')"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Registers FUNCTIONS; their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
