"""The text functions under SQL names in a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name: (parameters, type, SQL body); the bodies follow quire.functions.text
_SQL = {
    "quire_token_estimate": ("t STRING", "INT", "greatest(1, cast(ceil(length(t) / 4) as int))"),
    "quire_word_count": ("t STRING", "INT", r"size(filter(split(t, '[ \\t\\n\\r\\f\\x0B]+'), w -> w <> ''))"),
    "quire_length_hint": ("n BIGINT", "STRING", "case when n <= 1500 then 'one-line' when n <= 7500 then 'short' when n <= 30000 then 'medium' when n is not null then 'long' end"),
    "quire_preview": ("t STRING, most INT", "STRING", "case when length(t) > most then concat(substring(t, 1, most), '…[', length(t) - most, ' more chars]') else t end"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions and return their names."""
    for name, (params, kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return list(_SQL)
