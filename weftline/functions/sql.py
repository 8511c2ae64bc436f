"""Functions for SQL users: the splitter, offsets, scores and suppression under names in the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from weftline.functions.words import WORD

#: Bodies in SQL, so that Catalyst inlines them and no Python runs.
_WORD = WORD.replace("\\", "\\\\").replace("'", "\\'")
FUNCTIONS = {
    "split_words": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, '(?iU){_WORD}', 0)"),
    "word_count": ("t STRING", "INT", f"size(regexp_extract_all(t, '(?iU){_WORD}', 0))"),
    "sigmoid": ("x DOUBLE", "DOUBLE", "1 / (1 + exp(-x))"),
    "logit": ("p DOUBLE", "DOUBLE", "ln(p / (1 - p))"),
    "dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"),
    "argmax_first": ("a ARRAY<DOUBLE>", "INT", "CAST(array_position(a, array_max(a)) AS INT) - 1"),
    "overlaps": ("a_start BIGINT, a_end BIGINT, b_start BIGINT, b_end BIGINT", "BOOLEAN", "a_end > b_start AND a_start < b_end"),
}
#: Table functions.
TABLES = {
    "spans": (
        "n INT, width INT", "start INT, width_idx INT, end_ INT, is_padding BOOLEAN",
        "SELECT s.id, k.id, least(s.id + k.id + 1, n), s.id + k.id >= n FROM (SELECT explode(sequence(0, n - 1)) AS id) s, (SELECT explode(sequence(0, width - 1)) AS id) k WHERE n > 0",
    ),
}


def register(spark: SparkSession, prefix: str = "wl_") -> list[str]:
    """Create the functions in the session; their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {kind} RETURN {body}")
    for name, (args, kind, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS TABLE ({kind}) RETURN {body}")
    return [prefix + n for n in (*FUNCTIONS, *TABLES)]
