"""Scalar functions as SQL functions of a session.

SQL has no way to bind a Column function to a name, so each is a session-level SQL function whose
body is the function's own expression text where that exists, else a Spark SQL body.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "entity_key(c STRING)": ("STRING", r"lower(regexp_replace(regexp_replace(c, '(?U)\\A[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z', ''), '(?U)\\s+', ' '))"),
    "strip_text(c STRING)": ("STRING", r"regexp_replace(c, '(?U)\\A[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z', '')"),
    "escape_html(c STRING)": ("STRING", "replace(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"),
    "remove_urls(c STRING)": ("STRING", r"regexp_replace(regexp_replace(c, '(?dU)https?://[^\\s]+', ''), '(?dU)www\\.[^\\s]+', '')"),
    "progress_percent(done INT, total INT)": ("INT", "cast(5 + floor(70 * done / greatest(total, 1)) AS INT)"),
    "bubble_size(f BIGINT, ref BIGINT)": (
        "DOUBLE",
        "CASE WHEN f <= 1 THEN 9D WHEN greatest(2, ref) <= 2 THEN 16D ELSE 16 + 44 * pow(least(1D, greatest(0D, (ln(greatest(f, 2)) - ln(2)) / greatest(ln(greatest(2, ref)) - ln(2), 1e-9))), 0.65) END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions for this session; returns their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
