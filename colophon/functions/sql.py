"""The functions that queries in SQL may use, as SQL functions that the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BLANK = r"[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]"
_SLUG = (
    rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(t, '^{_BLANK}+|{_BLANK}+$', '')), "
    r"'[^\\p{L}\\p{N}_\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85-]', ''), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85_]+', '-'), '-{2,}', '-')"
)
#: name: (parameters, type, body)
FUNCTIONS = {
    "hamming64": ("a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    "megapixels": ("w DOUBLE, h DOUBLE", "DOUBLE", "w * h / 1e6D"),
    "from_hex64": ("t STRING", "BIGINT", "CASE WHEN t RLIKE '^[0-9a-fA-F]{16}$' THEN CAST(conv(t, 16, -10) AS BIGINT) END"),
    "slugify": ("t STRING", "STRING", f"coalesce(nullif(trim(BOTH '-' FROM left(coalesce(nullif(trim(BOTH '-' FROM {_SLUG}), ''), 'image'), 80)), ''), 'image')"),
    "choose_status": (
        "score INT, risk STRING, people BOOLEAN, prop BOOLEAN, mark BOOLEAN", "STRING",
        "CASE WHEN mark OR score < 60 THEN 'LOW_QUALITY' WHEN people OR prop THEN 'NEEDS_RELEASE' WHEN risk IN ('Medium', 'High') THEN 'REVIEW' ELSE 'READY' END",
    ),
    "is_pending": (
        "status STRING, attempts INT", "BOOLEAN",
        "CASE WHEN status IS NULL THEN true WHEN status IN ('READY', 'LOW_RESOLUTION', 'LOW_QUALITY', 'DUPLICATE', 'NEEDS_RELEASE', 'REVIEW', 'ERROR_PERMANENT') THEN false "
        "WHEN status = 'ERROR' THEN coalesce(attempts, 0) < 3 ELSE true END",
    ),
}


def register_functions(spark: SparkSession) -> None:
    """Make FUNCTIONS known to the session's SQL."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
