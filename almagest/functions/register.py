"""SQL names for the expressions, so that queries in text can use them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from almagest.operators.linking import lexical_key, variant_reason
from almagest.operators.text import unescape

#: Expressions that need no Python at run time, as SQL functions.
SQL_FUNCTIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION months_before(d DATE, n INT) RETURNS DATE RETURN add_months(d, -n)",
    "CREATE OR REPLACE TEMPORARY FUNCTION log_growth(r DOUBLE, p DOUBLE) RETURNS DOUBLE RETURN ln((r + 1) / (p + 1))",
    "CREATE OR REPLACE TEMPORARY FUNCTION ratio(n DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN try_divide(n, d)",
    "CREATE OR REPLACE TEMPORARY FUNCTION in_window(d DATE, a DATE, b DATE) RETURNS BOOLEAN RETURN d > a AND d <= b",
    "CREATE OR REPLACE TEMPORARY FUNCTION parse_iso(t STRING) RETURNS DATE RETURN try_cast(left(t, 10) AS DATE)",
    "CREATE OR REPLACE TEMPORARY FUNCTION stable_key(ns STRING, v STRING) RETURNS STRING RETURN concat(ns, ':', left(sha2(trim(v), 256), 24))",
)


def register(spark: SparkSession) -> None:
    for statement in SQL_FUNCTIONS:
        spark.sql(statement)
    for name, function in (("lexical_key", lexical_key), ("variant_reason", variant_reason), ("unescape_html", unescape)):
        spark.udf.register(name, function)
