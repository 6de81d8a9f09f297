"""All registered queries of the document engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.plans import formats, markup, relational, scalars  # noqa: F401  (formats adds to the queries of scalars)

FLAGSHIP = "html_text_blocks"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (scalars, markup, relational):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
