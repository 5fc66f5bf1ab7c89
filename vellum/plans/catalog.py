"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans import listing_queries, match_queries, paper_queries, prose_queries, reader_queries, submission_queries, table_queries

TABLES = [prose_queries.QUERIES, table_queries.QUERIES, paper_queries.QUERIES, match_queries.QUERIES, listing_queries.QUERIES, submission_queries.QUERIES, reader_queries.QUERIES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro redundancy of every document."""
    return prose_queries.macro_redundancy(spark, sf_dir)


def _wide(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its small integers as BIGINT, as SQL counts them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _wide(query) for table in TABLES for name, (query, _) in table.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for table in TABLES for name, (_, sql) in table.items() if sql}
