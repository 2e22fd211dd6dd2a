"""The six-column catalog rows over JDBC; any DataFrame with these columns does as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROWS = "select id, geometry::text as geometry, collection, datetime, end_datetime, content::text as content from items"
FETCH_SIZE = 10_000


def catalog_source(spark: SparkSession, source: dict | DataFrame | Callable[[SparkSession], DataFrame], query: str = ROWS) -> DataFrame:
    """Rows of a catalog: JDBC options, a DataFrame, or a function that makes one.

    With ``lowerBound``, ``upperBound`` and ``numPartitions`` among the options the rows are read in parallel by time.
    """
    if isinstance(source, DataFrame):
        return source
    if callable(source):
        return source(spark)
    options = {"fetchsize": str(FETCH_SIZE), "dbtable": f"({query}) t"} | source
    if "numPartitions" in options:
        options.setdefault("partitionColumn", "datetime")
    return spark.read.format("jdbc").options(**options).load()
