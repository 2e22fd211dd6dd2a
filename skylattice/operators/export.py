"""From catalog rows to item tables and files, and row-wise changes of items."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from skylattice.operators.catalog import catalog_rows, rows_to_item_texts, with_partition_files
from skylattice.operators.layout import to_item_texts, to_table_layout
from skylattice.sources.items import from_items, parse_items, read_items
from skylattice.sources.jdbc import catalog_source
from skylattice.sources.sinks import read_item_parquet, sync_partitions, write_item_lines, write_item_parquet

Source = dict | DataFrame | Callable[[SparkSession], DataFrame]


def map_items(texts: DataFrame, change: Callable[[dict], dict]) -> DataFrame:
    """Item texts changed by a function of one item's dict. Prefer expressions: this runs Python for each item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item": [json.dumps(change(json.loads(t)), ensure_ascii=False) for t in batch["item"]]})

    return texts.select("item").mapInPandas(run, T.StructType([T.StructField("item", T.StringType())]))


def catalog_item_texts(
    spark: SparkSession, source: Source, bases: DataFrame | None = None, collection: str | None = None, start: dt.datetime | None = None,
    end: dt.datetime | None = None, cql2: dict | None = None, change: Callable[[dict], dict] | None = None, unset: str | None = None,
) -> DataFrame:
    """JSON texts of the catalog's items that fulfil the conditions, completed by base items and changed by ``change``."""
    texts = rows_to_item_texts(catalog_rows(catalog_source(spark, source), collection, start, end, cql2), bases, unset)
    return texts if change is None else map_items(texts, change)


def catalog_to_table(spark: SparkSession, source: Source, strict: bool = True, drop_invalid: bool = True, **conditions: Any) -> DataFrame:
    """The catalog's items in the table layout; conditions as for ``catalog_item_texts``."""
    return to_table_layout(parse_items(catalog_item_texts(spark, source, **conditions), strict=strict), drop_invalid)


def catalog_to_parquet(spark: SparkSession, source: Source, path: str, write: dict[str, Any] | None = None, **conditions: Any) -> str:
    """Writes the catalog's items as item Parquet; ``write``: options of ``write_item_parquet``. Returns the path."""
    return write_item_parquet(catalog_to_table(spark, source, **conditions), path, **(write or {}))


def catalog_sync(
    spark: SparkSession, source: Source, partitions: DataFrame, path: str, updated_after: dt.datetime | None = None, write: dict[str, Any] | None = None,
    **conditions: Any,
) -> list[str]:
    """Writes the partitions that changed since ``updated_after`` from the catalog to files; returns their paths.

    ``partitions``: see ``with_partition_files``. Conditions, base items and ``change`` as for ``catalog_item_texts``.
    """
    changed = with_partition_files(partitions, updated_after)
    if changed.isEmpty():
        return []
    return sync_partitions(catalog_to_table(spark, source, **conditions), changed, path, **(write or {}))


def items_to_parquet(spark: SparkSession, source: Any, path: str, write: dict[str, Any] | None = None, strict: bool = True, drop_invalid: bool = True, **read: Any) -> str:
    """JSON items of files (a path or several), or dicts in a list, written as item Parquet in one call.

    ``read``: options of ``read_items``; ``write``: options of ``write_item_parquet``. Returns the path.
    """
    if isinstance(source, (list, tuple)) and source and isinstance(source[0], dict):
        items = from_items(spark, list(source))
    else:
        items = read_items(spark, source, strict=strict, **read)
    return write_item_parquet(to_table_layout(items, drop_invalid), path, **(write or {}))


def parquet_to_lines(spark: SparkSession, path: str, target: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Item Parquet written as newline-delimited JSON in one call."""
    write_item_lines(read_item_parquet(spark, path), target, mode, single_file)


def row_to_item(spark: SparkSession, row: Row, schema: T.StructType) -> dict:
    """The item of one row of a table in the table layout or an item frame."""
    table = spark.createDataFrame([row], schema)
    return json.loads(to_item_texts(table.drop("self_link"), inject_type=False).first()["item"])
