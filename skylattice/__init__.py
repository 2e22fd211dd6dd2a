"""A Spark-native engine for spatiotemporal catalog items."""

from skylattice.operators.export import catalog_item_texts, catalog_sync, catalog_to_parquet, catalog_to_table, items_to_parquet, map_items, parquet_to_lines, row_to_item
from skylattice.operators.layout import to_item_collection, to_item_frame, to_item_texts, to_items, to_json_layout, to_table_layout
from skylattice.operators.search import bbox_intersects, clustered, from_cql2, search
from skylattice.session import session_defaults
from skylattice.sources.items import from_items, from_table, item_texts, read_items
from skylattice.sources.schema import InferredSchema, infer
from skylattice.sources.sinks import read_item_parquet, sync_partitions, write_delta, write_item_lines, write_item_parquet

__version__ = "0.1.0"

__all__ = [
    "InferredSchema", "bbox_intersects", "catalog_item_texts", "catalog_sync", "catalog_to_parquet", "catalog_to_table", "clustered", "from_cql2", "from_items", "from_table", "infer", "item_texts", "map_items", "read_item_parquet", "read_items",
    "items_to_parquet", "parquet_to_lines", "row_to_item",
    "search", "session_defaults", "sync_partitions", "to_item_collection", "to_item_frame", "to_item_texts", "to_items", "to_json_layout", "to_table_layout",
    "write_delta", "write_item_lines", "write_item_parquet",
]
