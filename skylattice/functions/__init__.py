"""Functions on columns: geometry, reference system, times, boxes, assets."""

from skylattice.functions.columns import (
    TIME_KEYS,
    TOP_KEYS,
    asset_map,
    bbox_array,
    bbox_struct,
    format_time,
    parse_time,
    prune_null_assets,
    self_href,
)
from skylattice.functions.geo import bounds_of_wkb, geojson_from_wkb, wkb_from_geojson

__all__ = [
    "TIME_KEYS", "TOP_KEYS", "asset_map", "bbox_array", "bbox_struct", "bounds_of_wkb", "format_time", "geojson_from_wkb",
    "parse_time", "prune_null_assets", "self_href", "wkb_from_geojson",
]
