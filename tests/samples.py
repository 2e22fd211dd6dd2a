"""Items that differ in what matters."""

import copy

SCENE = {
    "type": "Feature", "stac_version": "1.0.0", "stac_extensions": ["https://example.com/eo.json"], "id": "scene-1", "collection": "scenes",
    "bbox": [10.5, 45.25, 11.5, 46.0],
    "geometry": {"type": "Polygon", "coordinates": [[[10.5, 45.25], [11.5, 45.25], [11.5, 46.0], [10.5, 46.0], [10.5, 45.25]]]},
    "links": [
        {"rel": "collection", "type": "application/json", "href": "https://example.com/scenes"},
        {"rel": "self", "type": "application/geo+json", "href": "https://example.com/scenes/scene-1"},
    ],
    "assets": {"image": {"href": "https://example.com/1.tif", "roles": ["data"], "gsd": 0.5, "title": None}, "thumbnail": {"href": "https://example.com/1.png"}},
    "properties": {"datetime": "2024-06-01T10:20:30.123456Z", "eo:cloud_cover": 12.5, "proj:epsg": 32632, "gsd": 1, "proj:shape": [100, 200], "platform": "a"},
}


def scene(number: int, **properties) -> dict:
    item = copy.deepcopy(SCENE)
    item["id"] = f"scene-{number}"
    item["properties"] |= properties
    return item


def point(number: int, **top) -> dict:
    item = {
        "type": "Feature", "id": f"point-{number}", "collection": "points", "bbox": [number, number, number, number],
        "geometry": {"type": "Point", "coordinates": [float(number), float(number)]}, "links": [], "assets": {"a": {"href": "x"}},
        "properties": {"datetime": "2024-01-01T00:00:00Z"},
    }
    return item | top
