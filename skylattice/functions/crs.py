"""The reference system of item geometries."""

#: Fixed value: EPSG:4326 as PROJJSON.
WGS84 = {
    "$schema": "https://proj.org/schemas/v0.7/projjson.schema.json",
    "type": "GeographicCRS",
    "name": "WGS 84",
    "datum_ensemble": {
        "name": "World Geodetic System 1984 ensemble",
        "members": [
            {"name": f"World Geodetic System 1984 ({name})", "id": {"authority": "EPSG", "code": code}}
            for name, code in (
                ("Transit", 1166), ("G730", 1152), ("G873", 1153), ("G1150", 1154), ("G1674", 1155), ("G1762", 1156), ("G2139", 1309),
            )
        ],
        "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563},
        "accuracy": "2.0",
        "id": {"authority": "EPSG", "code": 6326},
    },
    "coordinate_system": {
        "subtype": "ellipsoidal",
        "axis": [
            {"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"},
            {"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"},
        ],
    },
    "scope": "Horizontal component of 3D system.",
    "area": "World.",
    "bbox": {"south_latitude": -90, "west_longitude": -180, "north_latitude": 90, "east_longitude": 180},
    "id": {"authority": "EPSG", "code": 4326},
}
