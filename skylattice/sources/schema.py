"""One schema for items that differ: inference over variants, repair, strictness."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {
    "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(),
    "VOID": T.NullType(), "VARIANT": T.VariantType(), "BINARY": T.BinaryType(),
}


def parse_type(text: str) -> T.DataType:
    """The type that a text of ``schema_of_variant_agg`` names."""
    kind, rest = _type(text.strip())
    if rest.strip():
        raise ValueError(f"not a type: {text!r}")
    return kind


def _type(s: str) -> tuple[T.DataType, str]:
    if s.startswith("OBJECT<"):
        return _object(s[7:])
    if s.startswith("ARRAY<"):
        inner, rest = _type(s[6:])
        return T.ArrayType(inner), rest[1:]
    if s.startswith("DECIMAL("):
        return T.DoubleType(), s[s.index(")") + 1 :]
    for name, kind in _SIMPLE.items():
        if s.startswith(name):
            return kind, s[len(name) :]
    raise ValueError(f"not a type: {s[:40]!r}")


def _object(s: str) -> tuple[T.DataType, str]:
    fields = []
    while not s.startswith(">"):
        s = s.lstrip(", ")
        if s.startswith("`"):
            end = 1
            while s[end] != "`" or s[end : end + 2] == "``":
                end += 2 if s[end] == "`" else 1
            name, s = s[1:end].replace("``", "`"), s[end + 1 :]
        else:
            end = s.index(":")
            name, s = s[:end], s[end:]
        kind, s = _type(s[1:].lstrip())
        fields.append(T.StructField(name, kind))
    return T.StructType(fields), s[1:]


@dataclass
class InferredSchema:
    """Schema in the JSON layout (geometries as GeoJSON text), number of items, and what was repaired."""

    schema: T.StructType
    count: int
    only_null: list[str] = field(default_factory=list)
    conflicts: list[str] = field(default_factory=list)


#: Types of properties that are null in all items.
NULL_TYPES = {"datetime": T.StringType(), "proj:epsg": T.LongType(), "proj:wkt2": T.StringType()}
GEOMETRIES = ("geometry", "proj:geometry")


def infer(items: DataFrame, strict: bool = True, limit: int | None = None) -> InferredSchema:
    """Infers the schema of JSON texts in the column ``item`` with one aggregation over all rows (or ``limit`` of them).

    Numbers widen to doubles, objects and lists unite. Geometries stay GeoJSON texts and the top ``bbox`` is a list of
    doubles. Fields that are null in all items get the type they need (``NULL_TYPES``) or string; objects without a
    field become maps. A field of types that don't unite raises if ``strict``, else it becomes a string.
    """
    rows = items if limit is None else items.limit(limit)
    variant = F.parse_json("item")
    got = rows.select(variant.alias("v")).agg(F.schema_of_variant_agg("v").alias("s"), F.count("*").alias("n")).first()
    if not got["n"]:
        raise ValueError("no items")
    found = parse_type(got["s"])
    if not isinstance(found, T.StructType):
        raise ValueError("items must be objects")
    out = InferredSchema(found, got["n"])
    out.schema = _repair(found, "", out)
    if strict and out.conflicts:
        raise ValueError(f"fields of different types: {', '.join(out.conflicts)}")
    return out


def _repair(kind: T.DataType, path: str, notes: InferredSchema) -> T.DataType:
    name = path.rpartition(".")[2]
    if path == "geometry" or name == "proj:geometry":
        return T.StringType()
    if path == "bbox":
        return T.ArrayType(T.DoubleType())
    if isinstance(kind, T.StructType):
        if not kind.fields:
            return T.MapType(T.StringType(), T.StringType())
        return T.StructType([T.StructField(f.name, _repair(f.dataType, f"{path}.{f.name}".lstrip("."), notes)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_repair(kind.elementType, f"{path}[]", notes))
    if isinstance(kind, T.NullType):
        notes.only_null.append(path)
        return NULL_TYPES.get(name, T.StringType())
    if isinstance(kind, T.VariantType):
        notes.conflicts.append(path)
        return T.StringType()
    return kind


def same_schema(a: T.StructType, b: T.StructType) -> bool:
    """Whether two schemas have the same fields and types, in whatever order."""
    canon = lambda k: (
        {f.name: canon(f.dataType) for f in k.fields} if isinstance(k, T.StructType)
        else [canon(k.elementType)] if isinstance(k, T.ArrayType) else k.simpleString()
    )
    return canon(a) == canon(b)
