"""Writing item tables: Parquet with complete footers, newline-delimited JSON, Delta.

Spark's own Parquet writer can't set footer keys, so item Parquet is a Python data source whose tasks write with Arrow.
A task writes into a staging folder below the target; the commit on the driver moves the files of the tasks that
succeeded, so a task that is run again leaves nothing behind.
"""

from __future__ import annotations

import json
import os
import uuid
import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from skylattice.functions.columns import col
from skylattice.functions.crs import WGS84
from skylattice.operators.layout import GEOMETRY_TAG, to_item_texts

#: Versions of the Parquet metadata.
VERSIONS = ("1.0.0", "1.1.0")
DEFAULT_VERSION = "1.1.0"
ITEM_METADATA_VERSION = "1.0.0"
#: The footer key of the item metadata; readers that expect another name get it by this parameter.
ITEM_KEY = "item-metadata"
#: Rows of a row group.
ROW_GROUP_ROWS = 65_536


def footer_metadata(
    names: list[str], schema_version: str = DEFAULT_VERSION, collections: Mapping[str, Any] | None = None,
    collection: Mapping[str, Any] | None = None, item_key: str = ITEM_KEY,
) -> dict[bytes, bytes]:
    """Footer keys of a file with these columns: ``geo``, and the item metadata.

    ``collections``: collection documents by id. ``collection``, a single document, is deprecated.
    """
    if schema_version not in VERSIONS:
        raise ValueError(f"schema_version must be one of {VERSIONS}")
    geometry: dict[str, Any] = {"encoding": "WKB", "geometry_types": [], "crs": WGS84, "edges": "planar"}
    if schema_version >= "1.1.0":
        geometry["covering"] = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    geo: dict[str, Any] = {"version": schema_version, "columns": {"geometry": geometry}, "primary_column": "geometry"}
    if "proj:geometry" in names:
        geo["columns"]["proj:geometry"] = {"encoding": "WKB", "geometry_types": [], "crs": None}  # null: unknown
    item: dict[str, Any] = {"version": ITEM_METADATA_VERSION}
    if collection is not None:
        warnings.warn("'collection' is deprecated, use 'collections'", FutureWarning, stacklevel=2)
    if collection:
        item["collection"] = collection
    if collections:
        item["collections"] = collections
    return {b"geo": json.dumps(geo).encode(), item_key.encode(): json.dumps(item).encode()}


def resolve_path(path: str | os.PathLike, filesystem: pafs.FileSystem | None = None) -> tuple[pafs.FileSystem, str]:
    """The filesystem and the path in it. A given filesystem gets URLs without their scheme."""
    text = str(path)
    if filesystem is not None:
        return filesystem, text.split("://", 1)[1] if "://" in text else text
    if text.startswith("file:/"):
        text = "/" + text.removeprefix("file:").lstrip("/")
    if "://" not in text:
        return pafs.LocalFileSystem(), os.path.abspath(text)
    return pafs.FileSystem.from_uri(text)


def _truth(text: str) -> bool:
    return text.lower() == "true"


def _tagged(schema: pa.Schema, metadata: dict[bytes, bytes]) -> pa.Schema:
    fields = [f.with_metadata(GEOMETRY_TAG) if f.name == "geometry" else f for f in schema]
    return pa.schema(fields, metadata=metadata)


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task: name in the staging folder, and path below the target."""

    files: list[tuple[str, str]]


class _Groups:
    """Gathers Arrow batches to row groups of about ``rows`` rows."""

    def __init__(self, writer: pq.ParquetWriter, schema: pa.Schema, rows: int):
        self.writer, self.schema, self.rows, self.held, self.n = writer, schema, rows, [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(pa.RecordBatch.from_arrays(batch.columns, schema=self.schema))
        self.n += batch.num_rows
        if self.n >= self.rows:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held, self.schema), row_group_size=max(self.rows, self.n))
        self.held, self.n = [], 0

    def close(self) -> None:
        self.flush()
        self.writer.close()


class ItemParquetWriter(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        known = lambda k, d=None: next((v for o, v in options.items() if o.lower() == k.lower()), d)
        self.path, self.overwrite = known("path"), overwrite
        if not self.path:
            raise ValueError("item Parquet needs a path")
        loaded = lambda k: json.loads(known(k)) if known(k) else None
        self.metadata = footer_metadata(
            schema.names, known("schema_version", DEFAULT_VERSION), loaded("collections"), loaded("collection"), known("item_key", ITEM_KEY)
        )
        self.path_column = known("path_column")
        self.group_rows = int(known("row_group_rows", ROW_GROUP_ROWS))
        self.writer_options = {"compression": known("compression", "zstd")}
        for option, kind in (("compression_level", int), ("data_page_size", int), ("write_statistics", _truth), ("use_dictionary", _truth)):
            if known(option) is not None:
                self.writer_options[option] = kind(known(option))
        self.schema = to_arrow_schema(schema)
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _where(self) -> tuple[pafs.FileSystem, str]:
        return resolve_path(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = self._where()
        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        files: list[tuple[str, str]] = []
        writer, current = None, None
        try:
            for batch in iterator:
                for target, part in self._parts(batch):
                    if writer is None or target != current:
                        if writer is not None:
                            writer.close()
                        name, current = f"part-{uuid.uuid4().hex}.parquet", target
                        files.append((name, target or name))
                        schema = _tagged(part.schema, self.metadata)
                        writer = _Groups(pq.ParquetWriter(f"{root}/{self.staging}/{name}", schema, filesystem=fs, **self.writer_options), schema, self.group_rows)
                    writer.add(part)
        finally:
            if writer is not None:
                writer.close()
        return _Written(files)

    def _parts(self, batch: pa.RecordBatch) -> Iterator[tuple[str | None, pa.RecordBatch]]:
        """The batch, or its runs of equal paths (``path_column``) without that column."""
        if not self.path_column:
            yield None, batch
            return
        at = batch.schema.get_field_index(self.path_column)
        paths = batch.column(at).to_pylist()
        rest = batch.remove_column(at)
        start = 0
        for i in range(1, len(paths) + 1):
            if i == len(paths) or paths[i] != paths[start]:
                yield paths[start], rest.slice(start, i - start)
                start = i

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = self._where()
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(root)):
                if old.base_name.endswith(".parquet") and old.is_file:
                    fs.delete_file(old.path)
        files = [f for m in messages if m for f in m.files]
        for name, target in files:
            if "/" in target:
                fs.create_dir(os.path.dirname(f"{root}/{target}"), recursive=True)
            fs.move(f"{root}/{self.staging}/{name}", f"{root}/{target}")
        if not files and not self.path_column and not any(f.base_name.endswith(".parquet") for f in fs.get_file_info(pafs.FileSelector(root))):
            with pq.ParquetWriter(f"{root}/part-empty.parquet", _tagged(self.schema, self.metadata), filesystem=fs):
                pass
        self._clean(fs, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(*self._where())

    def _clean(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class ItemParquetSource(DataSource):
    """``df.write.format("itemparquet").save(path)``.

    Options: schema_version, collections, collection, item_key; compression, compression_level, data_page_size,
    row_group_rows, write_statistics, use_dictionary; path_column, a column with the path of each row's file below the
    target, for rows that are sorted by it and lie in one task for each path.
    """

    @classmethod
    def name(cls) -> str:
        return "itemparquet"

    def schema(self) -> str:
        raise NotImplementedError("read item Parquet with spark.read.parquet")

    def writer(self, schema: T.StructType, overwrite: bool) -> ItemParquetWriter:
        return ItemParquetWriter(schema, dict(self.options), overwrite)


def write_item_parquet(
    table: DataFrame, path: str, mode: str = "overwrite", schema_version: str = DEFAULT_VERSION, collections: Mapping[str, Any] | None = None,
    collection: Mapping[str, Any] | None = None, item_key: str = ITEM_KEY, single_file: bool = False, compression: str = "zstd", **more: Any,
) -> str:
    """Writes a table in the table layout; returns the path. ``single_file``: the path is one file, written by one task.

    ``more``: other options of ``ItemParquetSource``.
    """
    spark = table.sparkSession
    spark.dataSource.register(ItemParquetSource)
    footer_metadata(table.columns, schema_version, collections, collection, item_key)  # wrong options raise here
    options = {"schema_version": schema_version, "item_key": item_key, "compression": compression}
    options |= {k: str(v) for k, v in more.items()}
    options |= {k: json.dumps(v) for k, v in (("collections", collections), ("collection", collection)) if v}
    target = f"{path}.{uuid.uuid4().hex}" if single_file else str(path)
    rows = table.coalesce(1) if single_file else table
    rows.write.format("itemparquet").options(**options).mode(mode if not single_file else "overwrite").save(target)
    if single_file:
        fs, root = resolve_path(target)
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.endswith(".parquet")]
        _, to = resolve_path(path)
        fs.create_dir(os.path.dirname(to), recursive=True)
        fs.move(found[0], to)
        fs.delete_dir(root)
    return str(path)


def write_item_lines(table: DataFrame, path: str, mode: str = "append", single_file: bool = False) -> None:
    """Newline-delimited JSON. A folder of files, or one file, to which ``append`` adds."""
    texts = to_item_texts(table).select(F.col("item").alias("value"))
    if not single_file:
        texts.write.mode(mode).text(str(path))
        return
    with open(path, "ab" if mode == "append" else "wb") as f:
        for row in texts.toLocalIterator():
            f.write(row["value"].encode() + b"\n")


def write_delta(table: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """A Delta table. Without Delta's jar and package: ``ImportError``. Void columns, which Delta refuses, become strings."""
    try:
        import delta  # noqa: F401
    except ImportError as e:
        raise ImportError("writing Delta tables needs the delta-spark package and its jar") from e
    void = {f.name: F.lit(None).cast("string") for f in table.schema.fields if isinstance(f.dataType, T.NullType)}
    out = table.withColumns(void) if void else table
    out.write.format("delta").options(**options).mode(mode).save(path)


def read_item_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_footers(path: str, item_key: str = ITEM_KEY) -> Iterator[tuple[bytes | None, bytes | None]]:
    """The ``geo`` and item metadata of each Parquet file below a folder."""
    fs, root = resolve_path(path)
    for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
        if f.is_file and f.base_name.endswith(".parquet"):
            found = pq.read_metadata(f.path, filesystem=fs).metadata or {}
            yield found.get(b"geo"), found.get(item_key.encode())


def sync_partitions(items: DataFrame, partitions: DataFrame, path: str, **write: Any) -> list[str]:
    """Writes the items of changed partitions, one item Parquet file each: ``<collection>/<file>``; other files stay.

    ``partitions``: those to write, from ``with_partition_files``. ``write``: options of ``write_item_parquet``. Returns
    the paths of the files written; none if nothing has changed. A partition without items any more loses its file.
    The items are read once; those of a partition are written by one task, in their file's order of time, without
    being held in memory.
    """
    from skylattice.operators.catalog import assign_partitions

    where = F.concat(F.regexp_replace("collection", "[^A-Za-z0-9._-]", "_"), F.lit("/"), "file")
    changed = [r[0] for r in partitions.select(where).distinct().collect()]
    if not changed:
        return []
    placed = assign_partitions(items, partitions).withColumn("__path", where).drop("file")
    order = ["__path", *(["datetime"] if "datetime" in items.columns else [])]
    began = uuid.uuid4().hex
    write_item_parquet(placed.repartition("__path").sortWithinPartitions(*order), f"{path}/_sync-{began}", path_column="__path", **write)
    fs, root = resolve_path(path)
    staged, out = f"{root}/_sync-{began}", []
    for target in sorted(changed):
        if fs.get_file_info(f"{staged}/{target}").type == pafs.FileType.File:
            fs.create_dir(os.path.dirname(f"{root}/{target}"), recursive=True)
            fs.move(f"{staged}/{target}", f"{root}/{target}")
            out.append(f"{path}/{target}")
        elif fs.get_file_info(f"{root}/{target}").type == pafs.FileType.File:
            fs.delete_file(f"{root}/{target}")
    if fs.get_file_info(staged).type == pafs.FileType.Directory:
        fs.delete_dir(staged)
    return out
