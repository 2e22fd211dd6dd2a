"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of these are words: everything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where that is unset."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'skylattice-shared')}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and goes on from those files, so that lost executors cost no earlier work."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join by shuffle, whatever its size: the driver builds no table of it, which would grow with the input."""
    return df.hint("merge")


#: Up to so many ids are broadcast: 8 bytes each, about 40 MB as a hash table.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``gone`` (one column); rows with a null id stay.

    The ids are written and counted first. Up to ``BROADCAST_IDS`` they go to the rows, so that no text is moved.
    """
    gone = cut(gone.toDF("__gone"))
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    else:
        gone = shuffled(gone)
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Labels every vertex of an undirected graph with one vertex of its component.

    ``edges``: columns ``u``, ``v`` (bigint). Returns ``vertex``, ``label``, one row per vertex that has an edge to
    another one. Loops, repeated edges and null ends are ignored; no edges give no rows.

    Each round maps every vertex to the neighbour (or itself) with the smallest hash, another hash each round, and
    goes on with the graph of the images. A constant share of the vertices goes in each round whatever the shape, so
    the rounds grow with the logarithm of the largest component. Nothing but a count reaches the driver: no join broadcasts.
    """
    ends = edges.where("u is not null and v is not null and u <> v")
    # Both directions of a row, not a union, for which Spark would work out the edges twice.
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    graph = cut(ends.select(F.explode(both).alias("end")).select("end.u", "end.v").distinct())
    maps: list[DataFrame] = []
    for round_no in range(max_rounds):
        if graph.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_no)), F.col(c).alias("vertex"))
        step = cut(
            graph.groupBy("u")
            .agg(F.min(rank("v")).alias("best"))
            .select("u", F.least(rank("u"), F.col("best"))["vertex"].alias("to"))
        )
        maps.append(step)
        left = step.select("u", F.col("to").alias("a"))
        right = step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        graph = cut(
            graph.join(shuffled(left), "u")
            .join(shuffled(right), "v")
            .where("a <> b")
            .select(F.col("a").alias("u"), F.col("b").alias("v"))
            .distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not maps:
        return graph.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
    labels = maps[-1]
    for step in reversed(maps[:-1]):
        later = labels.select(F.col("u").alias("to"), F.col("to").alias("last"))
        labels = step.join(shuffled(later), "to", "left").select("u", F.coalesce("last", "to").alias("to"))
    return labels.select(F.col("u").alias("vertex"), F.col("to").alias("label"))
