"""Synchronisation by Structured Streaming: each run takes the files that came since the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sync_available(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType, partition_by: str = "collection", key: str = "id"
) -> int:
    """Takes all new Parquet files of ``source`` and writes them to ``target``, partitioned; returns the rows written.

    Of a micro-batch only partitions that it touches are written anew, with their old rows: rows with an id that is
    known are replaced by those that came, of several the one with the latest ``updated`` if there is such a column. A
    run with nothing new writes nothing.
    """
    written = [0]

    def upsert(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        fs = spark._jvm.org.apache.hadoop.fs.Path(target)
        exists = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
        new = batch.withColumn("__new", F.lit(1))
        if exists:
            touched = batch.select(partition_by).distinct()
            old = spark.read.schema(batch.schema).parquet(target).join(F.broadcast(touched) if touched.count() <= 10_000 else touched, partition_by, "left_semi")
            new = new.unionByName(old.withColumn("__new", F.lit(0)))
        order = F.struct("__new", *(["updated"] if "updated" in batch.columns else []), F.xxhash64(*[F.col(f"`{c}`") for c in batch.columns]))
        best = new.groupBy(partition_by, key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in batch.columns]), order).alias("row")).select("row.*")
        # The partitions are read and then overwritten, so the new content is in files of its own before.
        staged = f"{checkpoint}/staged-{number}"
        best.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(best.schema).parquet(staged)
        written[0] += rows.count()
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(target)
        done = spark._jvm.org.apache.hadoop.fs.Path(staged)
        done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return written[0]
