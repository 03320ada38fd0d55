"""Streaming upkeep: keyed upserts by micro-batch, and availability by event-time windows.

The table is dealt to buckets by key. A micro-batch merges and writes only the buckets that it has keys of, under its own number; then one
record file names them, which is what makes the batch count. A replayed batch starts from what was there before it and writes the same
again; readers take the latest recorded version of each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnfield.operators import merge


BUCKETS = 64
RECORD = "number long, bucket int"


def _recorded(spark: SparkSession, path: str, before: int | None) -> list[tuple[int, int]]:
    """Each bucket with its latest version: BUCKETS rows at most."""
    try:
        records = spark.read.schema(RECORD).option("recursiveFileLookup", "true").parquet(f"{path}/records")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    some = records if before is None else records.filter(F.col("number") < before)
    return sorted(map(tuple, some.groupBy("bucket").agg(F.max("number")).collect()))


def current(spark: SparkSession, path: str, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The table as it is, or as it was before a batch; all of it, or some buckets."""
    wanted = [f"{path}/data/number={n}/bucket={b}" for b, n in _recorded(spark, path, before) if buckets is None or b in buckets]
    return spark.read.parquet(*wanted) if wanted else None


def upserts(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column], once: bool = True) -> StreamingQuery:
    """Merges a stream of rows into the table at `path`; of a key's rows in one batch the last by `order` counts."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = merge.last_of(batch, keys, order)
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
        if not touched:
            return
        was = current(spark, path, number, touched)
        merged = last if was is None else merge.upsert(was, last, keys)
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/number={number}")
        spark.createDataFrame([(number, b) for b in touched], RECORD).coalesce(1).write.mode("overwrite").parquet(f"{path}/records/{number}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def nightly(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """site, night, open, events: counts of a stream of status events (site, ts, status) by site and day, with a watermark for late ones."""
    return (
        stream.withWatermark("ts", late).groupBy("site", F.window("ts", "1 day").alias("w"))
        .agg(F.count(F.when(F.col("status") == "available", 1)).alias("open"), F.count("*").alias("events"))
        .select("site", F.to_date("w.start").alias("night"), "open", "events")
    )
