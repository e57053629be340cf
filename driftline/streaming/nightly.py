"""Nights as micro-batches of Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.operators.nightly import process_night
from driftline.runtime import table
from driftline.schema import LinkConfig
from driftline.sources.state import StateStore


def take_in(store: StateStore, cfg: LinkConfig) -> Callable[[DataFrame, int], None]:
    """The function for ``foreachBatch``: nights of a batch in order; those taken in before are left out, so a batch may come again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        state = store.load()
        nights = [r.nid for r in batch.where("nid is not null").select("nid").distinct().collect()]  # nights, not rows
        for night in sorted(nights):
            if state.last_nid is None or night > state.last_nid:
                state = process_night(state, batch.where(F.col("nid") == night), night, cfg)
                store.save(state)

    return run


def start_nightly(alerts: DataFrame, store: StateStore, cfg: LinkConfig, checkpoint: str) -> StreamingQuery:
    """Link a stream of alerts night by night until what is there has been taken in."""
    return alerts.writeStream.foreachBatch(take_in(store, cfg)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A stream over one table of a data folder, be it a folder of files or a single file."""
    like = table(spark, sf_dir, name, *columns)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(like.schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def arrivals(stream: DataFrame) -> DataFrame:
    """Deliveries per day of arrival, each delivery once, as running counts."""
    timed = stream.withColumn("received_at", F.col("received_at").cast("timestamp"))
    return timed.groupBy(F.window("received_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "n")


def closed_days(stream: DataFrame, late: str) -> DataFrame:
    """Distinct deliveries per day, given out once a day is closed; rows later than ``late`` behind the newest are left out."""
    timed = stream.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", late)
    once = timed.dropDuplicatesWithinWatermark(["delivery_id"])
    return once.groupBy(F.window("received_at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "n")


def run_complete(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream of running results over what is there; the result after its last batch."""
    spark = counts.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(path)
