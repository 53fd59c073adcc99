"""An extension: the pending-keys query kept up to date as unit files arrive.

Units are read as a stream of Parquet files; each micro-batch is reduced to the keys that are neither kept nor in the dictionary and
appended to a table. A key that comes again is appended again with its batch, so a batch that is run twice after a failure changes
nothing that current_keys() shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliomill.operators.scans import kept

UNITS = "page long, text string"


def follow(spark: SparkSession, units: str, dictionary: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts the query: units is a folder of Parquet files (page, text), dictionary has key and value."""
    keys = dictionary.where("value IS NOT NULL").select(F.col("key").alias("text")).distinct()

    def add(batch: DataFrame, number: int) -> None:
        found = batch.where(~kept("text")).join(keys, "text", "left_anti").groupBy("text").agg(F.min("page").alias("first_page"), F.count(F.lit(1)).alias("n"))
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(UNITS).parquet(units).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_keys(spark: SparkSession, out: str) -> DataFrame:
    """text, first_page, n over all batches so far."""
    return spark.read.schema("text string, first_page long, n long, batch int").parquet(out).groupBy("text").agg(F.min("first_page").alias("first_page"), F.sum("n").alias("n"))
