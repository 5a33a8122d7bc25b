"""Feeding a miner from a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.plans.miner import Miner


def stream(miner: Miner, folder: str, checkpoint: str, **trigger):
    """A query that feeds every new file of a folder, each batch once, also if a failure makes it come again."""
    spark = miner.spark
    lines = spark.readStream.text(folder).select(
        F.col("_metadata.file_path").alias("file"),
        F.unix_timestamp(F.col("_metadata.file_modification_time")).alias("mtime"),
        F.col("_metadata.file_block_start").alias("part"),
        "value",
    )

    def step(batch, number):
        miner.feed(lines=batch.withColumn("at", F.monotonically_increasing_id()), batch_of=(checkpoint, number))

    writer = lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
