"""Exports as they arrive: each new file is parsed once, into tables that grow by batches, with exactly-once effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.sources import exports

#: Conversations of one batch and kind that their numbers leave room for.
ROOM = 1 << 40


def ingest(spark: SparkSession, folder: str, tables: str, checkpoint: str, run_ts: float = 0.0, available_now: bool = True) -> StreamingQuery:
    """Watch folder for export files and append their conversations and messages under `tables`.

    A batch writes to a folder of its own number, overwritten if the batch is run again, so a restart repeats nothing.
    conv_ord names a conversation in all batches: it runs by batch, kind of export, file and place in the file.
    """
    arriving = spark.readStream.schema("value string").option("wholetext", True).format("text").load(folder).selectExpr("_metadata.file_path AS path", "value AS raw")

    def take(batch: DataFrame, number: int) -> None:
        batch = exports.detect(batch)
        for k, kind in enumerate(exports.PARSERS):
            first = (number * len(exports.PARSERS) + k) * ROOM
            own = batch.filter(batch["export_type"] == kind).drop("export_type")
            conversations, messages, _ = exports.parse(own, kind, run_ts)
            for name, df in (("conversations", conversations), ("messages", messages)):
                df = df.withColumn("conv_ord", F.col("conv_ord") + F.lit(first).cast("long"))
                df.write.mode("overwrite").parquet(f"{tables}/{name}/batch={number}/kind={kind}")

    writer = arriving.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_table(spark: SparkSession, tables: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{tables}/{name}").parquet(f"{tables}/{name}/*/*")
