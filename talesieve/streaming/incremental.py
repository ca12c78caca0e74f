"""New files only: a streaming query that ends when all there is has been read, and goes on from its checkpoint next time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_new_files(spark: SparkSession, source: str, like: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], glob: str | None = None) -> DataFrame:
    """Reads parquet files of ``source`` not seen before, transforms and appends them to ``target``; the whole target.

    A batch is written under its number, so that one repeated after a failure replaces itself.
    """
    reader = spark.readStream.schema(like.schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", target).parquet(target).drop("batch")
