"""Writers. Whole results are replaced in a new folder, never edited in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talesieve.functions import text as X


def chapters(df: DataFrame, path: str) -> None:
    """Partitioned by chapter number, so that a range is read by its folders only."""
    df.write.mode("overwrite").partitionBy("chapter_num").parquet(path)


def versioned(df: DataFrame, root: str, version: str) -> str:
    """A table as a dated folder beside the earlier ones."""
    target = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return target


def markdown(df: DataFrame, path: str, md: str = "md") -> None:
    df.select(X.without_fences(F.col(md)).alias("value")).write.mode("overwrite").text(path)


def registry(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def without_keys(df: DataFrame, keys: list[str], column: str = "characters") -> DataFrame:
    """Entries of a map column removed by key, with the number removed."""
    kept = F.map_filter(column, lambda k, v: ~k.isin(keys))
    return df.withColumn("n_removed", F.size(column) - F.size(kept)).withColumn(column, kept)


def failures(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def dead_letters(df: DataFrame, path: str, reason: str) -> None:
    df.withColumn("reason", F.lit(reason)).write.mode("append").parquet(path)
