"""Inputs that several plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talesieve.sources.tables import table


def _latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest scrape of each chapter."""
    return _latest(table(spark, sf_dir, "chapters"), ["novel", "chapter_num"], ["scraped_at", "chapter_id"])


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest delivery of each segment.

    Partitioned by chapter first: that serves the choice of the latest as well as every window and fold over a chapter
    behind it, so that the texts are shuffled once.
    """
    rows = table(spark, sf_dir, "segments").repartition("novel", "chapter_num")
    return _latest(rows, ["novel", "chapter_num", "index"], ["parsed_at", "seg_id"])


def registry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "speakers").withColumn("novel", F.regexp_extract("novel_dir", "([^/]*)$", 1))
