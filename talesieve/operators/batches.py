"""Batches with a checkpoint, and the ladder of fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talesieve.operators import chunking


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work whose key isn't among the done ones."""
    return work.join(done.select(*key).distinct(), key, "left_anti")


def checkpoint_after(done: DataFrame, finished: DataFrame, key: list[str]) -> DataFrame:
    return done.select(*key).unionByName(finished.select(*key)).distinct()


def next_number(chapters: DataFrame, by: list[str], number: str = "chapter_num") -> DataFrame:
    return chapters.groupBy(*by).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def ladder(text: Column, cleaned: Column, limit: int, hard_limit: int, parts: Column) -> Column:
    """The strategy that a segment is rendered by: as it is, cleaned, in parts, or a placeholder."""
    longest = F.coalesce(F.array_max(F.transform(parts, lambda p: F.length(p))), F.lit(0))
    return F.when(F.length(text) <= limit, "normal").when(F.length(cleaned) <= limit, "cleaned").when(longest <= hard_limit, "split").otherwise("placeholder_inserted")


def with_ladder(segments: DataFrame, cleaned: Column, limit: int = 200, part_limit: int = 150, hard_limit: int = 250) -> DataFrame:
    """Adds ``strategy`` and ``n_parts``."""
    parts = chunking.sentence_chunks(cleaned, part_limit)
    s = ladder(F.col("text"), cleaned, limit, hard_limit, parts)
    return segments.withColumn("strategy", s).withColumn("n_parts", F.when(F.col("strategy") == "split", F.size(parts)).otherwise(1))
