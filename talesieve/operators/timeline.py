"""Segments on a time line, blocks of chapters, and run figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talesieve import schema


def with_pauses(segments: DataFrame, rules: DataFrame, key: list[str], order: list[str], default: int = schema.DEFAULT_PAUSE_MS) -> DataFrame:
    """Adds ``next_type`` and ``pause_ms``, the silence behind a segment; 0 behind the last."""
    w = Window.partitionBy(*key).orderBy(*order)
    ahead = segments.withColumn("next_type", F.lead("type").over(w)).withColumn("is_last", F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy(*key)))
    joined = ahead.join(rules, (F.col("type") == F.col("type_a")) & (F.col("next_type") == F.col("type_b")), "left")
    return joined.withColumn("pause_ms", F.when(F.col("is_last"), 0).otherwise(F.coalesce("pause_ms", F.lit(default)))).drop("type_a", "type_b", "is_last")


def with_offsets(segments: DataFrame, key: list[str], order: list[str], duration: str = "duration_ms", lead_in: int = schema.LEAD_IN_MS) -> DataFrame:
    """Adds ``start_ms``: the lead-in and all durations and pauses before."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start_ms", F.lit(lead_in) + F.coalesce(F.sum(F.col(duration) + F.col("pause_ms")).over(w), F.lit(0)))


def block_of(chapter: Column, size: int = 10) -> Column:
    return F.floor((chapter - 1) / size).cast("int")


def blocks(chapters: DataFrame, key: str, size: int = 10, gap_ms: int = 2000, existing: DataFrame | None = None) -> DataFrame:
    """Fixed blocks of chapters: ``key, block, file_name, members, n_members, duration_ms, status``.

    ``status``: skip for a full block whose file ``existing(key, block)`` exists, else build.
    """
    distinct = chapters.groupBy(key, "chapter_num").agg(F.max("duration_ms").alias("duration_ms"))
    b = distinct.withColumn("block", block_of(F.col("chapter_num"), size)).groupBy(key, "block").agg(F.array_join(F.sort_array(F.collect_list("chapter_num")), ",").alias("members"), F.count(F.lit(1)).cast("int").alias("n_members"), F.sum("duration_ms").alias("total"))
    b = b.join(existing.select(key, "block", F.lit(True).alias("exists")), [key, "block"], "left") if existing is not None else b.withColumn("exists", F.lit(None).cast("boolean"))
    first = F.col("block") * size + 1
    return b.select(key, "block", F.concat(F.lit("chapters_"), first, F.lit("_to_"), first + size - 1, F.lit(".mp3")).alias("file_name"), "members", "n_members", (F.col("total") + gap_ms * (F.col("n_members") - 1)).alias("duration_ms"), F.when(F.col("exists") & (F.col("n_members") == size), "skip").otherwise("build").alias("status"))


def throughput(runs: DataFrame, by: list[str]) -> DataFrame:
    """``runs(words, seconds)`` to words a minute and hours a chapter group needs."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("words").alias("words"), F.round(F.sum("words") * 60 / F.sum("seconds"), 2).alias("words_per_minute"), F.round(F.sum("seconds") / 3600, 4).alias("hours"))
