"""Operators over ordered labelled segments.

A sequence is identified by ``key`` columns and ordered by ``order`` (ties by ``tie``). Folds, whose step depends on what was
kept so far, run as higher-order aggregates over one sequence's array; its size is that of one chapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talesieve import schema
from talesieve.functions import text as X

MERGE_INCOMING, MERGE_CAP, SAME_LINE = 120, 400, 0.95


def reindexed(df: DataFrame, key: list[str], order: list[str], to: str = "index", offset: int = 0) -> DataFrame:
    """Dense numbering from ``offset`` within each sequence."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1 + offset)


def validated(df: DataFrame, key: list[str], order: list[str], offset: int = 0) -> DataFrame:
    """Defaults for missing and unknown types and tones, blank texts dropped, numbered anew."""
    known = lambda c, domain, default: F.when(F.col(c).isin(domain), F.col(c)).otherwise(default)
    kept = df.where(F.coalesce(X.strip(F.col("text")), F.lit("")) != "")
    return reindexed(kept.withColumns({"type": known("type", schema.TYPES, "narration"), "tone": known("tone", schema.TONES, "neutral")}), key, order, offset=offset)


def as_array(df: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row per sequence with its segments in order."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, *[F.col(f).alias(f"f_{f}") for f in fields])))
    return df.groupBy(*key).agg(F.transform(ordered, lambda s: F.struct(*[s[f"f_{f}"].alias(f) for f in fields])).alias("segments"))


def without_repeated_dialogue(df: DataFrame, key: list[str], order: list[str], id_col: str, threshold: float = SAME_LINE, carried: tuple[str, ...] = ()) -> DataFrame:
    """Rows that stay when a dialogue is dropped whose words are (nearly) those of the last kept row, itself a dialogue.

    Result: ``key, id_col, index`` and the columns ``carried`` along. Word sets are made once per row; the fold compares with the last kept row only.
    """
    prepared = df.withColumn("ws", X.word_set(F.coalesce("text", F.lit(""))))
    fields = list(dict.fromkeys([id_col, "type", "ws", *carried]))
    arrays = as_array(prepared, key, order, fields)
    empty = F.array().cast("array<struct<" + ",".join(f"{f}:{prepared.schema[f].dataType.simpleString()}" for f in fields) + ">>")

    def step(kept: Column, s: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        same = (s["type"] == "dialogue") & (last["type"] == "dialogue") & (X.overlap(last["ws"], s["ws"]) >= threshold)
        return F.when(F.coalesce(same, F.lit(False)), kept).otherwise(F.array_append(kept, s))

    kept = arrays.select(*key, F.posexplode(F.aggregate("segments", empty, step)).alias("index", "s"))
    return kept.select(*key, F.col(f"s.{id_col}").alias(id_col), "index", *[F.col(f"s.{c}").alias(c) for c in carried])


def merged(df: DataFrame, key: list[str], order: list[str], starts: DataFrame | None = None, incoming: int = MERGE_INCOMING, cap: int = MERGE_CAP, by: tuple[str, ...] = ("tone", "type")) -> DataFrame:
    """Short segments joined to the one before: ``key, index, type, tone, text, n_merged``.

    The first two rows stand alone as they come. A row joins the last one if it is shorter than ``incoming`` and agrees
    in ``by``; once the last one has ``cap`` characters, only if it begins no paragraph. ``starts`` gives per key the array
    ``starts`` of paragraph fingerprints.
    """
    arrays = as_array(df.withColumn("text", F.coalesce("text", F.lit(""))), key, order, ["type", "tone", "text"])
    if starts is not None:
        arrays = arrays.join(starts.select(*key, "starts"), key, "left")
    else:
        arrays = arrays.withColumn("starts", F.lit(None).cast("array<string>"))
    arrays = arrays.withColumn("starts", F.coalesce("starts", F.array().cast("array<string>")))
    empty = F.array().cast("array<struct<type:string,tone:string,text:string,n:int>>")
    one = lambda s: F.struct(s["type"].alias("type"), s["tone"].alias("tone"), s["text"].alias("text"), F.lit(1).alias("n"))

    def step(done: Column, s: Column) -> Column:
        n = F.size(done)
        last = F.get(done, n - 1)
        agrees = F.lit(True)
        for field in by:
            agrees = agrees & last[field].eqNullSafe(s[field])
        room = (F.length(last["text"]) < cap) | ~F.array_contains(F.col("starts"), X.fingerprint(s["text"]))
        joins = (n > 1) & (F.length(s["text"]) < incoming) & agrees & room
        longer = F.struct(last["type"].alias("type"), last["tone"].alias("tone"), F.concat(last["text"], F.lit(" "), X.strip(s["text"])).alias("text"), (last["n"] + 1).alias("n"))
        return F.when(F.coalesce(joins, F.lit(False)), F.array_append(F.slice(done, 1, F.greatest(n - 1, F.lit(0))), longer)).otherwise(F.array_append(done, one(s)))

    done = arrays.select(*key, F.posexplode(F.aggregate("segments", empty, step)).alias("index", "s"))
    return done.select(*key, "index", "s.type", "s.tone", "s.text", F.col("s.n").alias("n_merged"))


def paragraph_starts(chapters: DataFrame, key: list[str]) -> DataFrame:
    """Fingerprints of all paragraphs of a key's texts."""
    return chapters.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list(F.transform(X.paragraphs(F.col("text")), lambda p: X.fingerprint(p))))).alias("starts"))


def source_position(segment: Column, source: Column) -> Column:
    """Where a segment's first characters stand in the source: the first of 40, 30, 20 and 10 that do; else its length."""
    low, probe = F.lower(source), X.strip(X.no_punctuation(F.lower(F.substring(segment, 1, 40))))
    found = [F.nullif(F.when(probe != "", F.position(F.substring(probe, 1, n), low)).otherwise(0), F.lit(0)) for n in (40, 30, 20, 10)]
    return F.coalesce(*[f - 1 for f in found], F.length(source))


def in_source_order(segments: DataFrame, sources: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All segments of a key numbered by their place in the key's source text; ties keep ``order``."""
    placed = segments.join(sources.select(*key, F.col("text").alias("source_text")), key).withColumn("position", source_position(F.col("text"), F.col("source_text"))).drop("source_text")
    return placed.withColumn("new_index", F.row_number().over(Window.partitionBy(*key).orderBy("position", *order)) - 1)


def statistics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows and words by speaker, by type and by tone in one pass: ``dimension, value, n_segments, n_words``."""
    dims = ["speaker", "type", "tone"]
    sized = df.select(*(by or []), *dims, F.size(X.tokens(F.coalesce("text", F.lit("")))).alias("n_words"))
    view = sized.groupingSets([[*(by or []), d] for d in dims], *(by or []), *dims).agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n_words").alias("n_words"), F.grouping_id().alias("g"))
    bit = F.col("g").bitwiseAND(7)
    dimension = F.when(bit == 3, "speaker").when(bit == 5, "type").otherwise("tone")
    value = F.when(bit == 3, F.col("speaker")).when(bit == 5, F.col("type")).otherwise(F.col("tone"))
    return view.select(*(by or []), dimension.alias("dimension"), value.alias("value"), "n_segments", "n_words")
