"""The registry of speakers: lookups with fallback, assignment of voices, and reuse of voices."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talesieve import schema
from talesieve.functions import text as X


def newest(files: DataFrame, key: str, saved: str = "saved_at") -> DataFrame:
    """The last saved file of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(saved), F.desc(F.size("characters")), F.to_json("characters"))
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def oldest(files: DataFrame, key: str, saved: str = "saved_at") -> DataFrame:
    w = Window.partitionBy(key).orderBy(saved, F.size("characters"), F.to_json("characters"))
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def entries(files: DataFrame, key: str) -> DataFrame:
    """One row per registered character, with its place in the file."""
    return files.select(key, F.posexplode(F.map_entries("characters")).alias("pos", "e")).select(key, "pos", F.col("e.key").alias("name"), "e.value.*")


def dormant_entries(files: DataFrame, key: str) -> DataFrame:
    return files.where("dormant_voices is not null").select(key, F.posexplode(F.map_entries("dormant_voices")).alias("pos", "e")).select(key, "pos", F.col("e.key").alias("name"), "e.value.*")


def resolved_voices(segments: DataFrame, registry: DataFrame, key: str, speaker: str = "speaker") -> DataFrame:
    """Segments with ``voice`` and ``speed_variant``: the registry's; the default voice for narrator and system; else
    the key's voice for 'unknown', else the default."""
    who = F.coalesce(F.lower(X.strip(F.col(speaker))), F.lit("narrator"))
    # one row per name and key, whatever is registered twice
    known = registry.groupBy(key, F.lower("name").alias("who")).agg(F.max_by(F.struct(F.coalesce("xtts_speaker", F.lit(schema.DEFAULT_VOICE)).alias("voice"), F.coalesce("speed_variant", F.lit(1.0)).alias("speed")), "pos").alias("v"))
    unknown = known.where("who = 'unknown'").select(key, F.col("v.voice").alias("unknown_voice"))
    joined = segments.withColumn("who", who).join(known, [key, "who"], "left").join(unknown, key, "left")
    other = F.when(F.col("who").isin("narrator", "system"), schema.DEFAULT_VOICE).otherwise(F.coalesce("unknown_voice", F.lit(schema.DEFAULT_VOICE)))
    return joined.withColumn("voice", F.coalesce("v.voice", other)).withColumn("speed_variant", F.coalesce("v.speed", F.lit(1.0))).drop("v", "unknown_voice")


@F.pandas_udf(T.StringType())
def ascii_fold(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Decomposed, ASCII only, lower case, without white space at the ends."""
    for batch in names:
        yield batch.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower().strip())


def fuzzy_keys(asked: DataFrame, keys: DataFrame, name: str = "name") -> DataFrame:
    """Each asked name with ``found``: the key itself, else the key of the same folded form that was written last (``pos``, where there
    is one, else by name); and ``how``."""
    order = F.struct(*[F.col(c) for c in ("pos", name) if c in keys.columns])
    exact = keys.select(F.col(name).alias("exact")).distinct()
    folded = keys.withColumn("folded", ascii_fold(F.col(name))).groupBy("folded").agg(F.max_by(name, order).alias("by_fold"))
    out = asked.withColumn("folded", ascii_fold(F.col(name))).join(exact, F.col(name) == F.col("exact"), "left").join(folded, "folded", "left")
    return out.select(*asked.columns, F.coalesce("exact", "by_fold").alias("found"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_fold").isNotNull(), "folded").otherwise("missing").alias("how"))


def uncast(named: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Names that the registry of their key lacks."""
    return named.join(registry.select(key, "name"), [key, "name"], "left_anti")


def judged_assignments(asked: DataFrame, characters: DataFrame, voices: DataFrame, used: DataFrame, reserved: list[str], scope: str) -> DataFrame:
    """Each asked ``(scope, pos, name, voice)`` with ``verdict``: unknown_character, invalid_voice, reserved, taken or ok,
    and ``gender_warning``. Of several that ask for one voice within a scope, the first in order of ``pos`` has it."""
    c = characters.select(scope, "name", F.lower(F.coalesce("gender", F.lit("unknown"))).alias("gender"), F.lit(True).alias("is_character")).dropDuplicates([scope, "name"])
    v = voices.select(F.col("name").alias("voice"), F.lower("gender").alias("voice_gender"), F.lit(True).alias("is_voice"))
    u = used.select(scope, "voice", F.lit(True).alias("is_used")).distinct()
    rows = asked.join(c, [scope, "name"], "left").join(v, "voice", "left").join(u, [scope, "voice"], "left")
    refusal = F.when(F.col("is_character").isNull(), "unknown_character").when(F.col("is_voice").isNull(), "invalid_voice").when(F.col("voice").isin(reserved), "reserved").when(F.col("is_used"), "taken")
    rows = rows.withColumn("refusal", refusal)
    first = F.row_number().over(Window.partitionBy(scope, "voice", F.col("refusal").isNull()).orderBy("pos"))
    verdict = F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(first > 1, "taken").otherwise("ok")
    clash = (F.col("gender") != "unknown") & (F.col("gender") != F.col("voice_gender"))
    return rows.withColumn("verdict", verdict).select(scope, "pos", "name", "voice", "verdict", (F.coalesce(clash, F.lit(False)) & (verdict == "ok")).alias("gender_warning"))


def reused_voices(waiting: DataFrame, pool: DataFrame, scope: str, speeds: list[float] = schema.SPEED_OFFSETS) -> DataFrame:
    """Characters without a voice of their own given used ones at another speed: ``scope, pos, name, voice, speed_variant``.

    ``waiting(scope, pos, name, gender)``, ``pool(scope, pos, voice, gender, uses)``. In order of ``pos`` each takes the voice
    of fewest uses that isn't of another known gender, the first of equals; if there is none below the limit, any. Who finds
    none has null. A fold over the scope's characters; both arrays are those of one registry.
    """
    w = waiting.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct("pos", "name", F.coalesce("gender", F.lit("unknown")).alias("gender")))).alias("waiting"))
    v = pool.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct("pos", "voice", F.coalesce("gender", F.lit("unknown")).alias("gender"), F.col("uses").cast("int").alias("uses")))).alias("voices"))
    rows = w.join(v, scope, "left").withColumn("voices", F.coalesce("voices", F.expr("cast(array() as array<struct<pos:int,voice:string,gender:string,uses:int>>)")))
    start = F.struct(F.transform("voices", lambda x: x["uses"]).alias("uses"), F.expr("cast(array() as array<struct<pos:int,name:string,k:int,u:int>>)").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        slots = F.zip_with(F.sequence(F.lit(0), F.size("voices") - 1), F.col("voices"), lambda i, x: F.struct(F.get(acc["uses"], i).alias("u"), i.alias("k"), x["gender"].alias("g")))
        free = F.when(F.size("voices") > 0, F.filter(slots, lambda s: s["u"] < len(speeds))).otherwise(F.expr("cast(array() as array<struct<u:int,k:int,g:string>>)"))
        fitting = F.filter(free, lambda s: (c["gender"] == "unknown") | (s["g"] == "unknown") | (s["g"] == c["gender"]))
        best = F.array_min(F.when(F.size(fitting) > 0, fitting).otherwise(free))
        uses = F.when(best.isNull(), acc["uses"]).otherwise(F.transform(acc["uses"], lambda u, i: F.when(i == best["k"], u + 1).otherwise(u)))
        return F.struct(uses.alias("uses"), F.array_append(acc["out"], F.struct(c["pos"].cast("int").alias("pos"), c["name"].alias("name"), best["k"].alias("k"), best["u"].alias("u"))).alias("out"))

    done = rows.select(scope, "voices", F.explode(F.aggregate("waiting", start, step, lambda acc: acc["out"])).alias("x"))
    return done.select(scope, "x.pos", "x.name", F.get("voices", F.col("x.k"))["voice"].alias("voice"), F.get(F.array(*map(F.lit, speeds)), F.col("x.u")).alias("speed_variant"))


def snapshot_changes(old: DataFrame, new: DataFrame, key: list[str], fixed: list[str] = schema.FIXED_SPEAKERS) -> DataFrame:
    """``key, change`` between two snapshots with ``status``: dormant, reactivated, pruned, added, kept; one full outer join."""
    o = old.select(*key, F.col("status").alias("old_status"))
    n = new.select(*key, F.col("status").alias("new_status"))
    change = F.when(F.col("new_status").isNull(), "pruned").when(F.col("old_status").isNull(), F.when(F.col("new_status") == "dormant", "dormant").otherwise("added")).when((F.col("old_status") != "dormant") & (F.col("new_status") == "dormant"), "dormant").when((F.col("old_status") == "dormant") & (F.col("new_status") != "dormant"), "reactivated").otherwise("kept")
    return o.join(n, key, "full_outer").where(~F.col(key[-1]).isin(fixed)).select(*key, change.alias("change"))


def synchronised(old: DataFrame, new: DataFrame, voices: DataFrame, dormant: DataFrame, scope: str) -> DataFrame:
    """What a registry has to do after a change of snapshots: ``scope, name, action, voice``.

    free: a dormant character still holds a voice; restore: a reactivated one gets its saved voice back; needs_cast: that
    voice is in use, or none was saved; remove: a pruned one is registered. Of several that want one voice, the first name has it.
    """
    status = snapshot_changes(old, new, [scope, "name"])
    held = voices.select(scope, "name", F.col("xtts_speaker").alias("held")).dropDuplicates([scope, "name"])
    saved = dormant.select(scope, "name", F.col("xtts_speaker").alias("saved")).dropDuplicates([scope, "name"])
    gone = new.where("status = 'dormant'").select(scope, "name", F.lit(True).alias("is_dormant"))
    rows = status.join(held, [scope, "name"], "left").join(saved, [scope, "name"], "left").join(gone, [scope, "name"], "left")
    stays = rows.where("held is not null and change != 'pruned' and not coalesce(is_dormant, false)").select(scope, F.col("held").alias("saved"), F.lit(True).alias("in_use")).distinct()
    rows = rows.join(stays, [scope, "saved"], "left")
    first = F.row_number().over(Window.partitionBy(scope, "saved", "change").orderBy("name"))
    action = (
        F.when((F.col("change") == "pruned") & (F.col("held").isNotNull() | F.col("saved").isNotNull()), "remove")
        .when(F.col("is_dormant") & F.col("held").isNotNull(), "free")
        .when((F.col("change") == "reactivated") & F.col("saved").isNotNull() & F.col("in_use").isNull() & (first == 1), "restore")
        .when(F.col("change") == "reactivated", "needs_cast")
    )
    return rows.withColumn("action", action).where("action is not null").select(scope, "name", "action", F.coalesce("held", "saved").alias("voice"))


def upserted(base: DataFrame, changes: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Last row per key wins, those of ``changes`` over those of ``base``."""
    both = base.withColumn(seq, F.lit(None).cast(changes.schema[seq].dataType)).unionByName(changes)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(seq)))).where("_n = 1").drop("_n", seq)
