"""Audit of character keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talesieve import schema

#: Patterns of keys that name disposable figures.
GROUP_PATTERNS = [
    r"\d+$",
    r"_(leader|chief|boss)$",
    r"_(fighter|guard|soldier|warrior|scout|lieutenant|subordinate|archer|knight|thug|bandit|mercenary|spy|assassin|minion|grunt|lackey|mook|henchman)s?(_\w+)?$",
    r"^(unnamed|unknown|mystery|random|unnamed_\w+)",
    r"_(left|right|north|south|east|west)$",
    r"_(platinum|gold|silver|bronze|diamond|ruby|iron)\b",
    r"^(guard|soldier|fighter|warrior|scout|lieutenant|subordinate|archer|knight|thug|bandit|mercenary)s?(_|$)",
]
#: Phrases of a note that tells of no spoken word.
MENTION_ONLY = ["mentioned", "observed", "present", "in attendance", "seen", "noted", "referenced", "is noted", "appears briefly", "briefly seen"]


def is_group(key: Column) -> Column:
    return F.lower(key).rlike("|".join(f"(?:{p})" for p in GROUP_PATTERNS))


def has_dialogue(notes: Column) -> Column:
    """Whether any entry of the notes is more than a mention; blank notes: no."""
    entries = F.filter(F.transform(F.split(F.coalesce(notes, F.lit("")), r"\n\s*Ch \d+:"), lambda e: F.lower(F.regexp_replace(e, r"(?U)^\s+|\s+$", ""))), lambda e: e != "")
    mention = lambda e: e.rlike("|".join(MENTION_ONLY))
    return F.exists(entries, lambda e: ~mention(e))


def classified(characters: DataFrame, suspect_chapter: int | None = None) -> DataFrame:
    """``characters(name, notes, last_updated, introduced)`` with ``category``: keep, battle_group, ghost, suspicious or null."""
    intro = F.coalesce(F.col("introduced").try_cast("int"), F.lit(0))
    suspicious = F.lit(False) if suspect_chapter is None else F.coalesce((F.col("last_updated") == suspect_chapter) & (F.col("last_updated") != intro), F.lit(False))
    category = F.when(F.col("name").isin(schema.FIXED_SPEAKERS), "keep").when(is_group(F.col("name")), "battle_group").when(~has_dialogue(F.col("notes")), "ghost").when(suspicious, "suspicious")
    return characters.withColumn("category", category)
