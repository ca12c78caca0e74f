"""Novel databases kept as markdown: sections, character entries, and the patches that change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talesieve.functions import text as X

#: The commands of a patch.
COMMANDS = ["UPDATE_CHARACTER", "NEW_CHARACTER", "MARK_DORMANT", "REACTIVATE", "PRUNE", "UPDATE_SECTION", "APPEND_CHAPTER_MAP"]


def without_comments(md: Column) -> Column:
    return F.regexp_replace(md, r"(?s)<!--.*?-->", "")


def section(md: Column, name: str) -> Column:
    """Body of a '## name' section; null if there is none."""
    found = rf"(?ms)^## {name}[ \t]*\n(.*?)(?=^## |\z)"
    return F.when(md.rlike(found), F.regexp_extract(md, found, 1))


def sections(files: DataFrame, key: list[str], md: str = "md") -> DataFrame:
    """``key, pos, name, body`` of all '## ' sections."""
    parts = F.split(F.concat(F.lit("\n"), without_comments(F.col(md))), r"\n(?=## )")
    return files.select(*key, F.posexplode(parts).alias("pos", "p")).where(F.startswith("p", F.lit("## "))).select(*key, "pos", X.strip(F.regexp_extract("p", r"^## ([^\n]*)", 1)).alias("name"), F.regexp_replace("p", r"^## [^\n]*\n?", "").alias("body"))


def fields_of(body: Column) -> Column:
    """'- Name: value' lines as a map; names in lower case with underscores, the last of equals wins."""
    pairs = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*-[ \t]*(\w[\w ]*?[ \t]*:[ \t]*[^\n]*)$"), F.lit(1))
    named = F.transform(pairs, lambda p: F.struct(F.regexp_replace(F.lower(X.strip(F.substring_index(p, ":", 1))), r"\s+", "_").alias("k"), X.strip(F.regexp_replace(p, r"^[^:]*:", "")).alias("v")))
    # later entries overwrite earlier ones of the same name
    return F.aggregate(named, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def characters(files: DataFrame, key: list[str], md: str = "md") -> DataFrame:
    """``key, pos, name, status, confidence, role, last_updated_chapter, introduced_chapter, fields, notes`` of the '### ' entries."""
    body = section(without_comments(F.col(md)), "Characters")
    blocks = files.select(*key, F.posexplode(F.split(F.concat(F.lit("\n"), body), r"\n### ")).alias("pos", "b")).where("pos > 0")
    rows = blocks.select(*key, "pos", "b", X.strip(F.regexp_extract("b", r"^([^\n]*)", 1)).alias("name"), fields_of(F.regexp_replace("b", r"^[^\n]*\n?", "")).alias("fields"))
    word = lambda name, default: F.lower(F.coalesce(F.nullif(F.regexp_extract(F.try_element_at("fields", F.lit(name)), r"^(\w+)", 1), F.lit("")), F.lit(default)))
    number = lambda name: F.nullif(F.regexp_extract(F.try_element_at("fields", F.lit(name)), r"^(\d+)", 1), F.lit("")).try_cast("int")
    return rows.select(*key, "pos", "name", word("status", "active").alias("status"), word("confidence", "sparse").alias("confidence"), F.lower(F.coalesce(F.try_element_at("fields", F.lit("role")), F.lit("minor"))).alias("role"), number("last_updated_chapter").alias("last_updated_chapter"), number("introduced_chapter").alias("introduced_chapter"), "fields", patch_notes(F.col("b")).alias("notes"))


def unknown_share(files: DataFrame, key: list[str], md: str = "md") -> DataFrame:
    """``n_unknown, n_fields, share`` of the character fields whose value is 'unknown'; 1 where there are no fields."""
    body = F.coalesce(section(F.col(md), "Characters"), F.lit(""))
    total = F.regexp_count(body, F.lit(r"(?m)^\s*-\s+\w[\w_]*\s*:"))
    unknown = F.regexp_count(body, F.lit(r"(?mi)^\s*-\s+\w[\w_]*\s*:[ \t]*unknown[ \t]*$"))
    return files.select(*key, unknown.alias("n_unknown"), total.alias("n_fields"), F.when(total == 0, 1.0).otherwise(F.round(unknown / F.when(total == 0, 1).otherwise(total), 6)).alias("share"))


def render_characters(entries: DataFrame, key: list[str]) -> DataFrame:
    """A '## Characters' section per key out of ``pos, name, fields``."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    blocks = F.sort_array(F.collect_list(F.struct("pos", F.concat(F.lit("### "), F.col("name"), F.lit("\n"), lines).alias("t"))))
    return entries.groupBy(*key).agg(F.concat(F.lit("# Novel\n\n## Overview\n\n## Characters\n"), F.array_join(F.transform(blocks, lambda b: b["t"]), "\n\n"), F.lit("\n\n## Factions\n")).alias("md"))


def catalogue(md: DataFrame, key: list[str]) -> DataFrame:
    """Voices out of '### Name' entries with '- Key: value' lines, gender from the section they stand in."""
    blocks = md.select(*key, F.posexplode(F.split(F.concat(F.lit("\n"), F.col("md")), r"\n### ")).alias("pos", "b"))
    heading = F.lower(F.regexp_extract("b", r"(?m)^## ([^\n]*)$", 1))
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("section", F.last(F.nullif(heading, F.lit("")), True).over(w)).where("pos > 0")
    got = fields_of(F.regexp_replace("b", r"^[^\n]*\n?", ""))
    pick = lambda name: F.try_element_at("f", F.lit(name))
    return rows.withColumn("f", got).select(*key, F.col("pos").alias("pos"), X.strip(F.regexp_extract("b", r"^([^\n]*)", 1)).alias("name"), F.when(F.contains("section", F.lit("female")), "female").when(F.contains("section", F.lit("male")), "male").alias("gender"), pick("age").alias("age"), pick("accent").alias("accent"), pick("tone").alias("tone"), pick("best_for").alias("best_for"))


def patch_commands(patches: DataFrame, key: list[str], text: str = "patch") -> DataFrame:
    """``key, seq, cmd, arg, body`` of a patch's commands, in order; fences off."""
    verbs = "|".join(COMMANDS)
    parts = F.split(F.concat(F.lit("\n"), X.without_fences(F.col(text))), rf"\n(?=(?:{verbs})\b)")
    rows = patches.select(*key, F.posexplode(parts).alias("seq", "p")).where(F.col("p").rlike(rf"^(?:{verbs})\b"))
    return rows.select(*key, "seq", F.regexp_extract("p", rf"^({verbs})", 1).alias("cmd"), X.strip(F.regexp_extract("p", rf"^(?:{verbs})\b:?([^\n]*)", 1)).alias("arg"), F.regexp_replace("p", r"^[^\n]*\n?", "").alias("body"))


def patch_fields(body: Column) -> Column:
    """'name: value' lines of a command as a map; they end a block of notes."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*[a-z_]+:\s*\S") & ~x.rlike(r"^\s*arc_notes_append:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*([a-z_]+):", 1).alias("k"), X.strip(F.regexp_replace(x, r"^\s*[a-z_]+:", "")).alias("v")))
    return F.aggregate(pairs, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def patch_notes(body: Column) -> Column:
    """'Ch N: text' lines of a command as an array of (chapter, note)."""
    found = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^\s*-?\s*Ch\s+\d+\s*:"))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"Ch\s+(\d+)", 1).cast("int").alias("chapter"), X.strip(F.regexp_replace(x, r"^\s*-?\s*Ch\s+\d+\s*:", "")).alias("note")))


def patched(old: DataFrame, commands: DataFrame, key: list[str]) -> DataFrame:
    """Characters after all commands of a patch, folded per key and joined once.

    ``old``: key, status, fields, notes; ``commands``: key, seq, cmd, fields, notes. A NEW of a known key updates it; an UPDATE,
    MARK_DORMANT or REACTIVATE of one unknown to both the old state and the commands before it is rejected; a PRUNE is rejected
    if the old state has the key active or not at all. Result: key, status, fields, notes, n_rejected; pruned keys are left out.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "cmd", "fields", "notes")), lambda a, b: a["seq"] - b["seq"])
    folded = commands.groupBy(*key).agg(ordered.alias("cmds"))
    base = old.select(*key, F.col("status").alias("s0"), F.col("fields").alias("f0"), F.col("notes").alias("n0"))
    rows = base.join(folded, key, "full_outer")
    empty_map = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    start = F.struct(F.col("s0").isNotNull().alias("known"), F.coalesce("s0", F.lit("active")).alias("status"), F.coalesce("f0", empty_map).alias("fields"), F.coalesce("n0", F.expr("cast(array() as array<struct<chapter:int,note:string>>)")).alias("notes"), F.lit(False).alias("gone"), F.lit(0).alias("rejected"))

    def step(a: Column, c: Column) -> Column:
        writes = (c["cmd"] == "NEW_CHARACTER") | ((c["cmd"] == "UPDATE_CHARACTER") & a["known"])
        turns = c["cmd"].isin("MARK_DORMANT", "REACTIVATE") & a["known"]
        prunes = (c["cmd"] == "PRUNE") & (F.coalesce(F.col("s0"), F.lit("active")) != "active")
        incoming = F.coalesce(c["fields"], empty_map)
        fields = F.when(writes, F.map_concat(F.map_filter(a["fields"], lambda k, v: ~F.map_contains_key(incoming, k)), incoming)).otherwise(a["fields"])
        notes = F.when(writes, F.concat(a["notes"], F.coalesce(c["notes"], F.expr("cast(array() as array<struct<chapter:int,note:string>>)")))).otherwise(a["notes"])
        status = F.when(turns & (c["cmd"] == "MARK_DORMANT"), "dormant").when(turns, "active").when(writes, F.coalesce(F.try_element_at(incoming, F.lit("status")), a["status"])).otherwise(a["status"])
        return F.struct((a["known"] | writes).alias("known"), status.alias("status"), fields.alias("fields"), notes.alias("notes"), (a["gone"] | prunes).alias("gone"), (a["rejected"] + F.when(writes | turns | prunes, 0).otherwise(1)).alias("rejected"))

    done = rows.select(*key, F.aggregate(F.coalesce("cmds", F.expr("cast(array() as array<struct<seq:int,cmd:string,fields:map<string,string>,notes:array<struct<chapter:int,note:string>>>>)")), start, step).alias("x"))
    return done.where("x.known and not x.gone").select(*key, "x.status", "x.fields", "x.notes", F.col("x.rejected").alias("n_rejected"))


def last_changes(changes: DataFrame, key: list[str], seq: list[str], values: list[str]) -> DataFrame:
    """Change data folded: of each key the last value that isn't null of each column, and the number of changes."""
    order = F.struct(*seq)
    return changes.groupBy(*key).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), order)).alias(v) for v in values], F.count(F.lit(1)).alias("n_changes"))


def _quoted(value: Column) -> Column:
    """A value as a replacement that stands for itself."""
    return F.regexp_replace(value, r"([\\$])", r"\\$1")


def with_meta_field(md: Column, field: str, value: Column) -> Column:
    """Every 'field: ...' given the value; where that changes nothing, a line of it below the heading '## Meta'."""
    changed = F.regexp_replace(md, F.lit(rf"(?d)({field}:\s*)(.+)"), F.concat(F.lit("$1"), _quoted(value)))
    return F.when(changed != md, changed).otherwise(F.replace(md, F.lit("## Meta\n"), F.concat(F.lit(f"## Meta\n{field}: "), value, F.lit("\n"))))


def with_entry(md: Column, entry: Column) -> Column:
    """An entry, its fences off, at the end of the characters: before the rule above '## Factions', else at the end of all."""
    bare = X.strip(F.regexp_replace(F.regexp_replace(entry, r"(?m)^```(?:markdown)?\s*\n", ""), r"(?m)\n```\s*$", ""))
    mark = "\n---\n\n## Factions"
    return F.when(F.contains(md, F.lit(mark)), F.replace(md, F.lit(mark), F.concat(F.lit("\n\n"), bare, F.lit(mark)))).otherwise(F.concat(md, F.lit("\n\n"), bare, F.lit("\n")))


def without_entries(md: Column, names: Column) -> Column:
    """The text without the '### name' blocks of an array of names, the first of each; a block goes on to the next heading."""

    def less(text: Column, name: Column) -> Column:
        block = F.concat(F.lit(r"(?ms)\A(.*?)^### \Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\s*$.*?(?=^###? |\z)"))
        return F.regexp_replace(text, block, F.lit("$1"))

    return F.aggregate(names, md, less)


def with_sections(files: DataFrame, commands: DataFrame, key: list[str], md: str = "md") -> DataFrame:
    """``key, md`` after the UPDATE_SECTION and APPEND_CHAPTER_MAP commands of a patch, in order: bodies put at the end of the section named,
    or of 'Chapter Map'. A missing map is made at the end of all; another section that is missing, or a blank body, changes nothing."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "cmd", "arg", "body")), lambda a, b: a["seq"] - b["seq"])
    todo = commands.where("cmd in ('UPDATE_SECTION', 'APPEND_CHAPTER_MAP')").groupBy(*key).agg(ordered.alias("_todo"))

    def step(text: Column, c: Column) -> Column:
        body, named = X.strip(c["body"]), c["cmd"] == "UPDATE_SECTION"
        end = F.concat(F.lit(r"(?ms)\A(.*?^## \Q"), F.when(named, c["arg"]).otherwise("Chapter Map"), F.lit(r"\E(?=\s*\n).*?)\s*(?=^## |\z)"))
        there = F.rlike(text, end)
        grown = F.regexp_replace(text, end, F.concat(F.lit("$1"), F.when(named, "\n\n").otherwise("\n"), _quoted(body), F.lit("\n\n")))
        made = F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n\n## Chapter Map\n"), body, F.lit("\n"))
        return F.when(body == "", text).when(there, grown).when(named, text).otherwise(made)

    return files.select(*key, md).join(todo, key, "left").select(*key, F.when(F.col("_todo").isNull(), F.col(md)).otherwise(F.aggregate("_todo", F.col(md), step)).alias(md))
