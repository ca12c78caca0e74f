"""Queries over the speaker registries, voices and character keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talesieve import schema
from talesieve.functions import text as X
from talesieve.operators import audit, markdown
from talesieve.operators import registry as R
from talesieve.plans.catalogue import STRIP, query
from talesieve.plans.inputs import registry_files
from talesieve.sources.tables import table

_FILES = "files AS (SELECT *, regexp_extract(novel_dir, '([^/]*)$', 1) AS novel FROM speakers)"
_NEW = f"{_FILES}, newest AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY novel ORDER BY saved_at DESC, len(map_keys(characters)) DESC) = 1), oldest AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY novel ORDER BY saved_at, len(map_keys(characters))) = 1)"
_ENTRIES = "{0} AS (SELECT novel, k AS name, i AS pos, v.xtts_speaker AS xtts_speaker, v.gender AS gender, v.cast_by AS cast_by, v.is_overflow AS is_overflow, v.speed_variant AS speed_variant FROM (SELECT novel, unnest(map_keys(characters)) AS k, unnest(map_values(characters)) AS v, unnest(range(len(map_keys(characters)))) AS i FROM {1}))"
_REG = f"{_NEW}, {_ENTRIES.format('reg', 'newest')}"


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.entries(R.newest(registry_files(spark, sf_dir), "novel"), "novel")


@query(f"WITH {_REG} SELECT novel, name, CAST(pos AS INTEGER) AS pos, xtts_speaker, gender FROM reg")
def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir).select("novel", "name", "pos", "xtts_speaker", "gender")


_WHO = f"coalesce(lower({STRIP.format('speaker')}), 'narrator')"


@query(f"""WITH {_REG}, known AS (SELECT novel, lower(name) AS who, arg_max(coalesce(xtts_speaker, 'Ana Florence'), pos) AS voice, arg_max(coalesce(speed_variant, 1.0), pos) AS speed FROM reg GROUP BY ALL), u AS (SELECT novel, voice AS uv FROM known WHERE who = 'unknown')
SELECT seg_id, coalesce(voice, CASE WHEN {_WHO} IN ('narrator', 'system') THEN 'Ana Florence' ELSE coalesce(uv, 'Ana Florence') END) AS voice, coalesce(speed, 1.0) AS speed_variant
FROM segments s LEFT JOIN known k ON k.novel = s.novel AND k.who = {_WHO} LEFT JOIN u ON u.novel = s.novel""")
def speaker_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resolved_voices(table(spark, sf_dir, "segments"), _registry(spark, sf_dir), "novel").select("seg_id", "voice", "speed_variant")


@query("""SELECT seg_id, coalesce(t.speed, n.speed) AS speed, coalesce(t.temperature, n.temperature) AS temperature, coalesce(t.top_k, n.top_k) AS top_k FROM segments s LEFT JOIN tone_profiles t ON t.tone = s.tone CROSS JOIN (SELECT * FROM tone_profiles WHERE tone = 'neutral') n""")
def tone_profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "tone_profiles")
    kinds = table(spark, sf_dir, "segments").join(profiles.select("tone").withColumn("is_known", F.lit(True)), "tone", "left")
    return kinds.withColumn("tone", F.when(F.col("is_known"), F.col("tone")).otherwise("neutral")).join(profiles, "tone").select("seg_id", "speed", "temperature", "top_k")


_FOLDED = "trim(lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')))"


@query(f"""WITH {_REG}, keys AS (SELECT DISTINCT name FROM reg), asked AS (SELECT DISTINCT replace(speaker, ' ', '_') AS name FROM segments WHERE speaker IS NOT NULL), k AS (SELECT {_FOLDED.replace('{0}', 'name')} AS f, max(name) AS by_fold FROM keys GROUP BY f)
SELECT a.name, coalesce(e.name, by_fold) AS found, CASE WHEN e.name IS NOT NULL THEN 'exact' WHEN by_fold IS NOT NULL THEN 'folded' ELSE 'missing' END AS how FROM asked a LEFT JOIN keys e ON e.name = a.name LEFT JOIN k ON k.f = {_FOLDED.replace('{0}', 'a.name')}""")
def fuzzy_speaker_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "segments").select(F.replace("speaker", F.lit(" "), F.lit("_")).alias("name")).where("name is not null").distinct()
    return R.fuzzy_keys(asked, _registry(spark, sf_dir).select("name").distinct())


@query(f"WITH {_REG} SELECT DISTINCT novel, speaker AS name FROM segments s WHERE speaker IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reg WHERE reg.novel = s.novel AND reg.name = s.speaker)")
def uncast_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "segments").select("novel", F.col("speaker").alias("name")).where("name is not null").distinct()
    return R.uncast(named, _registry(spark, sf_dir), "novel")


@query(f"WITH {_REG} SELECT xtts_speaker AS voice, count(*) AS n_characters, count(DISTINCT novel) AS n_novels, CAST(sum(CASE WHEN is_overflow THEN 1 ELSE 0 END) AS BIGINT) AS n_overflow FROM reg GROUP BY xtts_speaker")
def voices_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir).groupBy(F.col("xtts_speaker").alias("voice")).agg(F.count(F.lit(1)).alias("n_characters"), F.countDistinct("novel").alias("n_novels"), F.sum(F.coalesce(F.col("is_overflow"), F.lit(False)).cast("long")).alias("n_overflow"))


_RESERVED = "('Wynengan Emaruun')"


_JUDGED = f"""{_REG}, asked AS (SELECT novel, pos, name, xtts_speaker AS voice, lower(coalesce(gender, 'unknown')) AS g FROM reg), j AS (SELECT a.*, lower(v.gender) AS vg, v.name IS NOT NULL AS ok FROM asked a LEFT JOIN voices v ON v.name = a.voice),
r AS (SELECT *, CASE WHEN NOT ok THEN 'invalid_voice' WHEN voice IN {_RESERVED} THEN 'reserved' END AS refusal FROM j), x AS (SELECT *, row_number() OVER (PARTITION BY novel, voice, refusal IS NULL ORDER BY pos) AS n FROM r),
y AS (SELECT *, CASE WHEN refusal IS NOT NULL THEN refusal WHEN n > 1 THEN 'taken' ELSE 'ok' END AS verdict FROM x)"""


@query(f"""WITH {_JUDGED}
SELECT novel, CAST(pos AS INTEGER) AS pos, name, voice, verdict, coalesce(g <> 'unknown' AND g <> vg, false) AND verdict = 'ok' AS gender_warning FROM y""")
def validate_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = _registry(spark, sf_dir)
    asked = reg.select("novel", "pos", "name", F.col("xtts_speaker").alias("voice"))
    nobody = asked.select("novel", "voice").where("false")
    return R.judged_assignments(asked, reg, table(spark, sf_dir, "voices"), nobody, ["Wynengan Emaruun"], "novel")


@query(f"""WITH RECURSIVE {_JUDGED}, wait AS (SELECT novel, pos, name, g, row_number() OVER (PARTITION BY novel ORDER BY pos, name) AS i FROM y WHERE verdict = 'taken'),
u AS (SELECT novel, xtts_speaker AS voice, count(*) AS uses FROM reg WHERE is_overflow GROUP BY ALL), pool AS (SELECT y.novel, list(y.voice ORDER BY y.pos) AS vs, list(y.vg ORDER BY y.pos) AS gs, list(coalesce(uses, 0) ORDER BY y.pos) AS us FROM y LEFT JOIN u ON u.novel = y.novel AND u.voice = y.voice WHERE verdict = 'ok' GROUP BY y.novel),
f AS (SELECT novel, CAST(0 AS BIGINT) AS i, us, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS n FROM pool
  UNION ALL SELECT novel, i, CASE WHEN best IS NULL THEN us ELSE list_transform(range(1, len(us) + 1), lambda j: us[j] + CASE WHEN j = best.k THEN 1 ELSE 0 END) END, best.k, best.u FROM (
    SELECT novel, i, us, list_sort(CASE WHEN len(list_filter(free, lambda s: g = 'unknown' OR s.g = 'unknown' OR s.g = g)) > 0 THEN list_filter(free, lambda s: g = 'unknown' OR s.g = 'unknown' OR s.g = g) ELSE free END)[1] AS best FROM (
      SELECT f.novel, w.i, w.g, f.us, list_filter(list_transform(range(1, len(f.us) + 1), lambda j: {{'u': f.us[j], 'k': j, 'g': p.gs[j]}}), lambda s: s.u < 6) AS free FROM f JOIN wait w ON w.novel = f.novel AND w.i = f.i + 1 JOIN pool p ON p.novel = f.novel)))
SELECT f.novel, CAST(w.pos AS INTEGER) AS pos, w.name, p.vs[f.k] AS voice, CAST(([{", ".join(map(str, schema.SPEED_OFFSETS))}])[f.n + 1] AS DOUBLE) AS speed_variant FROM f JOIN wait w USING (novel, i) JOIN pool p ON p.novel = f.novel""")
def overflow_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters whose voice was taken, given a used one at another speed."""
    judged = validate_assignments(spark, sf_dir)
    reg, voices = _registry(spark, sf_dir), table(spark, sf_dir, "voices")
    waiting = judged.where("verdict = 'taken'").join(reg.select("novel", "name", "gender"), ["novel", "name"]).select("novel", "pos", "name", F.lower(F.coalesce("gender", F.lit("unknown"))).alias("gender"))
    uses = reg.where("is_overflow").groupBy("novel", F.col("xtts_speaker").alias("voice")).agg(F.count(F.lit(1)).alias("uses"))
    pool = judged.where("verdict = 'ok'").select("novel", "pos", "voice").join(voices.select(F.col("name").alias("voice"), F.lower("gender").alias("gender")), "voice").join(uses, ["novel", "voice"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return R.reused_voices(waiting, pool, "novel")


_SNAP = f"{_NEW}, o AS (SELECT novel, unnest(map_keys(characters)) AS name FROM oldest), n AS (SELECT novel, unnest(map_keys(characters)) AS name FROM newest), dn AS (SELECT novel, unnest(map_keys(dormant_voices)) AS name FROM newest WHERE dormant_voices IS NOT NULL), do_ AS (SELECT novel, unnest(map_keys(dormant_voices)) AS name FROM oldest WHERE dormant_voices IS NOT NULL), os AS (SELECT novel, name, 'active' AS st FROM o UNION ALL SELECT novel, name, 'dormant' FROM do_ WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.novel = do_.novel AND o.name = do_.name)), ns AS (SELECT novel, name, 'active' AS st FROM n UNION ALL SELECT novel, name, 'dormant' FROM dn WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.novel = dn.novel AND n.name = dn.name))"


def _snapshot(files: DataFrame) -> DataFrame:
    active = R.entries(files, "novel").select("novel", "name", F.lit("active").alias("status"))
    dormant = R.dormant_entries(files, "novel").select("novel", "name", F.lit("dormant").alias("status"))
    return active.unionByName(dormant.join(active, ["novel", "name"], "left_anti"))


@query(f"""WITH {_SNAP} SELECT novel, name, CASE WHEN ns.st IS NULL THEN 'pruned' WHEN os.st IS NULL THEN CASE WHEN ns.st = 'dormant' THEN 'dormant' ELSE 'added' END WHEN os.st <> 'dormant' AND ns.st = 'dormant' THEN 'dormant' WHEN os.st = 'dormant' AND ns.st <> 'dormant' THEN 'reactivated' ELSE 'kept' END AS change
FROM os FULL JOIN ns USING (novel, name) WHERE name NOT IN ('narrator', 'system', 'unknown')""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = registry_files(spark, sf_dir)
    return R.snapshot_changes(_snapshot(R.oldest(files, "novel")), _snapshot(R.newest(files, "novel")), ["novel", "name"])


@query(f"""WITH {_SNAP}, {_ENTRIES.format("reg", "newest")}, sv AS (SELECT novel, unnest(map_keys(dormant_voices)) AS name, unnest(map_values(dormant_voices)).xtts_speaker AS saved FROM newest WHERE dormant_voices IS NOT NULL),
c AS (SELECT novel, name, os.st AS new_st, ns.st AS old_st FROM os FULL JOIN ns USING (novel, name) WHERE name NOT IN ('narrator', 'system', 'unknown')),
r AS (SELECT c.*, reg.xtts_speaker AS held, sv.saved FROM c LEFT JOIN reg USING (novel, name) LEFT JOIN sv USING (novel, name)),
stays AS (SELECT DISTINCT novel, held AS saved FROM r WHERE held IS NOT NULL AND new_st = 'active'),
x AS (SELECT r.*, old_st = 'dormant' AND new_st = 'active' AS back, stays.saved IS NOT NULL AS in_use FROM r LEFT JOIN stays ON stays.novel = r.novel AND stays.saved = r.saved),
y AS (SELECT *, row_number() OVER (PARTITION BY novel, saved, back ORDER BY name) AS n FROM x),
z AS (SELECT novel, name, CASE WHEN new_st IS NULL AND (held IS NOT NULL OR saved IS NOT NULL) THEN 'remove' WHEN new_st = 'dormant' AND held IS NOT NULL THEN 'free' WHEN back AND saved IS NOT NULL AND NOT in_use AND n = 1 THEN 'restore' WHEN back THEN 'needs_cast' END AS action, coalesce(held, saved) AS voice FROM y)
SELECT * FROM z WHERE action IS NOT NULL""")
def registry_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the newest file back to the oldest, so that characters go dormant, return and are pruned."""
    files = registry_files(spark, sf_dir)
    new, old = R.newest(files, "novel"), R.oldest(files, "novel")
    return R.synchronised(_snapshot(new), _snapshot(old), R.entries(new, "novel"), R.dormant_entries(new, "novel"), "novel")


_GROUPS = "|".join(f"(?:{p})" for p in audit.GROUP_PATTERNS)


@query(rf"""WITH k AS (SELECT DISTINCT speaker AS name FROM segments WHERE speaker IS NOT NULL), n AS (SELECT speaker AS name, count(*) FILTER ("type" = 'dialogue') AS d, max(chapter_num) AS last FROM segments WHERE speaker IS NOT NULL GROUP BY speaker)
SELECT name, CASE WHEN name IN ('narrator', 'system', 'unknown') THEN 'keep' WHEN regexp_matches(lower(name), '{_GROUPS}') THEN 'battle_group' WHEN d = 0 THEN 'ghost' WHEN last = 5 THEN 'suspicious' END AS category FROM n""")
def audit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = F.count_if(F.col("type") == "dialogue")
    named = table(spark, sf_dir, "segments").where("speaker is not null").groupBy(F.col("speaker").alias("name")).agg(F.when(spoken > 0, "argues with the captain").otherwise("is noted in the hall").alias("notes"), F.max("chapter_num").alias("last_updated"), F.lit("0").alias("introduced"))
    return audit.classified(named, suspect_chapter=5).select("name", "category")


@query(f"WITH {_REG} SELECT novel, CAST(sum(CASE WHEN gender IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS n_unknown, CAST(count(*) AS INTEGER) AS n_fields, round(sum(CASE WHEN gender IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS share FROM reg GROUP BY novel")
def unknown_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registries written as markdown, their unknown fields counted in the text."""
    rows = _registry(spark, sf_dir).select("novel", "pos", "name", F.create_map(F.lit("gender"), F.coalesce("gender", F.lit("unknown"))).alias("fields"))
    return markdown.unknown_share(markdown.render_characters(rows, ["novel"]), ["novel"])


@query(f"WITH {_REG} SELECT novel, CAST(pos + 1 AS INTEGER) AS pos, name, coalesce(lower(regexp_extract(cast_by, '^(\\w+)', 1)), 'sparse') AS confidence, lower(xtts_speaker) AS role, CAST(pos * 3 AS INTEGER) AS last_updated_chapter FROM reg".replace("coalesce(lower(regexp_extract(cast_by, '^(\\w+)', 1)), 'sparse')", "CASE WHEN cast_by IS NULL THEN 'sparse' ELSE lower(regexp_extract(cast_by, '^(\\w+)', 1)) END"))
def novel_md_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registries written as markdown entries and read back."""
    fields = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("Role").alias("k"), F.col("xtts_speaker").alias("v")), F.when(F.col("cast_by").isNotNull(), F.struct(F.lit("confidence").alias("k"), F.col("cast_by").alias("v"))), F.struct(F.lit("last_updated_chapter").alias("k"), (F.col("pos") * 3).cast("string").alias("v")))))
    rows = _registry(spark, sf_dir).where("xtts_speaker is not null").select("novel", "pos", "name", fields.alias("fields"))
    return markdown.characters(markdown.render_characters(rows, ["novel"]), ["novel"]).select("novel", "pos", "name", "confidence", "role", "last_updated_chapter")


@query("SELECT CAST(row_number() OVER (PARTITION BY gender ORDER BY pos) AS INTEGER) AS place, name, gender, age, accent, tone, best_for FROM voices")
def voices_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voices written as a markdown catalogue, a file per gender, and read back."""
    line = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n- {k}: "), F.col(c))).otherwise("")
    entry = F.concat(F.lit("### "), F.col("name"), line("Age", "age"), line("Accent", "accent"), line("Tone", "tone"), line("Best for", "best_for"))
    entries = F.sort_array(F.collect_list(F.struct("pos", entry.alias("t"))))
    md = table(spark, sf_dir, "voices").groupBy("gender").agg(F.concat(F.lit("# Voices\n\n## "), F.initcap(F.first("gender")), F.lit(" voices\n\n"), F.array_join(F.transform(entries, lambda x: x["t"]), "\n\n")).alias("md")).select(F.col("gender").alias("file"), "md")
    return markdown.catalogue(md, ["file"]).select(F.col("pos").alias("place"), "name", "gender", "age", "accent", "tone", "best_for")


@query(f"WITH {_REG} SELECT novel, string_agg(name || repeat(' ', greatest(0, 30 - length(name))) || ' ' || coalesce(gender, 'unknown'), chr(10) ORDER BY name) AS listing FROM reg WHERE name NOT IN ('narrator', 'system', 'unknown') GROUP BY novel")
def character_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.when(F.length("name") >= 30, F.col("name")).otherwise(F.rpad("name", 30, " "))
    line = F.concat(padded, F.lit(" "), F.coalesce("gender", F.lit("unknown")))
    rows = _registry(spark, sf_dir).where(~F.col("name").isin(schema.FIXED_SPEAKERS))
    return rows.groupBy("novel").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", line.alias("l")))), lambda x: x["l"]), "\n").alias("listing"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^\\w\\s-]', '', 'g'), '[\\s-]+', '_', 'g') AS slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query()
def casting_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered character cast anew, its own voice proposed; who is refused reuses a voice."""
    from talesieve.plans import pipelines

    reg = _registry(spark, sf_dir)
    asked = reg.select("novel", "pos", "name", F.col("xtts_speaker").alias("voice"))
    return pipelines.cast(reg.select("novel", "pos", "name", "gender"), reg, asked, table(spark, sf_dir, "voices"), ["Wynengan Emaruun"], "novel", mode="all")


@query(f"WITH {_REG}, x AS (SELECT novel, name FROM reg WHERE pos % 3 <> 1 UNION ALL SELECT DISTINCT novel, 'zz_new' FROM reg) SELECT novel, name, CASE WHEN name = 'zz_new' THEN 'guide' END AS role, '12' AS updated, concat('Old.', chr(10), chr(10), 'Later.') AS overview, 'Ch 12: $1 \\ dawn' AS map FROM x")
def novel_md_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novel databases edited as text: characters out, one in, a field of Meta set, a section and the chapter map grown; read back."""
    none = F.create_map(F.lit("gender"), F.lit("unknown"))
    reg = _registry(spark, sf_dir)
    files = markdown.render_characters(reg.select("novel", "pos", "name", none.alias("fields")), ["novel"]).withColumn("md", F.replace(F.replace("md", F.lit("## Overview\n"), F.lit("## Meta\nnovel: x\n\n## Overview\nOld.\n")), F.lit("\n\n## Factions"), F.lit("\n\n---\n\n## Factions")))
    gone = reg.where("pos % 3 = 1").groupBy("novel").agg(F.collect_list("name").alias("gone"))
    md = markdown.with_entry(F.col("md"), F.lit("```markdown\n### zz_new\n- role: guide\n```"))
    md = markdown.without_entries(md, F.coalesce("gone", F.expr("cast(array() as array<string>)")))
    edited = files.join(gone, "novel", "left").select("novel", markdown.with_meta_field(markdown.with_meta_field(md, "last_updated_chapter", F.lit("7")), "last_updated_chapter", F.lit("12")).alias("md"))
    commands = edited.select("novel", F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(c).alias("cmd"), F.lit(a).alias("arg"), F.lit(b).alias("body")) for i, (c, a, b) in enumerate([("UPDATE_SECTION", "Overview", "Later.\n"), ("UPDATE_SECTION", "Nowhere", "x"), ("APPEND_CHAPTER_MAP", "", "Ch 12: $1 \\ dawn")])])).alias("c")).select("novel", "c.*")
    done = markdown.with_sections(edited, commands, ["novel"])
    read = markdown.characters(done, ["novel"]).select("novel", "name", F.try_element_at("fields", F.lit("role")).alias("role"))
    whole = done.select("novel", F.regexp_extract("md", r"last_updated_chapter: (\d+)", 1).alias("updated"), X.strip(markdown.section(F.col("md"), "Overview")).alias("overview"), X.strip(markdown.section(F.col("md"), "Chapter Map")).alias("map"))
    return read.join(whole, "novel")


@query(f"""WITH {_REG}, k AS (SELECT DISTINCT novel, name FROM reg), c AS (SELECT *, length(name) % 4 AS how FROM k)
SELECT novel, name, CASE how WHEN 0 THEN 'dormant' ELSE 'active' END AS status, CASE how WHEN 1 THEN 'tall' END AS look, CASE how WHEN 1 THEN 'Ch 3: left' END AS note, CASE WHEN how IN (2, 3) THEN 1 ELSE 0 END AS n_rejected FROM c
UNION ALL SELECT DISTINCT novel, 'zz_new', 'active', 'short', 'Ch 1: came', 0 FROM k""")
def patch_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch against every registered character, as text: marked dormant, updated, pruned though active, and an update of one unknown
    before it is new."""
    known = _registry(spark, sf_dir).select("novel", "name").distinct()
    empty = F.expr("cast(map() as map<string,string>)")
    old = known.select("novel", "name", F.lit("active").alias("status"), empty.alias("fields"), F.expr("cast(array() as array<struct<chapter:int,note:string>>)").alias("notes"))
    how = F.length("name") % 4
    text = F.when(how == 0, F.concat(F.lit("MARK_DORMANT: "), "name")).when(how == 1, F.concat(F.lit("UPDATE_CHARACTER: "), "name", F.lit("\nlook: tall\narc_notes_append:\n- Ch 3: left"))).otherwise(F.concat(F.lit("PRUNE: "), "name"))
    one = known.where(~F.contains("name", F.lit("\n"))).groupBy("novel").agg(F.concat(F.lit("```\n"), F.array_join(F.collect_list(text), "\n"), F.lit("\nNEW_CHARACTER: zz_new\nlook: short\narc_notes_append:\n- Ch 1: came\n```")).alias("patch"))
    commands = markdown.patch_commands(one, ["novel"]).select("novel", F.col("arg").alias("name"), "seq", "cmd", markdown.patch_fields(F.col("body")).alias("fields"), markdown.patch_notes(F.col("body")).alias("notes"))
    done = markdown.patched(old, commands, ["novel", "name"])
    note = F.get("notes", F.lit(0))
    return done.select("novel", "name", "status", F.try_element_at("fields", F.lit("look")).alias("look"), F.when(note.isNotNull(), F.concat(F.lit("Ch "), note["chapter"], F.lit(": "), note["note"])).alias("note"), "n_rejected")
