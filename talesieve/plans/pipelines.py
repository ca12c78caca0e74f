"""The long chains: from a chapter's text to its segments, from characters to voices, from a patch to a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talesieve import schema
from talesieve.functions import text as X
from talesieve.operators import batches, coverage, jsonrepair, labelling, markdown, narration, rendering, timeline, waves
from talesieve.operators import registry as R
from talesieve.operators import segments as S
from talesieve.sources.tables import materialise

COVERAGE_GATE = 0.92


def labelled_segments(texts: DataFrame, key: list[str], factory) -> DataFrame:
    """Raw answers of a labeller, recovered, validated and without repeated dialogue: ``key, index, type, tone, text``."""
    asked = texts.select(*key, labelling.prompt(F.col("text")).alias("prompt"))
    found = jsonrepair.recovered(labelling.labelled(asked, factory)).select(*key, F.posexplode("segments").alias("index", "s"))
    rows = S.validated(found.select(*key, "index", "s.type", "s.tone", "s.text"), key, ["index"])
    return S.without_repeated_dialogue(rows.withColumn("_id", F.col("index")), key, ["index"], "_id", carried=("type", "tone", "text")).drop("_id")


def parsed(chapters: DataFrame, key: list[str], factory, gate: float = COVERAGE_GATE) -> DataFrame:
    """All chapters at once: labelled; those below the gate labelled again for their missing paragraphs, which are put in
    at their place; missing narration put in; short segments merged. ``key, index, type, tone, text, n_merged``."""
    texts = chapters.where("text is not null").select(*key, "text")
    first = materialise(labelled_segments(texts, key, factory).withColumn("part", F.lit(0)))
    low = coverage.word_coverage(texts, first, key).where(F.col("coverage") < gate).select(*key)
    behind = texts.join(low, key, "left_semi")
    gone = coverage.missing_paragraphs(behind, first, key, ["index"])
    paras = behind.select(*key, F.posexplode(coverage.X.paragraphs(F.col("text"))).alias("para_no", "para")).join(gone, [*key, "para_no"], "left_semi")
    again = paras.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_no", "para"))), lambda x: x["para"]), "\n\n").alias("text"))
    both = first.unionByName(labelled_segments(again, key, factory).withColumn("part", F.lit(1)))
    placed = S.in_source_order(both, texts, key, ["part", "index"]).select(*key, F.col("new_index").alias("index"), "type", "tone", "text")
    full = narration.inject(placed, texts, key, ["index"])
    return S.merged(full, key, ["index"], S.paragraph_starts(texts, key))


def inspected(responses: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Per answer its status, number of segments and the share of the source's words that they hold."""
    found = materialise(jsonrepair.recovered(responses).select(*key, "status", "segments"))
    rows = found.select(*key, F.explode("segments").alias("s")).select(*key, "s.text")
    held = coverage.word_coverage(sources, rows, key)
    return found.select(*key, "status", F.size("segments").alias("n_segments")).join(held, key, "left")


def cast(characters: DataFrame, registry: DataFrame, assignments: DataFrame, voices: DataFrame, reserved: list[str], scope: str, mode: str = "new", never_shared: DataFrame | None = None) -> DataFrame:
    """``scope, name, voice, speed_variant, how`` of characters that get a voice: 'own' or 'reused'.

    ``mode``: 'new' (those not in the registry) or 'all'. ``assignments(scope, pos, name, voice)`` are proposals, refused as in
    ``registry.judged_assignments``; who is refused reuses a voice of the scope at another speed. Characters of a ``status`` 'dormant' are
    left alone; ``never_shared(scope, voice)`` are voices that nobody else may reuse.
    """
    fixed = F.col("name").isin(R.schema.FIXED_SPEAKERS)
    if "status" in characters.columns:
        characters = characters.where("coalesce(lower(status), 'active') != 'dormant'")
    waiting = characters.where(~fixed) if mode == "all" else R.uncast(characters.where(~fixed), registry, scope)
    used = registry.select(scope, F.col("xtts_speaker").alias("voice")) if mode != "all" else registry.where(fixed).select(scope, F.col("xtts_speaker").alias("voice"))
    judged = materialise(R.judged_assignments(assignments.join(waiting.select(scope, "name"), [scope, "name"], "left_semi"), waiting, voices, used, reserved, scope))
    own = judged.where("verdict = 'ok'").select(scope, "name", "voice", F.lit(1.0).alias("speed_variant"), F.lit("own").alias("how"))
    rest = waiting.join(own, [scope, "name"], "left_anti").select(scope, "pos", "name", F.lower(F.coalesce("gender", F.lit("unknown"))).alias("gender"))
    held = used.where(~F.col("voice").isin(reserved)).unionByName(own.select(scope, "voice")).distinct()
    if never_shared is not None:
        held = held.join(never_shared.select(scope, "voice"), [scope, "voice"], "left_anti")
    uses = registry.where("is_overflow").groupBy(scope, F.col("xtts_speaker").alias("voice")).agg(F.count(F.lit(1)).alias("uses"))
    pool = held.join(voices.select(F.col("name").alias("voice"), F.lower("gender").alias("gender"), "pos"), "voice").join(uses, [scope, "voice"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    reused = R.reused_voices(rest, pool, scope).where("voice is not null").select(scope, "name", "voice", "speed_variant", F.lit("reused").alias("how"))
    return own.unionByName(reused)


def arc_update(files: DataFrame, patches: DataFrame, voices: DataFrame, dormant: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """Characters after a patch, and what the registry has to do about it."""
    old = markdown.characters(files, [scope])
    commands = markdown.patch_commands(patches, [scope]).where("cmd not in ('UPDATE_SECTION', 'APPEND_CHAPTER_MAP')")  # see markdown.with_sections
    commands = commands.select(scope, F.col("arg").alias("name"), "seq", "cmd", markdown.patch_fields(F.col("body")).alias("fields"), markdown.patch_notes(F.col("body")).alias("notes"))
    new = materialise(markdown.patched(old, commands, [scope, "name"]))
    status = lambda df: df.select(scope, "name", "status")
    return new, R.synchronised(status(old), status(new), voices, dormant, scope)


def better_of(primary: DataFrame, other: DataFrame, key: list[str], most_unknown: float = 0.4, md: str = "md") -> DataFrame:
    """Of each key the first novel database if it has characters and few unknown fields, else the other one."""
    good = markdown.unknown_share(primary, key).where((F.col("n_fields") > 0) & (F.col("share") <= most_unknown)).select(*key)
    chosen = primary.join(good, key, "left_semi")
    return chosen.unionByName(other.join(good, key, "left_anti"))


def chapter_audio(segments: DataFrame, registry: DataFrame, profiles: DataFrame, factory, key: list[str], scope: str, rate: int, cleaned=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From labelled segments to files: voices from the registry, speed of the tone's profile times the voice's, rendered with
    fallbacks, pauses, one WAV a chapter. Gives ``key, content``, the time line ``key, index, strategy, duration_ms, start_ms``, and the
    failure log."""
    voiced = R.resolved_voices(segments.where(X.strip(F.coalesce("text", F.lit(""))) != ""), registry, scope)
    speeds = profiles.select("tone", "speed").unionByName(profiles.where("tone = 'neutral'").select(F.lit(None).cast("string").alias("tone"), "speed"))
    known = profiles.select("tone", F.lit(True).alias("is_known"))
    toned = voiced.join(known, "tone", "left").withColumn("_tone", F.when(F.col("is_known"), F.col("tone"))).alias("v").join(speeds.alias("p"), F.col("v._tone").eqNullSafe(F.col("p.tone")))
    ready = toned.select(*[F.col(f"v.{c}") for c in (*key, "index", "type", "tone", "text", "voice")], (F.col("v.speed_variant") * F.col("p.speed")).alias("speed_variant"))
    said = materialise(rendering.rendered(ready, factory, X.spoken_form(F.col("text")) if cleaned is None else cleaned, rate))
    paused = timeline.with_pauses(said, schema.pause_rules(segments.sparkSession), key, ["index"])
    line = timeline.with_offsets(paused.withColumn("duration_ms", F.expr(f"size(wav) * 1000 div {rate}")), key, ["index"]).select(*key, "index", "strategy", "duration_ms", "start_ms")
    return waves.chapter_files(paused, key, "index", rate), line, rendering.failure_log(said, key)


def batch_run(chapters: DataFrame, done: DataFrame, key: list[str], process, lower: int | None = None, upper: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Chapters within a range that aren't done yet, processed together: ``key, status`` (done, failed, skipped) of every chapter of the
    range, and the checkpoint after it. ``process`` gets the pending chapters and gives rows with ``key``, one for each that
    has come out; what it leaves out has failed and is pending again next time."""
    number = F.col(key[-1])
    asked = chapters.where((number >= (1 if lower is None else lower)) & (F.lit(True) if upper is None else number <= upper))
    waiting = batches.pending(asked, done, key)
    finished = materialise(process(waiting).select(*key).distinct())
    before = done.select(*key, F.lit("skipped").alias("_before")).distinct()
    told = asked.select(*key).distinct().join(before, key, "left").join(finished.withColumn("_after", F.lit("done")), key, "left")
    return told.select(*key, F.coalesce("_before", "_after", F.lit("failed")).alias("status")), batches.checkpoint_after(done, finished, key)
