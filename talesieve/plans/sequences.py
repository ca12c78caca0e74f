"""Queries over ordered segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talesieve import schema
from talesieve.functions import audio
from talesieve.functions import text as X
from talesieve.operators import batches, chunking, jsonrepair, narration, timeline
from talesieve.operators import segments as S
from talesieve.plans.catalogue import CH, CLEAN, PARAGRAPHS, PROBE, SG, STRIP, TOKENS, WORDS, query
from talesieve.plans.inputs import chapters, segments

KEY = ["novel", "chapter_num"]
_TYPES = ", ".join(f"'{t}'" for t in schema.TYPES)
_TONES = ", ".join(f"'{t}'" for t in schema.TONES)
_VALID = f"""{SG}, ok AS (
  SELECT novel, chapter_num, seg_id, CASE WHEN "type" IN ({_TYPES}) THEN "type" ELSE 'narration' END AS "type", CASE WHEN tone IN ({_TONES}) THEN tone ELSE 'neutral' END AS tone, text, speaker,
    CAST(row_number() OVER (PARTITION BY novel, chapter_num ORDER BY "index", seg_id) - 1 AS INTEGER) AS "index"
  FROM sg WHERE {STRIP.format("coalesce(text, '')")} <> '')"""


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.validated(segments(spark, sf_dir), KEY, ["index", "seg_id"])


@query(f'WITH {_VALID} SELECT novel, chapter_num, seg_id, "index", "type", tone FROM ok')
def segment_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).select(*KEY, "seg_id", "index", "type", "tone")


@query(f"""WITH s AS (SELECT speaker, "type", tone, len({TOKENS.format("coalesce(text, '')")}) AS n FROM segments)
SELECT 'speaker' AS dimension, speaker AS value, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_words FROM s GROUP BY speaker
UNION ALL SELECT 'type', "type", count(*), CAST(sum(n) AS BIGINT) FROM s GROUP BY "type" UNION ALL SELECT 'tone', tone, count(*), CAST(sum(n) AS BIGINT) FROM s GROUP BY tone""")
def segment_stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talesieve.sources.tables import table

    return S.statistics(table(spark, sf_dir, "segments"))


@query(f"""WITH s AS (SELECT novel, chapter_num, speaker, "type", tone, len({TOKENS.format("coalesce(text, '')")}) AS n FROM segments)
SELECT novel, chapter_num, 'speaker' AS dimension, speaker AS value, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_words FROM s GROUP BY ALL
UNION ALL SELECT novel, chapter_num, 'type', "type", count(*), CAST(sum(n) AS BIGINT) FROM s GROUP BY ALL UNION ALL SELECT novel, chapter_num, 'tone', tone, count(*), CAST(sum(n) AS BIGINT) FROM s GROUP BY ALL""")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talesieve.sources.tables import table

    return S.statistics(table(spark, sf_dir, "segments"), KEY)


@query("""SELECT novel, chapter_num, count(*) AS n_long, CAST(sum(CASE WHEN contains(text, '"') THEN 1 ELSE 0 END) AS BIGINT) AS n_quoted, min(substring(text, 1, 80)) AS preview
FROM segments WHERE length(text) > 200 GROUP BY novel, chapter_num""")
def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talesieve.sources.tables import table

    rows = table(spark, sf_dir, "segments").where(F.length("text") > 200)
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_long"), F.sum(F.contains("text", F.lit('"')).cast("long")).alias("n_quoted"), F.min(F.substring("text", 1, 80)).alias("preview"))


@query(f"""WITH {_VALID}, nx AS (SELECT *, lead("type") OVER w AS next_type FROM ok WINDOW w AS (PARTITION BY novel, chapter_num ORDER BY "index"))
SELECT novel, chapter_num, "index", "type", next_type, CASE WHEN next_type IS NULL THEN 0 ELSE coalesce(pause_ms, 400) END AS pause_ms FROM nx
LEFT JOIN (VALUES {", ".join(f"('{a}','{b}',{p})" for a, b, p in schema.PAUSES)}) r(a, b, pause_ms) ON nx."type" = a AND next_type = b""")
def pause_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.with_pauses(_valid(spark, sf_dir), schema.pause_rules(spark), KEY, ["index"]).select(*KEY, "index", "type", "next_type", "pause_ms")


@query(f"""WITH {_VALID}, nx AS (SELECT *, lead("type") OVER w AS next_type, CAST(length(text) * 1000 // 15 AS BIGINT) AS duration_ms FROM ok WINDOW w AS (PARTITION BY novel, chapter_num ORDER BY "index")), p AS (
SELECT novel, chapter_num, "index", duration_ms, CASE WHEN next_type IS NULL THEN 0 ELSE coalesce(pause_ms, 400) END AS pause_ms FROM nx
LEFT JOIN (VALUES {", ".join(f"('{a}','{b}',{p})" for a, b, p in schema.PAUSES)}) r(a, b, pause_ms) ON nx."type" = a AND next_type = b)
SELECT novel, chapter_num, "index", duration_ms, CAST(500 + coalesce(sum(duration_ms + pause_ms) OVER (PARTITION BY novel, chapter_num ORDER BY "index" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM p""")
def timeline_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valid(spark, sf_dir).withColumn("duration_ms", F.expr("cast(length(text) * 1000 div 15 as bigint)"))
    paused = timeline.with_pauses(rows, schema.pause_rules(spark), KEY, ["index"])
    return timeline.with_offsets(paused, KEY, ["index"]).select(*KEY, "index", "duration_ms", "start_ms")


@query(f"""WITH {CH}, d AS (SELECT novel, chapter_num, coalesce(length(text), 0) * 60 AS duration_ms FROM ch), b AS (
SELECT novel, (chapter_num - 1) // 10 AS block, string_agg(chapter_num::VARCHAR, ',' ORDER BY chapter_num) AS members, count(*) AS n, sum(duration_ms) AS total FROM d GROUP BY ALL)
SELECT novel, CAST(block AS INTEGER) AS block, 'chapters_' || (block * 10 + 1) || '_to_' || (block * 10 + 10) || '.mp3' AS file_name, members, CAST(n AS INTEGER) AS n_members, CAST(total + 2000 * (n - 1) AS BIGINT) AS duration_ms,
CASE WHEN block % 2 = 0 AND n = 10 THEN 'skip' ELSE 'build' END AS status FROM b""")
def chapter_blocks_of_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chapters(spark, sf_dir).select("novel", "chapter_num", (F.coalesce(F.length("text"), F.lit(0)) * 60).cast("long").alias("duration_ms"))
    existing = rows.select("novel", timeline.block_of(F.col("chapter_num")).alias("block")).where("block % 2 = 0").distinct()
    return timeline.blocks(rows, "novel", existing=existing)


@query(f"""WITH {_VALID}, w AS (SELECT novel, chapter_num, "index", list_distinct({WORDS.format("text")}) AS ws, lag(list_distinct({WORDS.format("text")})) OVER (PARTITION BY novel, chapter_num ORDER BY "index") AS before FROM ok)
SELECT novel, chapter_num, "index", round(CASE WHEN least(len(ws), len(before)) = 0 THEN 0.0 ELSE len(list_intersect(ws, before)) / least(len(ws), len(before)) END, 6) AS overlap FROM w WHERE before IS NOT NULL""")
def adjacent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("index")
    rows = _valid(spark, sf_dir).withColumn("ws", X.word_set(F.col("text"))).withColumn("before", F.lag("ws").over(w)).where("before is not null")
    return rows.select(*KEY, "index", F.round(X.overlap(F.col("ws"), F.col("before")), 6).alias("overlap"))


_FOLD = """RECURSIVE {valid}, base AS (SELECT *, {words} AS ws FROM ok), f AS (
  SELECT novel, chapter_num, "index", seg_id, "type" AS lt, ws AS lw, true AS kept FROM base WHERE "index" = 0
  UNION ALL SELECT b.novel, b.chapter_num, b."index", b.seg_id, CASE WHEN k THEN b."type" ELSE lt END, CASE WHEN k THEN b.ws ELSE lw END, k FROM (
    SELECT b.*, f.lt, f.lw, NOT (b."type" = 'dialogue' AND f.lt = 'dialogue' AND CASE WHEN least(len(b.ws), len(f.lw)) = 0 THEN 0.0 ELSE len(list_intersect(b.ws, f.lw)) / least(len(b.ws), len(f.lw)) END >= {t}) AS k
    FROM f JOIN base b ON b.novel = f.novel AND b.chapter_num = f.chapter_num AND b."index" = f."index" + 1) b)"""


@query(f"""WITH {_FOLD.format(valid=_VALID, words=f'list_distinct({WORDS.format("text")})', t=0.5)}
SELECT novel, chapter_num, seg_id, CAST(row_number() OVER (PARTITION BY novel, chapter_num ORDER BY "index") - 1 AS INTEGER) AS "index" FROM f WHERE kept""")
def dedup_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At half of the words, so that enough rows drop out for the comparison to say something."""
    return S.without_repeated_dialogue(_valid(spark, sf_dir), KEY, ["index"], "seg_id", threshold=0.5)


@query(f"""WITH {_FOLD.format(valid=_VALID, words=f'list_distinct({WORDS.format("text")})', t=S.SAME_LINE)}
SELECT novel, chapter_num, seg_id, CAST(row_number() OVER (PARTITION BY novel, chapter_num ORDER BY "index") - 1 AS INTEGER) AS "index" FROM f WHERE kept""")
def dedup_consecutive_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.without_repeated_dialogue(_valid(spark, sf_dir), KEY, ["index"], "seg_id")



@query(f"""WITH RECURSIVE {_VALID}, {CH}, st AS (SELECT novel, chapter_num, list_transform({PARAGRAPHS.format("text")}, lambda p: {PROBE.format("p")}) AS starts FROM ch),
base AS (SELECT ok.*, coalesce(starts, []) AS starts, length(text) AS n, {STRIP.format("text")} AS bare, {PROBE.format("text")} AS probe FROM ok LEFT JOIN st USING (novel, chapter_num)),
f AS (SELECT novel, chapter_num, "index", 0 AS k, "type" AS t, tone AS o, text AS x, 1 AS m FROM base WHERE "index" = 0
  UNION ALL SELECT novel, chapter_num, "index", CASE WHEN j THEN k ELSE k + 1 END, CASE WHEN j THEN t ELSE "type" END, CASE WHEN j THEN o ELSE tone END, CASE WHEN j THEN x || ' ' || bare ELSE text END, CASE WHEN j THEN m + 1 ELSE 1 END FROM (
    SELECT b.*, f.k, f.t, f.o, f.x, f.m, (f.k >= 1 AND b.n < 120 AND b."type" = f.t AND b.tone = f.o AND (length(f.x) < 400 OR NOT list_contains(b.starts, b.probe))) AS j
    FROM f JOIN base b ON b.novel = f.novel AND b.chapter_num = f.chapter_num AND b."index" = f."index" + 1))
SELECT novel, chapter_num, CAST(k AS INTEGER) AS "index", arg_max(t, "index") AS "type", arg_max(o, "index") AS tone, md5(arg_max(x, "index")) AS text_md5, CAST(max(m) AS INTEGER) AS n_merged FROM f GROUP BY novel, chapter_num, k""")
def merge_short_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = S.paragraph_starts(chapters(spark, sf_dir).where("text is not null"), KEY)
    return S.merged(_valid(spark, sf_dir), KEY, ["index"], starts).select(*KEY, "index", "type", "tone", F.md5("text").alias("text_md5"), "n_merged")


_LOW = "lower(src)"
_SNIP = STRIP.format(CLEAN.format("substring(text, 1, 40)"))


@query(f"""WITH {_VALID}, {CH}, p AS (SELECT ok.novel, ok.chapter_num, ok."index", ch.text AS src, {_SNIP} AS probe FROM (SELECT * FROM ok) ok JOIN ch USING (novel, chapter_num)), q AS (
SELECT novel, chapter_num, "index", coalesce({", ".join(f"nullif(CASE WHEN probe <> '' THEN instr({_LOW}, substring(probe, 1, {n})) ELSE 0 END, 0) - 1" for n in (40, 30, 20, 10))}, length(src)) AS position FROM p)
SELECT novel, chapter_num, "index", CAST(row_number() OVER (PARTITION BY novel, chapter_num ORDER BY position, "index") - 1 AS INTEGER) AS new_index FROM q WHERE position IS NOT NULL""".replace("substring(text", "substring(ok.text"))
def repair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = chapters(spark, sf_dir).where("text is not null")
    return S.in_source_order(_valid(spark, sf_dir), sources, KEY, ["index"]).select(*KEY, "index", "new_index")


_SAID = STRIP.format("coalesce(text, '')")
_GAP = "regexp_extract(substring(src, start + 1), '^([^\"]*?)(\"|\\n\\n|\\z)', 1, 's')"
_UNLED = r"regexp_replace({0}, '^[\s,.\-—:;]+', '')".replace("{0}", STRIP.format(_GAP))


@query(f"""WITH RECURSIVE {_VALID}, {CH}, b AS (SELECT ok.novel, ok.chapter_num, ok."index" AS i, ok."type" AS t, coalesce(ch.text, '') AS src, lower(coalesce(ch.text, '')) AS low, {_SAID.replace("text", "ok.text")} AS said, {CLEAN.format("ok.text")} AS bare,
  lead(ok."type") OVER w AS next_type, lower(substring(lead(ok.text) OVER w, 1, 25)) AS next_probe FROM (SELECT * FROM ok) ok JOIN ch USING (novel, chapter_num) WINDOW w AS (PARTITION BY ok.novel, ok.chapter_num ORDER BY ok."index")),
f AS (SELECT DISTINCT novel, chapter_num, CAST(-1 AS INTEGER) AS i, CAST(0 AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS start FROM b
  UNION ALL SELECT novel, chapter_num, i, CASE WHEN pl < 0 THEN cur WHEN q < 0 THEN pl + length(lower(substring(said, 1, 25))) WHEN split THEN q ELSE q + 1 END, CASE WHEN pl >= 0 AND q >= 0 AND NOT split THEN q + 1 END FROM (
    SELECT *, coalesce(next_type = 'dialogue' AND contains(substring(low, pl + length(said) + 1, q - pl - length(said)), next_probe), false) AS split FROM (
      SELECT *, CASE WHEN pl < 0 OR instr(substring(src, pl + length(said) + 1), chr(34)) = 0 THEN -1 ELSE pl + length(said) + instr(substring(src, pl + length(said) + 1), chr(34)) - 1 END AS q FROM (
        SELECT b.*, f.cur, CASE WHEN t <> 'dialogue' OR length(said) < 5 OR instr(substring(low, f.cur + 1), lower(substring(said, 1, 25))) = 0 THEN -1 ELSE f.cur + instr(substring(low, f.cur + 1), lower(substring(said, 1, 25))) - 1 END AS pl
        FROM f JOIN b ON b.novel = f.novel AND b.chapter_num = f.chapter_num AND b.i = f.i + 1)))),
g AS (SELECT f.novel, f.chapter_num, f.i, {STRIP.format(_UNLED)} AS gap FROM f JOIN b USING (novel, chapter_num, i) WHERE start IS NOT NULL),
k AS (SELECT *, array_to_string({TOKENS.format(CLEAN.format("gap"))}[1:5], ' ') AS known_by FROM g WHERE len({TOKENS.format("gap")}) >= 3)
SELECT novel, chapter_num, CAST(i + row_number() OVER (PARTITION BY novel, chapter_num ORDER BY i) AS INTEGER) AS "index", 'narration' AS "type", 'neutral' AS tone, gap AS text, true AS added FROM k
WHERE length(known_by) >= 8 AND NOT EXISTS (SELECT 1 FROM b WHERE b.novel = k.novel AND b.chapter_num = k.chapter_num AND b.i <> k.i AND contains(b.bare, known_by))""")
def inject_narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valid(spark, sf_dir)
    return narration.inject(rows, chapters(spark, sf_dir), KEY, ["index"]).where("added")


_PACK = """RECURSIVE {source}, tok AS (SELECT id, CAST(i AS INTEGER) AS i, t FROM (SELECT id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM src)), f AS (
  SELECT id, i, CAST(0 AS INTEGER) AS k, t AS cur FROM tok WHERE i = 0
  UNION ALL SELECT n.id, n.i, CASE WHEN length(f.cur) + length(n.t) + 1 <= {limit} THEN f.k ELSE f.k + 1 END, CASE WHEN length(f.cur) + length(n.t) + 1 <= {limit} THEN f.cur || ' ' || n.t ELSE n.t END
  FROM f JOIN tok n ON n.id = f.id AND n.i = f.i + 1), c AS (SELECT id, k, arg_max(cur, i) AS cur FROM f GROUP BY id, k)"""


@query("WITH " + _PACK.format(source=f"src AS (SELECT doc_id AS id, {TOKENS.format('text')} AS ts FROM documents WHERE text IS NOT NULL AND length(text) < 3000)", limit=200).replace(" WHERE text IS NOT NULL AND length(text) < 3000", " WHERE text IS NOT NULL") + " SELECT id AS doc_id, CAST(count(*) AS INTEGER) AS n_chunks, CAST(max(length(cur)) AS INTEGER) AS longest FROM c GROUP BY id")
def word_pack_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talesieve.sources.tables import table

    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", chunking.word_chunks(F.col("text"), 200).alias("c")).where("size(c) > 0")
    return rows.select("doc_id", F.size("c").alias("n_chunks"), F.array_max(F.transform("c", F.length)).alias("longest"))


_PIECES = f"""flatten(list_transform(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {STRIP.format("s")} <> ''), lambda s: CASE WHEN length(s) <= 200 THEN [s] ELSE
  flatten(list_transform(string_split(regexp_replace(s, '([,;:—])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda c: CASE WHEN length(c) <= 200 THEN [c] ELSE list_concat([''], {TOKENS.format("c")}) END)) END))"""


@query(f"""WITH RECURSIVE {_VALID}, long AS (SELECT seg_id, {_PIECES} AS ts FROM ok WHERE length(text) > 200), tok AS (SELECT seg_id, unnest(ts) AS p, unnest(range(1, len(ts) + 1)) AS i FROM long),
f AS (SELECT DISTINCT seg_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS k, '' AS cur FROM long
  UNION ALL SELECT t.seg_id, t.i, CASE WHEN t.p <> '' AND length(cur) + length(t.p) + 1 <= 200 OR cur = '' THEN k ELSE k + 1 END,
  CASE WHEN t.p <> '' AND length(cur) + length(t.p) + 1 <= 200 THEN {STRIP.format("cur || ' ' || t.p")} ELSE t.p END FROM f JOIN tok t ON t.seg_id = f.seg_id AND t.i = f.i + 1),
c AS (SELECT seg_id, k, arg_max(cur, i) AS chunk FROM f GROUP BY seg_id, k)
SELECT seg_id, CAST(k AS INTEGER) AS chunk_no, chunk FROM c WHERE {STRIP.format("chunk")} <> '' UNION ALL SELECT seg_id, 0, text FROM ok WHERE length(text) <= 200""")
def greedy_pack_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valid(spark, sf_dir).select("seg_id", F.posexplode(chunking.spoken_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return rows


@query("WITH " + _PACK.format(source=r"src AS (SELECT seg_id AS id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ts FROM segments WHERE text IS NOT NULL AND length(text) > 150)", limit=150) + " SELECT id AS seg_id, CAST(count(*) AS INTEGER) AS n_parts, CAST(max(length(cur)) AS INTEGER) AS longest FROM c GROUP BY id")
def sentence_pack_150(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talesieve.sources.tables import table

    rows = table(spark, sf_dir, "segments").where(F.length("text") > 150).select("seg_id", chunking.sentence_chunks(F.col("text"), 150).alias("c"))
    return rows.select("seg_id", F.size("c").alias("n_parts"), F.array_max(F.transform("c", F.length)).alias("longest"))


@query(f"""SELECT seg_id, round(greatest(1.5, length(text) / 3.0, len({TOKENS.format("text")}) / 1.8), 6) AS longest_seconds FROM segments WHERE text IS NOT NULL""")
def duration_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talesieve.sources.tables import table

    return table(spark, sf_dir, "segments").where("text is not null").select("seg_id", F.round(audio.longest_seconds(F.col("text")), 6).alias("longest_seconds"))


@query(f"""WITH {_VALID}, a AS (SELECT *, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS clean FROM ok), p AS (SELECT *, CASE WHEN length(clean) <= 150 THEN [clean] ELSE string_split(regexp_replace(clean, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS parts FROM a),
q AS (SELECT *, CASE WHEN length(text) <= 200 THEN 'normal' WHEN length(clean) <= 200 THEN 'cleaned' WHEN list_max(list_transform(parts, lambda x: length(x))) <= 250 THEN 'split' ELSE 'placeholder_inserted' END AS strategy FROM p)
SELECT strategy, count(*) AS n FROM q GROUP BY strategy""")
def failure_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches.with_ladder(_valid(spark, sf_dir), X.ascii_only(F.col("text")))
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a labeller, spoilt by chapter number in one of five ways."""
    item = F.struct(F.col("index").cast("int").alias("index"), "speaker", "type", "tone", "text")
    plain = F.max(F.rlike("text", F.lit(r"[\[\]{}\\\\]")).cast("int")) == 0
    rows = _valid(spark, sf_dir).groupBy(*KEY).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("j"), plain.alias("plain"))
    how = F.when(F.col("plain"), F.col("chapter_num") % 5).otherwise(0)
    quoted = F.regexp_replace("j", r'"text":"', '"text":"she said "no" and ')
    raw = F.when(how == 0, F.col("j")).when(how == 1, F.concat(F.lit("```json\n"), F.col("j"), F.lit("\n```"))).when(how == 2, F.concat(F.regexp_replace("j", r"\]\z", ""), F.lit(',{"index": 999, "type": "narr'))).when(how == 3, F.regexp_replace("j", r"\}\]\z", "},]")).otherwise(quoted)
    return rows.select(*KEY, raw.alias("raw"))


@query(f"""WITH {_VALID}, n AS (SELECT novel, chapter_num, count(*) AS n, CASE WHEN max(CASE WHEN regexp_matches(text, '[\\[\\]{{}}\\\\]') THEN 1 ELSE 0 END) = 0 THEN chapter_num % 5 ELSE 0 END AS how, bool_or(regexp_matches(text, '"\\s*,')) AS ends,
  string_agg(text, chr(10) ORDER BY "index") AS texts, string_agg('she said "no" and ' || text, chr(10) ORDER BY "index") AS said FROM ok GROUP BY novel, chapter_num)
SELECT novel, chapter_num, CASE WHEN how = 3 THEN 'repaired' WHEN how < 3 THEN 'ok' WHEN ends THEN 'partial' ELSE 'repaired' END AS status, CAST(n AS INTEGER) AS n_segments, CASE WHEN how < 4 THEN md5(texts) WHEN NOT ends THEN md5(said) END AS texts_md5 FROM n""")
def json_repair_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the texts that came back, where a quote and comma within a text doesn't leave it in pieces."""
    found = jsonrepair.recovered(_responses(spark, sf_dir))
    return found.select(*KEY, "status", F.size("segments").alias("n_segments"), F.when(F.col("status") != "partial", F.md5(F.array_join(F.transform("segments", lambda s: s["text"]), "\n"))).alias("texts_md5"))


@query(f"""WITH {_VALID} SELECT novel, chapter_num, CAST(2 AS INTEGER) AS n_parts, CAST(count(*) AS INTEGER) AS n_segments, md5(string_agg(md5(text), ' ' ORDER BY "index")) AS texts_md5 FROM ok GROUP BY novel, chapter_num HAVING count(*) >= 4""")
def continuation_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays cut in two within an object and put together again."""
    item = F.struct(F.col("index").cast("int").alias("index"), "type", "tone", F.md5("text").alias("text"))
    rows = _valid(spark, sf_dir).groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("a")).where("size(a) >= 4")
    half = F.expr("size(a) div 2")
    first = F.concat(F.regexp_replace(F.to_json(F.slice("a", 1, half)), r"\]\z", ""), F.lit(',{"index": 7, "ty'))
    second = F.concat(F.regexp_replace(F.to_json(F.slice("a", half + 1, F.size("a") - half)), r"^\[", "Here is more: "), F.lit(""))
    parts = rows.select(*KEY, F.posexplode(F.array(first, second)).alias("seq", "raw"))
    whole = jsonrepair.stitched(parts, KEY, "seq")
    return jsonrepair.recovered(whole).select(*KEY, "n_parts", F.size("segments").alias("n_segments"), F.md5(F.array_join(F.transform("segments", lambda s: s["text"]), " ")).alias("texts_md5"))


@query(f"""WITH {_VALID}, {CH}, n AS (SELECT novel, chapter_num, count(*) AS n, CASE WHEN max(CASE WHEN regexp_matches(text, '[\\[\\]{{}}\\\\]') THEN 1 ELSE 0 END) = 0 THEN chapter_num % 5 ELSE 0 END AS how, bool_or(regexp_matches(text, '"\\s*,')) AS ends, list_distinct(flatten(list({WORDS.format("text")}))) AS ws FROM ok GROUP BY novel, chapter_num),
h AS (SELECT novel, chapter_num, n, how, ends, CASE WHEN how = 4 THEN list_concat(ws, ['she', 'said', 'no', 'and']) ELSE ws END AS ws FROM n), c AS (SELECT novel, chapter_num, list_distinct({WORDS.format("coalesce(text, '')")}) AS cw FROM ch)
SELECT novel, chapter_num, CASE WHEN how = 3 THEN 'repaired' WHEN how < 3 THEN 'ok' WHEN ends THEN 'partial' ELSE 'repaired' END AS status, CAST(n AS INTEGER) AS n_segments, CAST(len(cw) AS INTEGER) AS n_source_words, round(CASE WHEN len(cw) = 0 THEN 1.0 ELSE len(list_intersect(cw, ws)) / len(cw) END, 6) AS coverage FROM h LEFT JOIN c USING (novel, chapter_num)""")
def inspect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talesieve.plans import pipelines

    return pipelines.inspected(_responses(spark, sf_dir), chapters(spark, sf_dir), KEY)


@query()
def parse_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chapters through the stand-in labeller: labelled, repaired, narration put in, merged."""
    from talesieve.operators.labelling import offline_labeller
    from talesieve.plans import pipelines

    rows = pipelines.parsed(chapters(spark, sf_dir), KEY, offline_labeller)
    return rows.select(*KEY, "index", "type", F.length("text").alias("n_chars"), "n_merged")


_RATE = 20
_CLEAN_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"


@query("WITH " + _PACK.format(source=f"""{_VALID}, a AS (SELECT *, {_CLEAN_ASCII} AS clean, coalesce(nullif({_CLEAN_ASCII}, ''), text) AS body FROM ok),
src AS (SELECT seg_id AS id, CASE WHEN length(body) <= 150 THEN [body] ELSE string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS ts FROM a)""", limit=150) + f""", p AS (SELECT id, count(*) AS n, max(length(cur)) AS longest, sum(length({STRIP.format('cur')})) AS total, bool_and(regexp_matches(cur, '^[\\x00-\\x7F]*$')) AS plain FROM c GROUP BY id),
w AS (SELECT a.*, p.n, p.total, CASE WHEN text = clean AND length(text) <= 200 THEN 'normal' WHEN clean <> '' AND clean <> text AND length(clean) <= 200 THEN 'cleaned' WHEN n > 1 AND longest <= 200 AND plain THEN 'split' ELSE 'placeholder_inserted' END AS strategy,
  lead("type") OVER (PARTITION BY novel, chapter_num ORDER BY "index") AS next_type FROM a JOIN p ON p.id = a.seg_id),
x AS (SELECT w.*, CASE strategy WHEN 'normal' THEN length({STRIP.format('text')}) WHEN 'cleaned' THEN length({STRIP.format('clean')}) WHEN 'split' THEN total + 2 * (n - 1) ELSE 40 END AS samples, CASE WHEN next_type IS NULL THEN 0 ELSE coalesce(pause_ms, 400) * {_RATE} // 1000 END AS gap
  FROM w LEFT JOIN (VALUES {", ".join(f"('{a}','{b}',{p})" for a, b, p in schema.PAUSES)}) r(a, b, pause_ms) ON w."type" = r.a AND next_type = r.b)
SELECT novel, chapter_num, CAST(10 + sum(samples) + sum(gap) AS BIGINT) AS n_samples, count(*) FILTER (strategy <> 'normal') AS n_fallbacks, count(*) FILTER (strategy = 'placeholder_inserted') AS n_to_fix FROM x GROUP BY novel, chapter_num""")
def chapter_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From segments to WAV files and failure logs with a stand-in for the model."""
    from talesieve.operators.rendering import offline_renderer
    from talesieve.plans import pipelines
    from talesieve.plans.registries import _registry
    from talesieve.sources.tables import table

    files, _, log = pipelines.chapter_audio(_valid(spark, sf_dir), _registry(spark, sf_dir), table(spark, sf_dir, "tone_profiles"), offline_renderer, KEY, "novel", _RATE, X.ascii_only(F.col("text")))
    sizes = files.select(*KEY, ((F.octet_length("content") - 44) / 2).cast("long").alias("n_samples"))
    failed = log.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_fallbacks"), F.count("action").alias("n_to_fix"))
    return sizes.join(failed, KEY, "left").na.fill(0, ["n_fallbacks", "n_to_fix"])


@query(f"""WITH {_VALID}, {CH} SELECT novel, chapter_num, CASE WHEN chapter_num % 4 = 0 THEN 'skipped' WHEN EXISTS (SELECT 1 FROM ok WHERE ok.novel = ch.novel AND ok.chapter_num = ch.chapter_num) THEN 'done' ELSE 'failed' END AS status
FROM ch WHERE chapter_num BETWEEN 2 AND 30""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters 2 to 30 of every novel, each fourth done before; those without a segment come to nothing."""
    from talesieve.plans import pipelines

    rows, valid = chapters(spark, sf_dir), _valid(spark, sf_dir)
    done = rows.where("chapter_num % 4 = 0").select(*KEY)
    return pipelines.batch_run(rows, done, KEY, lambda waiting: valid.join(waiting.select(*KEY), KEY, "left_semi"), 2, 30)[0]
