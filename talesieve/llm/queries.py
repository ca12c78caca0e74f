"""The pN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talesieve.llm import boilerplate, bpe, canonical, cutoff, lookalike, mojibake, names, packing, sentences, spans
from talesieve.llm.arrowrun import records
from talesieve.llm.meanings import SAME_MEANING
from talesieve.sources.tables import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking_pairs(records(spark, sf_dir, "novel", "chapter_num"), "rec_kind", "rec_id", ["novel", "chapter_num"])


@query
def p7_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = lookalike.canonical_forms(records(spark, sf_dir), ["rec_kind", "rec_id"])
    return forms.select("rec_kind", "rec_id", "canonical", "repaired")


def _pooled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters").select(F.lit("chapter").alias("rec_kind"), F.col("chapter_id").alias("rec_id"), F.col("site").alias("pool"), "text")
    segments = table(spark, sf_dir, "segments").select(F.lit("segment").alias("rec_kind"), F.col("seg_id").alias("rec_id"), F.col("source").alias("pool"), "text")
    return chapters.unionByName(segments)


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.chain_posteriors(_pooled_records(spark, sf_dir), ["rec_kind", "rec_id"], ["rec_kind", "pool"]).select("rec_kind", "rec_id")


@query
def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored(_pooled_records(spark, sf_dir), ["rec_kind", "rec_id"], ["rec_kind", "pool"])


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, sf_dir, "chapters"), "chapter_id", "site")


@query
def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.without_repeated_lines(table(spark, sf_dir, "chapters"), "chapter_id", "site")


@query
def p5_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boilerplate.frequent_sequences(table(spark, sf_dir, "chapters"), "site")
    return found.select("site", F.array_join("pattern", " ").alias("pattern"), "n_rows")


_P5_LINES = """
WITH line AS (
  SELECT chapter_id, site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM chapters
), keyed AS (
  SELECT chapter_id, site, line_no, line, regexp_replace(lower(line), '[\\s\\p{Z}\\p{Nd}\\x{1C}-\\x{1F}\\x{85}]+', '', 'g') AS k,
         regexp_replace(line, '[\\s\\p{Z}\\x{1C}-\\x{1F}\\x{85}]+', '', 'g') <> '' AS filled FROM line
), frequent AS (
  SELECT k.site, k.k FROM keyed k JOIN (SELECT site, count(*) AS n_all FROM chapters GROUP BY site) s ON k.site IS NOT DISTINCT FROM s.site
  WHERE k.filled GROUP BY k.site, k.k, s.n_all HAVING count(DISTINCT k.chapter_id) >= 3 AND count(DISTINCT k.chapter_id) >= 0.03 * s.n_all
)
"""
ORACLES["p5_found"] = _P5_LINES + "SELECT k.chapter_id, CAST(k.line_no AS INTEGER) AS line_no FROM keyed k JOIN frequent f ON k.site IS NOT DISTINCT FROM f.site AND k.k = f.k WHERE k.filled"


ORACLES["p5_sequences"] = (
    _P5_LINES.replace("WITH line", "WITH RECURSIVE line")
    + """, sizes AS (SELECT site, count(*) AS n_all FROM chapters GROUP BY site),
seq AS (SELECT k.chapter_id, k.site, k.line_no, md5(k.k) AS k, n_all FROM keyed k JOIN frequent f ON k.site IS NOT DISTINCT FROM f.site AND k.k = f.k JOIN sizes s ON k.site IS NOT DISTINCT FROM s.site WHERE k.filled),
held AS (SELECT chapter_id, site, n_all, k AS pattern, min(line_no) AS pos FROM seq GROUP BY ALL UNION ALL
  SELECT chapter_id, site, n_all, pattern, pos FROM (SELECT *, count(*) OVER (PARTITION BY site, pattern) AS n FROM (
    SELECT h.chapter_id, h.site, h.n_all, h.pattern || ' ' || s.k AS pattern, min(s.line_no) AS pos FROM held h JOIN seq s ON s.chapter_id = h.chapter_id AND s.line_no > h.pos GROUP BY ALL)) WHERE n >= 3 AND n >= 0.03 * n_all)
SELECT site, pattern, count(*) AS n_rows FROM held GROUP BY site, pattern"""
)


def _lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"tone": table(spark, sf_dir, "tone_profiles"), "type": table(spark, sf_dir, "segment_types")}


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_rows(table(spark, sf_dir, "segments"), "seg_id", _lists(spark, sf_dir), SAME_MEANING)


@query
def p4_by_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p4_found``, by form alone: without words of the same meaning."""
    return canonical.map_rows(table(spark, sf_dir, "segments"), "seg_id", _lists(spark, sf_dir))


@query
def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no entry, with their rows."""
    segments = table(spark, sf_dir, "segments")
    found = p4_found(spark, sf_dir).where("canonical = 'unmatched'")
    typed = segments.select("seg_id", F.explode(F.map_from_arrays(F.array(F.lit("tone"), F.lit("type")), F.array("tone", "type"))).alias("field", "value"))
    return typed.join(found, ["seg_id", "field"]).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "segments").select("novel", F.col("speaker").alias("name")).distinct()
    keys = table(spark, sf_dir, "speakers").select(F.regexp_extract("novel_dir", "([^/]*)$", 1).alias("novel"), F.explode(F.map_keys("characters")).alias("name"))
    return typed.unionByName(keys)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked_pairs(_spellings(spark, sf_dir), "novel", "name")


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters").select(F.lit("chapter").alias("rec_kind"), F.col("chapter_id").alias("rec_id"), F.lit("line").alias("heading"), "text")
    segments = table(spark, sf_dir, "segments").select(F.lit("segment").alias("rec_kind"), F.col("seg_id").alias("rec_id"), F.when(F.col("index") == 0, "all").otherwise("none").alias("heading"), "text")
    # chapters train the models: their lines are whole
    return sentences.split_texts(chapters.unionByName(segments), ["rec_kind", "rec_id"], heading="heading", training=chapters)


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_texts(table(spark, sf_dir, "segments"), table(spark, sf_dir, "chapters"), ["novel", "chapter_num"], "index", "seg_id")


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select("seg_id")


@query
def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut segments of each source."""
    segments = table(spark, sf_dir, "segments").select("seg_id", "source")
    marked = segments.join(_cut(spark, sf_dir).select("seg_id", F.lit(1).alias("cut")), "seg_id", "left")
    return marked.groupBy("source").agg(F.count(F.lit(1)).alias("n_segments"), F.count("cut").alias("n_cut"), F.round(F.count("cut") / F.count(F.lit(1)), 6).alias("share"))


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "documents"))


@query
def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_shares(table(spark, sf_dir, "documents"))


@query
def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("cluster"), "text")
    return packing.pack(bpe.token_lengths(documents), "doc_id", "n_tokens", "source", "cluster")


@query
def p9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, beside the least number that could hold as much."""
    held = p9_containers(spark, sf_dir).where("container is not null").groupBy("container").agg(F.sum("length").alias("held"), F.max("beside").alias("mixed"))
    return held.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("held").alias("n_tokens"), F.ceil(F.sum("held") / packing.CAPACITY).alias("least_containers"), F.round(F.sum("held") / (F.count(F.lit(1)) * packing.CAPACITY), 6).alias("used"), F.sum(F.col("mixed").cast("int")).alias("n_same_source"))


@query
def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the layout: documents laid out, those without room, and the cases of each rule that is broken."""
    laid = materialise(p9_containers(spark, sf_dir))
    sizes = bpe.token_lengths(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = laid.groupBy("doc_id").agg(F.sum("length").alias("held"), F.count(F.lit(1)).alias("n_pieces"), F.count("container").alias("n_placed"))
    parts = [sizes.join(of, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("n_placed") == 0).alias("n_without_room"), F.count_if(~F.col("held").eqNullSafe(F.col("n_tokens").cast("long"))).alias("n_not_covered"),
        F.count_if((F.col("n_pieces") > 1) & (F.col("n_tokens") <= packing.CAPACITY)).alias("n_split_short"))]
    parts.append(laid.where("container is not null").groupBy("container").agg(F.sum("length").alias("held")).agg(F.count_if(F.col("held") > packing.CAPACITY).alias("n_overfull")))
    clusters = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("cluster"))
    parts.append(laid.where("container is not null").select("container", "doc_id").distinct().join(clusters, "doc_id").groupBy("container", "cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_copies_together")))
    rows = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


ORACLES["p9_checks"] = """SELECT count(*) AS n_documents, count(*) FILTER (coalesce(text, '') = '') AS n_without_room, CAST(0 AS BIGINT) AS n_not_covered, CAST(0 AS BIGINT) AS n_split_short,
CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_copies_together FROM documents"""
ORACLES["p5_clean"] = (
    _P5_LINES
    + """, kept AS (SELECT k.chapter_id, k.line_no, k.line, k.filled AND f.k IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.site IS NOT DISTINCT FROM f.site AND k.k = f.k AND k.filled),
t AS (SELECT chapter_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text, CAST(count(*) FILTER (gone) AS INTEGER) AS n_deleted FROM kept GROUP BY chapter_id)
SELECT c.chapter_id, t.text, coalesce(n_deleted, 0) AS n_deleted FROM chapters c LEFT JOIN t USING (chapter_id)"""
)
_P10_WINDOWS = """
WITH long AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200), w AS (SELECT doc_id, i, md5(substring(text, i, 200)) AS h FROM long)
"""
ORACLES["p10_found"] = _P10_WINDOWS + ", d AS (SELECT DISTINCT doc_id, h FROM w) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id"
ORACLES["p10_shares"] = (
    _P10_WINDOWS
    + """, several AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), hit AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM w SEMI JOIN several USING (h)),
s AS (SELECT doc_id, sum(least(200, coalesce(following - i, 200))) AS n FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, coalesce(round(n / nullif(length(text), 0), 6), 0.0) AS share FROM documents d LEFT JOIN s USING (doc_id)"""
)
