"""Queries over chapters and documents: scans, word sets, coverage, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talesieve.functions import ranges
from talesieve.functions import text as X
from talesieve.operators import batches, coverage, web
from talesieve.operators.segments import paragraph_starts
from talesieve.plans.catalogue import CH, CLEAN, PARAGRAPHS, PROBE, SG, STRIP, TOKENS, WORDS, query
from talesieve.plans.inputs import chapters, segments
from talesieve.sources.tables import table

KEY = ["novel", "chapter_num"]


@query("SELECT chapter_id, novel, chapter_num FROM chapters WHERE chapter_num BETWEEN 3 AND 12")
def chapter_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chapters").select("chapter_id", "novel", "chapter_num")
    return rows.where(ranges.in_range(F.col("chapter_num"), ranges.parse_range("3-12")))


@query("SELECT chapter_id, regexp_extract(path, '([^/]+)/input/[^/]+$', 1) AS novel_dir, CAST(regexp_extract(path, '([0-9]+)[^/]*$', 1) AS INTEGER) AS number FROM chapters")
def chapter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("chapter_id", X.novel_of_path(F.col("path")).alias("novel_dir"), X.chapter_of_path(F.col("path")).alias("number"))


@query(f"WITH {CH} SELECT novel, count(*) AS n, md5(string_agg(repeat('─', 60) || chr(10) || 'CHAPTER ' || chapter_num || chr(10) || coalesce(text, ''), chr(10) ORDER BY chapter_num)) AS book_md5 FROM ch GROUP BY novel")
def chapter_concat_by_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("─" * 60 + "\nCHAPTER "), F.col("chapter_num"), F.lit("\n"), F.coalesce("text", F.lit("")))
    pages = F.transform(F.sort_array(F.collect_list(F.struct("chapter_num", page.alias("p")))), lambda x: x["p"])
    return chapters(spark, sf_dir).groupBy("novel").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(pages, "\n")).alias("book_md5"))


@query("SELECT novel, max(chapter_num) + 1 AS next_number FROM chapters GROUP BY novel")
def next_free_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.next_number(table(spark, sf_dir, "chapters"), ["novel"])


@query("SELECT chapter_id FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.novel = c.novel AND s.chapter_num = c.chapter_num AND s.source IN ('rescue', 'fallback'))")
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "segments").where(F.col("source").isin("rescue", "fallback"))
    return batches.pending(table(spark, sf_dir, "chapters"), done, KEY).select("chapter_id")


@query("SELECT novel, chapter_num FROM segments WHERE source = 'rescue' UNION SELECT novel, chapter_num FROM chapters WHERE text IS NULL")
def checkpoint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "segments").where("source = 'rescue'")
    return batches.checkpoint_after(done, table(spark, sf_dir, "chapters").where("text is null"), KEY)


@query(f"SELECT doc_id, CAST(len(list_distinct({WORDS.format('text')})) AS INTEGER) AS n_distinct, CAST(len({WORDS.format('text')}) AS INTEGER) AS n_words FROM documents WHERE text IS NOT NULL")
def word_set_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(X.word_set(F.col("text"))).alias("n_distinct"), F.size(X.words(F.col("text"))).alias("n_words"))


@query("SELECT source, lang, count(*) AS n_documents, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, max(n_chars) AS longest FROM documents GROUP BY source, lang")
def document_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"), F.sum(F.col("text").isNull().cast("int")).alias("n_null"), F.max("n_chars").alias("longest"))


_HELD = f"held AS (SELECT novel, chapter_num, list_distinct(flatten(list({WORDS.format("coalesce(text, '')")}))) AS ws FROM sg GROUP BY ALL)"


@query(f"""WITH {CH}, {SG}, {_HELD}, c AS (SELECT novel, chapter_num, list_distinct({WORDS.format("coalesce(text, '')")}) AS ws FROM ch)
SELECT novel, chapter_num, CAST(len(c.ws) AS INTEGER) AS n_source_words, round(CASE WHEN len(c.ws) = 0 THEN 1.0 ELSE len(list_intersect(c.ws, coalesce(held.ws, []))) / len(c.ws) END, 6) AS coverage FROM c LEFT JOIN held USING (novel, chapter_num)""")
def chapter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.word_coverage(chapters(spark, sf_dir), segments(spark, sf_dir), KEY)


@query(f"""WITH {CH}, {SG}, {_HELD}, s AS (SELECT novel, chapter_num, unnest(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])["'']?\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format("x")}), lambda x: x <> '')) AS s FROM ch),
r AS (SELECT novel, chapter_num, len({WORDS.format("s")}) AS n, CASE WHEN len(list_distinct({WORDS.format("s")})) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({WORDS.format("s")}), coalesce(ws, []))) / len(list_distinct({WORDS.format("s")})) END AS r FROM s LEFT JOIN held USING (novel, chapter_num)),
b AS (SELECT *, CASE WHEN n < 3 THEN 'covered' WHEN r < 0.5 THEN 'missing' WHEN r < 0.85 THEN 'partial' ELSE 'covered' END AS b FROM r)
SELECT novel, chapter_num, count(*) AS total, count(*) FILTER (b = 'covered') AS covered, count(*) FILTER (b = 'partial') AS partial, count(*) FILTER (b = 'missing') AS missing FROM b GROUP BY ALL""")
def sentence_coverage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.sentence_buckets(chapters(spark, sf_dir), segments(spark, sf_dir), KEY)


@query(f"""WITH {CH}, {SG}, a AS (SELECT novel, chapter_num, sum(len({TOKENS.format("coalesce(text, '')")})) AS a FROM ch GROUP BY ALL), b AS (SELECT novel, chapter_num, sum(len({TOKENS.format("coalesce(text, '')")})) AS b FROM sg GROUP BY ALL)
SELECT novel, chapter_num, CAST(a AS BIGINT) AS source_words, CAST(coalesce(b, 0) AS BIGINT) AS segment_words, round(coalesce(b, 0) * 100 / nullif(a, 0), 1) AS pct FROM a LEFT JOIN b USING (novel, chapter_num)""")
def word_count_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.word_count_ratio(chapters(spark, sf_dir), segments(spark, sf_dir), KEY)




@query(f"""WITH {CH}, {SG}, j AS (SELECT novel, chapter_num, {CLEAN.format("string_agg(coalesce(text, ''), ' ' ORDER BY \"index\", seg_id)")} AS held FROM sg GROUP BY ALL),
p AS (SELECT novel, chapter_num, unnest({PARAGRAPHS.format("coalesce(text, '')")}) AS para, unnest(range(len({PARAGRAPHS.format("coalesce(text, '')")}))) AS para_no FROM ch),
s AS (SELECT novel, chapter_num, para_no, unnest(string_split(regexp_replace(para, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM p),
q AS (SELECT novel, chapter_num, para_no, {STRIP.format("substring(" + CLEAN.format(STRIP.format("s")) + ", 1, 50)")} AS probe FROM s WHERE len({TOKENS.format("s")}) >= 3)
SELECT novel, chapter_num, CAST(para_no AS INTEGER) AS para_no, CAST(count(*) AS INTEGER) AS n_sentences, CAST(sum(CASE WHEN probe <> '' AND NOT coalesce(contains(held, probe), false) THEN 1 ELSE 0 END) AS INTEGER) AS n_missing
FROM q LEFT JOIN j USING (novel, chapter_num) GROUP BY novel, chapter_num, para_no HAVING sum(CASE WHEN probe <> '' AND NOT coalesce(contains(held, probe), false) THEN 1 ELSE 0 END) > 0""")
def missing_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.missing_paragraphs(chapters(spark, sf_dir), segments(spark, sf_dir), KEY, ["index", "seg_id"])


@query(f"WITH {CH}, p AS (SELECT DISTINCT novel, chapter_num, unnest(list_transform({PARAGRAPHS.format('text')}, lambda p: {PROBE.format('p')})) AS fingerprint FROM ch) SELECT * FROM p")
def paragraph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = paragraph_starts(chapters(spark, sf_dir).where("text is not null"), KEY)
    return starts.select(*KEY, F.explode("starts").alias("fingerprint"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS n_ascii, md5(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS ascii_md5 FROM documents WHERE text IS NOT NULL")
def ascii_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(X.ascii_only(F.col("text"))).cast("long").alias("n_ascii"), F.md5(X.ascii_only(F.col("text"))).alias("ascii_md5"))


@query()
def tts_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "segments").where("text is not null").select("seg_id", X.spoken_form(F.col("text")).alias("spoken"))


@query("SELECT seg_id, md5(translate(text, '“”{}', '\"\"\"\"')) AS straight_md5 FROM segments WHERE text IS NOT NULL")
def quote_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "segments").where("text is not null").select("seg_id", F.md5(X.straight_quotes(F.col("text"))).alias("straight_md5"))


_PAGE = "'<html><head><title>t</title><script>var x = 1;</script></head><body><nav>Home</nav><article><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p><p>') || '</p><canvas>c</canvas><div class=\"share\"><div>Share <b>this</b></div></div></article><div class=\"comments\">First!</div><div id=\"site-modal\"><p>Join us</p></div><ul class=\"top-menu\"><li>All</li></ul><p class=\"recommended\">More</p><footer>(c)</footer></body></html>'"


@query(rf"""SELECT chapter_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format("x")}), lambda x: x <> ''), chr(10))) AS text_md5 FROM chapters WHERE text IS NOT NULL AND {STRIP.format("text")} <> ''""")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of the chapters give the chapters' lines back, without the noise around and within them."""
    pages = table(spark, sf_dir, "chapters").where("text is not null").where(X.strip(F.col("text")) != "").select("chapter_id", F.expr(_PAGE.replace("chr(10)", "'\\n'")).alias("html"))
    return web.pages_text(pages).select("chapter_id", F.md5("text").alias("text_md5"))


_LINES = rf"list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {STRIP.format('x')})"


_SINGLE = STRIP.format(rf"regexp_replace(array_to_string({_LINES}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(rf"""WITH a AS (SELECT chapter_id, string_split(translate({_SINGLE}, '“”{{}}', repeat(chr(34), 4)), chr(10)) AS ls FROM chapters WHERE text IS NOT NULL),
b AS (SELECT *, list_filter(range(len(ls)), lambda i: regexp_matches(ls[i + 1], '(?i)^\s*Chapter\s+\d+')) AS ix FROM a),
c AS (SELECT chapter_id, string_split({STRIP.format("array_to_string(CASE WHEN len(ix) = 0 THEN ls WHEN lower(ls[ix[1] + 1]) = lower(ls[ix[len(ix)] + 1]) THEN ls[ix[len(ix)] + 1:] ELSE ls[ix[1] + 1:] END, chr(10))")}, chr(10)) AS ls FROM b),
d AS (SELECT chapter_id, array_to_string(ls[1:coalesce(list_max(list_filter(range(1, len(ls) + 1), lambda i: {STRIP.format("ls[i]")} <> '' AND NOT regexp_matches({STRIP.format("ls[i]")}, '{web.BELOW}'))), 0)], chr(10)) AS t FROM c)
SELECT chapter_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM d""")
def html_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' texts hold no heading of an author's part, so the SQL only has the site's lines at the end."""
    rows = table(spark, sf_dir, "chapters").where("text is not null").select("chapter_id", web.cleaned(F.col("text")).alias("t"))
    return rows.select("chapter_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT novel, chapter_num FROM chapters), f AS (SELECT novel, chapter_num, 1 AS depth FROM (SELECT novel, min(chapter_num) AS chapter_num FROM p GROUP BY novel)
UNION ALL SELECT f.novel, p.chapter_num, f.depth + 1 FROM f JOIN p ON p.novel = f.novel AND p.chapter_num = f.chapter_num + 1 WHERE f.depth < 8)
SELECT novel || '/' || 'chapter_' || chapter_num AS url, depth FROM f""")
def next_page_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "chapters").select(*KEY).distinct()
    url = lambda n: F.concat(F.col("novel"), F.lit("/chapter_"), n)
    linked = pages.select(url(F.col("chapter_num")).alias("url"), url(F.col("chapter_num") + 1).alias("next_url"))
    starts = pages.groupBy("novel").agg(F.min("chapter_num").alias("n")).select(url(F.col("n")).alias("url"))
    return web.followed(linked, starts, 8).select("url", "depth")


@query(f"""WITH s AS (SELECT source, novel, chapter_num, len({TOKENS.format("coalesce(text, '')")}) AS w FROM segments), r AS (SELECT source, novel, chapter_num, sum(w) AS words, sum(w) * 0.4 + 2 AS seconds FROM s GROUP BY ALL)
SELECT source, count(*) AS n_runs, CAST(sum(words) AS BIGINT) AS words, round(sum(words) * 60 / sum(seconds), 2) AS words_per_minute, round(sum(seconds) / 3600, 4) AS hours FROM r GROUP BY source""")
def run_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talesieve.operators.timeline import throughput

    runs = table(spark, sf_dir, "segments").groupBy("source", *KEY).agg(F.sum(F.size(X.tokens(F.coalesce("text", F.lit(""))))).alias("words"))
    return throughput(runs.withColumn("seconds", F.col("words") * 0.4 + 2), ["source"])


@query("SELECT source, count(*) AS n_calls, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(length(text) // 4) AS BIGINT) AS output_tokens, CAST(sum(length(text) + length(text) // 4) AS BIGINT) AS total_tokens FROM segments WHERE text IS NOT NULL GROUP BY source")
def token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "segments").where("text is not null").select("source", F.length("text").cast("long").alias("i"), F.expr("length(text) div 4").alias("o"))
    return calls.groupBy("source").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum(F.col("i") + F.col("o")).alias("total_tokens"))
