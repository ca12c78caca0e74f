"""How much of a source text its segments hold. Three measures, which differ in what they compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talesieve.functions import text as X


def set_share(source: Column, held: Column) -> Column:
    """Share of a set's members that the other one holds; 1 for an empty set."""
    return F.when(F.size(source) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(source, held)) / F.size(source))


def segment_words(segments: DataFrame, key: list[str]) -> DataFrame:
    """Distinct words of all segments of a key. Words are made distinct before the shuffle and by hash aggregation."""
    words = segments.select(*key, F.explode(X.word_set(F.coalesce("text", F.lit("")))).alias("w")).distinct()
    return words.groupBy(*key).agg(F.collect_list("w").alias("held"))


def word_coverage(sources: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """``key, n_source_words, coverage`` by word sets without punctuation."""
    joined = sources.select(*key, X.word_set(F.coalesce("text", F.lit(""))).alias("ws")).join(segment_words(segments, key), key, "left")
    return joined.select(*key, F.size("ws").alias("n_source_words"), F.round(set_share(F.col("ws"), F.coalesce("held", F.array().cast("array<string>"))), 6).alias("coverage"))


def sentence_buckets(sources: DataFrame, segments: DataFrame, key: list[str], missing_below: float = 0.5, partial_below: float = 0.85) -> DataFrame:
    """``key, total, covered, partial, missing``: sentences by the share of their words that any segment holds."""
    sentences = sources.select(*key, F.explode(X.quote_aware_sentences(F.coalesce("text", F.lit("")))).alias("s"))
    ratio = sentences.join(segment_words(segments, key), key, "left").select(*key, F.size(X.words(F.col("s"))).alias("n"), set_share(X.word_set(F.col("s")), F.coalesce("held", F.array().cast("array<string>"))).alias("r"))
    bucket = F.when(F.col("n") < 3, "covered").when(F.col("r") < missing_below, "missing").when(F.col("r") < partial_below, "partial").otherwise("covered")
    count = lambda b: F.count_if(F.col("b") == b).alias(b)
    return ratio.withColumn("b", bucket).groupBy(*key).agg(F.count(F.lit(1)).alias("total"), count("covered"), count("partial"), count("missing"))


def joined_segments(segments: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One text of a key's segments in order."""
    texts = F.sort_array(F.collect_list(F.struct(*order, F.coalesce("text", F.lit("")).alias("t"))))
    return segments.groupBy(*key).agg(F.array_join(F.transform(texts, lambda x: x["t"]), " ").alias("joined"))


def missing_paragraphs(sources: DataFrame, segments: DataFrame, key: list[str], order: list[str], least_words: int = 0, probe: int = 50) -> DataFrame:
    """``key, para_no, n_sentences, n_missing``: paragraphs with a sentence (of three words) whose beginning no segment holds."""
    held = joined_segments(segments, key, order).select(*key, X.no_punctuation(F.lower("joined")).alias("held"))
    paras = sources.select(*key, F.posexplode(X.paragraphs(F.coalesce("text", F.lit("")))).alias("para_no", "para")).where(F.size(X.tokens(F.col("para"))) >= least_words)
    # exploded within the row: the held text is joined once per source, before
    with_held = paras.join(held, key, "left")
    long_enough = F.filter(F.transform(X.sentences(F.col("para")), X.strip), lambda s: F.size(X.tokens(s)) >= 3)
    start = lambda s: X.strip(F.substring(X.no_punctuation(F.lower(s)), 1, probe))
    gone = F.filter(long_enough, lambda s: (start(s) != "") & ~F.coalesce(F.contains(F.col("held"), start(s)), F.lit(False)))
    return with_held.select(*key, "para_no", F.size(long_enough).alias("n_sentences"), F.size(gone).alias("n_missing")).where("n_missing > 0")


def word_count_ratio(sources: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """Words of the segments as a percentage of those of the source; may exceed 100."""
    n = lambda c: F.size(X.tokens(F.coalesce(c, F.lit(""))))
    a = sources.groupBy(*key).agg(F.sum(n("text")).alias("source_words"))
    b = segments.groupBy(*key).agg(F.sum(n("text")).alias("segment_words"))
    return a.join(b, key, "left").select(*key, "source_words", F.coalesce("segment_words", F.lit(0)).alias("segment_words"), F.round(F.coalesce("segment_words", F.lit(0)) * 100 / F.nullif(F.col("source_words"), F.lit(0)), 1).alias("pct"))
