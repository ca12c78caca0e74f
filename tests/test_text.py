import pytest
from pyspark.sql import functions as F

from talesieve.functions import audio, ranges
from talesieve.functions import text as X


def one(spark, expression, *values):
    return spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(("said", "spoken"), [("w-who goes", "who goes"), ("I-I know", "I know"), ("no-no-no way", "no way"), ("Ah the Saint!", "Ah, the Saint"), ("Oh no!", "Oh, no"), ("[Sys] go,,; now", "Sys go; now"), ("été-été fin.", "t fin"), ("", ""), ("a\n", "a")])
def test_spoken_form(spark, said, spoken):
    assert one(spark, X.spoken_form(F.col("c0")), said) == spoken


@pytest.mark.parametrize(("message", "seconds"), [("try again in 12.5s", 12.5), ("in 1m30s", 90.0), ("retry after 45.2s", 45.2), ("in 2m", 120.0), ("whatever", 30.0)])
def test_wait_seconds(spark, message, seconds):
    assert one(spark, X.wait_seconds(F.col("c0")), message) == seconds


def test_words_and_overlap(spark):
    assert one(spark, X.words(F.col("c0")), "Café—au lait, AU lait!") == ["caféau", "lait", "au", "lait"]
    assert one(spark, X.overlap(X.word_set(F.col("c0")), X.word_set(F.col("c1"))), "a b c", "a b c d") == 1.0
    assert one(spark, X.overlap(X.word_set(F.col("c0")), X.word_set(F.col("c1"))), "", "a") == 0.0


def test_splitting(spark):
    assert one(spark, X.paragraphs(F.col("c0")), "\n a \n\n\n b\nc \n\n") == ["a", "b\nc"]
    assert one(spark, X.sentences(F.col("c0")), "One. Two! Three") == ["One.", "Two!", "Three"]
    assert one(spark, X.quote_aware_sentences(F.col("c0")), '"One." Two') == ['"One.', "Two"]
    assert one(spark, X.fingerprint(F.col("c0")), " Ab, c! ") == "ab c"


def test_names_and_paths(spark):
    assert one(spark, X.slug(F.col("c0")), " Shadow Slave ") == "shadow_slave"
    assert one(spark, X.title_of_slug(F.col("c0")), "shadow_slave") == "Shadow Slave"
    assert one(spark, X.novel_of_path(F.col("c0")), "novels/x_y/input/chapter_12.txt") == "x_y"
    assert one(spark, X.chapter_of_path(F.col("c0")), "novels/x_9/input/chapter_12.txt") == 12
    assert one(spark, X.chapter_of_path(F.col("c0")), "novels/x_9/input/notes.txt") == 0
    assert one(spark, X.without_fences(F.col("c0")), "```json\n[1]\n```") == "[1]\n"


def test_bar_keeps_long_labels(spark):
    assert one(spark, X.bar(F.col("c0"), F.col("c1"), F.lit(4)), "x" * 30, 2).startswith("x" * 30 + " " + "█" * 10 + "░" * 10)


@pytest.mark.parametrize(("text", "single", "bounds"), [("101", "exact", (101, 101)), ("101-200", "exact", (101, 200)), ("101-", "exact", (101, None)), ("-5", "exact", (1, 5)), ("10", "upto", (1, 10))])
def test_ranges(text, single, bounds):
    assert ranges.parse_range(text, single) == bounds


def test_bad_range():
    with pytest.raises(ValueError):
        ranges.parse_range("-")


def test_retry_delays():
    assert ranges.retry_delays(3) == [10, 20, 30] and ranges.retry_delays(70)[-1] == 600


def test_audio(spark):
    row = spark.range(1).select(audio.pcm16(F.array(F.lit(0.5), F.lit(-1.5), F.lit(2.0))).alias("a"), audio.placeholder().alias("p"), audio.at_speed(F.array(*[F.lit(float(i)) for i in range(11)]), F.lit(2.0)).alias("s")).first()
    assert row.a == [16383, -32768, 32767]
    assert len(row.p) == 48000 and row.p[24000] == 0.0 and max(row.p[:1920]) > 0.1 and max(row.p[-1920:]) > 0.1
    assert row.s == [0.0, 2.5, 5.0, 7.5, 10.0]
