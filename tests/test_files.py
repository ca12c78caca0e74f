import json

from pyspark.sql import functions as F

from talesieve.sources import files, sinks
from talesieve.streaming.incremental import run_new_files


def test_chapter_files(spark, tmp_path):
    folder = tmp_path / "novels" / "some_novel" / "input"
    folder.mkdir(parents=True)
    for n, text in ((2, "two\n\nlines"), (10, "ten")):
        (folder / f"chapter_{n}.txt").write_text(text)
    (folder / "notes.txt").write_text("no chapter")
    rows = files.chapters(spark, str(tmp_path / "novels")).orderBy("chapter_num").collect()
    assert [(r.novel, r.chapter_num, r.text) for r in rows] == [("some_novel", 2, "two\n\nlines"), ("some_novel", 10, "ten")]


def test_registry_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"characters": {"idan": {"xtts_speaker": "V", "gender": "male"}, "x": {"xtts_speaker": "W"}}, "dormant_voices": {}}, indent=1))
    (tmp_path / "b.json").write_text("{}")
    df = files.registries(spark, str(tmp_path))
    assert sorted(len(r.characters) for r in df.collect()) == [0, 2]
    kept = sinks.without_keys(df, ["idan", "nobody"])
    assert sorted((len(r.characters), r.n_removed) for r in kept.collect()) == [(0, 0), (1, 1)]
    sinks.registry(kept, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_checkpoint_and_sinks(spark, tmp_path):
    (tmp_path / "done.json").write_text(json.dumps({"completed": ["a", "b", "a"]}))
    assert files.checkpoint(spark, str(tmp_path / "done.json")).count() == 2
    df = spark.createDataFrame([(1, "x"), (2, "y")], "chapter_num int, text string")
    sinks.chapters(df, str(tmp_path / "ch"))
    assert spark.read.parquet(str(tmp_path / "ch")).where("chapter_num = 2").first().text == "y"
    assert sinks.versioned(df, str(tmp_path / "v"), "20250101").endswith("version=20250101")
    sinks.failures(df, str(tmp_path / "f"))
    sinks.failures(df, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 4
    sinks.dead_letters(df, str(tmp_path / "d"), "bad")
    assert spark.read.parquet(str(tmp_path / "d")).first().reason == "bad"


def test_voice_catalogue(spark, tmp_path):
    (tmp_path / "voices.md").write_text("# Voices\n\n## Female voices\n\n### Ada Low\n- Age: adult\n- Best for: villains\n\n## Male voices\n\n### Bo\n- Tone: dry\n")
    rows = files.voice_catalogue(spark, str(tmp_path / "voices.md")).orderBy("pos").collect()
    assert [(r.name, r.gender, r.age, r.tone, r.best_for) for r in rows] == [("Ada Low", "female", "adult", None, "villains"), ("Bo", "male", None, "dry", None)]


def test_stream_reads_new_files_only(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = spark.range(3).withColumn("x", F.lit("a"))
    first.write.parquet(f"{source}/1")
    once = lambda: run_new_files(spark, f"{source}/*", first, target, state, lambda b: b)
    assert once().count() == 3
    assert once().count() == 3
    spark.range(3, 5).withColumn("x", F.lit("b")).write.parquet(f"{source}/2")
    assert once().count() == 5
