import io
import wave

import numpy as np
from pyspark.sql import functions as F

from talesieve.operators import labelling, waves
from talesieve.plans import pipelines

TEXT = 'The bell rang. "I will go," she said, and took the lamp.\n\nNobody moved for an hour. The gate was shut.'


def test_labeller_runs_per_batch(spark):
    df = spark.createDataFrame([(1, TEXT)], "ch int, text string").select("ch", labelling.prompt(F.col("text")).alias("prompt"))
    assert '"dialogue"' in labelling.labelled(df, labelling.offline_labeller).first().raw
    assert spark.range(1).select(labelling.profile(F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.lit("Unknown")))).first()[0] == "  b: x"


def test_parsed_covers_its_chapters(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "One line only.")], "ch int, text string")
    rows = pipelines.parsed(df, ["ch"], labelling.offline_labeller).orderBy("ch", "index").collect()
    assert {r.ch for r in rows} == {1, 3}
    held = " ".join(r.text for r in rows if r.ch == 1)
    assert all(w in held for w in TEXT.replace("\n", " ").replace('"', "").replace(",", "").split() if w.isalpha())


def test_missing_paragraphs_are_asked_for_again(spark):
    def forgetful():
        import json

        from talesieve.operators.labelling import offline_labeller

        whole = offline_labeller()

        def label(prompts):
            answers = [json.loads(r) for r in whole(prompts)]
            # of a whole chapter, the second paragraph is forgotten
            return [json.dumps([s for s in a if "bell" not in p or "hour" not in s["text"] and "shut" not in s["text"]]) for p, a in zip(prompts, answers)]

        return label

    df = spark.createDataFrame([(1, TEXT)], "ch int, text string")
    assert "hour" not in " ".join(r.text for r in pipelines.labelled_segments(df, ["ch"], forgetful).collect())
    rows = pipelines.parsed(df, ["ch"], forgetful).orderBy("index").collect()
    assert "Nobody moved for an hour." in " ".join(r.text for r in rows)


def test_inspected(spark):
    raw = spark.createDataFrame([(1, '[{"index":0,"type":"narration","text":"The bell rang."}]'), (2, "no")], "ch int, raw string")
    src = spark.createDataFrame([(1, "The bell rang."), (2, "x")], "ch int, text string")
    rows = {r.ch: (r.status, r.n_segments, r.coverage) for r in pipelines.inspected(raw, src, ["ch"]).collect()}
    assert rows == {1: ("ok", 1, 1.0), 2: ("no_array", 0, 0.0)}


REG = "n string, pos int, name string, xtts_speaker string, gender string, is_overflow boolean"


def test_cast(spark):
    chars = spark.createDataFrame([("n", i, x, g) for i, (x, g) in enumerate([("narrator", None), ("idan", "male"), ("mira", "female"), ("tov", "male"), ("old", "male")])], "n string, pos int, name string, gender string")
    reg = spark.createDataFrame([("n", 0, "narrator", "R", None, None), ("n", 1, "old", "V0", "male", None)], REG)
    voices = spark.createDataFrame([(0, "V0", "male"), (1, "V1", "male"), (2, "V2", "female")], "pos int, name string, gender string")
    asked = spark.createDataFrame([("n", 0, "idan", "V1"), ("n", 1, "mira", "V1"), ("n", 2, "tov", "V0"), ("n", 3, "ghost", "V2")], "n string, pos int, name string, voice string")
    got = {r.name: (r.voice, r.speed_variant, r.how) for r in pipelines.cast(chars, reg, asked, voices, ["R"], "n").collect()}
    assert got["idan"] == ("V1", 1.0, "own") and got["mira"][2] == "reused" and got["tov"][0] in ("V0", "V1") and "ghost" not in got and "old" not in got


def test_arc_update_and_choice(spark):
    md = "## Characters\n### idan\n- status: active\n- role: hero\n\n### mira\n- status: active\n"
    files = spark.createDataFrame([("n", md)], "n string, md string")
    patch = spark.createDataFrame([("n", "MARK_DORMANT idan\nNEW_CHARACTER sela\nrole: maid")], "n string, patch string")
    voices = spark.createDataFrame([("n", "idan", "V1")], "n string, name string, xtts_speaker string")
    new, todo = pipelines.arc_update(files, patch, voices, voices.where("false"), "n")
    assert {r.name: r.status for r in new.collect()} == {"idan": "dormant", "mira": "active", "sela": "active"}
    assert [(r.name, r.action, r.voice) for r in todo.collect()] == [("idan", "free", "V1")]
    poor = spark.createDataFrame([("n", "## Characters\n### a\n- x: unknown\n"), ("m", md)], "n string, md string")
    other = spark.createDataFrame([("n", "B"), ("m", "B")], "n string, md string")
    assert {r.n: r.md[:1] for r in pipelines.better_of(poor, other, ["n"]).collect()} == {"n": "B", "m": "#"}


def test_waves(spark):
    rate = 1000
    speech = np.concatenate([np.sin(np.arange(1000)), np.zeros(1400)]).astype(float)
    assert 1000 <= waves.end_of_speech(speech, "x" * 9, rate) <= 1200
    assert waves.end_of_speech(np.ones(9000), "word", rate) == 1500
    df = spark.createDataFrame([(1, 0, speech.tolist(), "x" * 9, 100), (1, 1, [0.5] * 10, "a", 0), (2, 0, None, None, 0)], "ch int, index int, wav array<double>, text string, pause_ms int")
    sizes = [len(r.wav) for r in waves.trimmed(df, rate=rate).orderBy("ch", "index").collect()]
    assert 1000 <= sizes[0] <= 1200 and sizes[1:] == [10, 0]
    content = waves.chapter_files(df.where("ch = 1"), ["ch"], "index", rate).first().content
    with wave.open(io.BytesIO(bytes(content))) as w:
        assert w.getnframes() == 500 + 2400 + 100 + 10 and w.getframerate() == rate
    frames = spark.range(1).select(waves.rms_frames(F.array(*[F.lit(2.0)] * 10), 4, 2)).first()[0]
    assert frames == [2.0, 2.0, 2.0]
    kept = waves.kept_clips(spark.createDataFrame([("a", i, float(i % 3)) for i in range(9)], "g string, i int, seconds double"), ["g"], "i", 1.5, 2)
    assert [(r.i, r.n_skipped, r.warn) for r in kept.orderBy("i").collect()] == [(2, 6, True), (5, 6, True)]
    c = waves.centroids(spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0])], "label int, embedding array<double>"), "label").first()
    assert c.centroid == [2.0, 3.0] and c.n == 2


def test_resampling_keeps_a_tone(spark):
    wave_of = lambda n: np.sin(2 * np.pi * 3 * np.arange(n) / n)
    for n in (80, 128, 200, 101):
        assert np.allclose(waves.fourier_resampled(wave_of(100), n), wave_of(n))
    df = spark.createDataFrame([(wave_of(100).tolist(), 1.25), ([1.0, 2.0], 1.0), ([1.0], None), (None, 2.0)], "wav array<double>, speed double")
    got = [r.wav for r in waves.at_speed(df).collect()]
    assert np.allclose(got[0], wave_of(80)) and got[1:] == [[1.0, 2.0], [1.0], None]
