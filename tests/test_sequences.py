"""Folds against plain loops, golden cases, and what must hold of any input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from talesieve import schema
from talesieve.functions import text as X
from talesieve.operators import audit, batches, chunking, coverage, jsonrepair, narration, registry, timeline, web
from talesieve.operators import markdown as M
from talesieve.operators import segments as S

SEGMENT = "ch int, index int, type string, tone string, text string"
KEY = ["ch"]


def made(spark, seed, n_seq=12):
    r = random.Random(seed)
    words = "ash bell crane debt ember frost gate howl".split()
    rows = []
    for ch in range(n_seq):
        for i in range(r.randrange(0, 25)):
            text = " ".join(r.choice(words) for _ in range(r.choice([1, 3, 6, 30]))) + r.choice([".", "!", ""])
            rows.append((ch, i, r.choice(schema.TYPES[:2]), r.choice(schema.TONES[:2]), r.choice([text, text, text, None, " "])))
    return rows, spark.createDataFrame(rows, SEGMENT)


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_validated(spark):
    df = spark.createDataFrame([(1, 0, None, "happy", "a"), (1, 1, "dialogue", None, " \n"), (1, 2, "dialogue", "calm", "b"), (1, 3, "x", "calm", None)], SEGMENT)
    assert [tuple(r) for r in S.validated(df, KEY, ["index"]).orderBy("index").collect()] == [(1, 0, "narration", "neutral", "a"), (1, 1, "dialogue", "calm", "b")]


@pytest.mark.parametrize("seed", range(3))
def test_repeated_dialogue(spark, seed):
    rows, df = made(spark, seed)
    got = sorted((r.ch, r.id, r["index"]) for r in S.without_repeated_dialogue(df.withColumn("id", F.col("index")), KEY, ["index"], "id", 0.6).collect())
    want = []
    ws = lambda t: set(re.sub(r"[^\w\s]", "", (t or "").lower()).split())
    for ch, rs in groups(rows).items():
        kept = []
        for r in rs:
            a, b = ws(kept[-1][4]) if kept else set(), ws(r[4])
            if kept and r[2] == kept[-1][2] == "dialogue" and a and b and len(a & b) / min(len(a), len(b)) >= 0.6:
                continue
            kept.append(r)
        want += [(ch, r[1], k) for k, r in enumerate(kept)]
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_merged(spark, seed):
    rows, _ = made(spark, seed)
    rows = [(*r[:4], r[4] or "x") for r in rows]
    sources = [(ch, "\n\n".join(r[4] for r in rs[::2])) for ch, rs in groups(rows).items()]
    starts = S.paragraph_starts(spark.createDataFrame(sources, "ch int, text string"), KEY)
    got = sorted((r.ch, r["index"], r.text, r.n_merged) for r in S.merged(spark.createDataFrame(rows, SEGMENT), KEY, ["index"], starts, incoming=40, cap=60).collect())
    want = []
    probe = lambda t: re.sub(r"[^\w\s]", "", t.lower()).strip()[:40]
    for ch, rs in groups(rows).items():
        begins = {probe(r[4].strip()) for r in rs[::2] if r[4].strip()}
        out = []
        for r in rs:
            last = out[-1] if out else None
            if len(out) > 1 and len(r[4]) < 40 and last[:2] == [r[2], r[3]] and (len(last[2]) < 60 or probe(r[4]) not in begins):
                last[2] += " " + r[4].strip()
                last[3] += 1
            else:
                out.append([r[2], r[3], r[4], 1])
        want += [(ch, k, o[2], o[3]) for k, o in enumerate(out)]
    assert got == sorted(want)


def test_merge_leaves_the_first_two(spark):
    df = spark.createDataFrame([(1, i, "narration", "neutral", t) for i, t in enumerate("abc")], SEGMENT)
    assert [r.text for r in S.merged(df, KEY, ["index"]).orderBy("index").collect()] == ["a", "b c"]


def brute_chunks(text, limit):
    if len(text) <= limit:
        return [text]
    out, cur = [], ""

    def put(piece):
        nonlocal cur
        if len(cur) + len(piece) + 1 <= limit:
            cur = f"{cur} {piece}".strip()
            return
        if cur:
            out.append(cur)
        cur = piece

    for s in re.split(r"(?<=[.!?])\s+", text):
        if not s.strip():
            continue
        if len(s) <= limit:
            put(s)
            continue
        for c in re.split(r"(?<=[,;:—])\s+", s):
            if len(c) <= limit:
                put(c)
            else:
                if cur:
                    out.append(cur)
                cur = ""
                for w in c.split():
                    put(w)
    return [x for x in [*out, cur] if x.strip()]


def test_chunks(spark):
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("ab") for _ in range(r.randrange(1, 14))) + r.choice(["", "", ",", ".", "!"]) for _ in range(r.randrange(1, 80))) for _ in range(200)]
    texts += ["", "x" * 500, "a. " * 100]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.spoken_chunks(F.col("t"), 40).alias("c")).collect()
    for i, c in rows:
        assert c == brute_chunks(texts[i], 40), texts[i]
        assert all(len(x) <= 40 or " " not in x for x in c)


def test_coverage_of_itself_is_one(spark):
    src = spark.createDataFrame([(1, "The bell rang. Twice it rang!"), (2, "")], "ch int, text string")
    seg = src.withColumn("index", F.lit(0))
    assert {r.coverage for r in coverage.word_coverage(src, seg, KEY).collect()} == {1.0}
    assert coverage.missing_paragraphs(src, seg, KEY, ["index"]).isEmpty()
    got = coverage.missing_paragraphs(src, seg.where("ch = 2"), KEY, ["index"]).collect()
    assert [(r.ch, r.n_sentences, r.n_missing) for r in got] == [(1, 2, 2)]


def test_source_order(spark):
    src = spark.createDataFrame([(1, "One two three four. Five six seven. Eight nine.")], "ch int, text string")
    seg = spark.createDataFrame([(1, 0, "x", "y", "Eight nine."), (1, 1, "x", "y", "Not there at all"), (1, 2, "x", "y", "Five six")], SEGMENT)
    assert [r.text for r in S.in_source_order(seg, src, KEY, ["index"]).orderBy("new_index").collect()] == ["Five six", "Eight nine.", "Not there at all"]


def test_narration_is_put_in(spark):
    source = '"I will go," she said, and took the lamp away. "Stay."'
    df = spark.createDataFrame([(1, 0, "dialogue", "calm", "I will go,"), (1, 1, "dialogue", "calm", "Stay.")], SEGMENT)
    rows = narration.inject(df, spark.createDataFrame([(1, source)], "ch int, text string"), KEY, ["index"]).orderBy("index").collect()
    assert [r.type for r in rows] == ["dialogue", "narration", "dialogue"]
    assert [(r.text, r.added) for r in rows] == [("I will go,", False), ("she said, and took the lamp away.", True), ("Stay.", False)]
    one_quote = spark.createDataFrame([(1, 0, "dialogue", "", "One long quote."), (1, 1, "dialogue", "", "And more of it.")], SEGMENT)
    assert narration.inject(one_quote, spark.createDataFrame([(1, '"One long quote. And more of it."')], "ch int, text string"), KEY, ["index"]).count() == 2
    told = spark.createDataFrame([(1, 0, "dialogue", "", "I will go,"), (1, 1, "narration", "", "So she said and took, the lamp!")], SEGMENT)
    assert narration.inject(told, spark.createDataFrame([(1, source), (2, None)], "ch int, text string"), KEY, ["index"]).count() == 2


def test_time_line(spark):
    df = spark.createDataFrame([(1, 0, "dialogue", 1000), (1, 1, "narration", 500), (1, 2, "action", 200)], "ch int, index int, type string, duration_ms int")
    rows = timeline.with_offsets(timeline.with_pauses(df, schema.pause_rules(spark), KEY, ["index"]), KEY, ["index"]).orderBy("index").collect()
    assert [(r.pause_ms, r.start_ms) for r in rows] == [(450, 500), (400, 1950), (0, 2850)]


def test_blocks(spark):
    df = spark.createDataFrame([("n", c, 10) for c in (*range(1, 11), 12)], "novel string, chapter_num int, duration_ms int")
    existing = spark.createDataFrame([("n", 0), ("n", 1)], "novel string, block int")
    rows = timeline.blocks(df, "novel", existing=existing).orderBy("block").collect()
    assert [(r.file_name, r.n_members, r.duration_ms, r.status) for r in rows] == [("chapters_1_to_10.mp3", 10, 100 + 9 * 2000, "skip"), ("chapters_11_to_20.mp3", 1, 10, "build")]


def test_json_recovery(spark):
    good = '[{"index": 0, "type": "dialogue", "tone": "calm", "text": "a"}]'
    raws = {"ok": "```json\n" + good + "\n```", "repaired": good.replace("}]", "},]"), "partial": good.replace('"a"', '"she said "no", to me"'), "no_array": "sorry", "failed": "[nothing here]"}
    quoted = good.replace('"a"', '"she said "no" to me"')
    rows = {r.want: r for r in jsonrepair.recovered(spark.createDataFrame(list(raws.items()), "want string, raw string")).collect()}
    assert {w: r.status for w, r in rows.items()} == {w: w for w in raws}
    assert rows["partial"].segments[0].text == 'she said "no", to me'
    # quotes within a text, without a comma or brace behind them, are escaped
    row = jsonrepair.recovered(spark.createDataFrame([(quoted,)], "raw string")).first()
    assert (row.status, row.segments[0].text) == ("repaired", 'she said "no" to me')


def test_stitching(spark):
    parts = [(1, 0, '[{"a": 1}, {"b": '), (1, 1, 'and so: {"c": 3}'), (2, 0, '[{"a": 1}]')]
    rows = {r.ch: r.raw for r in jsonrepair.stitched(spark.createDataFrame(parts, "ch int, seq int, raw string"), KEY, "seq").collect()}
    assert rows == {1: '[{"a": 1},\n{"c": 3}\n]', 2: '[{"a": 1}]'}


@pytest.mark.parametrize(("key", "is_group"), [("guard_2", True), ("scout_leader", True), ("unnamed_soldier", True), ("idan", False), ("subordinate_left", True), ("soldiers", True)])
def test_group_names(spark, key, is_group):
    assert spark.createDataFrame([(key,)], "k string").select(audit.is_group(F.col("k"))).first()[0] is is_group


def test_audit(spark):
    rows = [("narrator", "", 5, "1"), ("guard_2", "speaks", 5, "1"), ("idan", "is noted", 5, "1"), ("mira", "argues", 5, "1"), ("sela", "argues", 5, "5"), ("tov", " ", 1, "x")]
    got = {r.name: r.category for r in audit.classified(spark.createDataFrame(rows, "name string, notes string, last_updated int, introduced string"), 5).collect()}
    assert got == {"narrator": "keep", "guard_2": "battle_group", "idan": "ghost", "mira": "suspicious", "sela": None, "tov": "ghost"}


@pytest.mark.parametrize("seed", range(4))
def test_reused_voices(spark, seed):
    r = random.Random(seed)
    g = lambda: r.choice(["male", "female", "unknown"])
    waiting = [("n", i, f"c{i}", g()) for i in range(r.randrange(1, 30))]
    pool = [("n", i, f"v{i}", g(), r.randrange(0, 5)) for i in range(r.randrange(1, 4))]
    got = {x.name: (x.voice, x.speed_variant) for x in registry.reused_voices(spark.createDataFrame(waiting, "n string, pos int, name string, gender string"), spark.createDataFrame(pool, "n string, pos int, voice string, gender string, uses int"), "n").collect()}
    uses, want = {p[2]: p[4] for p in pool}, {}
    for _, _, name, gender in waiting:
        fits = [p for p in pool if uses[p[2]] < 6 and ("unknown" in (gender, p[3]) or gender == p[3])] or [p for p in pool if uses[p[2]] < 6]
        if not fits:
            want[name] = (None, None)
            continue
        best = min(fits, key=lambda p: (uses[p[2]], p[1]))[2]
        want[name] = (best, schema.SPEED_OFFSETS[uses[best]])
        uses[best] += 1
    assert got == want


def test_synchronised(spark):
    snap = lambda rows: spark.createDataFrame(rows, "n string, name string, status string")
    old = snap([("n", "a", "active"), ("n", "b", "dormant"), ("n", "c", "active"), ("n", "d", "dormant"), ("n", "e", "dormant")])
    new = snap([("n", "a", "dormant"), ("n", "b", "active"), ("n", "d", "active"), ("n", "e", "active"), ("n", "f", "active")])
    voices = spark.createDataFrame([("n", "a", "V1"), ("n", "c", "V2"), ("n", "f", "V4")], "n string, name string, xtts_speaker string")
    dormant = spark.createDataFrame([("n", "b", "V3"), ("n", "d", "V4")], "n string, name string, xtts_speaker string")
    got = {r.name: (r.action, r.voice) for r in registry.synchronised(old, new, voices, dormant, "n").collect()}
    assert got == {"a": ("free", "V1"), "b": ("restore", "V3"), "c": ("remove", "V2"), "d": ("needs_cast", "V4"), "e": ("needs_cast", None)}


def test_fuzzy_keys(spark):
    asked = spark.createDataFrame([("Holmström",), ("holmstrom",), ("nobody",)], "name string")
    got = {r.name: (r.found, r.how) for r in registry.fuzzy_keys(asked, spark.createDataFrame([("Holmström",), ("Ada",)], "name string")).collect()}
    assert got == {"Holmström": ("Holmström", "exact"), "holmstrom": ("Holmström", "folded"), "nobody": (None, "missing")}


MD = """# T
## Overview
text
<!-- ### hidden
-->
## Characters
### idan
- Role: Hero
- status: Dormant
- last_updated_chapter: 12
- Voice style: unknown

### mira
- role: minor

## Factions
### none
"""


def test_markdown(spark):
    files = spark.createDataFrame([("n", MD), ("m", "# no sections")], "n string, md string")
    rows = M.characters(files, ["n"]).orderBy("pos").collect()
    assert [(r.name, r.status, r.role, r.last_updated_chapter) for r in rows] == [("idan", "dormant", "hero", 12), ("mira", "active", "minor", None)]
    assert rows[0].fields["voice_style"] == "unknown"
    assert [r.name for r in M.sections(files, ["n"]).orderBy("pos").collect()] == ["Overview", "Characters", "Factions"]
    assert {r.n: (r.n_unknown, r.n_fields) for r in M.unknown_share(files.withColumn("md", F.replace("md", F.lit("Voice style"), F.lit("Voice"))), ["n"]).collect()} == {"n": (1, 5), "m": (0, 0)}


def test_patches(spark):
    patch = "```\nUPDATE_CHARACTER idan\nrole: king\narc_notes_append:\n  Ch 7: speaks\nlast_updated_chapter: 7\nNEW_CHARACTER sela\nrole: maid\nPRUNE idan\nPRUNE old\nMARK_DORMANT mira\n```"
    cmds = M.patch_commands(spark.createDataFrame([("n", patch)], "n string, patch string"), ["n"]).withColumn("name", F.col("arg")).withColumn("fields", M.patch_fields(F.col("body"))).withColumn("notes", M.patch_notes(F.col("body")))
    assert cmds.count() == 5
    old = spark.createDataFrame([("n", "idan", "active", {"role": "hero"}, []), ("n", "mira", "active", {}, []), ("n", "old", "dormant", {}, [])], "n string, name string, status string, fields map<string,string>, notes array<struct<chapter:int,note:string>>")
    got = {r.name: r for r in M.patched(old, cmds, ["n", "name"]).collect()}
    assert set(got) == {"idan", "mira", "sela"} and got["idan"].n_rejected == 1 and got["mira"].status == "dormant"
    assert got["idan"].fields == {"role": "king", "last_updated_chapter": "7"} and [tuple(x) for x in got["idan"].notes] == [(7, "speaks")]


def test_pages(spark):
    html = '<body><nav>x</nav><div class="share">y<div>z</div></div><div class="content"><p>One<br>two</p><script>v</script></div></body>'
    assert web.main_text(html) == "One\ntwo" and web.main_text(None) is None and web.main_text("") == ""
    text = "Site\nChapter 1: A\n\n\n\n“Hi” {x}\nChapter 1: A\nbody \n\n\nAuthor's note:\nthanks\n"
    assert spark.createDataFrame([(text,)], "t string").select(web.cleaned(F.col("t"))).first()[0] == "Chapter 1: A\nbody"
    assert spark.createDataFrame([("Chapter 2\nbody\nNext Chapter\n\ndiscord.gg/x",)], "t string").select(web.cleaned(F.col("t"))).first()[0] == "Chapter 2\nbody"


def test_chain_ends_at_a_loop(spark):
    pages = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "url string, next_url string")
    rows = web.followed(pages, spark.createDataFrame([("a",), ("d",), ("zz",)], "url string"), 10).collect()
    assert sorted((r.start, r.depth, r.url) for r in rows) == [("a", 1, "a"), ("a", 2, "b"), ("a", 3, "c"), ("d", 1, "d")]


def test_ladder(spark):
    df = spark.createDataFrame([("short",), ("x" * 210 + "é" * 5,), ("w" * 300,), (("word " * 20 + ". ") * 5,)], "text string")
    rows = batches.with_ladder(df, X.ascii_only(F.col("text"))).collect()
    assert [r.strategy for r in rows] == ["normal", "split", "placeholder_inserted", "split"]
