"""Sentences, cut ends, encodings, look-alikes: cases made by hand, and what must not crash."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import types as T

from talesieve.llm import arrowrun, cutoff, lookalike, mojibake, sentences

LINES = [
    "The bell rang twice in the hall. Mr. Toral walked to the gate at 6.30 p.m. by the tower clock. The old man was tired.",
    "“Count the coins again,” whispered Yorana. “Your master lied to all of us!”",
    "“The moon was wrong last night!” Josephine sighed.",
    "“The moon was wrong last night!” The widow of the mill opened the iron gate, and the guards looked away.",
    "“I never learned to read the stars,” Mira said. “Nobody leaves.”",
    "The glassblower sold rope, salt, etc. The night was cold. Dr. Mirel arrived with Mrs. Toral in vol. 5. Nobody spoke.",
    "The scale read 29.1 marks when Prof. Sela folded the map... then looked up. Nobody moved for an hour.",
    "She waited for rope, salt, etc.",
    "He left at 9.10 p.m.",
    "It rained for a long time on the old roof.",
]
SENTENCES = """The bell rang twice in the hall.|Mr. Toral walked to the gate at 6.30 p.m. by the tower clock.|The old man was tired.|Nobody spoke.|The night was cold.|Dr. Mirel arrived with Mrs. Toral in vol. 5.
The scale read 29.1 marks when Prof. Sela folded the map... then looked up.|Nobody moved for an hour.|The glassblower sold rope, salt, etc.|He left at 9.10 p.m.|It rained on the old roof.|“Count the coins again,” whispered Yorana.""".replace("\n", "|").split("|")
SAID = ["“Count the coins again,” whispered Yorana. “Nobody leaves.”", "“I never learned to read the stars,” Mira said. “Nobody leaves.”", "“Nobody leaves,” Josephine sighed.", "The widow of the mill opened the iron gate, and the guards looked away."]
_shuffled = random.Random(4)
CORPUS = ["Chapter 1: A. B. Title\n" + "\n".join([*(" ".join(_shuffled.sample(SENTENCES, _shuffled.randrange(1, 4))) for _ in range(9)), *SAID]) for _ in range(60)]


@pytest.fixture(scope="module")
def splitter():
    return sentences.Splitter(CORPUS)


def pieces(splitter, text, heading="none"):
    found = splitter.units(text, heading)
    assert all(text[a:b] == text[a:b].strip() and a < b for a, b in found)
    return [text[a:b] for a, b in found]


@pytest.mark.parametrize(
    ("text", "units"),
    [
        (LINES[0], ["The bell rang twice in the hall.", "Mr. Toral walked to the gate at 6.30 p.m. by the tower clock.", "The old man was tired."]),
        (LINES[1], ["“Count the coins again,” whispered Yorana.", "“Your master lied to all of us!”"]),
        (LINES[2], [LINES[2]]),
        (LINES[3], ["“The moon was wrong last night!”", "The widow of the mill opened the iron gate, and the guards looked away."]),
        (LINES[6], ["The scale read 29.1 marks when Prof. Sela folded the map... then looked up.", "Nobody moved for an hour."]),
        ("「那王冠是木头做的！」叶听澜说。他走了。", ["「那王冠是木头做的！」叶听澜说。", "他走了。"]),
        ("「あの冠は木だ？」と白峰澪が言った。鐘が鳴った。", ["「あの冠は木だ？」と白峰澪が言った。", "鐘が鳴った。"]),
        ("二长老……在浮桥之下。他走了！", ["二长老……在浮桥之下。", "他走了！"]),
        ("ก่อนเที่ยง หมอยา 12 คน มา", ["ก่อนเที่ยง", "หมอยา 12 คน", "มา"]),
        ("उसने कहा। वह गया।", ["उसने कहा।", "वह गया।"]),
        ("— Лис не забывает долгов! — сказал Тавош.", ["— Лис не забывает долгов! — сказал Тавош."]),
        ("« Le sceau tiendra ! » dit Hector.", ["« Le sceau tiendra ! » dit Hector."]),
        ("What was this?! Nobody knew.\n\n  no mark here ", ["What was this?!", "Nobody knew.", "no mark here"]),
        ("", []),
        (" \n\t\n", []),
    ],
)
def test_units(splitter, text, units):
    assert pieces(splitter, text) == units


def test_language_is_that_of_the_line_and_of_the_whole_text():
    german = "Der alte Mann ging mit dem Hund über die Brücke und sah nicht zurück. "
    assert sentences.language("the fox and the well of the town. " * 10 + german * 30) == "de"
    assert sentences.line_language(german, "en") == "de" and sentences.line_language("Nobody.", "de") == "de"


def test_headings(splitter):
    assert pieces(splitter, CORPUS[0], "line")[0] == "Chapter 1: A. B. Title"
    assert pieces(splitter, "A. B! C?", "all") == ["A. B! C?"]


def test_garbled_units_keep_stored_positions(splitter):
    text = "“Nobody leaves!” The gate fell. “Stay.”"
    garbled = "".join(c if c.isascii() else "".join(chr(b) for b in c.encode()) for c in text)
    units = pieces(splitter, garbled)
    assert len(units) == len(pieces(splitter, text)) == 3
    assert "".join(units).replace(" ", "") == garbled.replace(" ", "")


def test_split_texts(spark):
    rows = [("a", 1, LINES[0], "x"), ("a", 1, LINES[0], "x"), ("b", 2, None, "y"), ("b", 3, "", "y"), ("b", 4, "word " * 50_000 + ". End", "y")]
    df = spark.createDataFrame(rows, "kind string, id long, text string, start_pos string")
    got = sentences.split_texts(df, ["kind", "id"], training=spark.createDataFrame([(t,) for t in CORPUS], "text string"))
    counts = {r.id: r["count"] for r in got.groupBy("id").count().collect()}
    assert counts == {1: 6, 4: 2} or counts == {1: 6, 4: 1}
    assert got.columns == ["kind", "id", "start_pos", "end_pos"]
    assert sentences.split_texts(df.where("false"), ["kind", "id"]).isEmpty()


ABBREVIATED = "He met Qx. Toral at the gate."


@pytest.fixture(scope="module")
def many_texts(spark):
    """More texts than the models were once fitted on; the abbreviation stands only in texts that a sample by hash leaves out."""
    shown = spark.range(400).selectExpr(f"concat('Chapter ', id, '\n{ABBREVIATED}') AS text").where("pmod(xxhash64(text), 1 << 20) >= 1 << 19").limit(60)
    return spark.range(9000).selectExpr("concat('Title ', id, '\nThe bell rang twice in the hall.') AS text").unionByName(shown).selectExpr("'n' AS novel", "cast(row_number() OVER (ORDER BY text) AS int) AS chapter_num", "text").cache()


def test_units_rest_on_all_texts(spark, many_texts):
    got = sentences.split_texts(spark.createDataFrame([(1, ABBREVIATED)], "id long, text string"), ["id"], training=many_texts)
    assert [tuple(r) for r in got.collect()] == [(1, 0, len(ABBREVIATED))]


def test_cut_texts_rest_on_all_texts(spark, many_texts):
    df = many_texts.where("text LIKE 'Chapter%'").selectExpr("novel", "chapter_num", "1 AS index", "cast(chapter_num AS long) AS seg_id", "'He met Qx.' AS text")
    assert cutoff.cut_texts(df, many_texts, ["novel", "chapter_num"], "index", "seg_id").count() == df.count() == 60


def test_workers_fit_the_same_models(spark):
    df = spark.createDataFrame([(t,) for t in [*CORPUS, None, ""]], "text string").repartition(3)
    ours, theirs, at_once = sentences.trained(df), sentences.trained(df, rows_on_driver=0), sentences.Splitter(CORPUS)
    for other in (theirs, at_once):
        assert (ours.ends.w == other.ends.w).all() and (ours.attributes.w == other.attributes.w).all() and ours.ends.w.any() and ours.attributes.w.any()
        assert (ours.characters.uni == other.characters.uni).all() and (ours.characters.bi == other.characters.bi).all()


CHAPTER = "Chapter 1: The Gate\nThe bell rang twice in the hall. The old man walked to the gate, and the guards looked away. Nobody spoke.\n\n“I will go tonight,” Mira said.\n\n“We are lost\n\nHe waited... then left the room."


def test_cut_texts(spark):
    texts = [
        (0, "Chapter 1: The"),  # a heading
        (1, "The bell rang twice in the ha"),  # cut within a word
        (2, "The old man walked to the gate,"),  # goes on in the next
        (3, "and the guards looked away."),
        (4, "Nobody…"),  # a mark in place of the end
        (5, "“I will go tonight,” Mira said."),
        (6, "“We are lost"),  # left open in the chapter itself
        (7, "He waited..."),  # a pause that the next one goes on from
        (8, "then left the room."),
        (9, None),
        (10, " "),
        (11, "The bell rang twice in the hall. The old man wal"),
    ]
    df = spark.createDataFrame([("n", 1, i, 100 + i, t, "s") for i, t in texts] + [("n", 1, 5, 120, "“I will go ton", "s"), ("n", 1, None, 121, "The old man walked to the ga", "s"), ("n", 1, None, 122, "Nobody spoke.", "s"), ("k", 1, 3, 123, "A long line that is cut he", "s"), ("k", 1, 3, 124, "A long line that is cut here.", "s")] + [("m", 1, 1, 999, "The bell rang twi", "s"), (None, None, 1, 998, "x y z", "s")], "novel string, chapter_num int, index int, seg_id long, text string, lost string")
    longer = spark.createDataFrame([("n", 1, CHAPTER), ("n", 1, CHAPTER), ("n", 2, None)], "novel string, chapter_num int, text string")
    got = cutoff.cut_texts(df, longer, ["novel", "chapter_num"], "index", "seg_id")
    assert sorted(r.seg_id for r in got.collect()) == [101, 104, 111, 120, 121, 123]
    assert cutoff.cut_texts(df.where("false"), longer, ["novel", "chapter_num"], "index", "seg_id").isEmpty()
    assert sorted(r.seg_id for r in cutoff.cut_texts(df, longer.where("false"), ["novel", "chapter_num"], "index", "seg_id").collect()) == [120, 123]


def test_cut_texts_are_judged_without_needless_work(spark, splitter, monkeypatch):
    calls = []
    kept = cutoff.END_MARKS
    monkeypatch.setattr(cutoff, "END_MARKS", type("Counted", (), {"sub": lambda _, *a: calls.append(a) or kept.sub(*a)})())
    assert cutoff.variants("The bell rang twice in the hall.", splitter.characters) == [(0, "The bell rang twice in the hall.")] and not calls
    assert cutoff.variants("Nobody [cut]", splitter.characters)[1:] == [(2, "Nobody")] and len(calls) == 1
    monkeypatch.setattr(cutoff, "language", lambda line: calls.append(line))
    group = cutoff.Group(splitter)
    group.values = {"The bell rang twice in the hall, and the old man was tired."}
    group.texts = [((1, 7, 1, False, True), 0, max(group.values)), ((2, 7, 2, False, False), 0, max(group.values)), ((3, 7, 3, False, True), 0, "The bell rang twice")]
    # a text of one form that is whole is sent on to nobody
    assert [r[0] for r in group.judged()] == [2, 3] and len(calls) == 1


def test_filter_asks_for_two_bits():
    line = "The bell rang twice in the hall."
    own = int(cutoff.prefix_hashes([line], [7])[0])
    known = np.zeros(cutoff.FILTER_BITS // 64, np.int64)
    found = []
    for shift in (0, 26):
        slot = own >> shift & (cutoff.FILTER_BITS - 1)
        known[slot >> 6] |= np.int64(1) << np.int64(slot & 63)
        found.append([(h, i, at) for part in cutoff.offered_places([line], [7], known) for h, i, at in zip(*(c.tolist() for c in part))])
    assert found == [[], [(own, 0, 0)]]


def test_batches_in_parts(spark):
    rows = [("a", 1, "xx"), ("b", None, None), ("c", 3, "yyyyyy"), ("d", 4, ""), ("e", 5, "z")]
    df = spark.createDataFrame(rows, "id string, n long, text string").coalesce(1)
    f = lambda b: {"id": b["id"], "n": arrowrun.as_list(b["n"]), "size": [b.num_rows] * b.num_rows, "text": arrowrun.as_list(b["text"])}
    got = [tuple(r) for r in arrowrun.map_arrays(df, T._parse_datatype_string("id string, n long, size int, text string"), f, "text", 5).collect()]
    assert got == [(i, n, 3 if i in "abc" else 2, t) for i, n, t in rows]


def test_plain_definitions_of_quick_functions(splitter):
    shuffled = random.Random(7)
    odd = ["".join(shuffled.choice("ab.!?,，、\"“” \t\r\n\x1c\x85\xa0\u2028\u3000 19said") for _ in range(shuffled.randrange(90))) for _ in range(3000)]
    for text in odd:
        s = re.sub(r"\r\n?|\u2028|\u2029|\x85(?=\s)", "\n", unicodedata.normalize("NFKC", text)) if set("\r\u2028\u2029") & set(text) else unicodedata.normalize("NFKC", text)
        assert lookalike.compose(text) == re.sub(r" ?\n ?", "\n", re.sub(r"[^\S\n]+", " ", s)).strip()
        for m in re.finditer("[.!?]", text):
            begin = m.start()
            while begin and not (text[begin - 1].isspace() or text[begin - 1] in sentences._ends_token):
                begin -= 1
            assert splitter._token(text, m.start())[0] == text[begin : m.start()]


def garble(text, real, read):
    return text.encode(real).decode(read, "replace")


CLEAN = ["Le greffier cherchait la clé de cuivre près de la fontaine sèche, « dit-il ».", "“The tiger’s collar…” she said — and left.", "Мельничиха покупает серую печать в замёрзшей гавани.", "約束どおり、薬師は山門の外で銅の鍵を買った。", "临近正午，老船夫在磨坊后面清点了银铃。", "คนเก็บภาษีซ่อนระฆังเงินข้างบ่อแห้ง", "그날 저녁 늙은 사공은 시장 위에서 잿빛 인장을 열었다."]
WRONG = [(0, "utf-8", "cp1252"), (0, "utf-8", "mac_roman"), (0, "utf-8", "cp437"), (1, "utf-8", "latin-1"), (2, "utf-8", "cp1251"), (2, "koi8-r", "cp1251"), (2, "cp1251", "latin-1"), (3, "cp932", "latin-1"), (4, "gbk", "latin-1"), (5, "cp874", "latin-1"), (6, "cp949", "latin-1")]


def test_encodings(spark):
    rows = [("c", i, "s", t) for i, t in enumerate(CLEAN * 30)]
    rows += [("g", 1000 + k, "s", garble(CLEAN[i], real, read)) for k, (i, real, read) in enumerate(WRONG)]
    rows += [("g", 2000, "s", CLEAN[0].encode("cp1252").decode("utf-8", "replace")), ("g", 2001, None, CLEAN[1] + "\n" + garble(CLEAN[0], "utf-8", "cp1252")), ("n", 3000, None, None), ("n", 3001, "s", ""), ("n", 3002, "s", "plain"), ("n", 3003, "s", "x" * 200_000 + "é")]
    df = spark.createDataFrame(rows, "kind string, id long, chain string, text string").withColumnRenamed("chain", "pool")
    got = {r.id: r for r in mojibake.restored(df, ["kind", "id"], ["kind", "pool"]).collect()}
    assert set(got) == {r[1] for r in rows if r[0] == "g"}
    right = sum(got[1000 + k].restored == CLEAN[i] for k, (i, _, _) in enumerate(WRONG))
    assert right >= len(WRONG) - 2
    assert got[2001].restored == CLEAN[1] + "\n" + CLEAN[0] and not got[2000].complete
    assert mojibake.chain_posteriors(df.where("false"), ["kind", "id"], ["kind", "pool"]).isEmpty()


def test_one_garbled_piece_among_clean_ideographs():
    clean = "临近正午，老船夫在磨坊后面清点了银铃。" * 3
    wrong = "陌生的刀客在两名守卫之间清点了残破的地图".encode().decode("gbk")
    assert len(clean) < 400 and mojibake.suspicious(wrong) and not mojibake.suspicious(clean)
    for text in (f"{clean}\n{wrong}", clean * 9 + wrong + "。" + clean * 9):
        assert mojibake.suspicious(text)
        model = mojibake.Model(*(c.astype("float32") for c in mojibake.counted([clean, "陌生的刀客在两名守卫之间清点了残破的地图。", text] * 20)))
        assert "utf-8>gbk" in mojibake.evidence([text], model)[0]
        assert "陌生的刀客在两名守卫之间清点了残破的地图" in mojibake.undo(text, "utf-8>gbk", model)


ACCENTED = ["Le greffier a déjà cherché la clé près de la forêt.", "Der Müller zählt die grünen Schlüssel über der Tür.", "La señora compró un jarrón pequeño para el niño.", "临近正午，老船夫在磨坊后面清点了银铃。", "約束どおり、薬師は山門の外で銅の鍵を買った。", "그날 저녁 늙은 사공은 시장 위에서 잿빛 인장을 열었다."]
UNSEEN = [(0, "utf-8", "cp1250"), (0, "utf-8", "cp1251"), (0, "utf-8", "cp874"), (1, "cp1252", "mac_roman"), (2, "cp1252", "mac_roman"), (1, "mac_roman", "cp1252"), (2, "mac_roman", "cp1252"), (3, "gbk", "cp949"), (4, "euc_jp", "gbk"), (5, "cp949", "gbk")]


@pytest.mark.parametrize(("i", "real", "read"), UNSEEN)
def test_chains_that_leave_no_odd_characters(i, real, read):
    model = mojibake.Model(*(c.astype("float32") for c in mojibake.counted(ACCENTED * 50)))
    wrong = ACCENTED[i].encode(real).decode(read, "ignore")
    clean, found = mojibake.evidence([ACCENTED[i], wrong], model)
    assert not clean and f"{real}>{read}" in found
    if len(wrong.encode(read)) == len(ACCENTED[i].encode(real)):
        assert mojibake.undo(wrong, f"{real}>{read}", model) == ACCENTED[i]


def test_lines_are_undone_each_by_itself():
    lines = [t[:n] for t in [*CLEAN, *ACCENTED, *(garble(CLEAN[i], real, read) for i, real, read in WRONG)] for n in (len(t), 5, 2)]
    lines += [b"\xa4\xa2\x8f\xa4".decode("latin-1"), "\x8f\xb0", "漢\x8f\x90", "a\ufffd", "ã\x81", "дЅ", " "]  # broken off within a character
    together = mojibake.Undoing("\n".join(lines))
    for chain in mojibake.CHAINS:
        assert together.by(chain).split("\n") == [mojibake.Undoing(t).by(chain) for t in lines]


def test_character_counts_do_not_depend_on_batches():
    whole, parts = mojibake.counted(CLEAN), [mojibake.counted(CLEAN[:3]), mojibake.counted(CLEAN[3:])]
    assert all((w == a + b).all() for w, a, b in zip(whole, *parts))


def test_undone_places():
    text, places = mojibake.undone_with_places("aÃ©b")
    assert text == "aéb" and places == [0, 1, 3, 4]


@pytest.mark.parametrize(("a", "b", "same"), [("The bell", "Ｔｈｅ bell", True), ("of mice", "ο​f mice", True), ("café", "café", True), ("café", "cafe", False), ("a b", "a b", True), ("care", "CARE", False), ("ﬁne", "fine", True), ("x²", "x2", False), ("end.", "end?", False), ("ﾊﾞﾗ", "バラ", True)])
def test_same_look(a, b, same):
    assert (lookalike.fold(lookalike.compose(a)) == lookalike.fold(lookalike.compose(b))) is same


def test_repair_needs_the_vocabulary(spark):
    rows = [(1, "The captain sleeps"), (2, "The сарtаin sleeps"), (3, "zуzzу flower"), (4, None), (5, ""), (6, "капитан спит"), (7, "кaпитан спит")]
    got = {r.id: (r.canonical, r.repaired) for r in lookalike.canonical_forms(spark.createDataFrame(rows, "id long, text string"), ["id"]).collect()}
    assert got == {1: ("The captain sleeps", 0), 2: ("The captain sleeps", 1), 3: ("zуzzу flower", 0), 5: ("", 0), 6: ("капитан спит", 0), 7: ("капитан спит", 1)}


def test_pairs_depend_on_the_vocabulary(spark):
    rows = [(1, "zуzzа"), (2, "zyzzа")]  # looks the same, but no text holds the word in one script
    df = lambda more: spark.createDataFrame([("s", *r, 1) for r in [*rows, *more]], "kind string, id long, text string, g int")
    assert lookalike.same_looking_pairs(df([]), "kind", "id", ["g"]).isEmpty()
    assert [tuple(r)[1:] for r in lookalike.same_looking_pairs(df([(3, "a zyzza")]), "kind", "id", ["g"]).collect()] == [(1, 2)]


def test_same_looking_pairs(spark):
    rows = [("s", 1, "n", 1, "of mice", "x"), ("s", 2, "n", 1, "οf mice", "x"), ("s", 3, "n", 1, "of mice", "x"), ("s", 4, "n", 2, "οf mice", "x"), ("s", 5, "n", 1, "ｏｆ mice", "x"), ("s", 6, "n", 1, " ", "x"), ("s", 7, "n", 1, " ", "x"), ("s", 8, None, None, "a b", "x"), ("s", 9, None, None, "a b", "x"), ("c", 1, "n", 1, "οf mice", "x"), ("s", 10, "n", 1, None, "x")]
    df = spark.createDataFrame(rows, "kind string, id long, novel string, chapter_num int, text string, key string")
    got = sorted(tuple(r) for r in lookalike.same_looking_pairs(df, "kind", "id", ["novel", "chapter_num"]).collect())
    assert got == [("s", 1, 2), ("s", 1, 5), ("s", 2, 3), ("s", 2, 5), ("s", 3, 5), ("s", 8, 9)]
    assert lookalike.same_looking_pairs(df.where("false"), "kind", "id", ["novel", "chapter_num"]).isEmpty()
