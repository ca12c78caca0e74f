"""Held-out accuracy on the test tables: segments tell where sentences of their chapters end."""

import os

import pandas as pd
import pytest

from talesieve.llm import mojibake, sentences

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001").replace("sf0.001", "sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    chapters = pd.read_parquet(f"{DATA}/chapters.parquet", columns=["chapter_id", "novel", "chapter_num", "text"]).dropna(subset=["text"])
    segments = pd.read_parquet(f"{DATA}/segments.parquet", columns=["seg_id", "novel", "chapter_num", "index", "text"]).dropna(subset=["text"])
    return chapters, segments


def test_segment_ends_are_unit_ends(tables):
    """Models fitted on half of the chapters; ends of segments of the other half (some are cut or parts of a sentence)."""
    chapters, segments = tables
    held_out = chapters.chapter_id % 2 == 0
    splitter = sentences.Splitter(chapters.text[~held_out].tolist())
    texts = {(r.novel, r.chapter_num): r.text for r in chapters[held_out].itertuples()}
    ends = {k: {e for _, e in splitter.units(t, "line")} for k, t in texts.items()}
    right = seen = 0
    for r in segments.rename(columns={"index": "place"}).itertuples():
        text, s = texts.get((r.novel, r.chapter_num)), r.text.strip()
        if text and s and r.place and text.count(s) == 1:
            seen += 1
            right += text.index(s) + len(s) in ends[r.novel, r.chapter_num]
    assert seen > 1000 and right / seen > 0.93


def test_units_of_segments_and_chapters_agree(tables):
    chapters, segments = tables
    splitter = sentences.Splitter(chapters.text[chapters.chapter_id % 2 == 1].tolist())
    texts = {(r.novel, r.chapter_num): r.text for r in chapters.itertuples()}
    ends = {k: {e for _, e in splitter.units(t, "line")} for k, t in texts.items()}
    differing = inner = 0
    for r in segments.rename(columns={"index": "place"}).itertuples():
        text = texts.get((r.novel, r.chapter_num))
        if text and r.place and r.text.strip() and text.count(r.text) == 1:
            at = text.index(r.text)
            own = {e + at for _, e in splitter.units(r.text, "none")[:-1]}
            theirs = {e for e in ends[r.novel, r.chapter_num] if at < e < at + len(r.text.rstrip())}
            inner += len(own | theirs)
            differing += len(own ^ theirs)
    assert inner > 500 and differing / inner < 0.02


def test_clean_texts_are_rarely_suspected_and_never_undone(tables):
    chapters, _ = tables
    clean = [t for t in chapters.text if not mojibake.suspicious(t)]
    model = mojibake.Model(*(c.astype("float32") for c in mojibake.counted(clean)))
    assert len(clean) > 0.7 * len(chapters)
    assert all(not g for g in mojibake.evidence(clean, model))
    for real, read in (("utf-8", "cp1252"), ("utf-8", "mac_roman")):
        lines = [x for t in clean for x in t.split("\n") if not x.isascii() and any("\xc0" <= c <= "\xff" for c in x)][:200]
        garbled = ["".join({v: k for k, v in mojibake._byte_of(read).items()}.get(b, chr(b)) for b in x.encode(real)) for x in lines]
        found = mojibake.evidence(garbled, model)
        assert sum(map(bool, found)) > 0.98 * len(lines)
        best = [max(g, key=g.get) if g else "" for g in found]
        assert sum(mojibake.undo(x, c, model) == y for x, c, y in zip(garbled, best, lines)) > 0.95 * len(lines)
