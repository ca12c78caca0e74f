"""Texts that lost their end.

A text was taken from a longer one. Texts and longer values join one another by a hash of their key and their first characters: a text
by its own, a longer value at each place where a piece may begin. Within a group of one prefix the longer values are sorted, and
a text is searched among those that it is a strict prefix of. What follows it there decides: nothing is lost if the sentence
ends there, or if the next text of the sequence goes on with what follows. A mark put in place of the lost end is set aside first.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from talesieve.llm import mojibake
from talesieve.llm.arrowrun import as_list, map_arrays, map_columns
from talesieve.llm.lookalike import compose, fold
from talesieve.llm.sentences import _end, _thai, Splitter, language, trained
from talesieve.llm.spans import _codes, gram_hashes
from talesieve.sources.tables import stored

#: Characters of the hashed prefix, and of that of shorter texts.
PREFIX, SHORT = 12, 4
#: Characters by which a text may be longer or shorter than what it was taken from, between equal ends.
SLIPS = 4
#: Bits of the filter on longer values, two of which are set for a prefix: 8 MB are sent to the workers, whatever the corpus.
FILTER_BITS = 1 << 26
#: Where in a hash the bits begin that name a place in the filter.
FILTER_SHIFTS = 0, 26
#: What is put in place of a lost end.
END_MARKS = re.compile(r"\s*(?:\.{3,}|…|\[(?:\.{3}|…|cut|more)\]|\((?:\.{3}|…|cut|more)\)|[—–-]|>>|»{2})$", re.I)
_mark_ends = ("...", "…", "]", ")", "—", "–", "-", ">>", "»»")
_opening = re.compile(r"^[\s\"“”„«»「」『』()\[\]'’—–-]+")


def _plain(text: str) -> str:
    return fold(compose(text))


def _table(holds) -> np.ndarray:
    return np.fromiter((holds(chr(c)) for c in range(1 << 16)), bool, 1 << 16)


_is_space = _table(str.isspace)
_is_break = _table(lambda c: c.isspace() or c in "\"“”„«»「」『』()[]—–,.!?…。！？，、।:;：；-" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff")


def _begins(codes: np.ndarray) -> np.ndarray:
    """Places where a piece may begin: no white space, behind white space, a mark or an ideograph."""
    low = np.minimum(codes, 0xFFFF).astype(np.int64)
    begins = ~_is_space[low]
    begins[1:] &= _is_break[low[:-1]]
    return np.flatnonzero(begins)


def _prefix_size(text: str) -> int:
    """Characters that a text is looked for by: fewer of a short one; 0 if it has too few."""
    return PREFIX if len(text) >= PREFIX else SHORT if len(text) >= SHORT else 0


def prefix_hashes(texts: list[str], keys: list[int] | np.ndarray) -> np.ndarray:
    """Of each text a hash of its key and prefix; texts are long enough for one."""
    sizes = np.fromiter(map(_prefix_size, texts), np.int64, len(texts))
    out = np.zeros(len(texts), np.uint64)
    for size in (PREFIX, SHORT):
        of = np.flatnonzero(sizes == size)
        if len(of):
            out[of] = gram_hashes(_codes("".join(texts[i][:size] for i in of.tolist())), size)[::size] ^ np.uint64(size)
    return (out ^ _mixed(np.asarray(keys, np.int64))).view(np.int64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ h >> np.uint64(31)


def offered_places(lines: list[str], keys: list[int], known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, line and place of all places of longer values whose hash the filter ``known`` lets pass."""
    codes = _codes("\n".join([*lines, ""]))
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    ends = np.cumsum(sizes)
    places = _begins(codes)
    line = np.searchsorted(ends, places, "right")
    left, mixed = ends[line] - 1 - places, _mixed(np.asarray(keys, np.int64))
    for size in (PREFIX, SHORT):
        fit = left >= size
        h = (gram_hashes(codes, size)[places[fit]] ^ np.uint64(size) ^ mixed[line[fit]]).view(np.int64)
        hit = np.arange(len(h))
        for shift in FILTER_SHIFTS:
            slot = h[hit] >> shift & (FILTER_BITS - 1)
            hit = hit[(known[slot >> 6] >> (slot & 63) & 1).astype(bool)]
        own, at = line[fit][hit], places[fit][hit]
        yield h[hit], own, at - (ends - sizes)[own]


def variants(text: str, characters: mojibake.Model) -> list[tuple[int, str]]:
    """Rank and form of what to look for: the text, what it was before a wrong decoding, and without a mark put in place of an end."""
    s = _plain(text)
    found = [(0, s)]
    if mojibake.suspicious(text) and (undone := _plain(mojibake.best_undone(text, characters)[0])) != s:
        found.append((1, undone))
    last = found[-1][1]
    if last.rstrip("\n").endswith(_mark_ends) and (core := END_MARKS.sub("", last)) != last and core:
        found.append((2, core))
    return found


def lines_of(text: str, characters: mojibake.Model) -> Iterator[str]:
    """The distinct lines of a longer value; those that were decoded wrongly also as they were before."""
    seen = set()
    for raw in text.split("\n"):
        forms = [_plain(raw)]
        if mojibake.suspicious(raw):
            forms.append(_plain(mojibake.best_undone(raw, characters)[0]))
        for line in forms:
            if line and line not in seen:
                seen.add(line)
                yield line


class Group:
    """All longer values and all texts of one key and one prefix."""

    def __init__(self, splitter: Splitter) -> None:
        self.splitter = splitter
        self.values: set[str] = set()
        self.texts: list[tuple[tuple, int, str]] = []

    def judged(self) -> Iterator[tuple]:
        """Id, key, position and comma of a text, rank, whether it is whole at any place, and what follows it at each place;
        a text of one form that is whole is left out, as no other form of it can be judged otherwise."""
        ordered = sorted(self.values)
        copies: dict[tuple, list[tuple[object, str]]] = {}
        if len(self.texts) > 1:
            for (rid, key, pos, _, _), rank, text in self.texts:
                if pos is not None and rank < 2:
                    copies.setdefault((key, pos), []).append((rid, text))
        for row, rank, text in self.texts:
            # another delivery that has more
            found, whole = [c[len(text) :] for i, c in copies.get(row[1:3], ()) if i != row[0] and len(c) > len(text) and c.startswith(text)], False
            if not found:
                found, whole = self._follows(ordered, text)
                if rank == 2:  # a mark that stands in the longer text too replaces nothing
                    found = [f for f in found if not END_MARKS.match(f.lstrip()[:3].rstrip())]
            if found or whole and not row[4]:
                yield (*row[:4], rank, whole, [] if whole else found)

    def _follows(self, ordered: list[str], text: str) -> tuple[list[str], bool]:
        found: list[str] = []
        at = bisect_left(ordered, text)
        places = []
        while at < len(ordered) and ordered[at].startswith(text):
            places.append((ordered[at], len(text)))
            at += 1
        if not places and len(text) > 2 * PREFIX:  # the same at both ends but for slips on the way
            for value in ordered:
                q = value.find(text[-PREFIX:], PREFIX)
                if q >= 0 and abs(q + PREFIX - len(text)) <= SLIPS:
                    places.append((value, q + PREFIX))
        for value, stop in places:
            rest = value[stop:].rstrip()
            if not rest or self._ends_at(value, stop):
                return [], True
            found.append(rest)
        return found, False

    def _ends_at(self, line: str, stop: int) -> bool:
        """Whether a sentence ends at a position within the line. Its language is asked for only where it decides."""
        if line[stop : stop + 1].isspace() and _thai.search(line) and language(line) == "th":
            return True
        begin = stop
        while begin and not line[begin - 1].isalnum():
            begin -= 1
        for m in _end.finditer(line, begin):
            if m.start() >= stop:
                return False
            if m.end() >= stop:
                return m.end() == stop and m.end() < len(line) and self.splitter.is_boundary(line, m, language(line))
        return False


def _goes_on(lost: str, nxt: str) -> bool:
    """Whether a next text begins with the lost end, or with as much of it as it has; from twice the prefix on, slips are let pass."""
    a, b = _opening.sub("", lost), _opening.sub("", nxt)
    n = min(len(a), len(b), 2 * PREFIX)
    return n > 0 and a[:n] == b[:n]


def cut_texts(df: DataFrame, longer: DataFrame, key: list[str], order: str, id_col: str, text_col: str = "text") -> DataFrame:
    """``id_col`` and ``lost`` (the lost end, as far as its line goes) of each text of ``df`` that was cut. A text that ends in
    a comma is taken to go on in a next text that is null or blank.

    ``longer`` has the columns of ``key`` and ``text_col``; texts of ``df`` of the same key and order are longer values to one another.
    Rows of order 0 (headings), null and blank texts, those of fewer than four characters, and texts found nowhere under their
    key are no cases. A null order has no next text. Rows of equal order are copies; each is judged by itself. A null in the key
    matches a null. Rows are brought together by key and prefix, so that no key is in one task; no text is compared with more
    than those that begin like it.
    """
    splitter = trained(longer, text_col)
    id_type = df.schema[id_col].dataType
    # as JSON, in which nulls are values like others
    k = F.xxhash64(F.to_json(F.struct(*key), {"ignoreNullFields": "false"})).alias("k")
    texts = df.select(k, F.col(order).cast("long").alias("pos"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met_schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("id", id_type), T.StructField("k", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("comma", T.BooleanType()), T.StructField("alone", T.BooleanType()), T.StructField("text", T.StringType())])

    def ask(batch: pa.RecordBatch) -> dict[str, list | pa.Array]:
        of, ranks, commas, forms = [], [], [], []
        for i, text in enumerate(as_list(batch["text"])):
            comma = text.endswith((",", "，", "、"))
            for rank, s in variants(text, splitter.characters):
                if len(s) >= SHORT:
                    of.append(i)
                    ranks.append(rank)
                    commas.append(comma)
                    forms.append(s)
        at = np.asarray(of, np.int64)
        alone = np.bincount(at, minlength=batch.num_rows)[at] < 2
        rows = {c: batch[c].take(pa.array(at)) for c in ("id", "k", "pos")}
        return rows | {"h": prefix_hashes(forms, rows["k"].to_numpy(zero_copy_only=False)), "rank": ranks, "comma": commas, "alone": alone, "text": forms}

    asked = stored(map_arrays(texts.where("coalesce(pos, 1) > 0 and length(trim(text)) > 0"), met_schema, ask, "text"))
    # a bitmap of fixed size says which prefixes are asked for at all; what it lets pass is joined exactly
    slots = asked.select(F.explode(F.array(*[F.shiftright("h", s).bitwiseAND(FILTER_BITS - 1) for s in FILTER_SHIFTS])).alias("slot"))
    words = slots.select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    packed = df.sparkSession.sparkContext.broadcast(bits)

    def offer(batch: pa.RecordBatch) -> dict[str, list | pa.Array]:
        lines, keys = [], []
        for key_, text in zip(as_list(batch["k"]), as_list(batch["text"])):
            lines += lines_of(text, splitter.characters)
            keys += [key_] * (len(lines) - len(keys))
        h, own, at = (np.concatenate(x) for x in zip(*offered_places(lines, keys, packed.value)))
        return {f.name: pa.nulls(len(h), f.type) for f in to_arrow_schema(met_schema)} | {"h": h, "text": [lines[i][a:] for i, a in zip(own.tolist(), at.tolist())]}

    offered = map_arrays(longer.select(k, F.col(text_col).alias("text")).where("length(trim(text)) > 0"), met_schema, offer, "text", 1_000_000)
    met = asked.unionByName(offered).repartition("h").sortWithinPartitions("h")
    judged_schema = T.StructType([T.StructField("id", id_type), T.StructField("k", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("comma", T.BooleanType()), T.StructField("rank", T.IntegerType()), T.StructField("whole", T.BooleanType()), T.StructField("follows", T.ArrayType(T.StringType()))])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(judged_schema)
        last, group, found = None, Group(splitter), []
        for batch in batches:
            offering = pc.is_null(batch["rank"])
            asking = batch.filter(pc.invert(offering))  # the others have no more than a hash and a text
            rows = zip(zip(*(as_list(asking[c]) for c in ("id", "k", "pos", "comma", "alone"))), as_list(asking["rank"]))
            for h, offers, text in zip(as_list(batch["h"]), as_list(offering), as_list(batch["text"])):
                if h != last:
                    if group.texts:
                        found += group.judged()
                    last, group = h, Group(splitter)
                if offers:
                    group.values.add(text)
                else:
                    group.texts.append((*next(rows), text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(out)], schema=out)
            found = []
        found = [*group.judged()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(out)], schema=out)

    best = F.min_by(F.struct("whole", "follows", "k", "pos", "comma"), "rank")
    suspects = stored(met.mapInArrow(judge, judged_schema).groupBy("id").agg(best.alias("x")).where("not x.whole").select("id", "x.follows", "x.k", "x.pos", "x.comma"))
    # what stands behind them
    behind = texts.where("pos is not null").select("k", (F.col("pos") - 1).alias("pos"), F.col("text").alias("next"))
    pairs = suspects.where("pos is not null").join(behind, ["k", "pos"]).select("id", "follows", "comma", "next")

    def on(cols: dict[str, list]) -> dict[str, list]:
        ids = []
        for rid, follows, comma, text in zip(cols["id"], cols["follows"], cols["comma"], cols["next"]):
            if not text or text.isspace():
                hit = comma
            else:
                hit = any(_goes_on(f, s) for _, s in variants(text, splitter.characters)[:2] for f in follows)
            if hit:
                ids.append(rid)
        return {"id": ids}

    continued = map_columns(pairs, T.StructType([T.StructField("id", id_type)]), on, "next").distinct()
    lost = F.aggregate("follows", F.get("follows", F.lit(0)), lambda a, b: F.when(F.length(b) < F.length(a), b).otherwise(a))
    return suspects.join(continued, "id", "left_anti").select(F.col("id").alias(id_col), lost.alias("lost"))
