"""Text that was decoded with the wrong encoding: finding the records, and restoring their text.

Every record has a latent encoding chain (identity, or: these bytes, of that encoding, were read as this one, once or
twice, or lost on the way). A chain explains a line by the text that it undoes to, so the line's likelihood under a chain
is that of the undone text under a character bigram model of the corpus' reliable lines. Expectation maximisation
over records pools the chains' shares per source and field: weak evidence in a record counts for more where its source
garbles much. Each record is then repaired by the chain of highest posterior.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talesieve.llm.arrowrun import map_columns
from talesieve.sources.tables import materialise

#: Buckets of the bigram counts; this bounds the model, whatever the corpus (4 bytes each are sent to the workers).
BUCKETS = 1 << 19
UNIGRAMS = 1 << 16
#: Nats that a line must gain to count as undone, before any prior.
LINE_COST = 4.0
#: Share that a chain has in a pool before any record was seen, and the weight of that belief in records.
PRIOR, PRIOR_WEIGHT = 1e-3, 20.0
#: EM goes on until no share of a pool moves by more.
SETTLED = 1e-4
#: Likelihood of a lost character, and nats that each further decoding of a chain costs.
LOST_CHAR, DOUBLE_COST = 1e-5, 1.0
#: Nats by which a replacement or control character, which no text has by itself, speaks for a loss.
LOST_GAIN = 20.0
#: Single-byte encodings that UTF-8 bytes are read as, then multi-byte ones.
UTF8_READ_AS = ("cp1252", "latin-1", "iso8859-15", "mac_roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "cp874")
UTF8_READ_AS_WIDE = ("cp932", "gbk", "cp949", "big5")
#: Encoding of the bytes, and what they were read as.
LEGACY_READ_AS = tuple((real, read) for read in ("cp1252", "mac_roman") for real in ("cp932", "euc_jp", "gbk", "big5", "cp949", "cp874", "cp1251", "koi8-r", "cp866")) + (
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("gbk", "cp949"), ("gbk", "cp932"), ("cp932", "gbk"), ("cp949", "gbk"), ("euc_jp", "gbk"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"))
LOST = "lost"


@lru_cache(None)
def _byte_of(name: str) -> dict[str, int]:
    """Characters of a single-byte encoding; undefined bytes are the control characters of the same number."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    for b in range(128, 160):
        table.setdefault(chr(b), b)
    return table


@lru_cache(None)
def _utf8_pattern(name: str) -> re.Pattern[str]:
    """Sequences of characters that are UTF-8 sequences in the encoding's bytes."""
    chars = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in _byte_of(name).items() if lo <= b <= hi) + "]"
    tail = chars(0x80, 0xBF)
    return re.compile(f"(?:{chars(0xC2, 0xDF)}{tail}|{chars(0xE0, 0xEF)}{tail}{{2}}|{chars(0xF0, 0xF4)}{tail}{{3}})+")


@lru_cache(None)
def _utf8_begins(name: str) -> re.Pattern[str]:
    """The first two characters of any such sequence; searched for more quickly."""
    chars = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in _byte_of(name).items() if lo <= b <= hi) + "]"
    return re.compile(chars(0xC2, 0xF4) + chars(0x80, 0xBF))


def _from_utf8(line: str, name: str) -> str:
    table = _byte_of(name)

    def back(m: re.Match[str]) -> str:
        try:
            return bytes(table[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _utf8_pattern(name).sub(back, line)


@lru_cache(200_000)
def _wide_bytes(c: str, name: str) -> bytes:
    try:
        return c.encode(name)
    except UnicodeEncodeError:
        return bytes([ord(c)]) if ord(c) < 256 else b"" if c == "\ufffd" else b"\xff"


def _wide_unknown(e: UnicodeEncodeError) -> tuple[bytes, int]:
    c = e.object[e.start]
    return b"\xff" if c > "\xff" and c != "\ufffd" else _wide_bytes(c, e.encoding), e.start + 1


codecs.register_error("talesieve.wide", _wide_unknown)




codecs.register_error("talesieve.unknown", lambda e: (b"\xff" * (e.end - e.start), e.end))


@lru_cache(None)
def _charmap(name: str) -> dict[int, int]:
    return {**{i: i for i in range(128)}, **{ord(c): b for c, b in _byte_of(name).items()}}


def _raw(line: str, read: str) -> bytes:
    """The bytes that were read as an encoding."""
    if read in UTF8_READ_AS_WIDE:
        return line.encode(read, "talesieve.wide")
    return codecs.charmap_encode(line, "talesieve.unknown", _charmap(read))[0]


#: All chains, by name: encodings in turn, of the bytes and what they were read as.
CHAINS = tuple(
    dict.fromkeys([
        *(f"utf-8>{n}" for n in UTF8_READ_AS),
        *(f"utf-8>{k}>utf-8>{n}" for n in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251") for k in dict.fromkeys((n, "cp1252", "latin-1"))),
        *(f"utf-8>{n}" for n in UTF8_READ_AS_WIDE),
        *(f"{real}>{read}" for real, read in LEGACY_READ_AS),
    ])
)


class Undoing:
    """Lines undone by one chain after the other; what chains have in common is done once. Each line is undone by itself:
    no encoding here has a line feed within a character, and a character that breaks off before one is lost alone."""

    def __init__(self, lines: str) -> None:
        self.line, self.raw, self.simple = lines, {}, {}

    def by(self, chain: str) -> str:
        steps = _steps(chain)
        real, read = steps[-1]
        if real == "utf-8" and read in UTF8_READ_AS:
            if (got := self.simple.get(read)) is None:
                got = self.simple[read] = _from_utf8(self.line, read)
            return _from_utf8(got, steps[0][1]) if len(steps) > 1 else got
        if (raw := self.raw.get(read)) is None:
            raw = self.raw[read] = _raw(self.line, read)
        if real == "euc_jp":  # two bytes of three are lost as one at an end only
            return "\n".join([x.decode(real, "replace") for x in raw.split(b"\n")])
        return raw.decode(real, "replace")


@lru_cache(None)
def _steps(chain: str) -> list[tuple[str, str]]:
    names = chain.split(">")
    return list(zip(names[::2], names[1::2]))

#: Characters that a line must hold to have been read as an encoding.
SHOWS = {
    **dict.fromkeys(("cp1252", "latin-1", "iso8859-15", "mac_roman", "cp1250", "cp850"), "\x80-\u024f\u02c6-\u02dd\u2013-\u2122\u2202-\u25ca\ufb01\ufb02"),
    "cp437": "\u0393-\u03c6\u2310-\u25a0\x80-\xff", "cp1251": "\u0400-\u04ff", "koi8-r": "\u0400-\u04ff\u2500-\u25a0", "cp866": "\u0400-\u04ff\u2500-\u25a0", "cp874": "\u0e00-\u0e5b",
    **dict.fromkeys(UTF8_READ_AS_WIDE, "\u3040-\ud7ff\uff61-\uff9f\uf900-\ufaff"),
}


#: Two characters in a row that stand for the bytes of another script.
_run = {read: re.compile(f"[{SHOWS[read]}]{{2}}") for read in ("cp1252", "mac_roman")}


@lru_cache(None)
def _tests() -> list[tuple[Callable[[str], object], list[str]]]:
    """The chains by what a piece must hold for any of them to have led to it: UTF-8 sequences in the characters of the
    encoding that was read last, or what that encoding shows; two in a row, where another script was read as Latin."""
    groups: dict[object, tuple[Callable[[str], object], list[str]]] = {}
    for name in CHAINS:
        real, read = name.split(">")[0], name.rsplit(">", 1)[1]
        if real == "utf-8" and read in UTF8_READ_AS:
            test = _utf8_begins(read)
        elif read in _run and real not in _run:
            test = _run[read]
        else:
            test = re.compile(f"[{SHOWS[read]}]")
        groups.setdefault(test.pattern, (test.search, []))[1].append(name)
    return list(groups.values())


@lru_cache(None)
def _by_sight() -> list[tuple[Callable[[str], object], list[str]]]:
    groups: dict[str, list[str]] = {}
    for name in CHAINS:
        groups.setdefault(SHOWS[name.rsplit(">", 1)[1]], []).append(name)
    return [(re.compile(f"[{chars}]").search, names) for chars, names in groups.items()]

_control = re.compile("[\x80-\x84\x86-\x9f\ufffd\ue000-\uf8ff]")
_tails = "".join(dict.fromkeys(re.escape(c) for n in ("cp1252", "latin-1", "iso8859-15") for c, b in _byte_of(n).items() if b < 0xC0))
_led = re.compile(f"[\u00c2-\u00f4][{_tails}]")
# a pattern that begins with a set of characters is searched for more quickly than one of branches or repeats
_dense = re.compile("[¡-ÿŒœŠšŸƒˆ˜‚„…†‡‰‹›•™Žž\x80-\x9f]" * 4)
_alone = re.compile(f"{_control.pattern[:-1]}─-▟√∂∑∏∫Ω≈∆◊]")
_two = re.compile("[\x80-\U0010ffff]" * 2)
_odd = [re.compile(p).search for p in ("‚[Ä\x80-\xff‘’“”]|ΓÇ|вЂ", "[а-яё][А-ЯЁ]", "[РС][Ѐ-Џѐ-џ\xa0-\xbf‚„…†‡€‰‹‘’“”•–—™›№]")]
_han = re.compile("[㐀-鿿가-힣｡-ﾟ]" * 2)
# characters that none of these hold: a text of no others needs no further look
_plain = re.compile("[\x00-\x7f‘’“”–—\u0900-\u097f\u0e00-\u0e7f\u3000-\u30ff，：？！（）]*").fullmatch
_utf8_three = re.compile(rb"[\xe3-\xed][\x80-\xbf]{2}")


# a line is taken apart at the ideographic marks that it still has: it may be garbled in part only
_pieces = re.compile("\n|[^\n。！？]*[。！？]+[」』”]*|[^\n。！？]+")


def suspicious(text: str) -> bool:
    """Whether a text may hold wrongly decoded places, in any of its pieces."""
    if text.isascii() or _plain(text):
        return False
    return _strange(text) or bool(_two.search(text) and _han.search(text)) and _utf8_in_wide(text)


def _strange(text: str) -> bool:
    if _alone.search(text):
        return True
    return bool(_two.search(text)) and bool(_dense.search(text) or _led.search(text) or any([odd(text) for odd in _odd]))


def _utf8_in_wide(text: str) -> bool:
    """Whether a ninth of the bytes of a text, or of one of its pieces, in a multi-byte encoding could be UTF-8 sequences."""
    held = []
    for n in UTF8_READ_AS_WIDE:
        if found := len(_utf8_three.findall(raw := text.encode(n, "ignore"))):
            if found * 9 > len(raw):
                return True
            held.append(n)  # only in these may a piece hold a sequence
    return bool(held) and any(len(_utf8_three.findall(raw := m[0].encode(n, "ignore"))) * 9 > len(raw) for m in _pieces.finditer(text) if len(m[0]) < len(text) and not m[0].isascii() for n in held)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _pairs(codes: np.ndarray) -> np.ndarray:
    return ((codes[:-1] * 0x9E3779B1 + codes[1:] * 0x85EBCA6B) & 0xFFFFFFFF) >> 7 & (BUCKETS - 1)


def _reliable(text: str) -> str:
    """What of a text counts for the model: all, or the other pieces of one that has only pieces in wrong ideographs."""
    return reliable_pieces(text) if suspicious(text) else text


def reliable_pieces(text: str) -> str:
    """Those of a suspicious text."""
    return "" if _strange(text) else "".join("\n" if suspicious(m[0]) else m[0] for m in _pieces.finditer(text)).strip("\n")


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters and of hashed character pairs of the reliable ones among some texts."""
    return counted_reliable([r for t in texts if t and (r := _reliable(t))])


def counted_reliable(good: list[str]) -> tuple[np.ndarray, np.ndarray]:
    uni, bi = np.zeros(UNIGRAMS, np.int64), np.zeros(BUCKETS, np.int64)
    for k in range(0, len(good), 2000):
        codes = _codes("\n" + "\n".join(good[k : k + 2000]) + "\n")
        uni += np.bincount(codes & (UNIGRAMS - 1), minlength=UNIGRAMS)
        uni[10] -= 1  # one line feed a text, however they are put together
        bi += np.bincount(_pairs(codes), minlength=BUCKETS)
    return uni, bi


def train(df: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters and of hashed character pairs over all reliable texts of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, bi = np.zeros(UNIGRAMS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            u, b = counted(batch.column(0).to_pylist())
            uni += u
            bi += b
        both = np.concatenate([uni, bi])
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(both[at], pa.int64())], names=["bucket", "n"])

    counts = df.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(UNIGRAMS + BUCKETS, np.float64)
    both[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    return both[:UNIGRAMS].astype(np.float32), both[UNIGRAMS:].astype(np.float32)


class Model:
    """Log-likelihood of a line under the character pairs of the reliable texts."""

    def __init__(self, uni: np.ndarray, bi: np.ndarray) -> None:
        self.uni, self.bi, self.total = uni, bi, float(uni.sum()) + 1.0

    def scores(self, lines: list[str]) -> np.ndarray:
        """Of each line by itself; lines must be without line feeds."""
        out = np.zeros(len(lines))
        begin, size = 0, 0
        for i, line in enumerate(lines):
            size += len(line) + 1
            if size > 500_000 or i + 1 == len(lines):
                out[begin : i + 1] = self._scores(lines[begin : i + 1])
                begin, size = i + 1, 0
        return out

    def _scores(self, lines: list[str]) -> np.ndarray:
        return self.scores_of_lines("\n".join(lines))

    def scores_of_lines(self, text: str) -> np.ndarray:
        """Of each line of a text that is not too long to be looked at as a whole."""
        codes = _codes("\n" + text + "\n")
        low = codes & (UNIGRAMS - 1)
        single = (self.uni[low] + 0.05) / (self.total + 0.05 * UNIGRAMS)
        single[codes == 0xFFFD] = LOST_CHAR
        each = np.log((self.bi[_pairs(codes)] + 2.0 * single[1:]) / (self.uni[low[:-1]] + 2.0))
        begins = np.flatnonzero(codes[:-1] == 10)
        return np.add.reduceat(each, begins)


def evidence(texts: list[str], model: Model) -> list[dict[str, float]]:
    """Nats by which each chain explains each text better than identity does, over the lines that it improves."""
    out: list[dict[str, float]] = []
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > 1_000_000 or i + 1 == len(texts):  # what is tried takes several times the room of the texts
            out += _evidence(texts[begin : i + 1], model)
            begin, size = i + 1, 0
    return out


def _parts(held: list[int], lines: list[str], limit: int = 100_000) -> Iterator[list[int]]:
    """Lines in parts of about ``limit`` characters, each line whole."""
    part: list[int] = []
    size = 0
    for k in held:
        part.append(k)
        size += len(lines[k]) + 1
        if size > limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _evidence(texts: list[str], model: Model) -> list[dict[str, float]]:
    of: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        for m in _pieces.finditer(text):
            if not m[0].isascii():
                of.setdefault(m[0], []).append(i)
    lines = list(of)
    own = model.scores(lines)
    gains: list[dict[str, float]] = [{} for _ in texts]
    for seen, names in _tests():
        for some in _parts([k for k, line in enumerate(lines) if seen(line)], lines):
            undoing = Undoing("\n".join([lines[k] for k in some]))
            least = own[some] + LINE_COST
            for name in names:
                got = undoing.by(name)
                gain = model.scores_of_lines(got) - least - DOUBLE_COST * (name.count(">") > 1)
                if not (hits := np.flatnonzero(gain > 0).tolist()):
                    continue
                undone = got.split("\n")
                for j in hits:
                    line = lines[some[j]]
                    if undone[j] != line and undone[j].strip("\ufffd ?"):
                        for i in of[line]:
                            gains[i][name] = gains[i].get(name, 0.0) + float(gain[j])
    for line, rows in of.items():
        if (n := line.count("\ufffd")) or _control.search(line):
            for i in rows:
                gains[i][LOST] = gains[i].get(LOST, 0.0) + LOST_GAIN * max(1, n)
    return gains


def chain_posteriors(df: DataFrame, ids: list[str], pool: list[str], text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Rows whose text is likelier wrongly decoded than not: ``ids``, ``pool``, ``chain`` (of highest posterior, the
    loss of characters only where no other chain explains the text) and ``p_garbled``.

    Null, empty and ASCII texts are never among them. Null pools are a pool of their own. Repeated rows count each;
    ``ids`` must tell rows apart. Other columns are not read.
    """
    model = model or Model(*train(df, text_col))
    both = list(dict.fromkeys([*ids, *pool]))
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in both], T.StructField("chain", T.StringType()), T.StructField("gain", T.DoubleType())])

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema}
        odd = [i for i, text in enumerate(cols[text_col]) if text and not text.isascii()]
        for i, gains in zip(odd, evidence([cols[text_col][i] for i in odd], model)):
            for chain, gain in gains.items():
                for c in both:
                    out[c].append(cols[c][i])
                out["chain"].append(chain)
                out["gain"].append(gain)
        return out

    seen = materialise(map_columns(df.select(*both, text_col), schema, run, text_col))
    sizes = materialise(df.groupBy(*pool).agg(F.count(F.lit(1)).alias("n_rows")))
    shares = sizes.select(*pool, "n_rows", F.lit(None).cast("map<string,double>").alias("shares"))
    moved = 1.0
    while moved > SETTLED:
        totals = _posterior(seen, shares, ids, pool).groupBy(*pool, "chain").agg(F.sum("p").alias("mass"))
        fresh = (
            sizes.alias("s").join(totals.alias("t"), [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in pool], "left")
            .groupBy(*[F.col(f"s.{c}").alias(c) for c in pool], "n_rows")
            .agg(F.map_from_entries(F.collect_list(F.when(F.col("chain").isNotNull(), F.struct("chain", ((F.col("mass") + PRIOR * PRIOR_WEIGHT) / (F.col("n_rows") + PRIOR_WEIGHT)).alias("share"))))).alias("shares"))
        )
        fresh = materialise(fresh)
        change = F.array_max(F.transform(F.map_entries("n.shares"), lambda e: F.abs(e["value"] - F.coalesce(F.try_element_at("o.shares", e["key"]), F.lit(0.0)))))
        step = fresh.alias("n").join(shares.alias("o"), [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in pool]).agg(F.max(change)).first()[0]
        moved, shares = step or 0.0, fresh
    final = _posterior(seen, shares, ids, pool)
    best = final.groupBy(*both).agg(F.sum("p").alias("p_garbled"), F.max_by("chain", F.struct(F.col("chain") != LOST, "p", "chain")).alias("chain"))
    return best.where("p_garbled > 0.5").select(*both, "chain", "p_garbled")


def _posterior(seen: DataFrame, shares: DataFrame, ids: list[str], pool: list[str]) -> DataFrame:
    """Responsibility of each chain for each record; identity has what is left of 1."""
    both = list(dict.fromkeys([*ids, *pool]))
    joined = seen.alias("e").join(shares.alias("s"), [F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}")) for c in pool])
    share = F.coalesce(F.try_element_at("s.shares", F.col("e.chain")), F.lit(PRIOR * PRIOR_WEIGHT) / (F.col("s.n_rows") + PRIOR_WEIGHT) + PRIOR)
    scored = joined.select(*[F.col(f"e.{c}").alias(c) for c in [*both, "chain"]], (F.col("e.gain") + F.log(share)).alias("l"))
    grouped = scored.groupBy(*both).agg(F.collect_list(F.struct("chain", "l")).alias("cs"))
    top = F.greatest(F.lit(0.0), F.array_max(F.transform("cs", lambda x: x["l"])))
    total = F.exp(-top) + F.aggregate("cs", F.lit(0.0), lambda a, x: a + F.exp(x["l"] - top))
    return grouped.withColumn("top", top).withColumn("total", total).select(*both, "top", "total", F.explode("cs").alias("c")).select(*both, F.col("c.chain").alias("chain"), (F.exp(F.col("c.l") - F.col("top")) / F.col("total")).alias("p"))


def undo(text: str, chain: str, model: Model) -> str:
    """The text with every piece undone that the chain improves."""
    if chain not in CHAINS:
        return text
    pieces = [m[0] for m in _pieces.finditer(text)]
    for i, piece in enumerate(pieces):
        if not piece.isascii():
            got = Undoing(piece).by(chain)
            if got != piece and "\n" not in got:
                own, new = model.scores([piece, got])
                if new - own > LINE_COST:
                    pieces[i] = got
    return "".join(pieces)


def restored(df: DataFrame, ids: list[str], pool: list[str], text_col: str = "text") -> DataFrame:
    """Of each garbled row: ``ids``, ``chain``, ``p_garbled``, ``restored`` (its text as far as it can be had) and
    ``complete`` (no place was lost). Same cases as ``chain_posteriors``."""
    model = Model(*train(df, text_col))
    found = chain_posteriors(df, ids, pool, text_col, model)
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in ids], T.StructField("chain", T.StringType()), T.StructField("p_garbled", T.DoubleType()), T.StructField("restored", T.StringType()), T.StructField("complete", T.BooleanType())])

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [undo(t, c, model) for t, c in zip(cols[text_col], cols["chain"])]
        return {c: cols[c] for c in (*ids, "chain", "p_garbled")} | {"restored": texts, "complete": [not _control.search(t) for t in texts]}

    return map_columns(df.select(*ids, text_col).join(found.select(*ids, "chain", "p_garbled"), ids), schema, run, text_col)


def _replaced(chars: str, name: str) -> str:
    table = _byte_of(name)
    return bytes([table[c] for c in chars]).decode("utf-8", "replace")


def undone_with_places(line: str) -> tuple[str, list[int]]:
    """A line with its UTF-8 sequences undone (read as the single-byte encoding that leaves the fewest characters), and
    of each position of it, the end included, the position in the line as stored."""
    best, place = line, list(range(len(line) + 1))
    for _ in range(2):
        name, shortest = None, best
        for n in UTF8_READ_AS:
            if _utf8_begins(n).search(best) and len(text := _utf8_pattern(n).sub(lambda m: _replaced(m[0], n), best)) < len(shortest):  # noqa: B023
                name, shortest = n, text
        if name is None:
            break
        places, at = [], 0
        for m in _utf8_pattern(name).finditer(best):
            places += place[at : m.start()]
            step = m.start()
            for c in _replaced(m[0], name):
                places.append(place[step])
                step += len(c.encode("utf-8")) if c != "�" else 1
            at = m.end()
        best, place = shortest, places + place[at:]
    return best, place


def _decoded_with_places(line: str, chain: str) -> tuple[str, list[int]]:
    """A line undone by one decoding, fed byte by byte, so that each character's first byte is known.

    What is no character of the single-byte encoding that the line was read as stays as it is.
    """
    real, read = chain.split(">")
    table = {} if read in UTF8_READ_AS_WIDE else _charmap(read)
    decoder = codecs.getincrementaldecoder(real)("replace")
    chars: list[str] = []
    places: list[int] = []
    begin = 0  # where the character that is being put together begins

    def put(got: str, following: int) -> None:
        nonlocal begin
        for c in got:
            chars.append(c)
            places.append(begin)
        if got:
            begin = following

    for i, c in enumerate(line):
        if table and ord(c) not in table:
            put(decoder.decode(b"", True), i)
            decoder.reset()
            begin = i
            put(c, i + 1)
            continue
        for byte in bytes([table[ord(c)]]) if table else _wide_bytes(c, read):
            put(decoder.decode(bytes([byte])), i + 1)
    put(decoder.decode(b"", True), len(line))
    return "".join(chars), [*places, len(line)]


def best_undone(line: str, model: Model) -> tuple[str, list[int]]:
    """As ``undone_with_places``, by any single decoding, if the model finds the result the likelier text.

    A line that is garbled in part only is taken apart at the ideographic marks that it still has.
    """
    pieces = [m[0] for m in _pieces.finditer(line)]
    if len(pieces) > 1:
        text, places, at = [], [], 0
        for piece in pieces:
            got, where = _best_undone(piece, model) if suspicious(piece) else (piece, list(range(len(piece) + 1)))
            text.append(got)
            places += [at + w for w in where[:-1]]
            at += len(piece)
        return "".join(text), [*places, len(line)]
    return _best_undone(line, model)


def _best_undone(line: str, model: Model) -> tuple[str, list[int]]:
    simple, places = undone_with_places(line)
    if simple != line and not suspicious(simple):
        return simple, places
    names = [n for seen, group in _by_sight() if seen(line) for n in group if n.count(">") == 1]
    undoing = Undoing(line)
    tried = [(n, got) for n in names if (got := undoing.by(n)) != line and "\n" not in got and got.strip("\ufffd ?")]
    if tried:
        scores = model.scores([line, simple, *(got for _, got in tried)])
        k = int(scores[2:].argmax())
        if scores[2 + k] > max(scores[0], scores[1]) + LINE_COST:
            chain = tried[k][0]
            if chain in {f"utf-8>{n}" for n in UTF8_READ_AS}:
                return simple, places
            return _decoded_with_places(line, chain)
    return simple, places
