"""Sentence units of texts in any language and script.

Candidates are end marks with the marks that close behind them (and, in Thai, spaces). Each candidate within a line is
classified by maximum entropy over its surroundings. The models are trained on reliable places only: line ends, which
end a sentence for certain, and words before exclamation and question marks, against all other full stops (what never ends
a line or stands before such a mark is an abbreviation); and, for the words behind a quotation, clauses behind a comma
within the quotation marks, which attribute it for certain, against the beginnings of lines, which do not.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from talesieve.llm import mojibake
from talesieve.llm.arrowrun import map_columns
from talesieve.llm.lookalike import INVISIBLE, compose, fold
from talesieve.sources.tables import stored

#: Distinct rows of features that are fitted on the driver; more are fitted by the workers, with the same result.
ROWS_ON_DRIVER = 2_000_000
WIDTH = 1 << 18
#: Words behind a quotation among which a verb of saying attributes it.
NEAR = 7
ROUNDS = 80
#: Share of line ends that a place like this must have among those with its left side, to end a sentence.
LEAST_END = 0.13
#: The same before a figure, where abbreviations are the rule.
LEAST_END_BEFORE_FIGURE = 0.4
#: End marks, marks that close, marks that open.
MARKS = ".!?…。！？।॥｡؟‼⁇⁈⁉"
CLOSING = "\"”’»」』）)]'“›〉》】"
OPENING = "\"“„«「『（([‘‹〈《【¡¿—–-"
#: Verbs of saying, by which the words behind a quotation attribute it.
SAYING = set(
    """said says say asked asks answered answers replied replies whispered whispers shouted shouts muttered mutters hissed hisses sighed sighs snapped snaps
    cried cries called calls murmured murmurs growled growls barked exclaimed laughed groaned added continued demanded declared agreed thought insisted yelled screamed
    dijo gritó susurró preguntó respondió contestó murmuró exclamó dit cria murmura demanda répondit chuchota souffla s'écria sagte rief flüsterte fragte antwortete murmelte schrie
    сказал сказала крикнул крикнула прошептал прошептала спросил спросила ответил ответила пробормотал пробормотала воскликнул воскликнула
    말했다 외쳤다 물었다 속삭였다 대답했다 중얼거렸다 कहा पूछा बोला बोली चिल्लाया फुसफुसाया""".split()
)
#: The same in scripts without spaces, as endings of a clause.
SAYING_ENDINGS = ("说", "問", "问", "道", "答", "喊", "叫", "言った", "叫んだ", "つぶやいた", "尋ねた", "答えた", "ささやいた", "囁いた", "พูด", "ถาม", "กล่าว", "ตอบ", "กระซิบ", "ตะโกน")

_closing = re.escape(CLOSING)
_thin = f"[{INVISIBLE}]*"
_wide = "぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"
_end = re.compile(f"(?P<marks>[{re.escape(MARKS)}](?:{_thin}[{re.escape(MARKS)}])*){_thin}(?P<close>(?:[^\\S\\n]?[»›]|{_thin}[{_closing}])*){_thin}")
_thai_space = re.compile("(?<=[^\\s])[^\\S\\n]+(?=[^\\s])")
_thai = re.compile("[฀-๿]")
_near = re.compile("[0-9A-Za-z０-９Ａ-Ｚａ-ｚÀ-ɏ๐-๙]")
_ideographic = re.compile(f"[{_wide}]")
_ends_token = frozenset("\"“”„«»「」『』()[]<>—¡¿,，、")
_between = re.compile(f"[\\s{re.escape(''.join(_ends_token))}]")
_next = re.compile(r"\s*([\"“„«「『（(\[‘‹《【¡¿<]*)\s*([—–-]?)\s*([^\s,.!?…。！？।]*)")
_clause = re.compile(r"[^.!?…。！？।\n]*")
_digits = re.compile(r"\d+")
_function_words = {
    w: lang
    for lang, ws in {
        "de": "der die das und den dem ein eine zwei nach vor im am zu auf aus mit von für ist sind war hat haben wir ich du er sie nicht kein keine bei bis wie wird über unter durch dass als",
        "fr": "le les une des dans du sur est au aux et pour avec qui que ne pas nous vous il elle ce cette son sa ses par après avant",
        "es": "el los las una en del con sobre para que por al y mi mis su sus no nunca antes dos tras se lo nos",
        "en": "the and of to was with his her at my i you we they this that is are he she it for from has have had be not in on will by",
    }.items()
    for w in ws.split()
}
_scripts = [(lang, re.compile(f"[{chars}]")) for lang, chars in (("ru", "Ѐ-ӿ"), ("hi", "ऀ-ॿ"), ("th", "฀-๿"), ("ja", "぀-ヿ"), ("zh", "㐀-鿿"), ("ko", "가-힣"))]
NOT_LATIN = ("ru", "hi", "th", "ja", "zh", "ko")
_not_latin = re.compile("[Ѐ-ӿऀ-ॿ฀-๿぀-ヿ㐀-鿿가-힣]")


class _Scripts(dict):
    """Of each character its language by script, and whether it is a letter."""

    def __missing__(self, c: str) -> tuple[str | None, bool]:
        got = self[c] = next((lang for lang, p in _scripts if p.match(c)), None), c.isalpha() or c.isalnum() and not c.isdecimal()
        return got


_script_of = _Scripts()


def language(text: str) -> str:
    """A coarse guess by script and function words, good enough for a feature."""
    if not text.isascii() and _not_latin.search(text):
        counts, letters = {lang: 0 for lang, _ in _scripts}, 0
        for c, n in Counter(text).items():
            lang, is_letter = _script_of[c]
            letters += n * is_letter
            if lang:
                counts[lang] += n
        if counts["ja"] * 6 > counts["zh"]:
            counts["ja"] += counts.pop("zh")
        best = max(counts, key=lambda k: counts[k])
        if 2 * counts[best] > letters - sum(counts.values()):
            return best
    votes = [lang for lang in map(_function_words.get, text.lower().split()) if lang]
    return max(dict.fromkeys(votes), key=votes.count) if votes else "xx"


def line_language(line: str, of_text: str, own: str | None = None) -> str:
    """The line's own language, as far as its script or function words tell; else that of its text, if in the same kind of script."""
    own = own or language(line)
    if own != "xx":
        return own
    return own if of_text in NOT_LATIN and (line.isascii() or _not_latin.search(line) is None) else of_text


@lru_cache(1 << 17)
def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (WIDTH - 1)


def left_features(left: str, lang: str, before: str = "") -> list[str]:
    """Of the token before a mark; of a figure also the token before it."""
    word = _digits.sub("9", left)
    if "." in word and len(word.rpartition(".")[2]) > 3:
        word = word.rpartition(".")[2]  # an address ends in a word
    kind = "digit" if word[-1:] == "9" else "none" if not word else "one" if len(word) == 1 else "up" if word[0].isupper() else "low"
    return ["bias", f"w={word.lower()}", f"k={kind}", f"kl={kind}|{lang}", f"n={min(len(word), 8)}", f"dot={'.' in word}", f"sfx={word[-3:]}|{lang}", *([f"before={before.lower()}", f"before={before.lower()}|{lang}"] if kind == "digit" else [])]


def clause_features(clause: str, lang: str) -> list[str]:
    """Of the words behind a quotation."""
    words = clause.split()
    bare = [w.strip(",;:—–-\"“”").lower() for w in (*words[:NEAR], *words[-1:])]
    spaced = lang not in ("zh", "ja", "th")
    n = len(words) if spaced else len(clause.strip()) // 3
    says = not SAYING.isdisjoint(bare[: min(len(words), NEAR)]) if spaced else clause.strip().endswith(SAYING_ENDINGS)  # further away it says nothing about who speaks the quotation
    return ["bias", f"n={min(n, 9)}", f"says={says}", f"says={says}|short={n <= 6}", f"low={bool(words) and words[0][:1].islower()}", f"comma={',' in clause or '，' in clause or '、' in clause}", *[f"v={w}" for w in bare[1 : min(len(words), 4)]], f"last={bare[-1] if bare else ''}"]


def _pull(w: np.ndarray, slots: np.ndarray, sizes: np.ndarray, no: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """The gradient over distinct rows of slots. Each row's part is a multiple of 2**-20, so that their sum is the same in any order."""
    g, bounds = np.zeros(len(w)), np.concatenate([[0], np.cumsum(sizes)])
    for a in range(0, len(sizes), 100_000):  # what is made on the way takes several times the room of the rows
        b = min(a + 100_000, len(sizes))
        own, of = slots[bounds[a] : bounds[b]], np.repeat(np.arange(b - a), sizes[a:b])
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[own], b - a), -30, 30)))
        part = np.rint(((no + yes)[a:b] * p - yes[a:b]) * (1 << 20)) / (1 << 20)
        g += np.bincount(own, part[of], len(w))
    return g


def _unpacked(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    packed, no, yes = rows["slots"], rows["no"].to_numpy(), rows["yes"].to_numpy()
    if not len(packed):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), no, yes
    packed = packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed
    _, ends, data = packed.buffers()
    ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int32), np.diff(ends) // 4, no, yes


def fitted(gradient: Callable[[np.ndarray], np.ndarray], models: int, penalty: float = 0.3) -> list[MaximumEntropy]:
    """Some models with slots one behind the other's, fitted by adaptive full gradients with a normal prior."""
    w, scale = np.zeros(models * WIDTH), np.full(models * WIDTH, 1e-6)
    for _ in range(ROUNDS):
        g = gradient(w) + penalty * w
        scale += g * g
        w -= g / np.sqrt(scale)
    return [MaximumEntropy(x) for x in w.astype(np.float32).reshape(models, WIDTH)]


class MaximumEntropy:
    """Two-class maximum entropy over hashed features."""

    def __init__(self, w: np.ndarray) -> None:
        self.w = w

    def probability(self, features: list[str]) -> float:
        return float(1 / (1 + np.exp(-np.clip(sum(float(self.w[_slot(f)]) for f in features), -30, 30))))


_behind_comma = re.compile(r"[,，](?:[\"”»]|\s»)\s+(?=[^\s—–-])|[,，]“,?\s+(?=[a-zäöü])")


class Places:
    """Places whose class is known for certain, as distinct rows of slots, with how often they are of either class."""

    def __init__(self) -> None:
        self.rows: dict[bytes, list[int]] = {}
        self.characters = np.zeros(mojibake.UNIGRAMS, np.int64), np.zeros(mojibake.BUCKETS, np.int64)

    def add(self, texts: list[str | None]) -> None:
        ends: Counter[tuple] = Counter()
        clauses: Counter[tuple] = Counter()
        reliable = []
        for text in texts:
            if not text:
                continue
            clean, whole = not mojibake.suspicious(text), None
            reliable.append(text if clean else mojibake.reliable_pieces(text))
            for line in text.split("\n")[1:]:
                s = line.rstrip()
                if not s or not clean and mojibake.suspicious(s):
                    continue
                if (lang := language(s)) == "xx":
                    whole = whole or language(text)
                    lang = line_language(s, whole, lang)
                for m in _end.finditer(s):
                    stop, marks = m.end(), m[1]
                    at_end, mark = stop == len(s), marks[-1]
                    if mark in "!?" or mark == "." and len(marks) < 2 and (at_end or s[stop].isspace()):
                        ends[(*Splitter._token(s, m.start()), lang, at_end or mark != ".")] += 1
                if m := _behind_comma.search(s):
                    clauses[_clause.match(s, m.end())[0], lang, True] += 1
                if not s.startswith(tuple(OPENING)):
                    clauses[_clause.match(s)[0], lang, False] += 1
        for (token, before, lang, is_end), n in ends.items():
            for known in {lang, "xx" if lang in ("de", "fr", "es", "en") else lang}:  # short texts don't tell
                self._count(left_features(token, known, before), 0, is_end, n)
        for (clause, lang, attributes), n in clauses.items():
            self._count(clause_features(clause, lang), WIDTH, attributes, n)
        for total, part in zip(self.characters, mojibake.counted_reliable([r for r in reliable if r])):
            total += part

    def _count(self, features: list[str], first: int, label: bool, n: int) -> None:
        key = array("i", [first + _slot(f) for f in features]).tobytes()
        self.rows.setdefault(key, [0, 0])[label] += n

    def rows_as(self, schema: pa.Schema) -> pa.RecordBatch:
        no, yes = zip(*self.rows.values()) if self.rows else ((), ())
        found = {"slots": list(self.rows), "bucket": [None] * len(no), "no": no, "yes": yes}
        return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)

    def characters_as(self, schema: pa.Schema) -> pa.RecordBatch:
        both = np.concatenate(self.characters)
        at = np.flatnonzero(both)
        found = {"slots": [None] * len(at), "bucket": at, "no": both[at], "yes": np.zeros(len(at), np.int64)}
        return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)


def trained(df: DataFrame, text_col: str = "text", rows_on_driver: int = ROWS_ON_DRIVER) -> Splitter:
    """The models, fitted on all texts of ``df``. Only distinct rows of features are kept, and the driver holds ``rows_on_driver`` of them at most:
    where there are more, each round's gradient is summed by the workers."""
    schema = T.StructType([T.StructField("slots", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("bucket", "no", "yes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, places = to_arrow_schema(schema), Places()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for k in range(0, len(texts), 1000):
                places.add(texts[k : k + 1000])
                if len(places.rows) > 100_000:
                    yield places.rows_as(out)
                    places.rows = {}
        yield places.rows_as(out)
        yield places.characters_as(out)

    counts = stored(df.select(text_col).where(F.length(text_col) > 0).mapInArrow(run, schema).groupBy("slots", "bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")))
    seen = counts.where("slots is null").select("bucket", "no").toPandas()
    characters = np.zeros(mojibake.UNIGRAMS + mojibake.BUCKETS, np.int64)
    characters[seen["bucket"].to_numpy(np.int64)] = seen["no"].to_numpy(np.int64)
    rows = counts.where("slots is not null").drop("bucket")
    if rows.count() <= rows_on_driver:
        own = _unpacked(rows.toArrow())
        return Splitter(fitted(lambda w: _pull(w, *own), 2), characters)
    return Splitter(fitted(lambda w: _pull_by_workers(w, rows), 2), characters)


def _pull_by_workers(w: np.ndarray, rows: DataFrame) -> np.ndarray:
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(len(sent.value))
        for batch in batches:
            g += _pull(sent.value, *_unpacked(batch))
        at = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(g[at], pa.float64())], names=["slot", "g"])

    # few tasks, as each gives a value a slot
    got = rows.coalesce(64).mapInArrow(run, "slot long, g double").groupBy("slot").agg(F.sum("g").alias("g")).toPandas()
    sent.destroy()
    g = np.zeros(len(w))
    g[got["slot"].to_numpy(np.int64)] = got["g"].to_numpy(np.float64)
    return g


class Splitter:
    """Both models, and what follows from them for whole texts. Made from texts, or from models fitted before and counts of characters."""

    def __init__(self, fitted_on: list[str] | list[MaximumEntropy], characters: np.ndarray | None = None) -> None:
        if characters is None:
            places = Places()
            places.add(fitted_on)
            own = _unpacked(places.rows_as(pa.schema([("slots", pa.binary()), ("no", pa.int64()), ("yes", pa.int64())])))
            fitted_on, characters = fitted(lambda w: _pull(w, *own), 2), np.concatenate(places.characters)
        self.ends, self.attributes = fitted_on
        self.characters = mojibake.Model(*(c.astype(np.float32) for c in np.split(characters, [mojibake.UNIGRAMS])))
        self.known: dict[tuple, bool] = {}
        self.clauses: dict[tuple, bool] = {}

    @staticmethod
    def _token(line: str, stop: int) -> tuple[str, str]:
        """The token before a mark; of a figure also the token before it."""
        begin = max(stop - 30, line.rfind(" ", max(stop - 30, 0), stop) + 1, 0)
        for m in _between.finditer(line, begin, stop):
            begin = m.end()
        while begin and not (line[begin - 1].isspace() or line[begin - 1] in _ends_token):  # longer ones
            begin -= 1
        word, before = line[begin:stop], ""
        if word[-1:].isdigit():
            last = begin
            while last and line[last - 1].isspace():
                last -= 1
            first = last
            while first and not line[first - 1].isspace():
                first -= 1
            before = line[first:last]
        word = word if word.isascii() else fold(compose(word))
        return word, before

    def attributes_quotation(self, clause: str, lang: str) -> bool:
        key = (clause, lang)
        if (got := self.clauses.get(key)) is None:
            if len(self.clauses) > 200_000:
                self.clauses.clear()
            features = clause_features(clause, lang)
            got = self.clauses[key] = self.attributes.probability(features) > (0.4 if "says=True" in features else 0.9)
        return got

    def is_boundary(self, line: str, m: re.Match[str], lang: str) -> bool:
        """Whether a candidate within a line, something behind it, ends a unit."""
        stop = m.end()
        wide = m["marks"][-1] in "。！？｡" or lang in ("zh", "ja")
        if not line[stop].isspace() and not (wide and (m["marks"][-1] not in "." or _ideographic.match(line[stop]))) and not m["close"]:
            return False
        nxt = _next.match(line, stop)
        word = nxt[3]
        first = word[:1]
        if first.islower() and (m["close"] or m["marks"][-1] == "…" or m["marks"].endswith("..") or any(map(str.isupper, line))):
            return False  # a pause, an abbreviation, or words that attribute; in a line of small letters, nothing
        if not first and not nxt[1] and not nxt[2]:
            return False
        if m["close"] and not nxt[1]:
            quoted = any(c in "\"”»」』“›" for c in m["close"])
            if quoted and self.attributes_quotation(_clause.match(line, stop)[0], lang):
                return False
            if not line[stop].isspace() and not wide:
                return False
        pause = m["marks"][-1] == "…" or m["marks"].endswith("..")
        if pause and wide:
            return bool(m["close"])
        if m["marks"][-1] not in "." or pause:
            return True
        token, before = self._token(line, m.start())
        if "." in token and len(token.rpartition(".")[2]) > 3:
            return True  # an address ends in a word
        key = (token, before, m["marks"], lang, first.isdigit())
        if (got := self.known.get(key)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[key] = self.ends.probability(left_features(token, lang, before)) > (LEAST_END_BEFORE_FIGURE if first.isdigit() else LEAST_END)
        return got

    def line_stops(self, line: str, of_line: Callable[[str], str]) -> list[int]:
        """Where units end within a line, its own end not included. Its language is asked for only if there are candidates."""
        candidates = [m for m in _end.finditer(line) if m.end() < len(line)]
        lang = of_line(line) if candidates else ""
        found = [m.end() for m in candidates if self.is_boundary(line, m, lang)]
        if _thai.search(line):
            for m in _thai_space.finditer(line):
                a, b = line[m.start() - 1], line[m.end()]
                if not _near.match(a) and not _near.match(b) and (_thai.match(a) or _thai.match(b)):
                    found.append(m.start())
            found = sorted(set(found))
        return found

    def units(self, text: str, heading: str) -> list[tuple[int, int]]:
        """Begin and end of each unit; ``heading``: 'none', 'line' (the first line is one unit) or 'all' (every line is)."""
        out: list[tuple[int, int]] = []
        of_text: list[str] = []

        def of_line(line: str) -> str:
            if (own := language(line)) == "xx" and len(line) < len(text):
                of_text[:] = of_text or [language(text)]
                own = line_language(line, of_text[0], own)
            return own

        at, first = 0, True
        for line in text.split("\n"):
            if line and not line.isspace():
                if heading == "all" or heading == "line" and first:
                    stops = []
                elif mojibake.suspicious(line):
                    stops = self._garbled_stops(line)
                else:
                    stops = self.line_stops(line, of_line)
                begin = 0
                for stop in (*stops, len(line)):
                    piece = line[begin:stop]
                    if s := piece.strip():
                        a = at + begin + len(piece) - len(piece.lstrip())
                        out.append((a, a + len(s)))
                    begin = stop
            first = False
            at += len(line) + 1
        return out

    def _garbled_stops(self, line: str) -> list[int]:
        """Those of the undone line, carried back to the stored characters."""
        undone, place = mojibake.best_undone(line, self.characters)
        return [place[x] for x in self.line_stops(undone, language)]


def split_texts(df: DataFrame, ids: list[str], text_col: str = "text", heading: str | None = None, training: DataFrame | None = None) -> DataFrame:
    """One row per unit: ``ids, start_pos, end_pos`` (code points of the stored text, end exclusive, no white space at
    either end). ``heading`` names a column with 'none', 'line' or 'all'. Null and blank texts have no unit. Repeated
    rows give their units each. Other columns are not read. The models are fitted on ``training`` (``df`` itself if
    none), on all of its texts."""
    cols = [*ids, text_col] + ([heading] if heading else [])
    splitter = trained(df if training is None else training, text_col)
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in ids], T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])

    def run(batch: dict[str, list]) -> dict[str, list]:
        heads = batch[heading] if heading else ["none"] * len(batch[text_col])
        found = [splitter.units(t, h) if t else [] for t, h in zip(batch[text_col], heads)]
        out = {c: [v for v, us in zip(batch[c], found) for _ in us] for c in ids}
        return out | {"start_pos": [a for us in found for a, _ in us], "end_pos": [b for us in found for _, b in us]}

    return map_columns(df.select(*cols), schema, run, text_col)
