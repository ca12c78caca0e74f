"""One consistent form of text whose characters differ though it looks the same.

Steps: compatibility composition of widths, ligatures, radicals and combining marks; invisible characters removed; every
space of the line made a plain one. Then the script-aware repair: in a token of several scripts (or of a script foreign
to its text that consists of look-alikes only) the look-alikes of the minor script are replaced by letters of the dominant
script, provided the corpus holds the resulting word in one script.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talesieve.llm.arrowrun import map_columns
from talesieve.sources.tables import materialise

#: Letters that look alike, in the order Latin, Cyrillic, Greek; a dot where a script has none.
LOOKALIKES = (
    "aа. cс. eе. iі. jј. oоο pр. sѕ. xх. yу. hһ. dԁ. qԛ. wԝ. v.ν "
    "AАΑ BВΒ CС. EЕΕ HНΗ IІΙ JЈ. KКΚ MМΜ N.Ν OОΟ PРΡ SЅ. TТΤ XХΧ YҮΥ Z.Ζ ZZΖ"
).split()
#: Characters without any width.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff"

LATIN, CYRILLIC, GREEK = "latin", "cyrillic", "greek"
#: Of each script, what a look-alike of another script becomes.
INTO: dict[str, dict[str, str]] = {LATIN: {}, CYRILLIC: {}, GREEK: {}}
for _row in LOOKALIKES:
    for _i, _s in enumerate((LATIN, CYRILLIC, GREEK)):
        for _c in _row:
            if _c != "." and _row[_i] not in (".", _c):
                INTO[_s].setdefault(_c, _row[_i])
#: Comparison form: every look-alike becomes the Latin letter.
FOLD = str.maketrans(INTO[LATIN])

_invisible = re.compile(f"[{INVISIBLE}]").sub
_line_ends = re.compile(r"\r\n?|\u2028|\u2029|\x85(?=\s)").sub
# characters whose compatibility form looks different: raised and lowered figures, fractions, circles, lone accents
_kept = re.compile("[¨ª¯²-µ¸-º¼-¾˘-˝⁰-ₜ™⅐-↋①-⓿]+")
_token = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ̀-ͯͰ-ϿЀ-ԯḀ-῿]+")
_foreign = re.compile("[Ͱ-ϿЀ-ԯ]").search
_latin = re.compile("[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]")
_cyrillic = re.compile("[Ѐ-ԯ]")
_greek = re.compile("[Ͱ-Ͽἀ-῿]")


def compose(text: str) -> str:
    """The text in compatibility form, without invisible characters, with plain spaces and line ends."""
    if text.isascii():
        s = text
    else:
        s = _invisible("", text)
        if _kept.search(s):
            parts, at = [], 0
            for m in _kept.finditer(s):
                parts += [unicodedata.normalize("NFKC", s[at : m.start()]), m[0]]
                at = m.end()
            s = "".join(parts) + unicodedata.normalize("NFKC", s[at:])
        else:
            s = unicodedata.normalize("NFKC", s)
    if "\r" in s or "\u2028" in s or "\u2029" in s:
        s = _line_ends("\n", s)
    if "\n" in s:
        return "\n".join([" ".join(line.split()) for line in s.split("\n")]).strip("\n")
    return " ".join(s.split())


def script_counts(token: str) -> Counter:
    return Counter({s: n for s, p in ((LATIN, _latin), (CYRILLIC, _cyrillic), (GREEK, _greek)) if (n := len(p.findall(token)))})


def convert(token: str, script: str) -> str | None:
    """The token with all look-alikes of other scripts in ``script``; None if a letter has no counterpart."""
    out = "".join(INTO[script].get(c, c) for c in unicodedata.normalize("NFD", token))
    out = unicodedata.normalize("NFC", out)
    return out if set(script_counts(out)) <= {script} else None


def suspicious_tokens(text: str) -> list[str]:
    """Tokens of several scripts, and tokens of look-alikes only in a script that is not the text's main one."""
    if not _foreign(text):
        return []
    main = script_counts(text).most_common(1)[0][0]
    found = []
    for token in set(_token.findall(text)):
        kinds = script_counts(token)
        if len(kinds) > 1 or (kinds and main not in kinds and convert(token, main)):
            found.append(f"{main}:{token}")
    return sorted(found)


def proposals(tagged: str) -> list[str]:
    """Words that a suspicious token may stand for, the likeliest first: its own dominant script, then its text's."""
    main, token = tagged.split(":", 1)
    kinds = script_counts(token)
    best = max(kinds.values())
    order = [s for s, n in sorted(kinds.items(), key=lambda x: (-x[1], x[0] != main, x[0]))] if len(kinds) > 1 else [main]
    if len(kinds) > 1 and main in kinds and kinds[main] == best:
        order = [main, *[s for s in order if s != main]]
    if main not in order:
        order.append(main)
    return [w for s in order if (w := convert(token, s)) and w != token]


def fold(text: str) -> str:
    """A comparison form, coarser than the canonical one: every look-alike becomes the Latin letter, whatever the word."""
    if not _foreign(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(FOLD))


def repair(text: str, words: dict[str, str]) -> str:
    return _token.sub(lambda m: words.get(m[0], m[0]), text)


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _pass_schema(ids: list[T.StructField]) -> T.StructType:
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in ids], T.StructField("key", T.BinaryType()), T.StructField("raw", T.BinaryType()), T.StructField("canonical", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("words", T.ArrayType(T.StringType()))])


def canonical_forms(df: DataFrame, ids: list[str], text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per row with a text: ``ids``, ``key`` (equal for texts of the same canonical form), ``raw`` (equal for the same
    characters), ``canonical`` (the one form; null without ``keep_text``) and ``repaired int`` (tokens replaced).

    ``ids`` must name one row together with nothing else. Null texts give no row; blank texts have the canonical form
    ''. Repeated rows are kept. Other columns of ``df`` are not read.
    """
    schema = _pass_schema([df.schema[c] for c in ids])

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in schema}
        vocabulary: set[str] = set()
        for i, text in enumerate(cols[text_col]):
            if text is None:
                continue
            s = compose(text)
            odd = suspicious_tokens(s)
            vocabulary.update(_token.findall(s) if not odd else set(_token.findall(s)).difference(t.split(":", 1)[1] for t in odd))
            for c in ids:
                out[c].append(cols[c][i])
            out["key"].append(digest(s))
            out["raw"].append(digest(text))
            out["canonical"].append(s if keep_text or odd else None)
            out["tokens"].append(odd or None)
            out["words"].append(None)
        pure = [w for w in vocabulary if len(script_counts(w)) == 1]
        for c in ids:
            out[c].append(None)
        for c in ("key", "raw", "canonical", "tokens"):
            out[c].append(None)
        out["words"].append(pure)
        return out

    seen = materialise(map_columns(df.select(*ids, text_col), schema, run, text_col))
    texts = seen.where("words is null")
    words = seen.where("words is not null").select(F.explode("words").alias("word")).distinct()

    asked_schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("word", T.StringType()), T.StructField("rank", T.IntegerType())])

    def ask(cols: dict[str, list]) -> dict[str, list]:
        rows = [(t, w, k) for t in cols["token"] for k, w in enumerate(proposals(t))]
        return {"token": [r[0] for r in rows], "word": [r[1] for r in rows], "rank": [r[2] for r in rows]}

    odd = texts.where("tokens is not null")
    asked = map_columns(odd.select(F.explode("tokens").alias("token")).distinct(), asked_schema, ask)
    chosen = asked.join(words, "word").groupBy("token").agg(F.min_by("word", "rank").alias("word"))
    per_text = odd.select(*ids, F.explode("tokens").alias("token")).join(chosen, "token").groupBy(*ids).agg(F.collect_set(F.struct(F.substring_index("token", ":", -1).alias("token"), "word")).alias("found"))

    fixed_schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in (df.schema[c] for c in ids)], T.StructField("key", T.BinaryType()), T.StructField("raw", T.BinaryType()), T.StructField("canonical", T.StringType()), T.StructField("repaired", T.IntegerType())])

    def mend(cols: dict[str, list]) -> dict[str, list]:
        out = {c: cols[c] for c in [*ids, "raw"]}
        done = [repair(s, {f["token"]: f["word"] for f in found or []}) for s, found in zip(cols["canonical"], cols["found"])]
        return out | {"canonical": done if keep_text else [None] * len(done), "key": [digest(s) for s in done], "repaired": [len(f or []) for f in cols["found"]]}

    mended = map_columns(odd.drop("tokens", "words").join(per_text, [*ids], "left"), fixed_schema, mend, "canonical")
    plain = texts.where("tokens is null").select(*ids, "key", "raw", "canonical", F.lit(0).alias("repaired"))
    return plain.unionByName(mended)


def same_looking_pairs(df: DataFrame, kind: str, id_col: str, group: list[str], text_col: str = "text") -> DataFrame:
    """Pairs ``id_a < id_b`` of rows of one group (nulls are a group of their own) and ``kind`` whose texts are not
    blank, differ in their characters and look the same. Rows of the same characters make no pair with one another.

    Only rows whose look has at least two spellings within the group are joined.
    """
    forms = canonical_forms(df, [kind, id_col, *group], text_col, keep_text=False).where(F.col("key") != F.lit(digest("")))
    forms = materialise(forms.select(kind, id_col, *group, "key", "raw"))
    at = [kind, *group, "key"]
    several = forms.groupBy(*at).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo != hi").select(*at)
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in at]
    rows = forms.alias("f").join(several.alias("s"), same("f", "s"), "left_semi")
    return rows.alias("a").join(rows.alias("b"), [*same("a", "b"), F.col(f"a.{id_col}") < F.col(f"b.{id_col}"), F.col("a.raw") != F.col("b.raw")]).select(F.col(f"a.{kind}").alias(kind), F.col(f"a.{id_col}").alias("id_a"), F.col(f"b.{id_col}").alias("id_b"))
