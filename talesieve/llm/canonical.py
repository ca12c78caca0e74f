"""Freely typed values mapped to the entries of a reference list.

Each distinct value is cut into tokens. Each distinct token is joined to the vocabulary of the reference lists by small
edit distance (a symmetric-delete neighbourhood), by abbreviation (leading letters, or consonants in order), by stem or by
exact form; the repaired tokens are combined by soft TF-IDF to rank the complete entries. A caller may give words of the same
meaning; they belong to an entry's phrases, but are matched by exact form only: a slip of the pen is sought near the list's own words.
A value whose best phrase belongs to another field's list only, or to none, is 'unmatched'.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talesieve.llm.arrowrun import map_columns
from talesieve.llm.lookalike import compose, fold

#: Words that qualify a value without changing its meaning.
QUALIFIERS = "a an the very slightly quite rather somewhat really extremely mostly bit little more less fairly highly too so pretty tone type voice style mood field".split()
#: Share of a phrase's weight that a value must reach.
LEAST_SCORE = 0.75
#: Endings that make other words of an English one.
ENDINGS = "ation ated ating ator ative ement ments ment ness ity ally ily ing ery ful ant ate ion ed es al ly s e y".split()
_letters = re.compile(r"[^\W\d_]+")
_remark = re.compile(r"\(.*?\)")
VOWELS = set("aeiouy")


def tokens_of(value: str) -> list[str]:
    """Tokens in comparison form; a token that had a full stop behind it keeps it."""
    s = _remark.sub(" ", fold(compose(value))).casefold()
    found = [s[m.start() : m.end()] + ("." if s[m.end() : m.end() + 1] == "." else "") for m in _letters.finditer(s)]
    kept = [t for t in found if t.rstrip(".") not in QUALIFIERS]
    return kept or found


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 3 else 1 if len(word) < 9 else 2


def deletions(word: str, k: int) -> set[str]:
    out = {word}
    for n in range(1, min(k, len(word) - 1) + 1):
        out.update("".join(c for i, c in enumerate(word) if i not in gone) for gone in combinations(range(len(word)), n))
    return out


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


def consonants(word: str) -> str:
    return word[:1] + "".join(c for c in word[1:] if c not in VOWELS)


def stem(word: str) -> str:
    """The word without endings, one after the other, as long as three letters are left."""
    while (ending := next((e for e in ENDINGS if word.endswith(e) and len(word) - len(e) >= 3), None)) is not None:
        word = word[: -len(ending)]
    return word


def abbreviates(short: str, word: str) -> bool:
    """Whether three or more letters are the word's first one and consonants of it in order."""
    rest = iter(consonants(word)[1:])
    return len(short) > 2 and short[0] == word[:1] and all(c in rest for c in short[1:])


def vocabulary_keys(word: str) -> set[str]:
    """Join keys of a reference word: its neighbourhood, its beginnings, its first letter with each of its consonants, its stem."""
    keys = {f"e:{d}" for d in deletions(word, edits_allowed(word))}
    keys |= {f"p:{word[:k]}" for k in range(2, len(word))}
    keys |= {f"c:{word[0]}{c}" for c in consonants(word)[1:]}
    return keys | ({f"s:{stem(word)}"} if len(word) > 2 else set())


def token_keys(token: str) -> set[str]:
    bare = token.rstrip(".")
    keys = {f"e:{d}" for d in deletions(bare, edits_allowed(bare))}
    if token.endswith(".") and len(bare) >= 2 or len(bare) >= 3:
        keys.add(f"p:{bare}")
    if len(bare) >= 3 and consonants(bare) == bare:
        keys.add(f"c:{bare[0]}{bare[-1]}")
    if len(bare) >= 4 and stem(bare) != bare:
        keys.add(f"s:{stem(bare)}")
    return keys


def similarity(token: str, word: str, kind: str) -> float:
    """Of a token to a reference word: 1 for the same, less for edits and abbreviations, 0 for too many edits."""
    bare = token.rstrip(".")
    if bare == word:
        return 1.0
    if kind == "e":
        d = edit_distance(bare, word)
        return 1.0 - 0.15 * d if d <= edits_allowed(word) else 0.0
    if kind == "c" and not abbreviates(bare, word):
        return 0.0
    if kind == "s":
        return 0.9
    return 0.84 if kind == "p" and token.endswith(".") else 0.8


def mapping(values: DataFrame, references: DataFrame, same_meaning: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``values(field, value)`` distinct, to ``field, value, canonical, score``: the best entry of the field's list.

    ``references(field, entry)`` holds the lists; ``same_meaning`` gives of a field's entry other phrases for it, separated by a comma and a
    blank. A null value gives no row; blank values and values without letters
    are 'unmatched'; an entry itself maps to itself. Ties go to the closer token, then to the entry first in the alphabet.
    """
    meant = same_meaning or {}
    phrases_schema = T.StructType([T.StructField(n, T.StringType()) for n in ("field", "entry", "phrase")] + [T.StructField("own", T.BooleanType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def phrases(cols: dict[str, list]) -> dict[str, list]:
        rows = []
        for field, entry in zip(cols["field"], cols["entry"]):
            rows.append((field, entry, entry, True, tokens_of(entry)))
            rows += [(field, entry, p, False, [t.rstrip(".") for t in tokens_of(p)]) for p in meant.get(field, {}).get(entry, "").split(", ") if p]
        return {n: [r[i] for r in rows] for i, n in enumerate(phrases_schema.names)}

    known = map_columns(references.where("entry is not null").select("field", "entry").distinct(), phrases_schema, phrases)

    word_schema = "word string, own boolean, key string"

    def words(cols: dict[str, list]) -> dict[str, list]:
        rows = [(w, own, k) for w, own in zip(cols["word"], cols["own"]) for k in (vocabulary_keys(w) if own else {f"e:{w}"})]
        return {"word": [r[0] for r in rows], "own": [r[1] for r in rows], "key": [r[2] for r in rows]}

    vocabulary = map_columns(known.select(F.explode("words").alias("word"), "own").groupBy("word").agg(F.max("own").alias("own")), T._parse_datatype_string(word_schema), words)
    n_phrases = known.count()  # of the reference list
    weights = known.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg((F.log(F.lit(float(n_phrases))) - F.log(F.count(F.lit(1)).cast("double")) + F.lit(1.0)).alias("idf"))

    cut_schema = T._parse_datatype_string("field string, value string, tokens array<string>")

    def cut(cols: dict[str, list]) -> dict[str, list]:
        return {"field": cols["field"], "value": cols["value"], "tokens": [tokens_of(v) for v in cols["value"]]}

    typed = map_columns(values.where("value is not null").select("field", "value").distinct(), cut_schema, cut)

    key_schema = T._parse_datatype_string("token string, key string")

    def keys(cols: dict[str, list]) -> dict[str, list]:
        rows = [(t, k) for t in cols["token"] for k in token_keys(t)]
        return {"token": [r[0] for r in rows], "key": [r[1] for r in rows]}

    near_schema = T._parse_datatype_string("token string, word string, similarity double")

    def judge(cols: dict[str, list]) -> dict[str, list]:
        return {"token": cols["token"], "word": cols["word"], "similarity": [similarity(t, w, k) if own else float(t.rstrip(".") == w) for t, w, k, own in zip(cols["token"], cols["word"], cols["kind"], cols["own"])]}

    tokens = typed.select(F.explode("tokens").alias("token")).distinct()
    pairs = map_columns(tokens, key_schema, keys).join(vocabulary, "key").select("token", "word", "own", F.substring("key", 1, 1).alias("kind")).distinct()
    near = map_columns(pairs, near_schema, judge).where("similarity > 0").groupBy("token", "word").agg(F.max("similarity").alias("similarity"))
    # soft TF-IDF: cosine of the value's tokens and a phrase's words, a token counting for its repaired word
    parts = typed.select("field", "value", F.size("tokens").alias("n"), F.explode(F.array_distinct("tokens")).alias("token")).join(near, "token").join(weights, "word")
    placed = known.select("field", "entry", "phrase", "own", F.size("words").alias("size"), F.explode(F.array_distinct("words")).alias("word")).join(weights, "word").withColumn("norm", F.sum(F.col("idf") * F.col("idf")).over(_by("field", "entry", "phrase")))
    p, q = parts.alias("p"), placed.alias("q")
    scored = (
        p.join(q, F.col("p.word") == F.col("q.word"))
        .groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value"), F.col("p.n").alias("n"), F.col("q.field").alias("of"), F.col("q.entry").alias("entry"), F.col("q.phrase").alias("phrase"), F.col("q.norm").alias("norm"))
        .agg(F.sum(F.col("q.idf") * F.col("q.idf") * F.col("p.similarity")).alias("dot"), F.sum(F.col("p.idf") * F.col("p.idf")).alias("held"), F.count(F.lit(1)).alias("hits"), F.max("q.own").alias("own"))
        .withColumn("score", F.col("dot") / F.sqrt(F.col("norm") * (F.col("held") + (F.col("n") - F.col("hits")) * F.lit(math.log(2.0)))))
    )
    best = scored.where(F.col("score") >= LEAST_SCORE).groupBy("field", "value").agg(F.max_by(F.struct("of", "entry"), F.struct(F.round("score", 6), F.col("of") == F.col("field"), "own", F.transform(F.split("entry", ""), lambda c: -F.ascii(c)))).alias("top"), F.max("score").alias("score"))
    named = best.select("field", "value", F.when(F.col("top.of") == F.col("field"), F.col("top.entry")).alias("entry"), "score")
    return typed.select("field", "value").join(named, ["field", "value"], "left").select("field", "value", F.coalesce("entry", F.lit("unmatched")).alias("canonical"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def map_rows(df: DataFrame, id_col: str, fields: dict[str, DataFrame], same_meaning: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """One row per row and field whose value is neither null nor an entry of its own list: ``id_col, field, canonical``.

    ``fields`` maps a column to its list, a table whose column of the same name holds the entries.
    """
    references = None
    for field, entries in fields.items():
        part = entries.select(F.lit(field).alias("field"), F.col(field).alias("entry"))
        references = part if references is None else references.unionByName(part)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    rows = df.select(F.col(id_col), F.explode(pairs).alias("x")).select(id_col, "x.field", "x.value").where("value is not null")
    odd = rows.alias("r").join(references.alias("e"), (F.col("r.field") == F.col("e.field")) & (F.col("r.value") == F.col("e.entry")), "left_anti")
    known = mapping(odd.select("field", "value").distinct(), references, same_meaning)
    return odd.join(known, ["field", "value"]).select(id_col, "field", "canonical")
