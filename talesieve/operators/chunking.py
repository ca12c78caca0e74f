"""Greedy packing of pieces of text into chunks of a length limit; a text's pieces go by once, an Arrow batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from talesieve.functions import text as X

#: White space as the engine's own expressions have it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def chunks_of(pieces: Iterable[str], limit: int, cuts: bool = False) -> list[str]:
    """Pieces joined by blanks while the chunk's length, the piece's and one more stay within the limit. With ``cuts``, an empty piece
    ends a chunk."""
    out, cur = [], ""
    for piece in pieces:
        if len(cur) + len(piece) + 1 <= limit and not (cuts and not piece):
            cur = f"{cur} {piece}".strip(_SPACE)
        else:
            if cur:
                out.append(cur)
            cur = piece
    return [*out, cur] if cur else out


def packed(pieces: Column, limit: int, cuts: bool = False) -> Column:
    """``chunks_of`` an array of pieces; null for null."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda p: None if p is None else chunks_of(p, limit, cuts))

    return F.pandas_udf(run, "array<string>")(pieces)


def sentence_chunks(text: Column, limit: int = 150) -> Column:
    """Whole sentences packed; one that is longer than the limit is a chunk of its own."""
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed(F.when(F.length(text) > limit, X.sentences(text)), limit))


def word_chunks(text: Column, limit: int) -> Column:
    return packed(X.tokens(text), limit)


def spoken_chunks(text: Column, limit: int = 200) -> Column:
    """Sentences packed; too long ones by clauses; too long clauses by words. Only a single word may exceed the limit."""
    kept = F.filter(X.sentences(text), lambda s: X.strip(s) != "")
    # an empty piece before a clause that is cut into words: it begins a chunk
    by_clause = lambda s: F.flatten(F.transform(X.clauses(s), lambda c: F.when(F.length(c) > limit, F.concat(F.array(F.lit("")), X.tokens(c))).otherwise(F.array(c))))
    pieces = F.flatten(F.transform(kept, lambda s: F.when(F.length(s) > limit, by_clause(s)).otherwise(F.array(s))))
    whole = F.filter(packed(F.when(F.length(text) > limit, pieces), limit, cuts=True), lambda c: X.strip(c) != "")
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(whole)
