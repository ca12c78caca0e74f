"""Long spans that stand word for word in more than one record.

A span of ``min_length`` characters holds a least gram (a third as long) by hash; all records that hold the span have it there. A
text is cut where the least gram of its windows changes, so that each window of ``min_length`` characters is in exactly
one piece, and equal windows are in pieces of equal grams. Pieces whose gram stands in one distinct text only are
dropped: this is all that the hashes decide. The characters of the others are brought together by gram, put into
compressed FM-indexes of bounded size, and streamed against them: backward search over a wavelet matrix gives, for every
window, the interval of its occurrences; where that holds another text, the window is shared.

A gram that more characters hang on than an index may hold (a notice in every page) is split by its whole windows,
which are counted by hash with partial sums. Copies of a whole text are one text until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from talesieve.llm.fmindex import FIRST, FMIndex
from talesieve.sources.tables import materialise

MIN_LENGTH = 200
#: Characters of an index; bounds what a task holds. Grams with more characters are split by their windows.
INDEX_CHARS = 1 << 20
#: Characters of which grams are hashed at a time, and windows of a piece: longer ones are cut, which loses no window.
SLICE_CHARS, PIECE_WINDOWS = 2_000_000, 256
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_length(min_length: int) -> int:
    return max(1, min_length // 3)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(codes: np.ndarray, k: int, base: int = _BASES[0]) -> np.ndarray:
    """A mixed polynomial hash of all grams of ``k`` characters."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n, SLICE_CHARS) + 1
        _powers[base] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64))))
    up, down = _powers[base]
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * up[:n])])
        h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


def least_of_windows(values: np.ndarray, w: int) -> np.ndarray:
    """Least value of each run of ``w`` values, by blocks of that length."""
    m = len(values)
    padded = np.full(-(-m // w) * w, np.iinfo(values.dtype).max, values.dtype)
    padded[:m] = values
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    starts = np.arange(m - w + 1)
    return np.minimum(behind[starts], ahead[starts + w - 1])


def pieces(texts: list[str], min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, number of windows and least gram of the pieces of all texts, in order."""
    k = gram_length(min_length)
    parts: list[list[np.ndarray]] = []
    block: list[tuple[int, int, str]] = []
    held = 0

    def close() -> None:
        nonlocal held
        sizes = np.fromiter((len(t) for _, _, t in block), np.int64, len(block))
        codes = _codes("".join(t for _, _, t in block))
        if len(codes) >= min_length:
            least = least_of_windows(gram_hashes(codes, k), min_length - k + 1)
            ends = np.cumsum(sizes)
            number = np.repeat(np.arange(len(block)), sizes)[: len(least)]
            inside = np.flatnonzero(ends[number] - np.arange(len(least)) >= min_length)
            number, least = number[inside], least[inside]
            new = np.ones(len(inside), bool)
            new[1:] = (least[1:] != least[:-1]) | (number[1:] != number[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(inside)))
            if len(count) and count.max() > PIECE_WINDOWS:
                times = -(-count // PIECE_WINDOWS)
                step = (np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)) * PIECE_WINDOWS
                first, count = np.repeat(first, times) + step, np.minimum(PIECE_WINDOWS, np.repeat(count, times) - step)
            of = number[first]
            own = np.fromiter((i for i, _, _ in block), np.int64, len(block))[of]
            offset = np.fromiter((o for _, o, _ in block), np.int64, len(block))[of]
            parts.append([own, inside[first] - (ends - sizes)[of] + offset, count, least[first].view(np.int64)])
        block.clear()
        held = 0

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - min_length + 1), SLICE_CHARS):
            part = text if len(text) <= SLICE_CHARS else text[at : at + SLICE_CHARS + min_length - 1]
            if len(part) >= min_length:
                block.append((i, at, part))
                held += len(part)
            if held >= SLICE_CHARS:
                close()
    close()
    return tuple(np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 4))


def _flagged_runs(thread: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thread, first and last place of runs of neighbouring places."""
    order = np.lexsort((place, thread))
    thread, place = thread[order], place[order]
    new = np.ones(len(thread), bool)
    new[1:] = (thread[1:] != thread[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    return thread[first], place[first], place[np.append(first[1:], len(thread)) - 1] if len(first) else place[:0]


def search(rows: list[tuple[int, int, int, str]], min_length: int, groups: bool) -> list[tuple]:
    """Of pieces ``(gram, id, start, text)``: with ``groups`` the windows that several ids hold as ``(gram, number, id)``, none of which
    follows from the window before it; else ``(id, start, stop)`` of the stretches that stand under another id too."""
    owners: dict[str, list[tuple[int, int, int]]] = {}
    for gram, i, start, text in rows:
        owners.setdefault(text, []).append((gram, i, start))
    texts, held = list(owners), list(owners.values())
    ids: dict[int, int] = {}
    several = np.fromiter((len({i for _, i, _ in own}) > 1 for own in held), bool, len(held))
    labels = np.fromiter((-1 - n if many else ids.setdefault(own[0][1], len(ids)) for n, (own, many) in enumerate(zip(held, several))), np.int64, len(held))
    index = FMIndex(texts, min_length)
    index.label(labels, several)
    thread, place, lo, hi = index.matched(texts)
    hit = index.shared(lo, hi)
    thread, place, lo, hi = thread[hit], place[hit], lo[hit], hi[hit]
    if not groups:
        return [(i, start + a, start + b + min_length) for t, a, b in zip(*(x.tolist() for x in _flagged_runs(thread, place))) for _, i, start in held[t]]
    _, once = np.unique(lo, return_index=True)
    lo, hi = lo[once], hi[once]
    # all of them go on to the left with one symbol: the window before this one says as much
    before, _ = index.wavelet.previous(lo)
    fresh = ~index.changes.none_between(lo + 1, hi) | (before < FIRST)
    lo, hi = lo[fresh], hi[fresh]
    n = hi - lo
    number = np.repeat(lo, n)
    text, _ = index.located(number + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    return list({(own[0], k, own[1]): None for t, k in zip(text.tolist(), number.tolist()) for own in held[t]})


def _same_text(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


class SharedSpans:
    """The texts of ``df`` reduced to pieces; what is shared is told as intervals or as groups.

    Null, empty and short texts share nothing. Ids are integers and unique. Other columns are not read. Copies of a text are
    members of one class, ``rep`` being their least id; only representatives are searched.
    """

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, index_chars: int = INDEX_CHARS) -> None:
        self.min_length = min_length
        self.texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= min_length)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number, start, windows, gram = pieces(batch.column(3).to_pylist(), min_length)
                stops = pa.array(np.concatenate([[0], np.cumsum(np.bincount(number, minlength=batch.num_rows))]), pa.int32())
                lists = [pa.ListArray.from_arrays(stops, pa.array(v)) for v in (start.astype(np.int32), windows.astype(np.int32), gram)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["id", "h1", "h2", "starts", "windows", "grams"])

        # one row per text, a fraction of the text's size
        self.kept = materialise(self.texts.select("id", *_same_text(F.col("text")), "text").mapInArrow(find, "id long, h1 long, h2 long, starts array<int>, windows array<int>, grams array<long>"))
        self.classes = self.kept.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
        distinct = self.kept.join(self.classes.select(F.col("rep").alias("id")), "id", "left_semi")
        found = distinct.select("id", F.inline(F.arrays_zip(F.col("starts").alias("start"), F.col("windows").alias("windows"), F.col("grams").alias("gram"))))
        chars = F.sum((F.col("windows") + F.lit(min_length - 1)).cast("long"))
        wide = materialise(found.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), chars.alias("chars")).where("lo != hi").select("gram", (F.col("chars") > index_chars).alias("split")))
        self.split = not wide.where("split").isEmpty()
        places = found.join(wide, "gram").groupBy("id").agg(F.collect_list(F.struct("start", "windows", "gram", "split")).alias("pieces"))
        self.placed = self.texts.join(places, "id")
        if self.split:  # read twice
            self.placed = materialise(self.placed)
        self.index_chars = index_chars

    def _cut(self) -> DataFrame:
        """``gram, id, start, text`` of the pieces to be searched by index."""
        min_length = self.min_length
        schema = T._parse_datatype_string("gram long, id long, start int, text string")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = to_arrow_schema(schema)
            for batch in batches:
                for rid, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                    rows = [(p["gram"], rid, p["start"], text[p["start"] : p["start"] + p["windows"] + min_length - 1]) for p in at if not p["split"]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

        return self.placed.mapInArrow(run, schema)

    def _windows(self) -> DataFrame:
        """``gram, w1, w2, id, start, before`` of all windows of the grams that are split; ``before`` is the code point in front of a
        window of the same piece, else -1."""
        min_length = self.min_length
        schema = T._parse_datatype_string("gram long, w1 long, w2 long, id long, start int, before int")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = to_arrow_schema(schema)
            for batch in batches:
                for rid, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                    for p in at:
                        if p["split"]:
                            n, a = p["windows"], p["start"]
                            codes = _codes(text[a : a + n + min_length - 1])
                            hashes = [gram_hashes(codes, min_length, b).view(np.int64) for b in _BASES]
                            before = np.concatenate([[-1], codes[: n - 1].astype(np.int32)])
                            columns = [np.full(n, p["gram"]), *hashes, np.full(n, rid), np.arange(a, a + n), before]
                            yield pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, out)], schema=out)

        return self.placed.where(F.exists("pieces", lambda p: p["split"])).mapInArrow(run, schema)

    def _searched(self, groups: bool) -> DataFrame:
        min_length, most = self.min_length, self.index_chars
        schema = T._parse_datatype_string("g1 long, g2 long, id long" if groups else "id long, a int, b int")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = to_arrow_schema(schema)
            rows: list[tuple[int, int, int, str]] = []
            size, last = 0, None

            def answer() -> pa.RecordBatch:
                nonlocal size
                found = search(rows, min_length, groups)
                rows.clear()
                size = 0
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(out)], schema=out)

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if row[0] != last and size >= most:  # a gram's pieces stay together
                        yield answer()
                    last = row[0]
                    rows.append(row)
                    size += len(row[3])
            if rows:
                yield answer()

        return self._cut().repartition("gram").sortWithinPartitions("gram").mapInArrow(run, schema)

    def groups(self) -> DataFrame:
        """``g1, g2, id``: groups of two or more representatives that hold a window in common. Any two that do are in one; windows
        that say no more than the ones before them make no group."""
        found = self._searched(True)
        if self.split:
            rows = self._windows()
            told = rows.groupBy("w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("before").alias("x"), F.max("before").alias("y")).where("lo != hi and (x != y or x < 0)").select("w1", "w2")
            found = found.unionByName(rows.join(told, ["w1", "w2"]).select(F.col("w1").alias("g1"), F.col("w2").alias("g2"), "id").distinct())
        return found

    def intervals(self) -> DataFrame:
        """``id, a, b``: stretches of representatives that stand in another text too. They may overlap or touch."""
        found = self._searched(False)
        if self.split:
            rows = self._windows()
            told = rows.groupBy("w1", "w2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("w1", "w2")
            found = found.unionByName(rows.join(told, ["w1", "w2"]).select("id", F.col("start").alias("a"), (F.col("start") + self.min_length).alias("b")))
        return found

    def members(self) -> DataFrame:
        """``id, rep, n_copies`` of every text of at least ``min_length`` characters."""
        return self.kept.select("id", "h1", "h2").join(self.classes, ["h1", "h2"]).select("id", "rep", "n_copies")


def shared_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, index_chars: int = INDEX_CHARS) -> tuple[DataFrame, DataFrame]:
    """Pairs ``rep_a < rep_b`` of class representatives with a common span, and ``id, rep, n_copies``, the classes of equal texts."""
    spans = SharedSpans(df, id_col, text_col, min_length, index_chars)
    g = spans.groups()
    pairs = g.alias("p").join(g.alias("q"), (F.col("p.g1") == F.col("q.g1")) & (F.col("p.g2") == F.col("q.g2")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("rep_a"), F.col("q.id").alias("rep_b")).distinct()
    return pairs, spans.members()


def shared_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, index_chars: int = INDEX_CHARS) -> DataFrame:
    """``doc_a < doc_b`` of all texts with at least one common span of ``min_length`` characters: the pairs of representatives given
    to their copies, and the copies of a text among themselves."""
    pairs, members = shared_classes(df, id_col, text_col, min_length, index_chars)
    copied = members.where("n_copies > 1")
    a, b = copied.select(F.col("id").alias("a"), F.col("rep").alias("rep_a")), copied.select(F.col("id").alias("b"), F.col("rep").alias("rep_b"))
    given = pairs.join(a, "rep_a", "left").join(b, "rep_b", "left").select(F.coalesce("a", "rep_a").alias("a"), F.coalesce("b", "rep_b").alias("b"))
    among = a.join(b, F.col("rep_a") == F.col("rep_b")).where("a < b").select("a", "b")
    return given.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).unionByName(among.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")))


def shared_shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, index_chars: int = INDEX_CHARS) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_chars`` (0 for null), ``n_shared`` (characters within a span of ``min_length`` that stands in
    another text too) and ``share`` (0 for empty and null texts). No pairs are made."""
    spans = SharedSpans(df, id_col, text_col, min_length, index_chars)
    # union of the intervals: what each one adds beyond the furthest end before it
    w = Window.partitionBy("id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    reached = spans.intervals().withColumn("reach", F.coalesce(F.max("b").over(w), F.lit(0)))
    added = reached.groupBy(F.col("id").alias("rep")).agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "reach")).cast("long")).alias("n_shared"))
    held = spans.members().join(added, "rep", "left").select("id", "n_copies", "n_shared")
    sizes = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"))
    n_shared = F.when(F.col("n_copies") > 1, F.col("n_chars").cast("long")).otherwise(F.coalesce("n_shared", F.lit(0).cast("long")))
    return sizes.join(held, "id", "left").select(F.col("id").alias(id_col), "n_chars", n_shared.alias("n_shared")).withColumn("share", F.coalesce(F.round(F.col("n_shared") / F.when(F.col("n_chars") > 0, F.col("n_chars")), 6), F.lit(0.0)))
