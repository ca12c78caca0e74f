"""Encoding of texts with a public byte-level BPE by speculation and verification.

For each distinct word of a batch, greedy longest match over the vocabulary proposes tokens. A proposal whose adjacent
tokens are all compatible (the pair, joined and merged anew, gives the same pair) is the BPE encoding of the word. Only
words with an incompatible pair are merged exactly. All steps but that last one run over whole batches in numpy.

Null and empty texts give an empty list. Special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary file of byte_bpe_50k; any rank file of the same format may be given instead.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits a text into words before any merge.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept by a worker between batches; beyond it the memory starts anew (results are the same).
CACHE_WORDS = 400_000
PAIR_BASE = 1 << 20


class SpeculativeEncoder:
    """Encoder of one rank file. ``exact_words`` counts the words that needed exact merging."""

    def __init__(self, ranks_path: str = DEFAULT_RANKS) -> None:
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(WORD_PATTERN).findall
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self._trie()
        self.exact_words = 0
        self.good_pairs = np.zeros(0, np.int64)
        self.bad_pairs = np.zeros(0, np.int64)
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _trie(self) -> None:
        """Nodes of the vocabulary's prefixes; edges as sorted keys node * 256 + byte."""
        nodes: dict[bytes, int] = {b"": 0}
        edges: dict[int, int] = {}
        for token in self.ranks:
            at = 0
            for k in range(1, len(token) + 1):
                child = nodes.setdefault(token[:k], len(nodes))
                edges[at * 256 + token[k - 1]] = child
                at = child
        self.edge_keys = np.fromiter(sorted(edges), np.int64, len(edges))
        self.edge_to = np.fromiter((edges[k] for k in self.edge_keys.tolist()), np.int32, len(edges))
        self.token_at = np.full(len(nodes), -1, np.int32)
        for token, rank in self.ranks.items():
            self.token_at[nodes[token]] = rank

    def merge(self, piece: bytes) -> list[int]:
        """Exact BPE of one word: the adjacent pair of lowest rank is merged until none is left."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 256:
            return self._merge_long(piece)
        pair = [self.ranks.get(a + b, PAIR_BASE) for a, b in zip(parts, parts[1:])]
        while pair and (low := min(pair)) < PAIR_BASE:
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = self.ranks.get(parts[i] + parts[i + 1], PAIR_BASE)
            if i:
                pair[i - 1] = self.ranks.get(parts[i - 1] + parts[i], PAIR_BASE)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges through a heap, for words of any length in n log n."""
        import heapq

        n = len(piece)
        end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        rank = lambda i: self.ranks.get(piece[i : end[nxt[i]]]) if nxt[i] < n else None
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
                continue
            j = nxt[i]
            alive[j], end[i], nxt[i] = False, end[j], nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for k in (i, prev[i]):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[nxt[k]]))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _longest(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte position, the longest token that begins there and ends by ``stop``, and its length."""
        n = len(data)
        token, length = np.zeros(n, np.int32), np.zeros(n, np.int32)
        at, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            key = node * 256 + data[at + depth]
            i = np.searchsorted(self.edge_keys, key)
            i[i == len(self.edge_keys)] = 0
            ok = self.edge_keys[i] == key
            at, node = at[ok], self.edge_to[i[ok]].astype(np.int64)
            depth += 1
            t = self.token_at[node]
            hit = t >= 0
            token[at[hit]], length[at[hit]] = t[hit], depth
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        return token, length

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens stays the same pair when merged anew; each pair is decided once."""
        keys = left.astype(np.int64) * PAIR_BASE + right
        distinct = np.unique(keys)
        new = distinct[~(np.isin(distinct, self.good_pairs) | np.isin(distinct, self.bad_pairs))]
        if len(new):
            ok = np.fromiter((self.merge(self.bytes_of[k >> 20] + self.bytes_of[k & (PAIR_BASE - 1)]) == [k >> 20, k & (PAIR_BASE - 1)] for k in new.tolist()), bool, len(new))
            self.good_pairs = np.union1d(self.good_pairs, new[ok])
            self.bad_pairs = np.union1d(self.bad_pairs, new[~ok])
        i = np.searchsorted(self.good_pairs, keys)
        i[i == len(self.good_pairs)] = 0
        return self.good_pairs[i] == keys if len(self.good_pairs) else np.zeros(len(keys), bool)

    def _learn(self, new: list[str]) -> None:
        """Encode words that were not seen before."""
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(raw), np.uint8)
        token, length = self._longest(data, np.repeat(ends, size))
        word, at, taken = np.arange(len(raw)), ends - size, []
        while len(word):  # one greedy step of all unfinished words at once
            taken.append((word, token[at]))
            at = at + length[at]
            more = at < ends[word]
            word, at = word[more], at[more]
        of = np.concatenate([w for w, _ in taken])
        tokens = np.concatenate([t for _, t in taken])
        order = np.argsort(of, kind="stable")
        of, tokens = of[order], tokens[order]
        same = of[1:] == of[:-1]
        failing = np.zeros(len(raw), bool)
        if same.any():
            ok = self._compatible(tokens[:-1][same], tokens[1:][same])
            failing[of[1:][same][~ok]] = True
        exact = {i: self.merge(raw[i]) for i in np.flatnonzero(failing).tolist()}
        self.exact_words += len(exact)
        counts = np.bincount(of, minlength=len(raw))
        base = len(self.flat)
        if exact:
            keep = ~failing[of]
            extra = list(exact.values())
            kept_counts = np.where(failing, 0, counts)
            starts = np.cumsum(kept_counts) - kept_counts
            flat = tokens[keep]
            at_extra, total = np.flatnonzero(failing), len(flat)
            sizes_extra = np.fromiter(map(len, extra), np.int64, len(extra))
            starts[at_extra] = total + np.cumsum(sizes_extra) - sizes_extra
            kept_counts[at_extra] = sizes_extra
            counts, tokens = kept_counts, np.concatenate([flat, np.fromiter((t for e in extra for t in e), np.int32, int(sizes_extra.sum()))])
        else:
            starts = np.cumsum(counts) - counts
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.starts = np.concatenate([self.starts, starts + base])
        self.sizes = np.concatenate([self.sizes, counts])
        self.flat = np.concatenate([self.flat, tokens.astype(np.int32)])

    def _word_ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all words of the texts, and the number of words of each text."""
        lists = [self.split(t) if t else [] for t in texts]
        if len(self.words) > CACHE_WORDS:
            self._reset()
        if new := [w for w in set().union(*lists) if w not in self.words]:
            self._learn(new)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        get = self.words.__getitem__
        return np.fromiter((i for ws in lists for i in map(get, ws)), np.int64, int(counts.sum())), counts

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        ids, counts = self._word_ids(texts)
        sums = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        stop = np.cumsum(counts)
        return sums[stop] - sums[stop - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts end to end, and the offsets of each text within them."""
        ids, counts = self._word_ids(texts)
        size = self.sizes[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(total)] if total else np.zeros(0, np.int32)
        stop = np.cumsum(counts)
        return flat, np.concatenate([[0], np.concatenate([[0], ends])[stop]]).astype(np.int64)


_ENCODERS: dict[str, SpeculativeEncoder] = {}


def encoder(ranks_path: str = DEFAULT_RANKS) -> SpeculativeEncoder:
    """The encoder of this Python worker."""
    if ranks_path not in _ENCODERS:
        _ENCODERS[ranks_path] = SpeculativeEncoder(ranks_path)
    return _ENCODERS[ranks_path]


#: Characters handled at once within an Arrow batch.
SLICE_CHARS = 4_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """One row per input row: its id and ``ids array<int>``. Other columns are not read. Repeated rows are kept.

    Null and empty text: an empty list. A null id stays null. There is no shuffle.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    arrow = pa.list_(pa.field("element", pa.int32(), nullable=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                flat, offsets = enc.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), type=arrow)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def token_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """One row per input row: all its columns but the text, and ``n_tokens bigint`` (0 for null and empty texts)."""
    keep = [c for c in df.columns if c not in (text_col, "n_tokens")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            sizes = np.concatenate([enc.lengths(texts[a:b]) for a, b in _slices(texts)]) if texts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*[F.col(c) for c in keep], F.col(text_col)).mapInArrow(run, schema)
