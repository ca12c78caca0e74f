"""A compressed full-text (FM) index over characters: packed bits, ranks by popcount, a sampled suffix array.

What stays of the text is its Burrows-Wheeler transform in a wavelet matrix; a character takes about 1.5 bits per level of
the alphabet. All searches go for many patterns at once.
"""

from __future__ import annotations

import numpy as np

SAMPLED = 32
#: The symbol of the alphabet's first character; lower ones are ends of texts.
FIRST = 2
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Bits:
    """A bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        raw = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([raw, np.zeros(-len(raw) % 8 + 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & _ONE).astype(bool)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the one that has ``k`` ones before it; the vector's length if there is none."""
        word = np.searchsorted(self.before, k, "right") - 1
        none = word >= len(self.words)
        word = np.minimum(word, len(self.words) - 1)
        left, bits = k - self.before[word], self.words[word]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((bits >> place.astype(np.uint64)) & ((_ONE << np.uint64(width)) - _ONE))
            beyond = low <= left
            left = np.where(beyond, left - low, left)
            place = np.where(beyond, place + width, place)
        return np.where(none, self.n, np.minimum((word << 6) + place, self.n))

    def none_between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether there are no ones from ``lo`` up to before ``hi``."""
        return self.rank(hi) <= self.rank(np.minimum(lo, hi))


class WaveletMatrix:
    """Ranks of, and access to, the symbols of a sequence of small integers: a bit vector per level."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in reversed(range(self.levels)):
            one = (values >> level & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(int(len(one) - one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``lo`` and before ``hi``."""
        begin, stops = np.zeros(len(symbol), np.int64), [lo, hi]
        for bits, zeros, level in zip(self.bits, self.zeros, reversed(range(self.levels))):
            one = (symbol >> level & 1).astype(bool)
            step = lambda i: np.where(one, zeros + (r := bits.rank(i)), i - r)  # noqa: B023, E731
            begin, stops = step(begin), [step(s) for s in stops]
        return stops[0] - begin, stops[1] - begin

    def previous(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before that position."""
        symbol, begin = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.bits, self.zeros):
            one = bits.get(i)
            symbol = symbol << 1 | one
            for_one = lambda x: np.where(one, zeros + (r := bits.rank(x)), x - r)  # noqa: B023, E731
            begin, i = for_one(begin), for_one(i)
        return symbol, i - begin


def sorted_suffixes(symbols: np.ndarray, depths: tuple[int, ...]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes in order, by prefix doubling; and of each depth a class per position, equal for equal next ``depth`` symbols."""
    n = len(symbols)
    classes: dict[int, np.ndarray] = {}

    def shifted(rank: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[: max(0, n - by)] = rank[by:] + 1
        return out

    def dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        s = key[order]
        fresh = np.zeros(n, np.int64)
        np.cumsum(s[1:] != s[:-1], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        return order, rank

    base, width = int(symbols.max(initial=0)) + 2, 1
    key = symbols.astype(np.int64)
    if min(depths) >= 3 and base**3 < 1 << 62:  # three symbols at once
        key, width = (key * base + shifted(key, 1)) * base + shifted(key, 2), 3
    order, rank = dense(key)
    while True:
        for d in depths:
            if width <= d < 2 * width:
                classes[d] = rank if d == width else rank * (n + 1) + shifted(rank, d - width)
        if width >= 2 * n or (len(classes) == len(depths) and rank[order[-1]] == n - 1):
            return order, classes
        order, rank = dense(rank * (n + 1) + shifted(rank, width))
        width *= 2


class FMIndex:
    """Of several texts. ``length`` is the length of the patterns that matching goes for."""

    def __init__(self, texts: list[str], length: int) -> None:
        self.length = length
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        separators = self.begins + sizes
        self.alphabet = np.unique(codes)
        symbols = np.searchsorted(self.alphabet, codes) + FIRST
        symbols[separators] = 1  # a text that itself holds the character 0 has it as a symbol of its own
        symbols[-1] = 0  # the end of all is unlike the others, so that the order of suffixes is that of rotations
        self.n = len(symbols)
        suffixes, classes = sorted_suffixes(symbols, (length - 1, length) if length > 1 else (length,))
        differs = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
        before = symbols[suffixes - 1]
        self.wavelet = WaveletMatrix(before, len(self.alphabet) + FIRST)
        self.symbols_before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.alphabet) + FIRST))])
        #: ones where the suffixes' next length - 1 symbols, and the symbols before them, change
        self.shorter = Bits(differs(classes[length - 1][suffixes])) if length > 1 else Bits(np.arange(self.n) == 0)
        self.changes = Bits(differs(before))
        sampled = suffixes % SAMPLED == 0
        self.sampled, self.samples = Bits(sampled), (suffixes[sampled] // SAMPLED).astype(np.int32)
        self._suffixes = suffixes  # given up once labelled

    def label(self, labels: np.ndarray, several: np.ndarray) -> None:
        """Of each text a label, and whether it stands in several records: an interval is shared if it holds two labels or such
        a text."""
        of = np.searchsorted(self.begins, self._suffixes, "right") - 1
        own = labels[of]
        self.label_changes = Bits(np.concatenate([[True], own[1:] != own[:-1]]))
        self.several = Bits(several[of])
        del self._suffixes

    def extended(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals with ``symbol`` put before them."""
        a, b = self.wavelet.rank(symbol, lo, hi)
        return self.symbols_before[symbol] + a, self.symbols_before[symbol] + b

    def widened(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals without the last symbol of their ``length``."""
        return self.shorter.select(self.shorter.rank(lo + 1) - 1), self.shorter.select(self.shorter.rank(hi))

    def located(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of suffixes by their rank."""
        at, steps, todo = i.copy(), np.zeros(len(i), np.int64), np.arange(len(i))
        while len(todo := todo[~self.sampled.get(at[todo])]):
            symbol, before = self.wavelet.previous(at[todo])
            at[todo] = self.symbols_before[symbol] + before
            steps[todo] += 1
        place = self.samples[self.sampled.rank(at)].astype(np.int64) * SAMPLED + steps
        text = np.searchsorted(self.begins, place, "right") - 1
        return text, place - self.begins[text]

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return ~self.label_changes.none_between(lo + 1, hi) | ~self.several.none_between(lo, hi)

    def matched(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics, as far as ``length``, of streamed texts that the index holds too: of every place of a text with
        ``length`` symbols from there, the text's number, the place, and the interval of these symbols. Each text's thread goes from
        its end to its beginning, a symbol a step, and gives up the last symbol when it holds ``length``."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = np.searchsorted(self.alphabet, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)) + FIRST
        begins = np.cumsum(sizes) - sizes
        thread = np.flatnonzero(sizes)
        place = sizes[thread] - 1
        lo, hi, held = np.zeros(len(thread), np.int64), np.full(len(thread), self.n), np.zeros(len(thread), np.int64)
        found: list[tuple] = [tuple(np.zeros(0, np.int64) for _ in range(4))]
        while len(thread):
            lo, hi = self.extended(symbols[begins[thread] + place], lo, hi)
            held += 1
            full = np.flatnonzero(held == self.length)
            if len(full):
                found.append((thread[full], place[full], lo[full], hi[full]))
                lo[full], hi[full] = self.widened(lo[full], hi[full])
                held[full] -= 1
            on = place > 0
            thread, place, lo, hi, held = thread[on], place[on] - 1, lo[on], hi[on], held[on]
        return tuple(np.concatenate(x) for x in zip(*found))
