"""Sample arithmetic on arrays of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE = 24_000


def samples_of_ms(ms: Column, rate: int = SAMPLE_RATE) -> Column:
    return F.floor(ms * rate / 1000).cast("long")


def ms_of_samples(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    return samples * 1000 / rate


def pcm16(wave: Column) -> Column:
    """Samples of -1..1 as clipped 16-bit integers, cut towards zero."""
    return F.transform(wave, lambda x: F.least(F.greatest(x.cast("double") * 32767, F.lit(-32768.0)), F.lit(32767.0)).cast("int").cast("short"))


def placeholder(duration_ms: int = 2000, tone_ms: int = 80, hertz: float = 440.0, loudness: float = 0.15, rate: int = SAMPLE_RATE) -> Column:
    """Silence with a soft tone at either end."""
    n, tone = rate * duration_ms // 1000, rate * tone_ms // 1000
    step = tone_ms / 1000 / (tone - 1)
    wave = lambda i: F.sin(i * F.lit(step * 2 * math.pi * hertz)) * loudness
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i < tone, wave(i)).when(i >= n - tone, wave(i - (n - tone))).otherwise(0.0))


def longest_seconds(text: Column) -> Column:
    """How long speech of a text may last at most."""
    n_words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1.5), F.length(text) / 3.0, n_words / 1.8)


def joined(waves: Column, gap_ms: int, rate: int = SAMPLE_RATE) -> Column:
    """Several waves one behind the other with silence between them."""
    gap = F.array_repeat(F.lit(0.0), rate * gap_ms // 1000)
    return F.aggregate(waves, F.array().cast("array<double>"), lambda a, w: F.when(F.size(a) == 0, w).otherwise(F.concat(a, gap, w)))


def at_speed(wave: Column, speed: Column) -> Column:
    """Linear resampling to floor(length / speed) samples."""
    n = F.floor(F.size(wave) / speed).cast("int")
    place = lambda i: i * (F.size(wave) - 1) / F.greatest(n - 1, F.lit(1))

    def value(i: Column) -> Column:
        p = place(i)
        k = F.floor(p).cast("int")
        a, b = F.get(wave, k), F.coalesce(F.get(wave, k + 1), F.get(wave, k))
        return a + (b - a) * (p - k)

    return F.when(n < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), value))
