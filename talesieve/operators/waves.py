"""Waveforms as arrays of samples: trailing noise off, frames, assembly of a chapter, files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talesieve import schema
from talesieve.functions.audio import SAMPLE_RATE


def rms_frames(wav: Column, window: int, hop: int) -> Column:
    """Root mean square of overlapping frames."""
    starts = F.when(F.size(wav) > window, F.sequence(F.lit(0), F.size(wav) - window - 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.sqrt(F.aggregate(F.slice(wav, i + 1, window), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / window))


def end_of_speech(samples: np.ndarray, text: str, rate: int = SAMPLE_RATE) -> int:
    """Where the speech of a text ends: not later than it can last, and behind the last loud frame before long silence."""
    n = len(samples)
    longest = int(max(1.5, len(text) / 3.0, len(text.split()) / 1.8) * rate)
    if n < rate * 0.3 or n > longest:
        return min(n, longest) if n >= rate * 0.3 else n
    window = int(rate * 0.05)
    hop = window // 2
    starts = np.arange(0, n - window, hop)
    if not len(starts):
        return n
    squares = np.concatenate([[0.0], np.cumsum(samples.astype(np.float64) ** 2)])
    energy = np.sqrt((squares[starts + window] - squares[starts]) / window)
    loud = np.flatnonzero(energy > 0.02 * energy.max()) if energy.max() >= 1e-6 else np.zeros(0, int)
    if len(loud) and len(energy) - 1 - loud[-1] > int(0.3 * rate / hop):
        return min(n, (int(loud[-1]) + 2) * hop + int(rate * 0.1))
    return n


def trimmed(clips: DataFrame, wav: str = "wav", text: str = "text", rate: int = SAMPLE_RATE) -> DataFrame:
    """The clips without what follows the speech; one cut for its length fades out over 50 ms."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for samples, words in zip(batch[wav], batch[text]):
                a = np.asarray(samples if samples is not None else [], np.float32)
                k = end_of_speech(a, words or "", rate)
                out, fade = a[:k].copy(), int(rate * 0.05)
                if k < len(a) and k == int(max(1.5, len(words or "") / 3.0, len((words or "").split()) / 1.8) * rate) and k > fade:
                    out[-fade:] *= np.linspace(1.0, 0.0, fade, dtype=np.float32)
                done.append(out)
            yield batch.assign(**{wav: done})

    return clips.mapInPandas(run, fields)


def silence_before(offset_ms: Column, rate: int = SAMPLE_RATE) -> Column:
    return F.array_repeat(F.lit(0.0), (offset_ms * rate / 1000).cast("int"))


def chapter_files(segments: DataFrame, key: list[str], order: str, rate: int = SAMPLE_RATE) -> DataFrame:
    """``key, content``: one 16-bit WAV per chapter out of ``wav`` and ``pause_ms`` of its segments, after the lead-in.

    A chapter is put together as one array, as it is one file in the end.
    """
    gap = lambda ms: F.array_repeat(F.lit(0.0).cast("float"), F.expr(f"cast({ms} * {rate} div 1000 as int)"))
    piece = F.concat(F.col("wav").cast("array<float>"), gap("pause_ms"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, piece.alias("w")))), lambda x: x["w"])
    whole = segments.groupBy(*key).agg(F.concat(F.array_repeat(F.lit(0.0).cast("float"), rate * schema.LEAD_IN_MS // 1000), F.flatten(parts)).alias("wav"))
    fields = ", ".join(f"`{c}` {segments.schema[c].dataType.simpleString()}" for c in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[key].assign(content=[wav_bytes(np.asarray(w), rate) for w in batch["wav"]])

    return whole.mapInPandas(run, f"{fields}, content binary")


def wav_bytes(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(samples * 32767, -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def centroids(embeddings: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group; positions are averaged with partial sums, no group is brought together."""
    long = embeddings.select(by, F.posexplode(vector).alias("pos", "x"))
    means = long.groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


def kept_clips(clips: DataFrame, by: list[str], order: str, least_seconds: float = 1.5, most: int = 50) -> DataFrame:
    """The first ``most`` long enough clips of each group, and how many were left out: ``n_skipped``, ``warn`` if over half."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    judged = clips.withColumn("n_skipped", F.count_if(F.col("seconds") < least_seconds).over(w)).withColumn("warn", F.col("n_skipped") * 2 > F.count(F.lit(1)).over(w))
    return judged.where(F.col("seconds") >= least_seconds).withColumn("_n", F.row_number().over(w.orderBy(order))).where(F.col("_n") <= most).drop("_n")


def fourier_resampled(samples: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples of the same band-limited signal, taken as periodic."""
    size = len(samples)
    if n < 1 or not size:
        return np.zeros(0)
    spectrum, least = np.fft.rfft(samples), min(n, size)
    out = np.zeros(n // 2 + 1, complex)
    out[: least // 2 + 1] = spectrum[: least // 2 + 1]
    if least % 2 == 0 and n != size:
        out[least // 2] *= 2 if n < size else 0.5  # the highest frequency stands for both of its signs
    return np.fft.irfft(out, n) * (n / size)


def at_speed(clips: DataFrame, wav: str = "wav", speed: str = "speed") -> DataFrame:
    """The clips at their speed: floor(length / speed) samples; a speed of 1 or null changes nothing."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [w if w is None or s is None or s != s or s == 1 else fourier_resampled(np.asarray(w), int(len(w) / s)) for w, s in zip(batch[wav], batch[speed])]
            yield batch.assign(**{wav: done})

    return clips.mapInPandas(run, fields)
