"""Segments rendered by a pluggable model, with fallbacks decided by what the model does."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talesieve.functions.audio import SAMPLE_RATE
from talesieve.operators import chunking

#: Text, voice, tone and speed to samples; it raises where it can't. What it needs belongs into the factory that makes it.
Renderer = Callable[[str, str, str, float], np.ndarray]
#: Tries of each text, characters of a part, seconds between parts and of a placeholder.
TRIES, PART_LIMIT, PART_GAP, PLACEHOLDER = 3, 150, 0.1, 2.0


@lru_cache(8)
def _made(factory: Callable[[], Renderer]) -> Renderer:
    """One renderer per worker process, as far as the factory is a plain function."""
    return factory()


def _tried(render: Renderer, tries: int, text: str, *how) -> tuple[np.ndarray | None, int]:
    for n in range(1, tries + 1):
        try:
            return np.asarray(render(text, *how), np.float32), n
        except Exception:  # noqa: BLE001, S112 - whatever a model raises is a failed try
            continue
    return None, tries


def _laddered(render: Renderer, tries: int, rate: int, text: str, cleaned: str, parts: list[str], voice: str, tone: str, speed: float) -> tuple[np.ndarray, str, int, int]:
    """Samples, strategy, parts and tries of one segment: as it is, cleaned, in parts, or a placeholder; there always is a wave."""
    spent = 0
    for strategy, words in (("normal", text), ("cleaned", cleaned)):
        if strategy == "normal" or words and words != text:
            wave, n = _tried(render, tries, words, voice, tone, speed)
            spent += n
            if wave is not None:
                return wave, strategy, 1, spent
    if len(parts) > 1:
        waves: list[np.ndarray] = []
        for part in parts:
            wave, n = _tried(render, tries, part, voice, "neutral", 1.0)
            spent += n
            if wave is None:
                break
            waves += [wave, np.zeros(int(rate * PART_GAP), np.float32)]
        else:
            return np.concatenate(waves[:-1]), "split", len(parts), spent
    return np.zeros(int(rate * PLACEHOLDER), np.float32), "placeholder_inserted", 1, spent


def rendered(segments: DataFrame, factory: Callable[[], Renderer], cleaned: Column, rate: int = SAMPLE_RATE, tries: int = TRIES) -> DataFrame:
    """Adds ``wav``, ``strategy``, ``n_parts`` and ``n_tries`` to segments with ``text, voice, tone, speed_variant``."""
    keep = segments.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema)
    ready = segments.withColumn("_cleaned", cleaned).withColumn("_parts", chunking.sentence_chunks(F.coalesce(F.nullif("_cleaned", F.lit("")), F.col("text")), PART_LIMIT))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = _made(factory)
        for b in batches:
            done = [_laddered(render, tries, rate, t, c, list(p), v, o, s) for t, c, p, v, o, s in zip(b["text"], b["_cleaned"], b["_parts"], b["voice"], b["tone"], b["speed_variant"])]
            yield b[keep].assign(wav=[d[0] for d in done], strategy=[d[1] for d in done], n_parts=[d[2] for d in done], n_tries=[d[3] for d in done])

    return ready.mapInPandas(run, f"{fields}, wav array<float>, strategy string, n_parts int, n_tries int")


def failure_log(waves: DataFrame, key: list[str]) -> DataFrame:
    """What wasn't rendered as it is: ``key, index, stage, strategy, text, voice, n_parts, action``."""
    stage = F.when(F.col("strategy") == "cleaned", 2).when(F.col("strategy") == "split", 3).otherwise(4)
    return waves.where("strategy != 'normal'").select(*key, "index", stage.alias("stage"), "strategy", "text", "voice", "n_parts", F.when(F.col("strategy") == "placeholder_inserted", "MANUAL FIX REQUIRED").alias("action"))


def offline_renderer() -> Renderer:
    """A stand-in without a model: silence, a sample for each character between its white ends; it fails at characters beyond ASCII and at over 200 of them."""

    def render(text: str, voice: str, tone: str, speed: float) -> np.ndarray:
        if not text.isascii() or len(text) > 200:
            raise ValueError("not to be spoken")
        return np.zeros(len(text.strip()), np.float32)

    return render
