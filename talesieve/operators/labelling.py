"""Labellers and other models as pluggable sources: a function of a batch of prompts, set up once per worker."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prompts to raw answers. What it needs (a model, a connection) belongs into the factory that makes it.
Labeller = Callable[[list[str]], list[str]]


def prompt(text: Column) -> Column:
    return F.concat(F.lit("Label the following text exactly as it stands. Leave no sentence out.\n\nTEXT:\n"), text)


def profile(fields: Column) -> Column:
    """Lines 'name: value' of a map in order of the alphabet, without unknown values."""
    known = F.filter(F.array_sort(F.map_entries(fields)), lambda e: F.lower(F.trim(e["value"])) != "unknown")
    return F.array_join(F.transform(known, lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])), "\n")


def labelled(prompts: DataFrame, factory: Callable[[], Labeller], text: str = "prompt") -> DataFrame:
    """Adds ``raw``, the labeller's answers. ``factory`` runs once per worker and stream of batches."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = factory()
        for batch in batches:
            yield batch.assign(raw=label(batch[text].tolist()))

    return prompts.mapInPandas(run, f"{fields}, raw string")


def offline_labeller() -> Labeller:
    """A stand-in without a model: sentences by their marks, those in quotation marks as dialogue."""
    split = re.compile(r"(?<=[.!?…。！？”\"])\s+")

    def label(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            text = p.partition("TEXT:\n")[2]
            parts = [s for line in text.split("\n") for s in split.split(line.strip()) if s]
            out.append(json.dumps([{"index": i, "type": "dialogue" if s[0] in "\"“„«「" else "narration", "tone": "neutral", "text": s} for i, s in enumerate(parts)], ensure_ascii=False))
        return out

    return label
