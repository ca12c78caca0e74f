"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Latest scrape of each chapter, latest delivery of each segment, newest and oldest registry of each novel, as SQL.
CH = "ch AS (SELECT * FROM chapters QUALIFY row_number() OVER (PARTITION BY novel, chapter_num ORDER BY scraped_at DESC, chapter_id DESC) = 1)"
SG = 'sg AS (SELECT * FROM segments QUALIFY row_number() OVER (PARTITION BY novel, chapter_num, "index" ORDER BY parsed_at DESC, seg_id DESC) = 1)'


class Snippet:
    """A piece of SQL with {0} for its argument; other braces stay."""

    def __init__(self, template: str) -> None:
        self.template = template

    def format(self, argument: str) -> str:
        return self.template.replace("{0}", argument)


STRIP = Snippet(r"regexp_replace({0}, '^[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+|[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '', 'g')")
CLEAN = Snippet(r"regexp_replace(lower({0}), '[^\p{L}\p{N}_\s]', '', 'g')")
WORDS = Snippet(r"list_filter(string_split_regex(" + CLEAN.template + r", '\s+'), lambda w: w <> '')")
TOKENS = Snippet(r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')")
PROBE = Snippet("substring(" + STRIP.format(CLEAN.template) + ", 1, 40)")
PARAGRAPHS = Snippet("list_filter(list_transform(string_split_regex({0}, '\\n\\n+'), lambda p: " + STRIP.format("p") + "), lambda p: p <> '')")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from talesieve.plans import general, registries, sequences, texts  # noqa: E402, F401
