"""Text out of web pages, and chains of pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talesieve.functions import text as X
from talesieve.sources.tables import materialise

#: Elements whose content is no text of the page; what names classes and ids of noise hold, and those of divisions with the
#: text; void elements.
DROPPED = "script style noscript iframe nav footer header aside form button svg canvas".split()
NOISE = "comment sidebar advert promo popup modal cookie footer header nav menu social share related recommend".split()
CONTENT = "content chapter story text entry post".split()
VOID = set("area base br col embed hr img input link meta source track wbr".split())
_noise = re.compile("|".join(NOISE), re.I)
_content = re.compile("|".join(CONTENT), re.I)
#: Lines that sites put below a chapter, and lines that begin a part that is no story.
BELOW = r"(?i)^(Report\s+chapter|Tip:\s+You\s+can\s+use|Previous\s+Chapter|Next\s+Chapter|Table\s+of\s+Contents|← Prev|Next →|Share\s+this|Rate\s+this|Add\s+to\s+library|Bookmark|Download\s+app|I\s+would\s+like\s+to\s+express\s+my\s+gratitude|Your\s+support\s+allows|Join\s+my\s+(?:newly\s+)?(?:created\s+)?Discord|(?:https?://)?discord\.gg/|(?:https?://)?patreon\.com/|power\s+stones?|golden\s+tickets?).*$"
CUT_FROM = r"(?i)^(From\s+the\s+author|Author['’]?s?\s+note|Translator['’]?s?\s+(?:note|thought)|transalator\s+thought)s?[\s:]*$"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


class _Main(HTMLParser):
    """Collects the text of the page and of the first visible element of each kind that may hold it."""

    KINDS = ("article", "main", "class", "id", "body", "page")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, list[str]]] = []
        self.found: dict[str, list[str]] = {"page": []}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        named = {k: v or "" for k, v in attrs if k in ("class", "id")}
        hidden = tag in DROPPED or any(map(_noise.search, named.values())) or bool(self.open and self.open[-1][1])
        kinds = [tag] if tag in ("article", "main", "body") else [k for k, v in named.items() if tag == "div" and _content.search(v)]
        first = [] if hidden else [k for k in kinds if k not in self.found]
        self.found |= {k: [] for k in first}
        self.open.append((tag, hidden, first))

    def handle_endtag(self, tag: str) -> None:
        for i in reversed(range(len(self.open))):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if data.strip() and not (self.open and self.open[-1][1]):
            for kind in ("page", *(k for _, _, kinds in self.open for k in kinds)):
                self.found[kind].append(data.strip())


def main_text(html: str | None) -> str | None:
    """Text of the first of an article, a main element, a division whose class or whose id names content, the body and the page that there
    is, a line per piece."""
    if html is None:
        return None
    p = _Main()
    p.feed(html)
    p.close()
    return "\n".join(next(p.found[k] for k in p.KINDS if k in p.found))


def pages_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with ``text`` instead of their HTML; nested noise is left out whole."""
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keep].assign(text=b[html].map(main_text))

    return pages.select(*keep, html).mapInPandas(run, ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string"]))


def lines_of(text: Column) -> Column:
    return F.transform(F.split(text, LINE_END), X.strip)


def single_blanks(text: Column) -> Column:
    """Every line stripped, every run of blank lines one blank line, none at the ends."""
    return X.strip(F.regexp_replace(F.array_join(lines_of(text), "\n"), r"\n{3,}", "\n\n"))


def _from(lines: Column, k: Column) -> Column:
    return F.slice(lines, k + 1, F.greatest(F.size(lines) - k, F.lit(0)))


def _places(lines: Column, holds: Callable[[Column], Column]) -> Column:
    """Indices of the lines for which a condition holds."""
    return F.array_compact(F.transform(lines, lambda x, i: F.when(holds(x), i)))


def from_heading(text: Column) -> Column:
    """From the first chapter heading on; from the last one if both say the same; else unchanged."""

    def cut(lines: Column, at: Column) -> Column:
        first, last = F.get(at, F.lit(0)), F.get(at, F.size(at) - 1)
        same = F.lower(X.strip(F.get(lines, first))) == F.lower(X.strip(F.get(lines, last)))
        return X.strip(F.array_join(_from(lines, F.when(same, last).otherwise(first)), "\n"))

    heads = lambda lines: _places(lines, lambda x: x.rlike(r"(?i)^\s*Chapter\s+\d+"))
    return X.let(F.split(text, "\n", -1), lambda lines: X.let(heads(lines), lambda at: F.when(F.size(at) == 0, F.array_join(lines, "\n")).otherwise(cut(lines, at))))


def without_below(text: Column) -> Column:
    """Up to the first line that begins another part, without the site's lines at the end."""
    end = r"(?U)\s+\z"
    cuts = lambda lines: _places(lines, lambda x: X.strip(x).rlike(CUT_FROM))
    stays = lambda lines: _places(lines, lambda x: X.let(X.strip(x), lambda s: (s != "") & ~s.rlike(BELOW)))
    story = lambda lines: X.let(cuts(lines), lambda c: F.slice(lines, 1, F.coalesce(F.get(c, F.lit(0)), F.size(lines))))
    kept = lambda lines: X.let(stays(lines), lambda at: F.array_join(F.slice(lines, 1, F.coalesce(F.get(at, F.size(at) - 1) + 1, F.lit(0))), "\n"))
    return F.regexp_replace(X.let(F.split(F.regexp_replace(text, end, ""), "\n", -1), lambda lines: X.let(story(lines), kept)), end, "")


def cleaned(text: Column) -> Column:
    """Single blank lines, straight quotes, from the heading to the story's end."""
    return X.let(X.straight_quotes(single_blanks(text)), lambda t: X.let(from_heading(t), without_below))


def absolute(href: Column, url: Column) -> Column:
    return F.when(F.startswith(href, F.lit("/")), F.concat(F.regexp_extract(url, r"^(https?://[^/]+)", 1), href)).otherwise(href)


def followed(pages: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """``start, depth, url`` along the next links from each start, ``most`` pages at most; an own page ends the chain.

    One join a step on the frontier of all chains; pages already visited by a chain aren't followed again.
    """
    links = pages.select("url", "next_url")
    frontier = starts.select(F.col("url").alias("start"), F.lit(1).alias("depth"), "url", F.array("url").alias("seen")).join(pages.select("url"), "url", "left_semi")
    result = frontier.select("start", "depth", "url")
    for _ in range(1, most):
        step = frontier.join(links, "url").where("next_url is not null and not array_contains(seen, next_url)").select("start", (F.col("depth") + 1).alias("depth"), F.col("next_url").alias("url"), F.array_append("seen", "next_url").alias("seen"))
        frontier = materialise(step.join(pages.select("url"), "url", "left_semi"))
        if frontier.isEmpty():
            break
        result = result.unionByName(frontier.select("start", "depth", "url"))
    return result
