"""Scalar text functions as Column to Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Interjections that get a comma when a word follows.
INTERJECTIONS = "Ah Oh Eh Uh Mm Hmm Hm Ha Hah Whoa Ooh Aah Aww".split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def no_punctuation(c: Column) -> Column:
    """Letters, figures, underscores and white space only."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def words(c: Column) -> Column:
    """Words in lower case without punctuation, repeated ones included."""
    return tokens(no_punctuation(F.lower(c)))


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def normalised(c: Column) -> Column:
    return F.array_join(words(c), " ")


def fingerprint(c: Column, length: int = 40) -> Column:
    """Leading characters in lower case without punctuation."""
    return F.substring(strip(no_punctuation(F.lower(c))), 1, length)


def paragraphs(c: Column, separator: str = r"\n\n+") -> Column:
    return F.filter(F.transform(F.split(c, separator), strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Pieces behind which a full stop, exclamation or question mark and white space stand."""
    return F.split(c, r"(?<=[.!?])\s+")


def quote_aware_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"""(?<=[.!?])["']?\s+"""), strip), lambda s: s != "")


def clauses(c: Column) -> Column:
    return F.split(c, r"(?<=[,;:—])\s+")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def spoken_form(c: Column) -> Column:
    """Brackets off, stutters undone, ASCII only, a comma behind a leading interjection, no end mark, runs collapsed."""
    c = F.regexp_replace(c, r"[\[\]]", "")
    c = F.regexp_replace(c, r"(?iU)\b([a-zA-Z]{1,3})-(?=\1)", "")
    c = F.regexp_replace(c, r"(?iU)\b(\w+)(?:-\1)+\b", "$1")
    c = ascii_only(c)
    c = F.regexp_replace(c, rf"(?i)^({'|'.join(INTERJECTIONS)})\s+(?=[A-Z])", "$1, ")
    c = F.regexp_replace(c, r"[?!.]+\z", "")
    c = F.regexp_replace(c, r"([,;:]){2,}", "$1")
    return strip(F.regexp_replace(c, " +", " "))


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "“”{}", '""""')


def without_fences(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^```[A-Za-z]*[ \t]*$\n?|```", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^\w\s-]", ""), r"[\s-]+", "_")


def title_of_slug(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def lead_connectors_off(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s,.\-—:;]+", "")


def wait_seconds(message: Column, default: float = 30.0) -> Column:
    """Seconds that an error message asks to wait: '1m30s', '2m', 'after 12s'."""
    number = lambda p, g: F.nullif(F.regexp_extract(message, p, g), F.lit("")).try_cast("double")
    minutes_seconds, minutes, after = r"in\s+(?:(\d+)m)?(\d+(?:\.\d+)?)s", r"in\s+(\d+)m(?!\d)", r"after\s+(\d+(?:\.\d+)?)s"
    return F.coalesce(F.coalesce(number(minutes_seconds, 1), F.lit(0.0)) * 60 + number(minutes_seconds, 2), number(minutes, 1) * 60, number(after, 1), F.lit(default))


def error_class(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *xs: F.greatest(*[m.contains(x).cast("int") for x in (*xs, xs[0])]) == 1
    return F.when(has("rate_limit", "429", "rate limit"), "rate_limit").when(has("503"), "503").when(has("502"), "502").when(has("timeout", "timed out"), "timeout").when(has("connection"), "connection").otherwise("other")


def overlap(a: Column, b: Column) -> Column:
    """Common words over the smaller word set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.when(least == 0, 1).otherwise(least))


def bar(label: Column, value: Column, total: Column, width: int = 20) -> Column:
    """One line of a console report: label, filled and empty cells, value."""
    filled = F.when(total > 0, F.floor(value * width / F.when(total > 0, total))).otherwise(0).cast("int")
    padded = F.when(F.length(label) >= 22, label).otherwise(F.rpad(label, 22, " "))
    return F.concat(padded, F.lit(" "), F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled), F.lit(" "), value.cast("string"))


def novel_of_path(path: Column) -> Column:
    """The folder above 'input'; '.' if the file isn't in such a folder."""
    found = F.regexp_extract(path, r"([^/]+)/input/[^/]+$", 1)
    return F.when(found == "", ".").otherwise(found)


def chapter_of_path(path: Column) -> Column:
    """First integer of the file's name; 0 if there is none."""
    digits = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"(\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(0))
