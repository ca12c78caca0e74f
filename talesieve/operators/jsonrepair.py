"""Segments out of the raw answers of a labeller: JSON arrays, fenced, truncated or with unescaped quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talesieve import schema
from talesieve.functions import text as X

_ITEMS = f"array<{schema.SEGMENT.simpleString()}>"
_ITEM = schema.SEGMENT.simpleString()


def array_part(raw: Column) -> Column:
    """From the first '[' to the last ']', the array closed behind its last object if it is cut; null if there is none."""
    bare = X.strip(F.regexp_replace(raw, r"```json|```", ""))
    begin = F.instr(bare, "[")
    closed = F.regexp_extract(bare, r"(?s)^[^\[]*(\[.*\])", 1)
    objects = F.regexp_extract(bare, r"(?s)^[^\[]*(\[.*\})", 1)
    return F.when(begin == 0, F.lit(None)).when(closed != "", closed).when(objects != "", F.concat(objects, F.lit("\n]")))


def with_escaped_quotes(part: Column) -> Column:
    """Quotes within the values of "text" escaped; a value ends at the first quote before a comma or closing brace."""
    value = r'(?s)"text":\s*".*?"(?=\s*[,}])'
    begins = r'^("text":\s*")'
    inner = lambda m: F.regexp_replace(F.regexp_replace(m, begins, ""), r'"\z', "")
    escaped = lambda m: F.concat(F.regexp_extract(m, begins, 1), F.regexp_replace(inner(m), r'(?<!\\)"', r'\\"'), F.lit('"'))
    found = F.transform(F.regexp_extract_all(part, F.lit(f"({value})"), F.lit(1)), escaped)
    return F.array_join(F.zip_with(F.split(part, value, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def simple_repairs(part: Column) -> Column:
    """A missing index, quotes within texts, a comma before a closing bracket, a missing closing bracket."""
    part = with_escaped_quotes(F.regexp_replace(part, r'"index"\s*:\s*(?=[,}])', '"index": 0'))
    part = F.regexp_replace(part, r",\s*([}\]])", "$1")
    return F.when(F.rtrim(part).endswith("]"), part).otherwise(F.concat(F.regexp_extract(part, r"(?s)^(.*\})", 1), F.lit("\n]")))


def field_by_field(obj: Column) -> Column:
    """An object that isn't JSON, by its known fields; the text goes on to the object's last quote."""
    some = lambda name: F.nullif(F.regexp_extract(obj, rf'"{name}"\s*:\s*"([^"]+?)"', 1), F.lit(""))
    has_text = F.rlike(obj, F.lit(r'"text"\s*:\s*"'))
    body = X.strip(F.regexp_replace(F.regexp_extract(obj, r'(?s)"text"\s*:\s*"(.*)', 1), r'"?\s*,?\s*\}?\s*\z', ""))
    index = F.coalesce(F.nullif(F.regexp_extract(obj, r'"index"\s*:\s*(\d+)', 1), F.lit("")).try_cast("int"), F.lit(0))
    return F.struct(index.alias("index"), some("speaker").alias("speaker"), some("type").alias("type"), some("tone").alias("tone"), F.when(has_text, F.regexp_replace(body, r'"\z', "")).alias("text"))


def object_by_object(part: Column) -> Column:
    """Every flat object by itself: as JSON, else field by field; those without text or type are dropped."""
    objects = F.regexp_extract_all(part, F.lit(r"(?s)(\{[^{}]*\})"), F.lit(1))
    each = F.transform(objects, lambda o: X.let(F.from_json(o, _ITEM), lambda p: F.when(p["text"].isNotNull(), p).otherwise(field_by_field(o))))
    return F.filter(each, lambda s: s["text"].isNotNull() & s["type"].isNotNull())


def recovered(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``segments`` and ``status``: ok, repaired, partial (recovered object by object), failed or no_array."""
    good = lambda a: a.isNotNull() & F.forall(a, lambda s: s.isNotNull() & (s["text"].isNotNull() | s["type"].isNotNull()))
    told = lambda a, status: F.struct(F.lit(status).alias("status"), a.alias("segments"))
    none = F.array().cast(_ITEMS)

    def last(c: Column) -> Column:
        return F.when(F.size(c) > 0, told(c, "partial")).otherwise(told(none, "failed"))

    def second(part: Column) -> Column:
        return X.let(F.from_json(simple_repairs(part), _ITEMS), lambda b: F.when(good(b), told(b, "repaired")).otherwise(X.let(object_by_object(part), last)))

    def first(part: Column) -> Column:
        return F.when(part.isNull(), told(none, "no_array")).otherwise(X.let(F.from_json(part, _ITEMS), lambda a: F.when(good(a), told(a, "ok")).otherwise(second(part))))

    return responses.withColumn("_r", X.let(array_part(F.col(raw)), first)).withColumns({"status": F.col("_r.status"), "segments": F.col("_r.segments")}).drop("_r")


def stitched(parts: DataFrame, key: list[str], seq: str, raw: str = "raw", passes: int = 3) -> DataFrame:
    """A first answer and up to ``passes`` continuations as one array: cut behind the last object, joined, closed."""
    ordered = F.slice(F.sort_array(F.collect_list(F.struct(seq, F.col(raw).alias("r")))), 1, passes + 1)
    rows = parts.groupBy(*key).agg(F.transform(ordered, lambda x: X.strip(F.regexp_replace(x["r"], r"```json|```", ""))).alias("rs"))
    head = lambda s: F.regexp_extract(s, r"(?s)^(.*\})", 1)
    tail = lambda s: F.regexp_extract(s, r"(?s)(\{.*)\z", 1)

    def step(acc: Column, part: Column) -> Column:
        return F.when(acc == "", part).when(tail(part) == "", acc).when(head(acc) == "", acc).otherwise(F.concat(head(acc), F.lit(",\n"), tail(part)))

    whole = F.aggregate("rs", F.lit(""), step)
    opened = F.when(F.startswith(whole, F.lit("[")), whole).otherwise(F.concat(F.lit("["), whole))
    closed = F.when(F.endswith(F.rtrim(opened), F.lit("]")), opened).otherwise(F.concat(F.coalesce(F.nullif(head(opened), F.lit("")), F.lit("[")), F.lit("\n]")))
    return rows.select(*key, F.size("rs").alias("n_parts"), closed.alias(raw))


def flat_uris(candidates: Column) -> Column:
    """candidates[].chunks[].web.uri, nulls at any level skipped."""
    chunks = F.flatten(F.transform(F.filter(candidates, lambda c: c.isNotNull() & c["chunks"].isNotNull()), lambda c: c["chunks"]))
    return F.array_compact(F.transform(chunks, lambda x: x["web"]["uri"]))


def object_or_embedded(raw: Column) -> Column:
    """A JSON object of strings, or the first one within other text."""
    parse = lambda s: F.from_json(s, "map<string,string>")
    bare = X.strip(X.without_fences(raw))
    return F.coalesce(parse(bare), parse(F.regexp_extract(bare, r"(?s)(\{.*\})", 1)))
