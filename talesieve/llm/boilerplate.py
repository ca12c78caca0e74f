"""Lines that recur excessively within one source, found by prefix growth over the line sequences of each source.

A line's identity is its text in lower case without white space and digits. Rows become sequences of their frequent lines; a
pattern is grown by every frequent line behind its leftmost match in a row, until no longer one is frequent (PrefixSpan with
projected sequences). Before patterns are grown for deletion, lines that follow one another in all rows that hold either are
glued to one: a footer of fifty lines is one symbol then, not two to the fifty patterns. The occurrences of the lines of all
frequent patterns are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talesieve.sources.tables import materialise

MIN_ROWS, MIN_SHARE = 3, 0.03


def line_key(line: Column) -> Column:
    """128 bits that stand for a line's identity; null for blank lines."""
    bare = F.regexp_replace(F.lower(line), r"(?U)[\s\d]+", "")
    return F.when(F.regexp_replace(line, r"(?U)\s+", "") != "", F.md5(bare))


def _keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), line_key)


def _enough(n: Column, n_all: Column, min_share: float, many_rows: int | None) -> Column:
    share = n >= F.lit(min_share) * n_all
    return share if many_rows is None else share | (n >= many_rows)


def frequent_lines(df: DataFrame, source: str, text_col: str = "text", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, many_rows: int | None = None) -> DataFrame:
    """First level: ``source``, ``key``, ``n_rows`` (rows that hold the line) and ``n_all`` (rows of the source).

    A line needs ``min_rows`` rows, and ``min_share`` of the source's rows or ``many_rows`` of them, if that is given.
    Rows with null text count towards ``n_all`` only. A null source is a source. A line counts once per row.
    """
    rows = df.select(F.col(source), F.col(text_col))
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n_all"))
    held = rows.select(source, F.explode(F.array_compact(F.array_distinct(_keys(F.col(text_col))))).alias("key")).groupBy(source, "key").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_rows)
    return held.alias("h").join(sizes.alias("s"), F.col(f"h.{source}").eqNullSafe(F.col(f"s.{source}"))).where(_enough(F.col("n_rows"), F.col("n_all"), min_share, many_rows)).select(F.col(f"h.{source}").alias(source), "key", "n_rows", "n_all")


def _with_hits(df: DataFrame, columns: list[str], source: str, text_col: str, lines: DataFrame) -> DataFrame:
    """Each row with ``keys`` of its lines and ``hits``, those among them that are in its source's ``lines(source, key)``."""
    by_source = lines.groupBy(F.col(source).alias("_source")).agg(F.collect_set("key").alias("_found"))
    rows = df.select(*dict.fromkeys([*columns, source, text_col])).withColumn("keys", _keys(F.col(text_col)))
    joined = rows.join(by_source, F.col(source).eqNullSafe(F.col("_source")), "left")
    return joined.withColumn("hits", F.coalesce(F.array_intersect("keys", "_found"), F.expr("cast(array() as array<string>)"))).drop("_found", "_source")


def _is_hit(key: Column) -> Column:
    return F.coalesce(F.array_contains(F.col("hits"), F.coalesce(key, F.lit(""))), F.lit(False))


def lines_to_delete(df: DataFrame, source: str, text_col: str = "text", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, many_rows: int | None = None) -> DataFrame:
    """``source, key`` of the lines of all frequent sequences, single lines included."""
    found = frequent_sequences(df, source, text_col, min_rows, min_share, many_rows, glue=True)
    return materialise(found.select(source, F.explode("pattern").alias("key")).distinct())


def repeated_lines(df: DataFrame, id_col: str, source: str, text_col: str = "text", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, many_rows: int | None = None) -> DataFrame:
    """One row per occurrence to delete: ``id_col`` and ``line_no`` (split at line feeds, from 0, blank lines counted)."""
    rows = _with_hits(df, [id_col], source, text_col, lines_to_delete(df, source, text_col, min_rows, min_share, many_rows))
    return rows.where(F.size("hits") > 0).select(id_col, "hits", F.posexplode("keys").alias("line_no", "key")).where(_is_hit(F.col("key"))).select(id_col, "line_no")


def without_repeated_lines(df: DataFrame, id_col: str, source: str, text_col: str = "text", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, many_rows: int | None = None) -> DataFrame:
    """One row per input row: ``id_col``, the text without the repeated lines (null stays null) and ``n_deleted``."""
    rows = _with_hits(df, [id_col], source, text_col, lines_to_delete(df, source, text_col, min_rows, min_share, many_rows))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.when(F.size("hits") == 0, lines).otherwise(F.filter(lines, lambda x, i: ~_is_hit(F.get("keys", i))))
    return rows.withColumn("kept", kept).select(id_col, F.array_join("kept", "\n").alias(text_col), F.coalesce(F.size("keys") - F.size("kept"), F.lit(0)).alias("n_deleted"))


def _same(a: str, b: str, *columns: str) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def frequent_sequences(df: DataFrame, source: str, text_col: str = "text", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, many_rows: int | None = None, glue: bool = False) -> DataFrame:
    """Frequent sequences of frequent lines, of any length: ``source``, ``pattern array<string>`` of line keys, ``n_rows``
    (rows that hold the lines in this order; any others, frequent ones too, may stand between).

    With ``glue``, lines that are always neighbours among the frequent ones, once a row, count as one; of the patterns of
    such lines only those with all of them are given.
    """
    frequent = materialise(frequent_lines(df, source, text_col, min_rows, min_share, many_rows))
    sizes = frequent.select(source, "n_all").distinct()
    rows = _with_hits(df, [], source, text_col, frequent).where(F.size("hits") > 0).select(source, F.filter("keys", _is_hit).alias("rest"))
    # lines as small numbers of their source
    numbered = frequent.select(source, "key", "n_rows", F.row_number().over(Window.partitionBy(source).orderBy("key")).alias("code"))
    codes = numbered.groupBy(F.col(source).alias("_source")).agg(F.map_from_entries(F.collect_list(F.struct("key", "code"))).alias("_codes"))
    names = numbered.groupBy(F.col(source).alias("_source")).agg(F.map_from_entries(F.collect_list(F.struct("code", F.array("key").alias("keys")))).alias("_names"))
    coded = rows.join(codes, F.col(source).eqNullSafe(F.col("_source"))).select(source, F.transform("rest", lambda k: F.try_element_at("_codes", k)).alias("rest"))
    if glue:
        coded = materialise(coded)
        glued = _glued(coded, numbered, source)
        starts = lambda x, i: (i == 0) | ~F.coalesce(F.array_contains("_glued", F.get("rest", i - 1)), F.lit(False))
        marked = coded.join(glued, F.col(source).eqNullSafe(F.col("_source")), "left").select(source, "rest", F.coalesce("_glued", F.expr("cast(array() as array<int>)")).alias("_glued"))
        heads = marked.select(source, "rest", F.filter("rest", starts).alias("heads"), F.filter(F.transform("rest", lambda x, i: F.when(starts(x, i), i)), lambda i: i.isNotNull()).alias("at"))
        coded = materialise(heads)
        until = F.coalesce(F.get("at", F.col("i") + 1), F.size("rest"))
        units = coded.select(source, "rest", "at", F.posexplode("heads").alias("i", "code")).select(source, "code", F.slice("rest", F.get("at", F.col("i")) + 1, until - F.get("at", F.col("i"))).alias("unit"))
        unit_of = units.groupBy(source, "code").agg(F.first("unit").alias("unit"))  # the same in all rows
        parts = unit_of.select(source, F.col("code").alias("head"), F.posexplode("unit").alias("i", "code")).alias("u").join(numbered.alias("n"), _same("u", "n", source, "code")).select(F.col(f"u.{source}").alias(source), "head", "i", "key")
        listed = parts.groupBy(source, "head").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "key"))), lambda x: x["key"]).alias("keys"))
        names = listed.groupBy(F.col(source).alias("_source")).agg(F.map_from_entries(F.collect_list(F.struct("head", "keys"))).alias("_names"))
        coded = coded.select(source, F.col("heads").alias("rest"))
    # a row is here once per pattern that it holds, with what follows the leftmost match
    level = coded.select(source, F.expr("cast(array() as array<int>)").alias("pattern"), "rest")
    result: DataFrame | None = None
    while True:
        grown = _grown(level, source)
        counts = grown.groupBy(source, "pattern").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= min_rows)
        counts = materialise(counts.alias("c").join(sizes.alias("s"), _same("c", "s", source)).where(_enough(F.col("n_rows"), F.col("n_all"), min_share, many_rows)).select(F.col(f"c.{source}").alias(source), "pattern", "n_rows"))
        if result is not None and counts.isEmpty():
            break
        result = counts if result is None else result.unionByName(counts)
        level = materialise(grown.alias("g").join(counts.alias("c"), _same("g", "c", source, "pattern"), "left_semi").where(F.size("rest") > 0))
    spelled = result.join(names, F.col(source).eqNullSafe(F.col("_source")))
    return spelled.select(source, F.flatten(F.transform("pattern", lambda x: F.try_element_at("_names", x))).alias("pattern"), "n_rows")


def _glued(coded: DataFrame, numbered: DataFrame, source: str) -> DataFrame:
    """Of each source the lines that stand once in every row that holds them, and are followed by one and the same line that stands
    nowhere else: the number of such neighbours is that of the rows, and of all occurrences, of either."""
    at = coded.select(source, F.posexplode("rest").alias("i", "code"), F.col("rest"))
    seen = at.groupBy(source, "code").agg(F.count(F.lit(1)).alias("n_seen"))
    once = numbered.alias("n").join(seen.alias("s"), _same("n", "s", source, "code")).where("n_seen = n_rows").select(F.col(f"n.{source}").alias(source), F.col("n.code").alias("code"), "n_rows")
    pairs = at.select(source, "code", F.get("rest", F.col("i") + 1).alias("next")).where("next is not null and next != code").groupBy(source, "code", "next").agg(F.count(F.lit(1)).alias("n_pairs"))
    left = pairs.alias("p").join(once.alias("o"), _same("p", "o", source, "code") & (F.col("n_pairs") == F.col("n_rows"))).select(F.col(f"p.{source}").alias(source), F.col("p.code").alias("first"), F.col("next").alias("code"), "n_pairs")
    both = left.alias("p").join(once.alias("o"), _same("p", "o", source, "code") & (F.col("n_pairs") == F.col("n_rows")))
    return both.groupBy(F.col(f"p.{source}").alias("_source")).agg(F.collect_set("first").alias("_glued"))


def _grown(level: DataFrame, source: str) -> DataFrame:
    """The patterns of each row extended by each distinct line of the ``rest`` of its keys."""
    extended = level.where("size(rest) > 0").select(source, "pattern", "rest", F.explode(F.array_distinct("rest")).alias("key"))
    return extended.select(source, F.array_append("pattern", F.col("key")).alias("pattern"), F.expr("slice(rest, cast(array_position(rest, key) as int) + 1, size(rest))").alias("rest"))
