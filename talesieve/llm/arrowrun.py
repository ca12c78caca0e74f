"""Arrow batches in and out of Python functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_columns(df: DataFrame, schema: T.StructType, f: Callable[[dict[str, list]], dict[str, list]], chars: str | None = None, limit: int = 8_000_000) -> DataFrame:
    """``f`` gets a batch as lists by column and returns lists by column of ``schema``, of any equal length.

    A batch whose column ``chars`` holds more than ``limit`` characters is handed over in parts, each row whole.
    """
    return map_arrays(df, schema, lambda batch: f({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)}), chars, limit)


def map_arrays(df: DataFrame, schema: T.StructType, f: Callable[[pa.RecordBatch], dict[str, list | pa.Array]], chars: str | None = None, limit: int = 8_000_000) -> DataFrame:
    """As ``map_columns``; ``f`` gets the batch itself and returns lists, numpy's arrays or Arrow's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            n = batch.num_rows
            cuts, total = [0], 0
            if chars:
                sizes = pc.fill_null(pc.utf8_length(batch.column(chars)), 0).to_numpy(zero_copy_only=False)
                for i, size in enumerate(sizes.tolist() if sizes.sum() > limit else ()):
                    total += size
                    if total > limit and i + 1 < n:
                        cuts.append(i + 1)
                        total = 0
            cuts.append(n)
            for a, b in zip(cuts, cuts[1:]):
                got = f(batch if (a, b) == (0, n) else batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([v.cast(x.type) if isinstance(v := got[x.name], pa.Array) else pa.array(v, x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


def as_list(column: pa.Array) -> list:
    """As ``to_pylist``, of strings and of values without nulls several times faster."""
    t = column.type
    quick = pa.types.is_string(t) or pa.types.is_large_string(t) or not column.null_count and (pa.types.is_integer(t) or pa.types.is_boolean(t))
    return column.to_numpy(zero_copy_only=False).tolist() if quick else column.to_pylist()


def records(spark, sf_dir: str, *extra: str) -> DataFrame:
    """Chapters and segments as one table: rec_kind, rec_id, the columns of ``extra`` that both have, and text."""
    from pyspark.sql import functions as F

    from talesieve.sources.tables import table

    parts = [table(spark, sf_dir, t).select(F.lit(k).alias("rec_kind"), F.col(i).alias("rec_id"), *extra, "text") for t, k, i in (("chapters", "chapter", "chapter_id"), ("segments", "segment", "seg_id"))]
    return parts[0].unionByName(parts[1])
