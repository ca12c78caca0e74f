"""Items of varying length laid into containers of fixed capacity.

Items are dealt over shards by hash, so that no shard is bound to a source or a cluster of copies. Within a shard, items
go in order of falling length to the tightest container that they fit in and that is compatible. Containers are kept by
the room they have left, as bitmaps; each source and each cluster of copies has a bitmap of the containers that hold it. The
search goes on from the tightest room to the next larger one, to the largest, until a container without the item's source
and cluster is found. If there is none, one that holds the source will do, as mixing sources is worth less than space; one that
holds a copy never will: a container is opened. What containers of all shards are left with much room are dealt and packed
once more, in fewer shards.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talesieve.sources.tables import materialise

CAPACITY = 2048
#: Items of a shard; what a task holds.
SHARD_ITEMS = 20_000
#: Containers filled to less than this share are packed once more.
FULL = 0.98


class Containers:
    """Open containers by room left; bit ``c`` of a bitmap stands for container ``c``."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.n = capacity, 0
        self.rooms: list[int] = []
        self.by_room: dict[int, int] = {}
        self.of_source: dict[object, int] = {}
        self.of_cluster: dict[object, int] = {}

    def _tightest(self, size: int, closed: int) -> tuple[int, int] | None:
        """Room and number of the first container outside of a bitmap, from the least room that is enough."""
        for k in range(bisect_left(self.rooms, size), len(self.rooms)):
            room = self.rooms[k]
            if free := self.by_room[room] & ~closed:
                return room, (free & -free).bit_length() - 1
        return None

    def put(self, size: int, source: object, cluster: object) -> tuple[int, bool]:
        """The container for an item, and whether the container held the item's source already."""
        held, copies = self.of_source.get(source, 0), self.of_cluster.get(cluster, 0)
        found = self._tightest(size, held | copies)
        beside = found is None and (found := self._tightest(size, copies)) is not None
        if found is None:
            room, c = self.capacity, self.n
            self.n += 1
        else:
            room, c = found
            self.by_room[room] ^= 1 << c
            if not self.by_room[room]:
                del self.by_room[room], self.rooms[bisect_left(self.rooms, room)]
        self.of_source[source] = held | 1 << c
        self.of_cluster[cluster] = copies | 1 << c
        if left := room - size:
            if left not in self.by_room:
                insort(self.rooms, left)
            self.by_room[left] = self.by_room.get(left, 0) | 1 << c
        return c, beside


def pack(items: DataFrame, id_col: str, size_col: str, source_col: str, cluster_col: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per piece: ``container`` (string), ``id_col, piece, start, length, beside`` (its source was in the container already).

    An item of more than ``capacity`` is split into full pieces and a rest; no other item is split. Items of size 0 and
    null sizes take no room and are in container null. Null sources and clusters are values like others. Repeated rows are
    items of their own. No two items of a cluster are in one container.
    """
    base = items.select(F.col(id_col), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(cluster_col).alias("cluster"))
    cut = base.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((size - 1) div {capacity} as int)"))))).select(id_col, "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece").cast("long") * capacity).alias("length"), "source", "cluster")
    cut = materialise(cut)
    whole = cut.where(F.col("length") == capacity).select(F.concat_ws("-", F.lit("w"), F.xxhash64(id_col, "piece", F.monotonically_increasing_id()).cast("string")).alias("container"), id_col, "piece", "start", "length", F.lit(False).alias("beside"))
    none = cut.where("length = 0").select(F.lit(None).cast("string").alias("container"), id_col, "piece", "start", "length", F.lit(False).alias("beside"))
    loose = cut.where(f"length > 0 and length < {capacity}").withColumn("tie", F.xxhash64(id_col, "piece"))
    packed = materialise(_round(loose, id_col, capacity, shard_items, "a"))
    fill = packed.groupBy("container").agg(F.sum("length").alias("held"))
    kept = fill.where(F.col("held") >= F.lit(FULL * capacity)).select("container")
    again = packed.join(kept, "container", "left_anti").drop("container", "beside")
    second = _round(again, id_col, capacity, shard_items, "b")
    done = packed.join(kept, "container", "left_semi").unionByName(second)
    columns = ["container", id_col, "piece", "start", "length", "beside"]
    return done.select(*columns).unionByName(whole.select(*columns)).unionByName(none.select(*columns))


def _round(loose: DataFrame, id_col: str, capacity: int, shard_items: int, name: str) -> DataFrame:
    n = loose.count()
    shards = max(1, -(-n // shard_items))
    dealt = loose.withColumn("shard", F.pmod(F.xxhash64("tie", F.lit(name)), F.lit(shards)).cast("int"))
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("length"), "tie").select(id_col, "piece", "start", "length", "source", "cluster", "tie", "shard")
    schema = T.StructType([*[f for f in ordered.schema if f.name != "shard"], T.StructField("container", T.StringType()), T.StructField("beside", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, Containers(capacity)
        for batch in batches:
            names, beside = [], []
            for length, source, cluster, s in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 7))):
                if s != shard:
                    shard, bins = s, Containers(capacity)
                c, mixed = bins.put(length, source, cluster)
                names.append(f"{name}-{s}-{c}")
                beside.append(mixed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(names, pa.string()), pa.array(beside)], names=schema.names)

    return ordered.mapInArrow(run, schema)
