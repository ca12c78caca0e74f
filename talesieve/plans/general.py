"""Queries over the relational tables, embeddings and events, and on fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talesieve.functions import audio
from talesieve.functions import text as X
from talesieve.operators import jsonrepair, markdown, waves
from talesieve.plans.catalogue import query
from talesieve.sources.tables import ensure_checkpoint_dir, table
from talesieve.streaming.incremental import run_new_files

#: Messages of a labeller's host and the seconds that they ask to wait.
MESSAGES = [("Please try again in 12.5s", 12.5, "other"), ("Error 429: try again in 1m30s", 90.0, "rate_limit"), ("rate_limit reached, in 2m", 120.0, "rate_limit"), ("503: retry after 45.2s", 45.2, "503"), ("502 bad gateway", 30.0, "502"), ("Request timed out", 30.0, "timeout"), ("Connection reset", 30.0, "other")]


@query("SELECT message, CAST(seconds AS DOUBLE) AS seconds, error_class FROM (VALUES " + ", ".join(f"('{m}', {s}, '{'connection' if 'onnection' in m else c}')" for m, s, c in MESSAGES) + ") t(message, seconds, error_class)")
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(m,) for m, _, _ in MESSAGES], "message string")
    return rows.select("message", X.wait_seconds(F.col("message")).alias("seconds"), X.error_class(F.col("message")).alias("error_class"))


@query("WITH m AS (SELECT label, i, count(*) AS n, round(avg(x), 5) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) SELECT label, max(n) AS n, list(m ORDER BY i) AS centroid FROM m GROUP BY label")
def voice_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = waves.centroids(table(spark, sf_dir, "embeddings"), "label")
    return c.select("label", "n", F.transform("centroid", lambda x: F.round(x, 5)).alias("centroid"))


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(least(greatest(CAST(x AS DOUBLE) * 32767, -32768), 32767)) AS SMALLINT)) AS pcm FROM embeddings")
def pcm16_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", audio.pcm16(F.col("embedding")).alias("pcm"))


@query("SELECT 48000 AS n, 1920 AS tone, round(sum(abs(0.15 * sin(2 * pi() * 440 * (i * 0.08 / 1919)))) * 2, 4) AS energy FROM range(1920) t(i)")
def placeholder_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = spark.range(1).select(audio.placeholder().alias("w"))
    return wave.select(F.size("w").alias("n"), F.lit(1920).alias("tone"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + F.abs(x)), 4).alias("energy"))


@query("SELECT vec_id, CAST(floor(64 / 1.25) AS INTEGER) AS n_fast, CAST(64 * 3 + 2 * 24 AS INTEGER) AS n_joined FROM embeddings")
def resample_and_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("w"))
    return rows.select("vec_id", F.size(audio.at_speed(F.col("w"), F.lit(1.25))).alias("n_fast"), F.size(audio.joined(F.array("w", "w", "w"), 1)).alias("n_joined"))


@query("""WITH c AS (SELECT vec_id, label, 1.0 + (vec_id % 17) / 10.0 AS seconds FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM c WHERE seconds >= 1.5)
SELECT label, count(*) AS n_kept, round(sum(seconds), 4) AS seconds FROM k WHERE n <= 50 GROUP BY label""")
def clip_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 clips of each label that last a second and a half."""
    clips = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.lit(1.0) + (F.col("vec_id") % 17) / 10.0).alias("seconds"))
    kept = waves.kept_clips(clips, ["label"], "vec_id")
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n_kept"), F.round(F.sum("seconds"), 4).alias("seconds"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, min(ts) AS first_ts FROM events GROUP BY event_type")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_element_at(jsonrepair.object_or_embedded(F.col("props")), F.lit("k")).try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.min("ts").alias("first_ts"))


@query("""SELECT user_id, arg_max(event_type, struct_pack(ts, event_id)) AS event_type, arg_max(value, struct_pack(ts, event_id)) AS value, count(*) AS n_changes FROM events GROUP BY user_id""")
def patch_cdc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.last_changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("SELECT event_id, event_type, value FROM events")
def stream_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through a streaming query that ends by itself; what it wrote is what there is."""
    import uuid

    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4()}"
    like = table(spark, sf_dir, "events")
    return run_new_files(spark, sf_dir, like, f"{root}/target", f"{root}/state", lambda b: b.select("event_id", "event_type", "value"), glob="events.parquet")


@query("SELECT rpad(mark, 22, ' ') || ' ' || repeat('█', CAST(n * 20 // total AS INTEGER)) || repeat('░', CAST(20 - n * 20 // total AS INTEGER)) || ' ' || n AS line FROM (SELECT event_type AS mark, count(*) AS n, (SELECT count(*) FROM events) AS total FROM events GROUP BY event_type)")
def report_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(X.bar(F.col("event_type"), F.col("n"), F.sum("n").over(Window.partitionBy())).alias("line"))


@query("SELECT o_custkey AS k, flatten(list(us ORDER BY o_orderkey)) AS uris FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['u' || o_orderkey] END AS us FROM orders) GROUP BY o_custkey")
def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("u"), F.col("o_orderkey")))
    candidate = F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.array(F.struct(F.struct(uri.alias("uri")).alias("web"))).alias("chunks"))).otherwise(F.struct(F.array(F.struct(F.struct(uri.alias("uri")).alias("web")), F.struct(F.struct(F.lit(None).cast("string").alias("uri")).alias("web"))).alias("chunks")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", candidate.alias("c")))), lambda x: x["c"])
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(jsonrepair.flat_uris(ordered).alias("uris"))


# Plain relational companions, beyond what the operators above need.


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def lineitem_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("t"))
    joined = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("k").alias("n_orders"), F.round(F.sum("t"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three FROM events")
def sliding_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.sum("value").over(w).alias("last_three"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
