"""Files: chapters, novel databases, registries, checkpoints, audio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talesieve.functions import text as X
from talesieve.operators import markdown

#: Schema of a registry file.
REGISTRY = "characters map<string,struct<xtts_speaker:string,gender:string,cast_by:string,is_overflow:boolean,speed_variant:double>>, dormant_voices map<string,struct<xtts_speaker:string,gender:string,dormant_since_chapter:int>>"


def chapters(spark: SparkSession, root: str) -> DataFrame:
    """``novel, chapter_num, path, text`` of <root>/<novel>/input/chapter_<n>.txt; files are read whole, names filtered first."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "chapter_*.txt").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(X.novel_of_path(path).alias("novel"), X.chapter_of_path(path).alias("chapter_num"), path.alias("path"), F.col("value").alias("text"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def registries(spark: SparkSession, path: str) -> DataFrame:
    """Registry files, one row each; a missing part is an empty map."""
    rows = spark.read.option("multiLine", True).schema(REGISTRY).json(path).select(F.col("_metadata.file_path").alias("path"), "*")
    empty = F.expr("cast(map() as map<string,struct<xtts_speaker:string,gender:string,cast_by:string,is_overflow:boolean,speed_variant:double>>)")
    return rows.withColumn("characters", F.coalesce("characters", empty))


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Completed entries of a checkpoint file, each once."""
    return spark.read.option("multiLine", True).schema("completed array<string>").json(path).select(F.explode("completed").alias("entry")).distinct()


def voice_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return markdown.catalogue(whole_texts(spark, path).select("path", F.col("text").alias("md")), ["path"])


def audio(spark: SparkSession, root: str) -> DataFrame:
    """Audio files below a folder: path, size and number in the name (null if there is none)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{wav,mp3}").load(root)
    number = F.nullif(F.regexp_extract(F.regexp_extract("path", r"([^/]*)$", 1), r"(\d+)", 1), F.lit("")).try_cast("int")
    return files.select("path", "length", number.alias("number"), "content")


def stub_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("unknown", "Ana Florence")], "name string, voice string")
