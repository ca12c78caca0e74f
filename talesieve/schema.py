"""Fixed domains and small reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The types and tones that a segment may have.
TYPES = ["dialogue", "narration", "action", "thought"]
TONES = ["neutral", "calm", "tense", "whisper", "angry", "sad", "excited", "cold", "fearful", "sarcastic", "pleading", "commanding", "gentle", "mocking", "sorrowful", "triumphant"]
#: Milliseconds of silence between two segments of these types, and otherwise.
PAUSES = [("dialogue", "dialogue", 300), ("dialogue", "narration", 450), ("dialogue", "action", 200), ("narration", "dialogue", 400), ("narration", "narration", 350), ("action", "dialogue", 200), ("thought", "narration", 400)]
DEFAULT_PAUSE_MS, LEAD_IN_MS = 400, 500
#: Names that stand for no character.
FIXED_SPEAKERS = ["narrator", "system", "unknown"]
DEFAULT_VOICE = "Ana Florence"
#: Speeds of the first to sixth reuse of a voice.
SPEED_OFFSETS = [0.85, 1.15, 0.88, 1.12, 0.92, 1.08]

SEGMENT = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("speaker", T.StringType()), T.StructField("type", T.StringType()), T.StructField("tone", T.StringType()), T.StructField("text", T.StringType())])


def pause_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAUSES, "type_a string, type_b string, pause_ms int")
