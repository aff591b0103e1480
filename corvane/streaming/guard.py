"""Extension: the same rules on a stream of texts.

The steps from a text to its level are stateless, so they run unchanged on a streaming
DataFrame. Sources of actions are looked up in batch (``policy.guidance``), for instance in a
foreachBatch sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.explain import cue_observer, observed
from corvane.operators.policy import action_ids, level, policy_flags

INPUTS = "input_id long, text string"


def read_inputs(spark: SparkSession, folder: str, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(INPUTS).format(kind).load(folder)


def levels(inputs: DataFrame, observer=cue_observer) -> DataFrame:
    """input_id, category, flags, level and proposed actions of inputs(input_id, text), streaming or not."""
    seen = observed(inputs, observer).withColumn("_f", policy_flags(F.col("text"), F.col("category"), F.col("signals"), F.col("facts")))
    flags = F.col("_f.flags")
    first = level(F.col("category"), F.col("issues"), flags, F.col("facts"))
    return seen.select("input_id", "rejected", "category", flags.alias("flags"), first.alias("level"), action_ids(first, F.col("category"), flags, F.col("facts")).alias("actions"))
