"""Prefix snapshots: text files of a prefix and an AS number in each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """seq, prefix and value of each line; seq follows the order of files and lines.

    The order comes from Spark's own row ids (file splits in order), so no sort and no single task is needed.
    """
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    words = F.split("value", " ")
    return lines.filter("trim(value) != ''").select("seq", F.get(words, F.lit(0)).alias("prefix"), F.get(words, F.lit(1)).alias("value"))
