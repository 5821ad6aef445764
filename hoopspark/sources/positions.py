"""Listed player positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_positions(listed: DataFrame) -> DataFrame:
    """Most recent known position of each player."""
    known = listed.where(F.col("POSITION").isNotNull()).withColumn("personId", F.col("PERSON_ID").try_cast("bigint"))
    return known.where(F.col("personId").isNotNull()).groupBy("personId").agg(
        F.max_by("POSITION", "season").alias("position")
    )
