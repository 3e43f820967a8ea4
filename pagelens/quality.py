"""Keeping bad records apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quarantine(df: DataFrame, key: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and (key, reason) for the others. ``rules`` maps a reason to the condition of a bad row.

    One bad record never fails the set: rules are expected to use conversions that give null.
    """
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rules.items()])
    judged = df.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL").select(key, "reason")
