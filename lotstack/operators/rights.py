"""Rights, parties and units: the star join, as of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_on(rrr: DataFrame, day: str) -> DataFrame:
    """Links in force on a day, its ends included; an open end is no end."""
    at = F.lit(day).cast("date")
    return rrr.where((F.col("status") == "active") & (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") >= at)))


def star(rrr: DataFrame, parties: DataFrame, rights: DataFrame) -> DataFrame:
    """Each link with its party and its right. Catalyst broadcasts the small sides by their measured size."""
    p = parties.select(F.col("pid").alias("party_ref"), F.col("name").alias("party_name"), F.col("type").alias("party_type"))
    r = rights.select(F.col("rid").alias("right_ref"), F.col("type").alias("right_type"), "share_numerator", "share_denominator")
    return rrr.join(p, "party_ref").join(r, "right_ref")


def shares(linked: DataFrame) -> DataFrame:
    """(spatial_unit_ref, right_type, share): shares added up."""
    share = F.col("share_numerator") / F.col("share_denominator")
    return linked.groupBy("spatial_unit_ref", "right_type").agg(F.sum(share).alias("share"))
