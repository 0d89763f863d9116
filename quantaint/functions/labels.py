"""Scenario labels and injection sizes, as values and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_tag(ratio: Column) -> Column:
    """0.0001 -> 0p01pct, 0.001 -> 0p1pct, 0.2 -> 20pct."""
    percent = ratio * F.lit(100.0)
    digits = F.when(percent < 1, F.format_string("%.2f", percent)).otherwise(
        F.format_string("%.1f", percent)
    )
    trimmed = F.regexp_replace(digits, r"\.?0+$", "")
    return F.concat(F.replace(trimmed, F.lit("."), F.lit("p")), F.lit("pct"))


def seed_tag(seed: Column) -> Column:
    return F.concat(F.lit("seed"), F.format_string("%02d", seed))


def norm_scale(scale: Column) -> Column:
    return F.regexp_replace(scale.cast("string"), "^sf", "")


def norm_seed(seed: Column) -> Column:
    return F.regexp_replace(seed.cast("string"), "^seed", "")


def safe_ratio_count(base: Column, ratio: Column) -> Column:
    """At least one row of a non-empty table, otherwise the floor of the share."""
    share = F.floor(base * ratio).cast("bigint")
    return F.when((base > 0) & (ratio > 0), F.greatest(F.lit(1).cast("bigint"), share)).otherwise(
        F.lit(0).cast("bigint")
    )
