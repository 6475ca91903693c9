"""Forgetting curves: decay, reinforcement, rehearsal and archiving."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86400.0


def seconds_since(moment: Column, now: str) -> Column:
    unix = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return F.greatest(F.lit(0.0), unix(F.lit(now).cast("timestamp_ntz")) - unix(moment.cast("timestamp_ntz")))


def decay_base(strength: Column, dt: Column, base: Column, count: Column) -> Column:
    """Stability grows with the base value and 0.05 an access, up to a day; it is one second at least."""
    stability = F.greatest(F.lit(1.0), F.least(F.lit(1.0), base + 0.05 * count) * DAY)
    return F.least(F.lit(1.0), strength * F.exp(-dt / stability))


def decay_half_life(strength: Column, dt: Column, days: float) -> Column:
    return F.least(F.lit(1.0), strength * F.lit(1.0) if math.isinf(days) else strength * F.exp(-dt * math.log(2) / (days * DAY)))


def with_decay(rows: DataFrame, now: str, half_life: float | None = None) -> DataFrame:
    dt = seconds_since(F.col("last_accessed"), now)
    d = decay_base(F.col("strength"), dt, F.col("base_value"), F.col("access_count")) if half_life is None else decay_half_life(F.col("strength"), dt, half_life)
    return rows.withColumn("decayed", F.round(d, 9))


def apply_strength(hits: DataFrame, strengths: DataFrame, now: str, half_life: float = 7.0) -> DataFrame:
    """0.7 relevance and 0.3 decayed strength; archived memories go; one without a row is fresh."""
    s = strengths.select(F.col("memory_id").alias("id"), "strength", "last_accessed", "access_count", "base_value", "archived")
    out = hits.join(s, "id", "left").filter(~F.coalesce("archived", F.lit(False)))
    d = F.coalesce(decay_half_life(F.col("strength"), seconds_since(F.col("last_accessed"), now), half_life), F.lit(1.0))
    return out.withColumn("decayed", F.round(d, 9)).withColumn("final_score", F.round(0.7 * F.col("score") + 0.3 * d, 9))


def touched(hits: DataFrame, strengths: DataFrame, now: str) -> DataFrame:
    """Strength rows after the hits were read: full strength, one access more, accessed now."""
    ids = hits.select(F.col("id").alias("memory_id")).distinct()
    moment = F.lit(now).cast("timestamp_ntz")
    return ids.join(strengths, "memory_id", "left").select("memory_id", F.lit(1.0).alias("strength"), (F.coalesce("access_count", F.lit(0)) + 1).alias("access_count"), moment.alias("last_accessed"), F.coalesce("base_value", F.lit(0.5)).alias("base_value"), F.coalesce("archived", F.lit(False)).alias("archived"))


def rehearse(rows: DataFrame, now: str) -> DataFrame:
    """0.2 on top of the decayed strength; above 0.1 the memory is taken out of the archive."""
    d = with_decay(rows, now)
    up = F.least(F.lit(1.0), F.col("decayed") + 0.2)
    return d.select("memory_id", F.round(up, 9).alias("strength"), (F.col("access_count") + 1).alias("access_count"), (F.col("archived") & (up <= 0.1)).alias("archived"))


def to_rehearse(rows: DataFrame, now: str) -> DataFrame:
    return with_decay(rows, now).filter("not archived and decayed < 0.3 and base_value > 0.5")


def to_archive(rows: DataFrame, now: str) -> DataFrame:
    return with_decay(rows, now).filter("not archived and decayed < 0.1")
