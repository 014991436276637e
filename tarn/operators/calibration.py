"""Confidence calibration as column expressions, and the temperature grid as one aggregation for all temperatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import calibration_error


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def temperature(raw: Column, t: Column | float) -> Column:
    """raw ** (1 / t), 0 for anything not positive. A temperature above 1 raises values below 1."""
    return F.when(raw <= 0, F.lit(0.0)).otherwise(F.pow(raw, F.lit(1.0) / t))


def by_evidence(raw: Column, strength: Column, count: Column) -> Column:
    out = raw * strength * F.least(F.lit(1.0), count / F.lit(3.0))
    return F.when(strength < 0.5, F.least(out, F.lit(0.7))).otherwise(out)


def combined(raw: Column, strength: Column, count: Column, t: float) -> Column:
    scaled = F.when(raw > 0.9, temperature(raw, t)).otherwise(raw)
    scaled = scaled * F.when(strength < 0.3, 0.7).when(strength < 0.5, 0.85).otherwise(1.0)
    return clamp(F.when(count < 2, scaled * 0.9).when(count >= 3, F.least(F.lit(1.0), scaled * 1.05)).otherwise(scaled))


def uncertainty(raw: Column, strength: Column, count: Column) -> Column:
    middle = F.when(raw.between(0.4, 0.6), 0.3).otherwise(0.1)
    return F.least(F.lit(1.0), (1 - strength) * 0.5 + F.greatest(F.lit(0.0), 1 - count / F.lit(5.0)) * 0.3 + middle * 0.2)


def calibrate(raw: Column, strength: Column, count: Column, method: str = "temperature_evidence", t: float = 1.5) -> Column:
    if method == "temperature":
        return clamp(temperature(raw, t))
    return clamp(by_evidence(raw, strength, count)) if method == "evidence" else combined(raw, strength, count, t)


def threshold(strength: Column, count: Column, least: float = 0.5) -> Column:
    """Confidence to be asked for: more for weak evidence or a single source."""
    base = F.when(strength < 0.5, 0.7).when(strength < 0.7, 0.6).otherwise(least)
    return F.when(count < 2, F.greatest(base, F.lit(0.65))).otherwise(base)


def temperature_grid(results: DataFrame, confidence: str = "confidence", correct: str = "is_correct", steps: int = 20, target: float = 0.1) -> DataFrame:
    """t, ece, gap for temperatures 1.0, 1.1, ...; the one to choose has the least gap to target, not the least error."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: 1 + i * 0.1)).alias("t")
    scaled = results.select(grid, F.col(confidence).alias("c"), F.col(correct).alias("ok")).withColumn("c", F.pow("c", 1 / F.col("t")))
    return calibration_error(scaled, "c", "ok", ("t",)).withColumn("gap", F.abs(F.col("ece") - target))
