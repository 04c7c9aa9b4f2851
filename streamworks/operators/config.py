"""Configuration tables checked against range rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed ranges.
WINDOW_LEAST, WINDOW_BELOW, WINDOW_DEFAULT = 64, 0x8000, 128
EQ_Q, EQ_GAIN = (0.1, 20.0), (-15.0, 15.0)
FEEDBACK = (0.0, 0.95)
CURVE_POINTS, CURVE_RANGE = 6, (-100.0, 0.0)


def _outside(col: str, low: float, high: float) -> Column:
    return ~F.col(col).between(low, high)


def rules(columns: list[str]) -> dict[str, Column]:
    """The rules that apply to a table with these columns, by what they say when broken."""
    found: dict[str, Column] = {}
    if "window" in columns:
        found["window"] = (F.col("window") != 0) & ((F.col("window") < WINDOW_LEAST) | (F.col("window") >= WINDOW_BELOW))
    if "q" in columns:
        found["eq_q"] = _outside("q", *EQ_Q)
    if "gain" in columns:
        found["eq_gain"] = _outside("gain", *EQ_GAIN)
    if {"fc", "sample_rate"} <= set(columns):
        found["eq_fc"] = F.col("fc") >= F.col("sample_rate") / 2
    if "feedback" in columns:
        found["delay_feedback"] = _outside("feedback", *FEEDBACK)
    if "points" in columns:
        xs = F.transform("points", lambda p: p["x"])
        found["curve_count"] = F.size("points") > CURVE_POINTS
        found["curve_ends"] = ~(F.array_contains(xs, 0.0) & F.array_contains(xs, -100.0))
        found["curve_distinct"] = F.size(F.array_distinct(xs)) != F.size(xs)
        found["curve_range"] = F.exists("points", lambda p: ~p["x"].between(*CURVE_RANGE) | ~p["y"].between(*CURVE_RANGE))
    return found


def validate_config(df: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """adds ``violations``, and window 0 becomes its default."""
    checks = rules(df.columns) | (extra or {})
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()])) if checks else F.array().cast("array<string>")
    out = df.withColumn("violations", broken)
    return out.withColumn("window", F.when(F.col("window") == 0, WINDOW_DEFAULT).otherwise(F.col("window"))) if "window" in df.columns else out


def validate_filter_bank(df: DataFrame) -> DataFrame:
    """(bank, kind, fc): at most one high-pass and one low-pass, which stand at the bank's lowest and highest fc."""
    found = df.groupBy("bank").agg(
        F.count_if(F.col("kind") == "high_pass").alias("n_hp"), F.count_if(F.col("kind") == "low_pass").alias("n_lp"), F.min("fc").alias("low"), F.max("fc").alias("high"),
        F.min(F.when(F.col("kind") == "high_pass", F.col("fc"))).alias("hp"), F.max(F.when(F.col("kind") == "low_pass", F.col("fc"))).alias("lp"),
    )
    broken = [("two_high_pass", F.col("n_hp") > 1), ("two_low_pass", F.col("n_lp") > 1), ("high_pass_not_lowest", F.col("hp") > F.col("low")), ("low_pass_not_highest", F.col("lp") < F.col("high"))]
    return found.select("bank", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in broken])).alias("violations"))
