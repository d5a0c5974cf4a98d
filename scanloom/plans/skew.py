"""Joins that survive a key which holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys can each hold more than 1/HOT_KEYS of the rows.
HOT_KEYS = 64


def hot_keys(df: DataFrame, key: str, least: int = 20_000, at_most: int = HOT_KEYS) -> list:
    """The up to ``at_most`` most frequent values of ``key`` with ``least`` rows or more.

    Counts are exact and combined before the shuffle; the driver gets ``at_most`` values.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [r[0] for r in counts.orderBy(F.desc("n")).limit(at_most).collect()]


def is_hot(key: Column, hot: list) -> Column:
    return key.isin(hot) if hot else F.lit(False)


def salted_join(probe: DataFrame, build: DataFrame, key: str, how: str = "inner", *, hot: list | None = None, salts: int = 32, spread: Column | None = None) -> DataFrame:
    """``probe`` joined with ``build`` (few rows a key) on ``key``; no task gets a whole hot key.

    Rows of the hot keys of ``probe`` are spread over ``salts`` parts by a hash of all their
    columns (or of ``spread``); the rows of those keys in ``build`` are repeated for each part.
    ``how``: inner, left, left_semi or left_anti. The result has the rows of the plain join.
    """
    hot = hot_keys(probe, key) if hot is None else hot
    if not hot:
        return probe.join(build, key, how)
    part = F.pmod(spread if spread is not None else F.xxhash64(*probe.columns), F.lit(salts)).cast("int")
    left = probe.withColumn("_salt", F.when(is_hot(F.col(key), hot), part).otherwise(F.lit(0)))
    parts = F.when(is_hot(F.col(key), hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = build.withColumn("_salt", F.explode(parts))
    return left.join(right, [key, "_salt"], how).drop("_salt")
