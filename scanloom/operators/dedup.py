"""Exact and perceptual duplicates of the hash index, and their groups."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.plans.skew import salted_join

SEGMENTS, ERRORS, BITS = 5, 3, 64


def segment_bounds(segments: int = SEGMENTS, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, length) of each segment; lengths differ by one at most."""
    lengths = [bits // segments + (i < bits % segments) for i in range(segments)]
    return [(sum(lengths[:i]), n) for i, n in enumerate(lengths)]


def segment_entries(value: Column, segments: int = SEGMENTS, errors: int = ERRORS) -> Column:
    """An entry for each choice of ``segments - errors`` segments of a 64-bit value: values within ``errors`` bits share one."""
    cut = [F.shiftrightunsigned(value, start).bitwiseAND(F.lit(2**n - 1).cast("bigint")) for start, n in segment_bounds(segments)]
    return F.array(*[F.xxhash64(F.lit(i), *[cut[s] for s in chosen]) for i, chosen in enumerate(itertools.combinations(range(segments), segments - errors))])


def group_id(master: Column) -> Column:
    return F.substring(F.md5(master), 1, 16)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 5 * distance)


def exact_groups(df: DataFrame, key: Column, order: Column, name: Column) -> DataFrame:
    """Keys held by two or more rows: key, master (the first in order), group_id, copies. Partial aggregation; no group is collected."""
    grouped = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.min_by(name, order).alias("master"), F.countDistinct(order).alias("copies"))
    return grouped.where("copies > 1").withColumn("group_id", group_id(F.col("master").cast("string")))


def nearest_earlier(df: DataFrame, record: str, value: str) -> DataFrame:
    """For each record the closest earlier record within three bits: record, match, distance, similarity; ties go to the first.

    Equal values are reduced to their first record; distinct values meet under an entry of 25 or 26 bits (two of five segments), which a
    pair within three bits must share, and are verified. Of a value's other holders only the first can be earlier and closest, and of
    those first ones that the record comes after, the closest: at most one a distance is kept for each value, so no hot value multiplies.
    """
    values = df.where(F.col(value).isNotNull() & F.col(record).isNotNull()).select(F.col(record).alias("r"), F.col(value).alias("v"))
    firsts = values.groupBy("v").agg(F.min("r").alias("first"))
    indexed = firsts.select("v", "first", F.explode(segment_entries(F.col("v"))).alias("entry"))
    a, b = indexed.select("entry", F.col("v").alias("av")), indexed.select("entry", F.col("v").alias("bv"), F.col("first").alias("match"))
    distance = hamming(F.col("av"), F.col("bv"))
    pairs = salted_join(a, b, "entry").where((F.col("av") != F.col("bv")) & (distance <= ERRORS))
    near = pairs.groupBy(F.col("av").alias("v"), distance.alias("distance")).agg(F.min("match").alias("match"))
    near = near.unionByName(firsts.select("v", F.lit(0).alias("distance"), F.col("first").alias("match")))
    hits = salted_join(values.distinct(), near, "v").where(F.col("match") < F.col("r"))
    best = hits.groupBy("r").agg(F.min(F.struct("distance", "match")).alias("best"))
    return best.select(F.col("r").alias(record), "best.match", "best.distance", similarity(F.col("best.distance")).alias("similarity"))
