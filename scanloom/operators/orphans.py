"""References to records that do not exist, or came later.

A Bloom filter over the parents' keys is built once, by a partial and a final aggregate, saved, and
reaches the children's scan as a scalar subquery, inside code generation. What it denies is an orphan for
certain and needs no join; only what it lets through is joined with the parents. A filter holds
at most ``MOST_ITEMS`` keys in 8 MB (Spark's cap); more parents are dealt into up to ``MOST_FILTERS`` filters by a hash of
their key, and a reference is tested by that of its own hash. Beyond 64 million parents the filters fill up
and let more through; the join still decides.

Defined cases: a null or blank reference is none and gives no row; a reference from which
nothing is left after normalising ('?') names no parent; repeated child rows count once;
repeated parents count once, by their earliest creation; a parent without creation time
is never later; without parents every given reference is missing; other columns of either
table, whatever their names, are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.classic.column import _to_java_column
from pyspark.sql.internal import InternalFunction

from scanloom.functions.keys import document_key, is_given
from scanloom.plans.skew import hot_keys, salted_join
from scanloom.plans.workspace import Workspace


MOST_ITEMS = 4_000_000
MOST_FILTERS = 16


def bloom_of(df: DataFrame, key: Column, items: int, bits_per_item: int = 16) -> Column:
    """A Bloom filter of the 64-bit ``key`` over ``df`` as a scalar subquery; Spark caps its items and bits."""
    items = min(max(items, 1_000), MOST_ITEMS)
    bits = items * bits_per_item
    agg = InternalFunction._invoke_internal_function_over_columns("bloom_filter_agg", key, F.lit(items).cast("bigint"), F.lit(bits).cast("bigint"))
    return df.select(agg.alias("bloom")).scalar()


def saved_filter(ws: Workspace, df: DataFrame, key: Column, items: int, *, bits_per_item: int = 16, most_items: int | None = None) -> Callable[[Column], Column]:
    """A test of 64-bit keys: false only for keys that ``df`` does not have. Its filters are built in one pass and saved, a few MB each."""
    most_items = most_items or MOST_ITEMS
    parts = min(MOST_FILTERS, -(-items // most_items)) or 1
    items = min(max(items // parts, 1_000), most_items)
    agg = lambda k: InternalFunction._invoke_internal_function_over_columns("bloom_filter_agg", k, F.lit(items).cast("bigint"), F.lit(items * bits_per_item).cast("bigint"))
    part = lambda k: F.pmod(F.hash(k), F.lit(parts))
    keyed = df.select(key.alias("k")) if parts == 1 else df.select(key.alias("k"), part(key).alias("part"))
    # A filter of nothing is null. Its part of the keys goes into each filter as null otherwise, which it ignores.
    made = keyed.agg(*[agg(F.col("k") if parts == 1 else F.when(F.col("part") == i, F.col("k"))).alias(f"b{i}") for i in range(parts)])
    saved = ws.save(made, f"filter-{uuid.uuid4().hex[:8]}")

    def test(probe: Column) -> Column:
        tests = [might_contain(saved.select(f"b{i}").scalar(), probe) for i in range(parts)]
        out = tests[-1]
        for i in range(parts - 2, -1, -1):
            out = F.when(part(probe) == i, tests[i]).otherwise(out)
        return out

    return test


def might_contain(bloom: Column, key: Column) -> Column:
    """False only where the filter holds no such key; an empty filter holds none."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.active()._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    sides = [utils.expression(_to_java_column(c)) for c in (bloom, key)]
    test = utils.column(jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(*sides))
    return F.coalesce(ClassicColumn(test), F.lit(False))


@dataclass(frozen=True)
class Reference:
    """A table with references. ``row_id``, ``key`` and ``created_at`` (of the parents' type) are columns of ``df``."""

    name: str
    df: DataFrame
    row_id: Column
    key: Column
    created_at: Column


def find_orphans(references: list[Reference], parents: DataFrame, parent_key: Column, parent_created: Column, *, bits_per_parent: int = 16, hot: list | None = None) -> DataFrame:
    """Rows (table_name, row_id, state, created_at) whose parent is ``missing``, or ``early``: there, but created later."""
    known = parents.where(is_given(parent_key)).select(document_key(parent_key).alias("key"), parent_created.alias("parent_created")).where("key <> ''")
    ws = Workspace(parents.sparkSession, "orphans")
    known = ws.save(known.groupBy("key").agg(F.min("parent_created").alias("parent_created")), "parents")
    rows = None
    for r in references:
        part = r.df.where(is_given(r.key)).select(
            F.lit(r.name).alias("table_name"), r.row_id.cast("string").alias("row_id"), document_key(r.key).alias("key"), r.created_at.alias("created_at")
        )
        rows = part if rows is None else rows.unionByName(part)
    may_be = saved_filter(ws, known, F.xxhash64("key"), known.count(), bits_per_item=bits_per_parent)
    hot = hot_keys(rows, "key") if hot is None else hot
    tested = rows.withColumn("maybe", may_be(F.xxhash64("key")))
    certain = tested.where(~F.col("maybe")).select("table_name", "row_id", F.lit("missing").alias("state"), "created_at")
    checked = salted_join(tested.where("maybe").drop("maybe"), known.withColumn("found", F.lit(True)), "key", "left", hot=hot)
    state = F.when(F.col("found").isNull(), "missing").when(F.col("parent_created") > F.col("created_at"), "early")
    verified = checked.withColumn("state", state).where("state IS NOT NULL").select("table_name", "row_id", "state", "created_at")
    return certain.unionByName(verified).dropDuplicates(["table_name", "row_id", "state", "created_at"])


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds as a timestamp without zone, meant as UTC."""
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def month(created_at: Column) -> Column:
    """'YYYY-MM', or '' for null."""
    return F.coalesce(F.date_format(created_at, "yyyy-MM"), F.lit(""))
