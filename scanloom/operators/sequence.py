"""Operators over ordered values: runs, peaks, valleys, gaps, greedy groupings. Set-oriented where the semantics allow, folds within a row else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(values: DataFrame, key: str, pos: str, value: str, above: float, least: int) -> DataFrame:
    """Maximal runs of positions whose value exceeds ``above``, of ``least`` positions or more: key, start_pos, end_pos, run_length."""
    w = Window.partitionBy(key).orderBy(pos)
    kept = values.where(F.col(value) > above).withColumn("island", F.col(pos) - F.row_number().over(w))
    out = kept.groupBy(key, "island").agg(F.min(pos).alias("start_pos"), F.max(pos).alias("end_pos"), F.count("*").alias("run_length"))
    return out.where(F.col("run_length") >= least).drop("island")


def page_bounds(brightness: Column, *, bright: float = 0.95, gap: float = 0.05, page: float = 0.2) -> Column:
    """Pages of a scan from its columns' brightness (array, 0 to 1): what lies between bright gaps of ``gap`` of the width, if ``page`` of it wide. One fold."""
    width = F.size(brightness)
    least_gap, least_page = F.floor(width * gap), F.floor(width * page)
    start = F.named_struct(F.lit("run"), F.lit(-1), F.lit("left"), F.lit(0), F.lit("pages"), F.array().cast("array<struct<x_start:int,x_end:int>>"))
    closed = F.concat(brightness, F.array(F.lit(0.0)))

    def step(state: Column, x: Column) -> Column:
        i, v = x["i"], x["v"]
        in_gap = v > bright
        ends = ~in_gap & (state["run"] >= 0)
        wide = ends & (i - state["run"] >= least_gap)
        cut = F.array(F.named_struct(F.lit("x_start"), state["left"], F.lit("x_end"), state["run"]))
        keep = wide & (state["run"] - state["left"] >= least_page)
        return F.named_struct(
            F.lit("run"), F.when(in_gap & (state["run"] < 0), i).when(in_gap, state["run"]).otherwise(F.lit(-1)),
            F.lit("left"), F.when(wide, i).otherwise(state["left"]),
            F.lit("pages"), F.when(keep, F.concat(state["pages"], cut)).otherwise(state["pages"]),
        )

    def finish(state: Column) -> Column:
        last = F.array(F.named_struct(F.lit("x_start"), state["left"], F.lit("x_end"), width))
        return F.when(width - state["left"] >= least_page, F.concat(state["pages"], last)).otherwise(state["pages"])

    indexed = F.transform(closed, lambda v, i: F.named_struct(F.lit("i"), i, F.lit("v"), v.cast("double")))
    return F.aggregate(indexed, start, step, finish)


def peaks(values: DataFrame, key: str, pos: str, value: str, *, reach: int = 2, spread: float = 0.1) -> DataFrame:
    """Local maxima: above mean + ``spread`` standard deviations, and nothing larger within ``reach`` positions."""
    whole = Window.partitionBy(key)
    near = whole.orderBy(pos).rowsBetween(-reach, reach)
    out = values.withColumns({"level": F.avg(value).over(whole) + spread * F.stddev_pop(value).over(whole), "top": F.max(value).over(near)})
    return out.where((F.col(value) > F.col("level")) & (F.col(value) == F.col("top"))).select(key, pos, value)


def merge_close(positions: Column, distance: int = 3) -> Column:
    """Of ascending positions, those farther than ``distance`` from the last one kept."""
    far = lambda kept, p: F.when((F.size(kept) == 0) | (p - F.element_at(kept, -1) > distance), F.concat(kept, F.array(p))).otherwise(kept)
    return F.aggregate(positions, F.array().cast("array<int>"), lambda kept, p: far(kept, p.cast("int")))


def valleys(values: DataFrame, key: str, pos: str, value: str, *, below: float = 0.3) -> DataFrame:
    """Strict local minima below a share of the mean."""
    whole = Window.partitionBy(key)
    w = whole.orderBy(pos)
    out = values.withColumns({"before": F.lag(value).over(w), "after": F.lead(value).over(w), "level": below * F.avg(value).over(whole)})
    return out.where((F.col(value) < F.col("before")) & (F.col(value) < F.col("after")) & (F.col(value) < F.col("level"))).select(key, pos, value)


def gaps(values: DataFrame, key: str, order: list[str], at: str) -> DataFrame:
    """Distance to the previous value in order."""
    return values.withColumn("gap", F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(*order)))


def greedy_batches(sizes: Column, *, most_items: int = 5, most_size: int = 100 * 1024 * 1024) -> Column:
    """Batch numbers for sizes in order: a new batch when the current one holds ``most_items`` or would exceed ``most_size``. One fold over a key's array."""
    start = F.named_struct(F.lit("batch"), F.lit(0), F.lit("n"), F.lit(0), F.lit("total"), F.lit(0).cast("bigint"), F.lit("out"), F.array().cast("array<int>"))

    def step(s: Column, size: Column) -> Column:
        full = (s["n"] > 0) & ((s["n"] >= most_items) | (s["total"] + size > most_size))
        batch = s["batch"] + F.when(full, 1).otherwise(0)
        return F.named_struct(
            F.lit("batch"), batch, F.lit("n"), F.when(full, 1).otherwise(s["n"] + 1), F.lit("total"), F.when(full, size).otherwise(s["total"] + size), F.lit("out"), F.concat(s["out"], F.array(batch))
        )

    return F.aggregate(F.transform(sizes, lambda x: F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint"))), start, step, lambda s: s["out"])


def line_groups(ys: Column, height: int = 15) -> Column:
    """Line numbers for ascending y positions: a new line when a position is ``height`` or more from the line's first."""
    start = F.named_struct(F.lit("line"), F.lit(-1), F.lit("first"), F.lit(0.0), F.lit("out"), F.array().cast("array<int>"))

    def step(s: Column, y: Column) -> Column:
        new = (s["line"] < 0) | (F.abs(y - s["first"]) >= height)
        line = s["line"] + F.when(new, 1).otherwise(0)
        return F.named_struct(F.lit("line"), line, F.lit("first"), F.when(new, y).otherwise(s["first"]), F.lit("out"), F.concat(s["out"], F.array(line)))

    return F.aggregate(F.transform(ys, lambda y: y.cast("double")), start, step, lambda s: s["out"])


def cluster_angles(angles: Column, width: float = 0.5) -> Column:
    """Group numbers for angles: each joins the first group whose first angle is within ``width``, else begins one."""
    start = F.named_struct(F.lit("seeds"), F.array().cast("array<double>"), F.lit("out"), F.array().cast("array<int>"))

    def step(s: Column, a: Column) -> Column:
        near = F.transform(s["seeds"], lambda seed: F.abs(seed - a) <= width)
        at = F.array_position(near, F.lit(True)).cast("int")
        seeds = F.when(at == 0, F.concat(s["seeds"], F.array(a))).otherwise(s["seeds"])
        return F.named_struct(F.lit("seeds"), seeds, F.lit("out"), F.concat(s["out"], F.array(F.when(at == 0, F.size(seeds) - 1).otherwise(at - 1))))

    return F.aggregate(F.transform(angles, lambda a: a.cast("double")), start, step, lambda s: s["out"])


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before it: one union and one window, no range join."""
    both = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")
