"""Levelled runs of sorted rows in a shared folder: the store below seen keys and the segment index.

A run is an immutable Parquet table, bucketed and sorted by a 64-bit key, one file a bucket. A batch becomes a run of level 0; when a level has
``fanout`` runs, they are merged into one of the next level, so a row is rewritten a logarithmic number of times. A
probe is a merge join with each run, which is neither shuffled nor sorted again: only the batch is.

What runs there are is said by a manifest, a JSON file of its own for each state; a state is there when its manifest is. ``Runs`` opens
the last one that it finds in its folder, so a later session, or another one, goes on without the batches of before. Files of a
run that was merged away are removed after the next manifest is written. Two writers cannot both write the same manifest: the second one fails.

The minimum and maximum of each row group and page are a run's block fences. A batch of at most ``FENCED`` keys is pushed into the
scan, which then reads the blocks whose fences enclose one of them; a larger batch of hashed keys meets every block anyway.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FENCED = 1_000
HOT = 64
SALTS = 32
_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made and run within take the files' order from the table, so that no run is sorted again."""
    was = spark.conf.get(_SORTED, "false")
    spark.conf.set(_SORTED, "true")
    try:
        yield
    finally:
        spark.conf.set(_SORTED, was)


class Runs:
    """Runs of rows ``columns`` (DDL), by ``key`` (bigint). ``group`` and ``merged`` say how rows become one, ``hot_rows`` when a key is hot."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, key: str, group: list[str], merged: dict[str, str], *, fanout: int = 4, hot_rows: int = 20_000, weight: str = "1"):
        self.spark, self.folder, self.columns, self.key, self.group, self.merged = spark, folder.rstrip("/"), columns, key, group, merged
        self.fanout, self.hot_rows, self.weight = fanout, hot_rows, weight
        self.buckets, self.runs, self.number = int(spark.conf.get("spark.sql.shuffle.partitions")), [], 0
        self._open()

    # ---- the folder

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _open(self) -> None:
        fs, p = self._fs(self.folder)
        if not fs.exists(p):
            return
        names = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().startswith("manifest-"))
        if not names:
            return
        state = json.loads(self.spark.read.text(f"{self.folder}/{names[-1]}", wholetext=True).first()[0])
        self.buckets, self.number = state["buckets"], state["number"]
        for run in state["runs"]:
            table = f"run_{uuid.uuid4().hex[:16]}"
            self.spark.sql(f"CREATE TABLE {table} ({self.columns}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({', '.join(self.group)}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run['name']}'")
            self.runs.append(run | {"table": table})

    def _commit(self, gone: list[dict]) -> None:
        """The present runs as the next manifest; then the files of the ones that are gone."""
        self.number += 1
        kept = [{k: run[k] for k in ("name", "level", "hot")} for run in self.runs]
        fs, p = self._fs(f"{self.folder}/manifest-{self.number:08d}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"number": self.number, "buckets": self.buckets, "runs": kept}).encode()))
        out.close()
        for run in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {run['table']}")
            fs, p = self._fs(f"{self.folder}/{run['name']}")
            fs.delete(p, True)
        fs, p = self._fs(f"{self.folder}/manifest-{self.number - 1:08d}.json")
        fs.delete(p, False)

    def close(self) -> None:
        """Forgets the runs; their files stay. Results that read them must have been saved."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run['table']}")
        self.runs = []

    def destroy(self) -> None:
        """Forgets the runs and removes the folder."""
        self.close()
        fs, p = self._fs(self.folder)
        fs.delete(p, True)

    # ---- rows

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"level-{level}-{uuid.uuid4().hex[:12]}"
        table = f"run_{uuid.uuid4().hex[:16]}"
        placed = rows.select(*[c.split()[0] for c in self.columns.split(", ")]).repartition(self.buckets, self.key)
        placed.write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, self.key).sortBy(*self.group).saveAsTable(table)
        total = self.spark.table(table).agg(F.sum(F.expr(self.weight))).first()[0] or 0
        hot = []
        if total >= self.hot_rows:
            counts = self.spark.table(table).groupBy(self.key).agg(F.sum(F.expr(self.weight)).alias("n"))
            hot = counts.where(F.col("n") >= self.hot_rows).orderBy(F.desc("n")).limit(HOT).collect()
        self.runs.append({"name": name, "table": table, "level": level, "hot": [r[0] for r in hot]})

    def append(self, rows: DataFrame) -> None:
        """Adds rows (of ``columns``, already grouped) as a run of level 0, and merges what there is to merge."""
        with sorted_scans(self.spark):
            self._write(rows, 0)
            gone: list[dict] = []
            level = 0
            while any(r["level"] >= level for r in self.runs):
                own = [r for r in self.runs if r["level"] == level]
                if len(own) >= self.fanout:
                    self._write(self.merged_rows(own), level + 1)
                    self.runs = [r for r in self.runs if r not in own]
                    gone += own
                level += 1
            self._commit(gone)

    def merged_rows(self, runs: list[dict] | None = None) -> DataFrame:
        """The rows of several (default: all) runs, equal ones merged."""
        runs = self.runs if runs is None else runs
        df = self.spark.table(runs[0]["table"])
        for r in runs[1:]:
            df = df.unionByName(self.spark.table(r["table"]))
        return df.groupBy(*self.group).agg(*[F.expr(x).alias(c) for c, x in self.merged.items()])

    def hot_keys(self) -> list[int]:
        """At most ``HOT`` keys a run that hold ``hot_rows`` of its rows (by ``weight``)."""
        return sorted({k for r in self.runs for k in r["hot"]})

    def fenced(self, batch: DataFrame) -> list[int] | None:
        """The keys of a small batch, None for a larger one."""
        few = [r[0] for r in batch.select(self.key).distinct().limit(FENCED + 1).collect()]
        return few if len(few) <= FENCED else None

    def scans(self, within: list[int] | None = None) -> list[DataFrame]:
        """The runs as tables, of small batches only the blocks whose fences enclose one of the keys."""
        tables = [self.spark.table(r["table"]) for r in self.runs]
        if within is None:
            return tables
        if not within:
            return [t.limit(0) for t in tables]
        near = F.col(self.key).between(min(within), max(within)) & F.col(self.key).isin(within)
        return [t.where(near) for t in tables]
