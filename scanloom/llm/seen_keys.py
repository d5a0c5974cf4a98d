"""Has this key been seen before? Log-structured sorted runs.

Keys lie in the levelled runs of ``scanloom.llm.runs``: sorted by a 64-bit hash of the key, with the full key, the
earliest row that had it and its number of rows. A probe is a merge join on the hash with each run, and every hit is verified by the full
key. Nothing but one block of a run and the sort buffer of a task is in memory, however many keys there are.

The store is durable: ``SeenKeys`` opens what its folder holds, and later batches are appended and probed without the
earlier ones. Rows of keys that hold a large share of a batch are spread over several tasks; the counts come with the runs.

Defined cases: rows without a key are no cases; the earliest row of a key not seen before is no case; row ids are unique;
of the run's entries for a key the earliest counts; empty runs and empty batches give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.runs import SALTS, Runs, sorted_scans
from scanloom.plans.workspace import Workspace

COLUMNS = "hash bigint, key binary, first bigint, n bigint"
BEFORE = -(2**63)
HOT_ROWS = 20_000
WIDTHS = (16, 24, 32, 48, 64)


class SeenKeys:
    """A set of keys in levelled, sorted, immutable runs, in a folder that is kept."""

    def __init__(self, spark: SparkSession, folder: str, *, fanout: int = 4):
        self.spark = spark
        self.runs = Runs(spark, folder, COLUMNS, "hash", ["hash", "key"], {"first": "min(first)", "n": "sum(n)"}, fanout=fanout, hot_rows=HOT_ROWS, weight="n")

    def append(self, keys: DataFrame) -> None:
        """Adds a batch (key binary, row bigint)."""
        hashed = keys.where("key IS NOT NULL").groupBy(F.xxhash64("key").alias("hash"), "key")
        self.runs.append(hashed.agg(F.min("row").alias("first"), F.count("*").alias("n")))

    def probe(self, rows: DataFrame, *, verify: bool = True) -> DataFrame:
        """The ``rows`` (key binary, row bigint, and others) whose key has an entry earlier than the row; use within ``sorted_scans``.

        Without ``verify`` a hit of the hash is believed; for the rate of wrong answers only.
        """
        hot = self.runs.hot_keys()
        hashed = rows.where("key IS NOT NULL").withColumn("hash", F.xxhash64("key"))
        is_hot = F.col("hash").isin(hot) if hot else F.lit(False)
        hashed = hashed.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
        hits = None
        for run in self.runs.scans(self.runs.fenced(hashed)):
            part = self._hits(hashed.where(~is_hot), run, verify, False)
            if hot:
                # The few entries of hot keys are repeated for each salt; the run itself stays where it is.
                copies = run.where(is_hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                part = part.unionByName(self._hits(hashed.where(is_hot), copies, verify, True))
            hits = part if hits is None else hits.unionByName(part)
        return hashed.limit(0).drop("hash", "salt") if hits is None else hits.drop("hash", "salt")

    @staticmethod
    def _hits(rows: DataFrame, run: DataFrame, verify: bool, salted: bool) -> DataFrame:
        on = (F.col("p.hash") == F.col("r.hash")) & (F.col("r.first") < F.col("p.row"))
        if salted:
            on = on & (F.col("p.salt") == F.col("r.salt"))
        if verify:
            on = on & (F.col("p.key") == F.col("r.key"))
        return rows.alias("p").join(run.hint("merge").alias("r"), on, "left_semi")

    def wrong_answers(self, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
        """Rows (width, wrong): how many rows of new keys a hash of ``width`` bits alone takes for seen.

        Only the first row of a key can be answered wrongly, namely if another key of the same hash came before it.
        """
        entries = self.runs.merged_rows().select("first", F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.shiftrightunsigned("hash", 64 - w).alias("cut")) for w in widths])).alias("x"))
        new = F.count_if(F.col("first") > BEFORE) - F.when(F.min("first") > BEFORE, 1).otherwise(0)
        return entries.groupBy("x.width", "x.cut").agg(new.alias("wrong")).groupBy("width").agg(F.sum("wrong").alias("wrong"))


def keys_of(df: DataFrame, digest: Column, row: Column) -> DataFrame:
    return df.select(F.unhex(digest).alias("key"), row.cast("bigint").alias("row")).where("key IS NOT NULL")


def _filled(history: DataFrame, arrivals: DataFrame, name: str, batches: int, probed: bool) -> tuple[SeenKeys, Workspace, DataFrame | None]:
    """A store of history and arrivals, the latter in ``batches`` ranges of row ids; with the rows found on the way, each batch probed after it was appended."""
    ws = Workspace(arrivals.sparkSession, name)
    store, found = SeenKeys(arrivals.sparkSession, ws.path("store"), fanout=batches + 1), None
    store.append(history.select("key", F.lit(BEFORE).cast("bigint").alias("row")))
    least, most = arrivals.agg(F.min("row"), F.max("row")).first()
    step = -(-(most - least + 1) // batches) if least is not None else 1
    for n in range(batches if least is not None else 0):
        batch = arrivals.where((F.col("row") >= least + n * step) & (F.col("row") < least + (n + 1) * step))
        store.append(batch)
        if probed:
            with sorted_scans(arrivals.sparkSession):
                part = ws.save(store.probe(batch).select("row").distinct(), f"found-{n}")
            found = part if found is None else found.unionByName(part)
    return store, ws, found


def seen_before(history: DataFrame, arrivals: DataFrame, name: str, *, batches: int = 2) -> DataFrame:
    """Rows (row) of ``arrivals`` (key, row) whose key is in ``history`` (key) or in an earlier row.

    The arrivals come in batches of ascending row ids; the last one brings the level to its fan-out, so the runs are merged before it is probed.
    """
    store, _, found = _filled(history, arrivals, name, batches, True)
    store.runs.destroy()
    return arrivals.select("row").limit(0) if found is None else found


def error_rate(history: DataFrame, arrivals: DataFrame, name: str, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Rows (width, rows_with_key, new_keys, wrong, wrong_share): the wrong answers of hashes alone, by their width in bits; verification averts all of them."""
    store, ws, _ = _filled(history, arrivals, name, 1, False)
    entries = store.runs.merged_rows().where(F.col("first") > BEFORE)
    totals = ws.save(entries.agg(F.count("*").alias("new_keys")), "totals").first()[0]
    asked = arrivals.count()
    spark = arrivals.sparkSession
    wrong = ws.save(store.wrong_answers(widths), "wrong")
    store.runs.destroy()
    given = spark.createDataFrame([(w,) for w in widths], "width int").join(F.broadcast(wrong), "width", "left")
    count = F.coalesce("wrong", F.lit(0)).cast("bigint")
    return given.select("width", F.lit(asked).cast("bigint").alias("rows_with_key"), F.lit(totals).cast("bigint").alias("new_keys"), count.alias("wrong"), (count / F.lit(max(asked, 1))).alias("wrong_share"))
