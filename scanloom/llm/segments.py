"""New batches against all history: a segment index for exact digests and 64-bit hashes within a few bits.

A 64-bit hash is cut into ``SEGMENTS`` fixed segments. Of two hashes that differ in at most ``ERRORS``
bits, at least ``SEGMENTS - ERRORS`` segments agree at their positions (a bit string keeps its length and positions, so the substrings
to probe are those at the same place). The index stores for each hash one entry for each choice of that many segments; a probe
joins on the entry and verifies the distance. With 5 segments and 3 errors an entry has 25 or 26 bits, so that the chance
candidates of a probe stay few; digests are entries of their own kind, verified in full.

The index consists of the levelled runs of ``scanloom.llm.runs``, by entry. A batch is appended to it and probed against it: history is neither read again as a source,
nor shuffled, nor sorted. ``SegmentIndex`` opens what its folder holds, so the index outlives the session. Copies of a hash or digest count
once in it, with the smallest id that has it, and no pairs within them ever arise. Entries that very many hashes share (near-blank scans) are split over several tasks.

Defined cases: values without a digest and values that are no 64-bit hash match nothing; ids are in the order of the batches; repeated rows
count once; records without an id are left out; batches without records, and an empty table, give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.keys import digest, hash64
from scanloom.llm.runs import SALTS, Runs, sorted_scans
from scanloom.operators.dedup import ERRORS, segment_entries
from scanloom.plans.skew import salted_join
from scanloom.plans.workspace import Workspace

COLUMNS = "entry bigint, hash bigint, digest binary, first bigint"
HOT_HASHES = 20_000


class SegmentIndex:
    """An appendable index of idents: ``hash`` (bigint) or ``digest`` (binary), each with the smallest id that has it; in a folder that is kept."""

    def __init__(self, spark: SparkSession, folder: str, *, fanout: int = 4):
        self.runs = Runs(spark, folder, COLUMNS, "entry", ["entry", "hash", "digest"], {"first": "min(first)"}, fanout=fanout, hot_rows=HOT_HASHES)

    @staticmethod
    def entries(idents: DataFrame) -> DataFrame:
        """``idents`` (hash, digest, one of them null; and others) with their index entries exploded."""
        of_digest = F.array(F.xxhash64(F.lit("digest"), F.col("digest")))
        return idents.withColumn("entry", F.explode(F.when(F.col("hash").isNotNull(), segment_entries(F.col("hash"))).otherwise(of_digest)))

    def append(self, idents: DataFrame) -> None:
        """Adds idents (hash, digest, first), each once."""
        self.runs.append(self.entries(idents))

    def probe(self, idents: DataFrame, errors: int = ERRORS) -> DataFrame:
        """For each of the idents (hash, digest) that has a match: the least ``first`` among all matches, as ``seen``; use within ``sorted_scans``."""
        probes = self.entries(idents.select("hash", "digest"))
        hot = self.runs.hot_keys()
        is_hot = F.col("entry").isin(hot) if hot else F.lit(False)
        near = F.bit_count(F.col("p.hash").bitwiseXOR(F.col("r.hash"))) <= errors
        same = F.when(F.col("p.hash").isNotNull(), near).otherwise(F.col("p.digest") == F.col("r.digest"))
        found = None
        for run in self.runs.scans(self.runs.fenced(probes)):
            pairs = [(probes.where(~is_hot).alias("p"), run.where(~is_hot).alias("r"), F.col("p.entry") == F.col("r.entry"))]
            if hot:
                # The index's rows of a hot entry are dealt to the salts, the probes repeated for each.
                dealt = run.where(is_hot).withColumn("salt", F.pmod(F.xxhash64("hash", "digest"), F.lit(SALTS)).cast("int"))
                copies = probes.where(is_hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                pairs.append((copies.alias("p"), dealt.alias("r"), (F.col("p.entry") == F.col("r.entry")) & (F.col("p.salt") == F.col("r.salt"))))
            for p, r, on in pairs:
                part = p.join(r.hint("merge"), on & same).select("p.hash", "p.digest", "r.first")
                found = part if found is None else found.unionByName(part)
        if found is None:
            return idents.select("hash", "digest", F.lit(None).cast("bigint").alias("seen")).limit(0)
        return found.groupBy("hash", "digest").agg(F.min("first").alias("seen"))


def _idents(records: DataFrame) -> DataFrame:
    """Distinct idents of records (id, hash, digest) with the smallest id of each, combined before the shuffle."""
    one = F.explode(F.array(F.struct("hash", F.lit(None).cast("binary").alias("digest")), F.struct(F.lit(None).cast("bigint").alias("hash"), F.col("digest")))).alias("x")
    return records.select("id", one).select("id", "x.*").where("hash IS NOT NULL OR digest IS NOT NULL").groupBy("hash", "digest").agg(F.min("id").alias("first"))


def repeats(hashes: DataFrame, *, name: str = "segments") -> DataFrame:
    """Rows (seen_id, new_id): each record of a batch after the first that repeats an earlier record, and the smallest such id."""
    spark = hashes.sparkSession
    ws = Workspace(spark, name)
    records = ws.save(hashes.where("id IS NOT NULL").select("id", "batch_no", hash64("perceptual_hash").alias("hash"), F.unhex(digest("content_hash")).alias("digest")), "records")
    index, found = SegmentIndex(spark, ws.path("index")), None
    batches = sorted(r[0] for r in records.where("batch_no IS NOT NULL").select("batch_no").distinct().collect())
    for n in batches:
        batch = ws.save(_idents(records.where(F.col("batch_no") == n)), f"idents-{n}")
        index.append(batch)
        if n >= 1:
            with sorted_scans(spark):
                part = ws.save(index.probe(batch), f"seen-{n}")
            found = part if found is None else found.unionByName(part)
    index.runs.destroy()
    if found is None:
        return spark.createDataFrame([], "seen_id bigint, new_id bigint")
    new = records.where("batch_no >= 1").select("id", "hash", "digest")
    sides = []
    for kind in ("hash", "digest"):
        best = found.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.min("seen").alias("seen"))
        sides.append(salted_join(new.where(F.col(kind).isNotNull()).select("id", kind), best, kind).where("seen < id").select("id", "seen"))
    return sides[0].unionByName(sides[1]).groupBy("id").agg(F.min("seen").alias("seen_id")).select("seen_id", F.col("id").alias("new_id"))
