"""Pairwise matches consolidated into groups: connected components by Hash-to-Min.

The cluster of a vertex is a set of rows (v, u), never a collected list. In each round every
vertex sends its cluster to the least member and that member to all others; the rounds end when
the set of rows is stable, after a number logarithmic in the longest chain in practice. Clusters of a large share
of all rows are spread over several tasks. Each round is a table in the shared folder, so the
lineage stays short and a lost executor costs no more than the tasks it ran.

Defined cases: links with a null end and links of a vertex with itself are none; both directions of a link and repeated links
count once; vertices without links are in no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.keys import file_path
from scanloom.llm.survivors import scan_group
from scanloom.plans.skew import salted_join
from scanloom.plans.workspace import Workspace

HOT_ROWS = 20_000


def _state(clusters: DataFrame) -> tuple[int, int]:
    """Rows of a set and a sum over their hashes: equal for equal sets."""
    n, total = clusters.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return n, total


def components(links: DataFrame, *, name: str = "components", rounds: int = 60) -> DataFrame:
    """Rows (group_id, id) for links (a bigint, b bigint): group_id is the least id linked directly or indirectly."""
    ws = Workspace(links.sparkSession, name)
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x")).select("x.*")
    own = ends.select("v", F.col("v").alias("u"))
    clusters = ws.save(ends.unionByName(own).distinct(), "round-0")
    before = _state(clusters)
    for n in range(1, rounds + 1):
        least = ws.save(clusters.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), f"least-{n}")
        hot = [r[0] for r in least.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n")).limit(64).select("v").collect()]
        sent = salted_join(clusters, least.drop("n"), "v", "inner", hot=hot)
        pairs = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")
        after = ws.save(sent.select(pairs).select("x.*").distinct(), f"round-{n}")
        ws.drop(f"round-{n - 1}")
        ws.drop(f"least-{n}")
        now, clusters = _state(after), after
        if now == before:
            return clusters.groupBy("v").agg(F.min("u").alias("group_id")).select("group_id", F.col("v").alias("id"))
        before = now
    raise RuntimeError(f"not stable after {rounds} rounds")


def scan_links(hashes: DataFrame, matches: DataFrame, *, least_percent: float = 85.0) -> DataFrame:
    """Links (a, b) between records of document_hashes: a shared group id, or a match of at least ``least_percent``.

    Scores up to 1 are shares. A group becomes a star around its least id. Paths meet by what they resolve to; paths without record link nothing.
    """
    members = hashes.select(scan_group().alias("g"), F.col("id").alias("a")).where("g IS NOT NULL AND a IS NOT NULL")
    hubs = members.groupBy("g").agg(F.min("a").alias("b"))
    stars = salted_join(members, hubs, "g").select("a", "b")
    score = F.col("similarity_score")
    strong = F.when(score <= 1, score >= least_percent / 100).otherwise(score >= least_percent)
    pairs = matches.where(strong).select(file_path("left_path").alias("l"), file_path("right_path").alias("r")).where("l <> r")
    records = hashes.select(file_path("file_path").alias("path"), "id").where("path IS NOT NULL AND id IS NOT NULL").groupBy("path").agg(F.min("id").alias("id"))
    left = salted_join(pairs, records.select(F.col("path").alias("l"), F.col("id").alias("a")), "l")
    both = salted_join(left, records.select(F.col("path").alias("r"), F.col("id").alias("b")), "r")
    return stars.unionByName(both.select("a", "b"))
