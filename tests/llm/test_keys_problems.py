"""Survivors, seen keys, components and batch repeats: edge cases, and results against plain Python."""

from dataclasses import replace
from datetime import datetime

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanloom.llm import components, queries_keys, runs, seen_keys, segments, survivors
from scanloom.operators import dedup


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


HASHES = "id long, duplicate_group_id string, file_size long, first_seen timestamp_ntz, last_seen timestamp_ntz, image_dimensions string, processing_status string"
G, H = "0123456789abcdef", "ffff456789abcdef"


def found(df):
    fields = survivors.scan_fields()
    return survivors.by_field(survivors.latest(df, survivors.scan_group(), F.col("id"), fields).where("records = 2"), fields)


def test_survivors_cases(spark):
    t = lambda y: datetime(y, 3, 1)
    data = [
        (2, G, 10, t(2024), t(2024), "10x10", "new"),
        (2, G, 10, t(2024), t(2024), "10x10", "new"),
        (1, G, 10, t(2019), None, "5x20", None),
        (3, G, 1 << 40, t(2023), t(2025), "(0, 500)", "duplicate"),
        (4, H, 10, t(2024), t(2024), "1x1", "new"),
        (5, "none", 10, t(2024), t(2024), "1x1", "new"),
        (6, "none", 10, t(2024), t(2024), "1x1", "new"),
        (None, G, 99, t(2021), t(2024), "9x999", "new"),
        (7, "0" * 16, -1, None, None, "unknown", None),
        (8, "0" * 16, None, t(9999), None, None, None),
    ]
    df = spark.createDataFrame(data, HASHES).withColumn("field_name", F.lit("clash"))
    assert rows(found(df), "group", "field_name", "id") == [(G, "file_size", 1), (G, "first_seen", 3), (G, "image_dimensions", 1)]
    assert found(df.limit(0)).count() == 0
    fused = {r.duplicate_group_id: r for r in survivors.survivors(spark, df).collect()}
    assert set(fused) == {G, "0" * 16} and fused[G].processing_status == "duplicate" and fused["0" * 16].file_size is None


def test_dates_come_before_the_learned_precedence(spark):
    groups = [f"{n:016x}" for n in range(20)]
    t = lambda d: datetime(2024, 1, d)
    # In most groups new is followed by pending and duplicate.
    data = [(10 * n + i, groups[n], t(d), v) for n in range(10) for i, (v, d) in enumerate((("new", 1), ("pending", 2), ("duplicate", 3)))]
    cases = {
        10: [("duplicate", 1), ("new", 2)],  # the dates contradict the majority
        11: [("new", 5), ("duplicate", None)],
        12: [("duplicate", 5), ("new", None)],
        13: [("new", 5), ("duplicate", 5)],
        14: [("new", None), ("duplicate", None), ("pending", None)],
        15: [("duplicate", 1), ("new", 2), ("duplicate", None)],
        16: [("new", 5), ("other", None), ("pending", None), ("new", None)],
        17: [("other", 5), ("duplicate", None)],
        18: [(None, 9), ("new", 5), ("new", 5), ("new", 4)],
    }
    data += [(10 * n + i, groups[n], d and t(d), v) for n, case in cases.items() for i, (v, d) in enumerate(case)]
    df = spark.createDataFrame([(i, g, 10, t(1), seen, "1x1", v) for i, g, seen, v in data], HASHES)
    got = {r.duplicate_group_id: (r.processing_status, r.processing_status_id % 10) for r in survivors.survivors(spark, df).collect()}
    assert all(got[groups[n]] == ("duplicate", 2) for n in range(10))
    assert {n: got[groups[n]] for n in cases} == {10: ("new", 1), 11: ("duplicate", 1), 12: ("duplicate", 0), 13: ("duplicate", 1), 14: ("duplicate", 1), 15: ("new", 1), 16: ("pending", 2), 17: ("other", 0), 18: ("new", 1)}


def test_p1_orders_constraints_and_what_it_learns(spark, tmp_path, monkeypatch):
    t = lambda d: datetime(2024, 1, d)
    # In most groups the smaller size, the earlier time and the larger dimensions come last.
    data = [(10 * n + i, f"{n:016x}", size, t(first), t(seen), dims, "new") for n in range(3) for i, (size, first, seen, dims) in enumerate(((90, 9, 1, "1x1"), (10, 2, 2, "9x9")))]
    data += [(101, G, 50, t(3), t(5), "5x5", "new"), (102, G, 70, t(8), t(4), "7x7", "new"), (103, G, 40, t(1), None, "4x4", "new"), (104, G, 60, t(4), None, "6x6", "new")]
    data += [(201, H, 0, None, t(5), "unknown", "new"), (202, H, 7, t(2), None, None, "new"), (203, H, 7, t(2), None, "0x3", "new")]
    spark.createDataFrame(data, HASHES).write.parquet(f"{tmp_path}/document_hashes.parquet")
    known, directions = [], survivors.directions
    monkeypatch.setattr(survivors, "directions", lambda *x: known.append([tuple(r) for r in x[1]]) or directions(*x))
    got = lambda: {(g, f): i for g, f, i in rows(queries_keys.p1_found(spark, str(tmp_path)), "duplicate_group_id", "field_name", "id")}
    bound = got()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW document_hashes AS FROM '{tmp_path}/document_hashes.parquet/*.parquet'")
        assert bound == {(g, f): i for g, f, i in db.sql(queries_keys.P1_SQL).fetchall()}
    assert {f: bound[G, f] for f in ("file_size", "first_seen", "image_dimensions")} == {"file_size": 102, "first_seen": 103, "image_dimensions": 102}
    assert known == [[("file_size", "worst", "best", 0, 4), ("first_seen", "worst", "best", 4, 0), ("image_dimensions", "worst", "best", 3, 1)]]
    fields = [replace(f, constraint=False) for f in survivors.scan_fields()]
    monkeypatch.setattr(survivors, "scan_fields", lambda: fields)
    free = got()
    # The latest dated record is 101; undated ones come after it if the learned direction goes from its value to theirs.
    assert {f: free[G, f] for f in ("file_size", "first_seen", "image_dimensions")} == {"file_size": 103, "first_seen": 103, "image_dimensions": 104}
    assert {f: i for (g, f), i in free.items() if g == H} == {"file_size": 202, "first_seen": 202}


def test_constraints_outrank_what_is_learned():
    larger, smaller = survivors.Ranked("a", None), survivors.Ranked("b", None, constraint=False)
    evidence = [("a", "worst", "best", 3, 900), ("b", "worst", "best", 3, 900)]
    assert survivors.directions([larger, smaller], evidence) == {"a": 1, "b": -1}
    assert survivors.directions([smaller], [("b", "worst", "best", 5, 5)]) == survivors.directions([smaller]) == {"b": 0}


def test_latest_is_the_end_of_the_partial_order(spark):
    import random

    random.seed(3)
    data = [(i, i % 40, random.choice([None, 1, 2, 3, 4, 5]), random.choice([None, None, *range(1, 8)])) for i in range(1, 200)]
    df = spark.createDataFrame(data, "id long, g int, v int, d int").withColumn("t", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, d)"))
    for least in (False, True):
        for constraint, later in ((True, 1), (False, 1), (False, -1), (False, 0)):
            way = -later if least else later
            expected = {}
            for g in range(40):
                mine = {v: [(d, i) for i, h, x, d in data if (h, x) == (g, v)] for v in range(1, 6)}
                last = {v: max((d, -i) for d, i in seen if d) if any(d for d, _ in seen) else None for v, seen in mine.items() if seen}
                first = {v: -last[v][1] if last[v] and not constraint else min(i for _, i in mine[v]) for v in last}
                dated = sorted((v for v in last if last[v]), key=lambda v: (last[v][0], way * v, -first[v]))
                order = {(a, b) for a in last for b in last if way * a < way * b and (constraint or not (last[a] or last[b]))}
                if not constraint:
                    order |= {*zip(dated, dated[1:], strict=False)}
                    order |= {(dated[-1], u) if way * u > way * dated[-1] else (u, dated[-1]) for u in last if dated and not last[u]}
                ends = [v for v in last if all(a != v for a, _ in order)]
                assert len(ends) == 1 or not last or not (way or dated)
                expected[g] = min((first[v] for v in ends), default=None)
            field = survivors.Ranked("best", F.col("v"), least, constraint)
            got = survivors.latest(df, F.col("g"), F.col("id"), [field], F.col("t"), {"best": later})
            assert {r.group: r.best for r in got.collect()} == expected, (least, constraint, later)


def test_precedence_is_learned(spark):
    data = [(g, v, datetime(2024, 1, d)) for g in range(4) for v, d in (("new", 1), ("pending", 2), ("duplicate", 3))] + [(9, "duplicate", datetime(2024, 1, 1)), (9, "new", datetime(2024, 1, 2)), (9, None, datetime(2024, 1, 2)), (9, "pending", None)]
    df = spark.createDataFrame(data, "g int, v string, t timestamp_ntz")
    learned = survivors.learn_precedence(df, F.col("g"), survivors.Learned("v", F.col("v"), F.col("t")))
    got = {(r.earlier, r.later): (r.support, r.against) for r in learned.collect()}
    assert got[("new", "duplicate")] == (4, 1) and got[("duplicate", "new")] == (1, 4) and got[("new", "pending")] == (4, 0)
    ranks = survivors.topological_ranks((a, b, *n) for (a, b), n in got.items())
    assert ranks["new"] < ranks["pending"] < ranks["duplicate"]


def test_cycles_break_at_the_weakest():
    ranks = survivors.topological_ranks([("a", "b", 9, 0), ("b", "c", 8, 0), ("c", "a", 2, 0)])
    assert ranks["a"] < ranks["b"] < ranks["c"]


def key(df):
    return seen_keys.keys_of(df, F.col("digest"), F.col("row"))


def test_seen_cases(spark):
    a, b, c = "aa" * 32, "bb" * 32, "cc" * 32
    arrivals = spark.createDataFrame([(5, a), (1, b), (2, None), (3, b), (4, c), (9, b)], "row long, digest string").withColumn("hash", F.lit("clash"))
    history = spark.createDataFrame([(a,), (a,), (None,)], "digest string").select(F.unhex("digest").alias("key"))
    assert rows(seen_keys.seen_before(history, key(arrivals), "t"), "row") == [(3,), (5,), (9,)]
    assert rows(seen_keys.seen_before(history.limit(0), key(arrivals), "t"), "row") == [(3,), (9,)]
    assert seen_keys.seen_before(history, key(arrivals.limit(0)), "t").count() == 0


def test_runs_compact_and_stay_exact(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(seen_keys, "HOT_ROWS", 5)
    known, expected, got, row = set(), set(), set(), 0
    for batch in range(5):
        data = []
        for i in range(30):
            row += 1
            k = 0 if i % 3 == 0 else (batch * 7 + i * i) % 40
            data.append((row, f"{k:064x}"))
            if k in known:
                expected.add(row)
            known.add(k)
        df = key(spark.createDataFrame(data, "row long, digest string"))
        # Each batch meets what the last one left in the folder, and nothing else.
        store = seen_keys.SeenKeys(spark, f"file://{tmp_path}/keys", fanout=2)
        monkeypatch.setattr(runs, "FENCED", 1_000 if batch % 2 else 3)
        store.append(df)
        with runs.sorted_scans(spark):
            found = store.probe(df)
            if not store.runs.hot_keys():
                assert found._jdf.queryExecution().executedPlan().toString().count("Sort ") <= len(store.runs.runs)
            got |= {r.row for r in found.collect()}
        levels = [r["level"] for r in store.runs.runs]
        store.runs.close()
    assert got == expected
    assert len(levels) < 5 and max(levels) >= 2
    assert len(list((tmp_path / "keys").glob("manifest-*"))) == 1 and len(list((tmp_path / "keys").glob("level-*"))) == len(levels)


def test_wrong_answers_are_counted(spark):
    data = [(i, f"{i * 7919:064x}") for i in range(1, 1500)] + [(2000 + i, f"{i * 7919:064x}") for i in range(1, 300)]
    history = spark.createDataFrame([(f"{i:064x}",) for i in range(100)], "digest string").select(F.unhex("digest").alias("key"))
    arrivals = key(spark.createDataFrame(data, "row long, digest string"))
    hashes = {r.row: r.h for r in arrivals.select("row", F.xxhash64("key").alias("h")).collect()}
    old = {r.h for r in history.select(F.xxhash64("key").alias("h")).collect()}
    for r in seen_keys.error_rate(history, arrivals, "t", (8, 16, 64)).collect():
        cut = lambda h, w=r.width: (h % 2**64) >> (64 - w)
        taken, keys, wrong = {cut(h) for h in old}, set(old), 0
        for row in sorted(hashes):
            wrong += cut(hashes[row]) in taken and hashes[row] not in keys
            taken.add(cut(hashes[row]))
            keys.add(hashes[row])
        assert (r.wrong, r.rows_with_key) == (wrong, len(data)) and (wrong == 0 if r.width == 64 else wrong > 0 or r.width == 16)


def test_segment_index_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "HOT_HASHES", 4)
    idents = lambda rows: spark.createDataFrame(rows, "hash long, digest binary, first long")
    for n in range(4):
        index = segments.SegmentIndex(spark, f"file://{tmp_path}/index", fanout=3)
        index.append(idents([(1 << (20 + 3 * n + i), None, 10 * n + i) for i in range(3)] + [(None, bytes([n]), 100 + n)]))
        index.runs.close()
    index = segments.SegmentIndex(spark, f"file://{tmp_path}/index")
    assert index.runs.hot_keys() and max(r["level"] for r in index.runs.runs) == 1
    with runs.sorted_scans(spark):
        probe = index.probe(idents([(0, None, 0), (0b1111 << 40, None, 0), (None, b"\x02", 0), (None, b"\x09", 0)]))
        assert rows(probe, "seen") == [(0,), (102,)]
        cold = index.probe(idents([(None, bytes([i % 250, i // 250]), i) for i in range(2_000)]))
        # One exchange and one sort a run for the probes, in both parts (hot or not); the runs that are not hot are only scanned.
        tree = cold._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "Bucketed: true" in tree
        assert cold.count() == 0
    index.runs.destroy()


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in list(parent))


def test_components_equal_union_find(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 10)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200), (300, 299), (299, 298), (298, 300)]
    df = spark.createDataFrame([*pairs, (None, 1), (1, None)], "a long, b long").withColumn("v", F.lit("clash"))
    assert rows(components.components(df), "group_id", "id") == union_find(pairs)
    assert components.components(df.limit(0)).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 25), st.integers(1, 25)), min_size=1, max_size=25))
def test_components_on_any_graph(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    assert rows(components.components(df), "group_id", "id") == union_find(pairs)


def test_scan_links_cases(spark):
    hashes = spark.createDataFrame([(1, "/srv/scanstore/a", G), (2, "/srv/scanstore/b", G), (3, "/srv/scanstore/c", "none"), (4, "/srv/scanstore/d", None), (4, "/srv/scanstore/d", None), (5, "/srv/scanstore/e", "none")], "id long, file_path string, duplicate_group_id string")
    matches = spark.createDataFrame(
        [("b", "./c", 85.0), ("c", "d", 84.99), ("d", "gone", 99.0), ("d", "e", 0.85), ("e", "a", 0.8499), ("a", "a", 100.0), (None, "a", 99.0), ("a", "d", None)], "left_path string, right_path string, similarity_score double"
    )
    assert rows(components.components(components.scan_links(hashes, matches)), "group_id", "id") == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)]


def test_segment_entries_share_one_within_errors(spark):
    import random

    random.seed(5)
    data = []
    for _ in range(60):
        x = random.getrandbits(64)
        y = x
        for bit in random.sample(range(64), random.randint(0, 3)):
            y ^= 1 << bit
        data.append((x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y))
    df = spark.createDataFrame(data, "x long, y long")
    assert df.where(F.arrays_overlap(dedup.segment_entries(F.col("x")), dedup.segment_entries(F.col("y")))).count() == 60
    assert sum(n for _, n in dedup.segment_bounds()) == 64


def test_repeats_equal_brute_force(spark):
    import random

    random.seed(11)
    base = [random.getrandbits(64) for _ in range(12)]
    data = []
    for i in range(120):
        p = random.choice(base)
        for bit in random.sample(range(64), random.randint(0, 5)):
            p ^= 1 << bit
        c = f"{random.randint(0, 60):064x}"
        data.append((i + 1, min(6, i // 18), random.choice([f"{p:x}", f"0x{p:016X}", None, "n/a"]), random.choice([c, "sha256:" + c, None, ""])))
    data.append(data[50])
    hex_of = lambda p: int(p, 16) if p and p != "n/a" else None
    digest_of = lambda c: c[-64:] if c else None
    expected = []
    for i, b, p, c in sorted(set(data)):
        if b >= 1:
            hits = [j for j, _, q, d in data if j < i and ((digest_of(c) and digest_of(c) == digest_of(d)) or (hex_of(p) is not None and hex_of(q) is not None and bin(hex_of(p) ^ hex_of(q)).count("1") <= 3))]
            if hits:
                expected.append((min(hits), i))
    df = spark.createDataFrame(data, "id long, batch_no int, perceptual_hash string, content_hash string").withColumn("entry", F.lit("clash"))
    assert rows(segments.repeats(df), "seen_id", "new_id") == sorted(expected)
    assert segments.repeats(df.limit(0)).count() == 0
    assert segments.repeats(df.where("batch_no = 0")).count() == 0
