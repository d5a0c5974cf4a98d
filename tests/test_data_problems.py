"""Consolidation, orphans and shredding: edge cases, and results against plain Python."""

import json
import posixpath
from datetime import datetime
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scanloom import queries_data as Q
from scanloom.operators.consolidate import consolidated_index, plan_bins, small_files, storage_paths
from scanloom.operators.orphans import Reference, find_orphans
from scanloom.operators.shred import adjacency, catalog_attributes, catalog_children, children
from scanloom.plans.skew import salted_join
from scanloom.sources.parquet_blocks import consolidate_parquet, merge_files, read_footer, write_struct


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---- orphans


def test_orphans_cases(spark):
    at = datetime(2024, 5, 1)
    parents = spark.createDataFrame([("AB-1", at, 1), ("AB-1", at, 1), ("CD", None, 2), (None, at, 3), ("", at, 4)], "id string, created_at timestamp_ntz, state int")
    children = spark.createDataFrame(
        [("1", "ab1", datetime(2024, 4, 1)), ("1", "ab1", datetime(2024, 4, 1)), ("2", "{ab-1}", datetime(2024, 6, 1)), ("3", "zz", None), ("4", None, at), ("5", " \t", at), ("6", "?", at), ("7", "cd", at), ("8", "AB1", None)],
        "key string, found string, parent_created timestamp_ntz",
    )
    ref = Reference("t", children, F.col("key"), F.col("found"), F.col("parent_created"))
    got = find_orphans([ref], parents, F.col("id"), F.col("created_at"))
    assert rows(got, "row_id", "state") == [("1", "early"), ("3", "missing"), ("6", "missing")]
    empty = find_orphans([ref], parents.limit(0), F.col("id"), F.col("created_at"))
    assert rows(empty, "row_id", "state") == [(x, "missing") for x in "123678"]
    none = find_orphans([Reference("t", children.limit(0), F.col("key"), F.col("found"), F.col("parent_created"))], parents, F.col("id"), F.col("created_at"))
    assert none.count() == 0


def test_salted_join_equals_plain(spark):
    probe = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), "id")
    build = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = salted_join(probe, build, "k", how, hot=[7]), probe.join(build, "k", how)
        assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count()


# ---- consolidation


def test_small_files_cases(spark):
    listing = spark.createDataFrame(
        [(5, "/srv/scanstore/a", 10), (3, "a", 10), (4, "/srv/scanstore/b", None), (6, "c", 0), (7, "d", 1_048_576), (8, "e", 1_048_575), (9, "x/../e", 1_048_575), (10, None, 5), (11, " ", 5), (12, "unnamed", 5)],
        "file_id long, path string, size_bytes long",
    ).withColumn("named", F.lit("clash"))
    refs = spark.createDataFrame([(p,) for p in ("a", "/srv/scanstore/./a", "b", "c", "d", "file:///srv/scanstore/e", None, "")], "path string")
    got = small_files(listing, [(refs, F.col("path"))])
    assert rows(got, "file_id", "size_bytes") == [(3, 10), (8, 1_048_575)]
    assert rows(consolidated_index(got, target=100), "file_id") == [(3,), (8,)]
    assert consolidated_index(got.limit(0)).count() == 0


def test_storage_paths_of_one_kind_are_all_named(spark):
    df = spark.createDataFrame([("a", '[{"kind":"processed","path":"/x"},{"kind":"processed","path":"/y"},{"kind":"k","path":null}]'), ("b", '{"root":"/r","paths":{"preview":"z"}}'), ("c", "[")], "id string, storage_paths string")
    assert rows(storage_paths(df), "path") == [("/x",), ("/y",), ("z",)]


def test_bins_hold_each_file_once(spark):
    files = spark.range(500).select(F.concat(F.lit("/f"), "id").alias("path"), F.col("id").alias("file_id"), (F.col("id") % 37 + 1).alias("size_bytes"))
    got = plan_bins(files, target=200, slices=3)
    assert got.select("file_id").distinct().count() == 500
    ends = got.groupBy("container").agg(F.max(F.col("offset") + F.col("size_bytes")).alias("end"), F.sum("size_bytes").alias("bytes"))
    assert ends.where("end <> bytes").count() == 0 and ends.agg(F.max("bytes")).first()[0] <= 200 + 37


def test_blocks_are_copied_exactly(tmp_path, spark):
    schema = pa.schema([("i", pa.int64()), ("s", pa.string()), ("l", pa.list_(pa.float64())), ("b", pa.bool_())])
    made = []
    for n, codec in enumerate(("snappy", "zstd", "gzip", "none")):
        t = pa.table({"i": range(n * 100, n * 100 + 100), "s": ["x" * (i % 7) if i % 5 else None for i in range(100)], "l": [[1.0] * (i % 3) for i in range(100)], "b": [True, None] * 50}, schema)
        pq.write_table(t, tmp_path / f"{n}.parquet", compression=codec, row_group_size=40)
        made.append(t)
    pq.write_table(schema.empty_table(), tmp_path / "9.parquet")
    files = [str(tmp_path / f"{n}.parquet") for n in (0, 1, 2, 3, 9)]
    out = str(tmp_path / "out" / "all.parquet")
    report = merge_files(files, out)
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in files)
    assert (report["rows"], report["row_groups"]) == (400, groups)
    assert pq.read_table(out).equals(pa.concat_tables(made))
    assert spark.read.parquet(out).agg(F.sum("i")).first()[0] == sum(range(400))
    with pa.OSFile(files[0]) as f:
        footer = read_footer(f)
        raw = write_struct(footer)
        f.seek(f.size() - 8 - len(raw))
        assert f.read(len(raw)) == raw
    pq.write_table(pa.table({"other": [1]}), tmp_path / "odd.parquet")
    with pytest.raises(ValueError):
        merge_files([files[0], str(tmp_path / "odd.parquet")], str(tmp_path / "bad.parquet"))
    assert not (tmp_path / "bad.parquet").exists()


def test_consolidation_keeps_rows(tmp_path, spark):
    spark.range(1000).repartition(20).write.parquet(str(tmp_path / "many"))
    report = consolidate_parquet(spark, str(tmp_path / "many"), str(tmp_path / "few"))
    assert report.count() == 1 and report.first()["rows"] == 1000
    assert rows(spark.read.parquet(str(tmp_path / "few")), "id") == [(i,) for i in range(1000)]


# ---- shredding


def plain_children(parent, steps, meta, paths, dims):
    """(parent, child, key) by direct recursion; no shared code."""

    def load(x):
        while isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                return x
        return x

    out = set()

    def listed(x):
        return x if isinstance(x, list) else [] if x is None else [x]

    def find(x, name):
        x = load(x)
        if isinstance(x, dict):
            for k, v in x.items():
                if k == name:
                    yield load(v)
                else:
                    yield from find(v, name)
        elif isinstance(x, list):
            for v in x:
                yield from find(v, name)

    def regions(x, prefix):
        for found in find(x, "regions"):
            for i, r in enumerate(listed(found)):
                r = load(r)
                if isinstance(r, dict):
                    out.add((parent, "region", f"{prefix}.{i}"))
                    regions(r, f"{prefix}.{i}")

    s = load(steps)
    s = load(s.get("steps", s)) if isinstance(s, dict) else s
    if isinstance(s, (list, dict)):
        for i, x in enumerate(listed(s)):
            if x is not None:
                out.add((parent, "step", str(i)))
    for tasks in find(meta, "tasks"):
        pairs = tasks.items() if isinstance(tasks, dict) and not isinstance(tasks.get("task_id"), str) else [(None, t) for t in listed(tasks)]
        for k, t in pairs:
            t = load(t)
            if isinstance(t, dict):
                key = t.get("task_id", k)
                out.add((parent, "task", key))
                regions(t, key)
    p = load(paths)
    p = load(p["paths"]) if isinstance(p, dict) and "paths" in p else p
    for k, v in (p.items() if isinstance(p, dict) and "path" not in p else [(None, e) for e in listed(p)] if isinstance(p, (dict, list)) else []):
        v = load(v)
        if isinstance(v, dict):
            if v.get("path") is not None:
                out.add((parent, "path", k or v["kind"]))
        elif v is not None:
            out.add((parent, "path", k))
    for b in find(dims, "boundaries"):
        for i, x in enumerate(listed(b)):
            if x is not None:
                out.add((parent, "boundary", str(i)))
    return out


def test_children_equal_plain_recursion(spark, folder):
    expected = set()
    for r in pq.read_table(f"{folder}/document_catalog.parquet").to_pylist():
        expected |= plain_children(r["id"], r["pipeline_applied"], r["processing_metadata"], r["storage_paths"], None)
    for r in pq.read_table(f"{folder}/document_pages.parquet").to_pylist():
        expected |= plain_children(r["id"], None, None, None, r["page_dimensions"])
    got = Q.p6_found(spark, folder).collect()
    assert len(got) == len(set(map(tuple, got))) and {(r.parent_id, r.child, r.child_key) for r in got} == expected


def test_shred_shapes(spark):
    cases = {
        "a": ('{"step":"skew","ms":5}', '{"tasks":{"color":{"regions":{"type":"stamp","regions":[null,{"type":"x"}]}},"skew":null}}', '{"kind":"processed","path":"/p"}'),
        "b": (json.dumps(json.dumps(["x", None, "y"])), '{"run":{"tasks":"[{\\"task_id\\":\\"t\\"}]"}}', '{"root":"/r","paths":{"a":null,"b":"q"}}'),
        "c": ('["x', "", "null"),
        "d": (None, "[]", '[{"kind":"k","path":null},null,{"kind":"m","path":"z"}]'),
        "e": ("[" * 3000 + "]" * 3000, "{}", '"plain"'),
    }
    df = spark.createDataFrame([(k, *v, "clash") for k, v in cases.items()], "id string, pipeline_applied string, processing_metadata string, storage_paths string, child string")
    pages = spark.createDataFrame([("p", '{"size":{"boundaries":[[0,9],null,{"x_start":3,"x_end":4}]}}'), ("q", '{"boundaries":{"x_start":1,"x_end":2}}'), (None, '{"boundaries":[1]}'), ("r", '"{\\"boundaries\\":[[1,2]]}"')], "id string, page_dimensions string")
    got = rows(catalog_children(df, pages), "parent_id", "child", "child_key")
    assert [g for g in got if g[0] != "e"] == sorted(
        [("a", "step", "0"), ("a", "task", "color"), ("a", "region", "color.0"), ("a", "region", "color.0.1"), ("a", "path", "processed"), ("b", "step", "0"), ("b", "step", "2"), ("b", "task", "t"), ("b", "path", "b"), ("d", "path", "m")]
        + [("p", "boundary", "0"), ("p", "boundary", "2"), ("q", "boundary", "0"), ("r", "boundary", "0")]
    )
    flat = {(r.parent_id, r.child_key): r for r in catalog_children(df, pages).where("child = 'boundary'").collect()}
    assert (flat["p", "0"].x_start, flat["p", "2"].x_end, flat["q", "0"].x_end) == (0, 4, 2)
    assert children(adjacency(df.limit(0), "id", {"pipeline_applied": "steps"})).count() == 0


def test_every_scalar_of_a_child_is_kept(spark):
    meta = {
        "tasks": [
            {"task_id": "t", "status": "completed", "seconds": 2.5, "params": {"dpi": 200, "limits": {"low": 5}, "status": "deep"}, "result": "{\"note\": \"n\"}", "regions": [{"type": "x", "area": 1.5, "bbox": [7, 8]}, "loose", {"bbox": {"x": None, "a.b": True}}]},
        ],
        "engine": {"version": "1"},
    }
    row = ("a", '[{"step":"skew","ms":7294,"opts":{"retry":1}},"plain"]', json.dumps(meta), '{"kind":"k","path":"/p","size":{"w":3}}')
    df = spark.createDataFrame([row, row], "id string, pipeline_applied string, processing_metadata string, storage_paths string")
    pages = spark.createDataFrame([("p", '{"dpi":3,"boundaries":[[0,9],{"x_start":1,"x_end":2,"by":["e"]}]}')], "id string, page_dimensions string")
    flat = {(r.child, r.child_key): r for r in catalog_children(df, pages).collect()}
    assert (flat["step", "0"].seconds, flat["task", "t"].seconds, flat["task", "t"].status) == (7.294, 2.5, "completed")
    got = catalog_attributes(df, pages).collect()
    expected = {
        ("step", "0"): {"step": "skew", "ms": "7294", "opts.retry": "1"},
        ("step", "1"): {"": "plain"},
        ("task", "t"): {"task_id": "t", "status": "completed", "seconds": "2.5", "params.dpi": "200", "params.limits.low": "5", "params.status": "deep", "result.note": "n", "regions.1": "loose"},
        ("region", "t.0"): {"type": "x", "area": "1.5", "bbox.0": "7", "bbox.1": "8"},
        ("region", "t.2"): {"bbox.x": None, "bbox.a\\.b": "true"},
        ("path", "k"): {"kind": "k", "path": "/p", "size.w": "3"},
        ("boundary", "0"): {"0": "0", "1": "9"},
        ("boundary", "1"): {"x_start": "1", "x_end": "2", "by.0": "e"},
    }
    assert sorted((r.child, r.child_key, r.path, str(r.value)) for r in got) == sorted((*k, p, str(v)) for k, x in expected.items() for p, v in x.items())
    whole = adjacency(df, "id", {"pipeline_applied": "steps"}).unionByName(adjacency(pages, "id", {"page_dimensions": "boundaries"}))
    assert rows(children(whole), "child", "child_key") == [("boundary", "0"), ("boundary", "1"), ("step", "0"), ("step", "1")]


def test_adjacency_keeps_every_node(spark):
    text = '{"a":[1,{"b":null}],"c":"{\\"d\\":true}"}'
    df = spark.createDataFrame([("k", text)], "id string, j string")
    got = rows(adjacency(df, "id", {"j": "tasks"}), "node", "parent", "label", "kind")
    assert [(n, p, k) for n, p, _, k in got] == [(0, -1, "object"), (1, 0, "list"), (2, 1, "number"), (3, 1, "object"), (4, 3, "null"), (5, 0, "object"), (6, 5, "boolean")]


# ---- the queries against plain Python


def resolve(path):
    path = path.strip()
    if not path:
        return None
    path = path.replace("\\", "/")
    if path.lower().startswith("file:"):
        path = unquote(path[7:])
    path = posixpath.normpath(posixpath.join("/srv/scanstore", path))
    return "/" + path.lstrip("/")


def test_p3_equals_plain(spark, folder):
    named = set()
    for r in pq.read_table(f"{folder}/document_pages.parquet").to_pylist():
        named |= {resolve(p) for p in (r["original_image_path"], r["processed_image_path"]) if p}

    def strings(x):
        if isinstance(x, str):
            try:
                yield from strings(json.loads(x))
            except ValueError:
                yield x
        elif isinstance(x, dict):
            for v in x.values():
                yield from strings(v)
        elif isinstance(x, list):
            for v in x:
                yield from strings(v)

    for r in pq.read_table(f"{folder}/document_catalog.parquet").to_pylist():
        try:
            named |= {resolve(p) for p in strings(json.loads(r["storage_paths"] or "null")) if "/" in p or "\\" in p}
        except ValueError:
            pass
    files = {}
    for r in pq.read_table(f"{folder}/stored_files.parquet").to_pylist():
        if r["path"]:
            files.setdefault(resolve(r["path"]), []).append((r["file_id"], r["size_bytes"]))
    expected = sorted((min(i for i, _ in v),) for p, v in files.items() if p in named and any(s is not None and 0 < s < 1_048_576 for _, s in v))
    assert rows(Q.p3_found(spark, folder), "file_id") == expected


# ---- filters and containers at scale


def test_filters_are_split(spark, monkeypatch):
    from scanloom.operators import orphans
    from scanloom.plans.workspace import Workspace

    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    others = spark.range(10_000, 15_000).select(F.xxhash64("id").alias("k"))
    ws = Workspace(spark, "filters")
    for most in (None, 1000):
        test = orphans.saved_filter(ws, keys, F.col("k"), 5000, most_items=most)
        assert keys.where(test(F.col("k"))).count() == 5000
        assert others.where(test(F.col("k"))).count() < 100
    assert keys.where(orphans.saved_filter(ws, keys.limit(0), F.col("k"), 0)(F.col("k"))).count() == 0


def test_containers_are_full_but_the_last(spark):
    files = spark.range(3000).select(F.col("id").alias("file_id"), F.col("id").cast("string").alias("path"), (F.col("id") % 100 + 1).alias("size_bytes"))
    for target, slices in ((10_000, 1), (1_000, 3)):
        sizes = sorted(r[1] for r in plan_bins(files, target=target).groupBy("container").agg(F.sum("size_bytes")).collect())
        assert sum(sizes) == 151_500 and all(abs(n - target) <= 100 for n in sizes[slices:])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from scanloom.plans.workspace import shared_folder

    given = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=given, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: given, applicationId="a"))
    with pytest.raises(ValueError):
        shared_folder(cluster)
