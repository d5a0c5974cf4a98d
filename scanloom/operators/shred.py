"""Deeply nested JSON of varying shape, shredded into an adjacency table and flat tables of child objects and of their scalars.

``adjacency`` stores one row a node: the row it belongs to, the column, the node's number
(in the order written), its parent's number, label (field name), ordinal (position in a
list), kind and scalar; nodes that are a child object, and all scalars below one down to
the next child, also name that child, its key and their path from there. ``children`` joins the object nodes with the
scalars whose parent they are and pivots those that children have in common. ``attributes`` is the table linked to it that has every scalar of every child.

A path names fields and positions from the child down, joined by dots (``params.limits.low``, ``bbox.0``); it is empty for the
child itself. Dots and backslashes in a field's name are written after a backslash.

What counts as a child, per layout of a column:

``steps``: entries of the list itself or of a field ``steps``; key: position.
``tasks``: entries of a field ``tasks`` (a list, or an object by task id); key: the field
    ``task_id``, else the field name. Objects under ``regions`` at any depth of a task are
    regions; key: task id and positions joined by dots, a region inside another going on.
``paths``: entries of the list or object itself or of a field ``paths``; key: ``kind`` or field name.
``boundaries``: entries of a field ``boundaries`` at any depth; key: position.

Defined cases: null, blank and invalid JSON have no nodes; text that itself holds JSON
stands for that JSON, however often it is wrapped; null entries count for positions but
are no children, and so does a path entry whose path is null; a single object in place of a list has
position 0; a task without any id and rows without a key have no children; of values that share
a key within one row, the greatest wins in ``children`` and all are in ``attributes``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADJACENCY = "parent_id string, source string, node int, parent int, label string, ordinal int, kind string, scalar string, child string, child_key string, path string"
_NAMES = [x.split()[0] for x in ADJACENCY.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32()}[x.split()[1]] for x in ADJACENCY.split(", ")]

#: The shapes of the catalogue's JSON columns.
CATALOG_LAYOUT = {"pipeline_applied": "steps", "processing_metadata": "tasks", "storage_paths": "paths"}
PAGE_LAYOUT = {"page_dimensions": "boundaries"}


def _reject(_: str):
    raise ValueError("not JSON")


def unwrap(value):
    """What a string that holds a JSON object, list or string stands for; anything else as it is."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        try:
            value = json.loads(value, parse_constant=_reject)
        except (ValueError, RecursionError):
            break
    return value


def parse(text: str | None):
    """(value, True) of a JSON text, unwrapped; (None, False) for null and for text that is no JSON."""
    if not text:
        return None, False
    try:
        return unwrap(json.loads(text, parse_constant=_reject)), True
    except (ValueError, RecursionError):
        return None, False


def _entries(layout: str, value):
    """(key, value, label, ordinal) of the entries of a container, key None for no child; whether it is one object in place of a list."""
    if isinstance(value, dict):
        single = {"steps": True, "boundaries": True, "tasks": isinstance(value.get("task_id"), (str, int)), "paths": "kind" in value and "path" in value}[layout]
        if not single:
            return [(_key(layout, k, None, unwrap(v)), unwrap(v), k, None) for k, v in value.items()], False
        return [(_key(layout, None, 0, value), value, None, None)], True
    if isinstance(value, list):
        return [(_key(layout, None, i, unwrap(v)), unwrap(v), None, i) for i, v in enumerate(value)], False
    return [], False


def _key(layout: str, field: str | None, position: int | None, value) -> str | None:
    if value is None:
        return None
    if layout in ("steps", "boundaries"):
        return str(position)
    if layout == "tasks":
        if not isinstance(value, dict):
            return None
        own = value.get("task_id")
        return str(own) if isinstance(own, (str, int)) and own != "" else field
    if isinstance(value, dict):
        own = value.get("kind") if field is None else field
        return str(own) if own is not None and ("path" not in value or value["path"] is not None) else None
    return field


CHILD = {"steps": "step", "tasks": "task", "paths": "path", "boundaries": "boundary"}


def shred(layout: str, root, emit) -> None:
    """Calls emit(node, parent, label, ordinal, kind, scalar, child, child_key, path) for each node of ``root``."""
    count = 0

    def add(value, parent, label, ordinal, child, key, path) -> int:
        nonlocal count
        if isinstance(value, dict):
            kind, scalar = "object", None
        elif isinstance(value, list):
            kind, scalar = "list", None
        elif isinstance(value, str):
            kind, scalar = "string", value
        elif value is None:
            kind, scalar = "null", None
        else:
            kind, scalar = ("boolean" if isinstance(value, bool) else "number"), json.dumps(value)
        emit(count, parent, label, ordinal, kind, scalar, child, key, path)
        count += 1
        return count - 1

    # what: "look" for the container, "within" a child that may hold regions, or None. child, key, path: the child above and the way from it. A stack, so that depth is no limit.
    container = root
    if isinstance(root, dict):
        field = {"steps": "steps", "tasks": "tasks", "paths": "paths", "boundaries": "boundaries"}[layout]
        if layout in ("tasks", "boundaries") or field in root:
            container = None
    elif layout == "boundaries":
        container = None
    todo = [(root, -1, None, None, "container" if container is not None else "look", None, None, None)]
    while todo:
        value, parent, label, ordinal, what, child, key, path = todo.pop()
        value = unwrap(value)
        scalar = not isinstance(value, (dict, list))
        shown = (child, key, path) if scalar or what in ("child", "region") else (None, None, None)
        if what == "container":
            entries, single = _entries(layout, value)
            me = parent if single else add(value, parent, label, ordinal, None, None, None)
            inner = [(v, me, k, i, *(("child", CHILD[layout], c, "") if c is not None else (None, None, None, None))) for c, v, k, i in entries]
        elif what == "regions":
            listed = value if isinstance(value, list) else [value]
            me = add(value, parent, label, ordinal, None, None, None) if isinstance(value, list) else parent
            inner = []
            for i, v in enumerate(map(unwrap, listed)):
                if isinstance(v, dict):
                    inner.append((v, me, None, i, "region", "region", f"{key}.{i}", ""))
                else:
                    inner.append((v, me, None, i, None, child, key, _below(path, i) if isinstance(value, list) else path))
        else:
            me = add(value, parent, label, ordinal, *shown)
            inner = []
            inside = "within" if layout == "tasks" and what in ("child", "region", "within") else None
            if isinstance(value, dict):
                for k, v in value.items():
                    if what == "look":
                        inner.append((v, me, k, None, "container" if k == layout else "look", None, None, None))
                    else:
                        inner.append((v, me, k, None, "regions" if inside and k == "regions" else inside, child, key, _below(path, k)))
            elif isinstance(value, list):
                for i, v in enumerate(value):
                    inner.append((v, me, None, i, "look" if what == "look" else inside, child, key, _below(path, i)))
        todo.extend(reversed(inner))


def _below(path: str | None, step: str | int) -> str | None:
    """The path one field or position further down; None outside children."""
    if path is None:
        return None
    if isinstance(step, str):
        step = step.replace("\\", "\\\\").replace(".", "\\.") or "\\"
    return f"{path}.{step}" if path else str(step)


def adjacency(df: DataFrame, key: str, layouts: dict[str, str], *, children_only: bool = False, scalars_only: bool = False) -> DataFrame:
    """The adjacency table of the JSON columns in ``layouts``; with ``children_only`` of the children and the scalars right below them only, with ``scalars_only`` of all scalars of children only."""
    some = children_only or scalars_only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            keys = batch.column(0).to_pylist()
            for i, (name, layout) in enumerate(layouts.items()):
                for row, text in zip(keys, batch.column(i + 1).to_pylist()):
                    if row is None or text is None or (some and layout == "boundaries" and "boundaries" not in text and "\\u" not in text):
                        continue
                    value, ok = parse(text)
                    if ok and children_only:
                        shred(layout, value, lambda *x, r=row, n=name: rows.append((r, n, *x)) if x[6] is not None and "." not in x[8] else None)
                    elif ok and scalars_only:
                        shred(layout, value, lambda *x, r=row, n=name: rows.append((r, n, *x)) if x[6] is not None and x[4] not in ("object", "list") else None)
                    elif ok:
                        shred(layout, value, lambda *x, r=row, n=name: rows.append((r, n, *x)))
            fields = list(zip(*rows)) if rows else [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(fields, _TYPES)], names=_NAMES)

    return df.select(F.col(key).cast("string"), *layouts).mapInArrow(run, ADJACENCY)


def _pick(condition: Column) -> Column:
    return F.max(F.when(condition, F.col("scalar")))


PIVOTED = ("name", "status", "seconds", "type", "confidence", "path", "x_start", "x_end")


def children(nodes: DataFrame) -> DataFrame:
    """One row a child object: parent_id, child, child_key, name, status, seconds, type, confidence, path, x_start, x_end.

    A node of a child object and the scalars whose ``parent`` it is meet under its number; the scalars become columns. Both sides of this
    join come from one table and are combined before the shuffle, so that it is a grouping by (row, column, number). A second one makes equal children one.
    """
    label, ordinal, head = F.col("label"), F.col("ordinal"), F.col("path") == ""
    own = F.col("kind").isin("string", "number", "boolean")
    joined = (
        nodes.where("child IS NOT NULL AND NOT contains(path, '.')")
        .groupBy("parent_id", "source", F.when(head, F.col("node")).otherwise(F.col("parent")).alias("owner"))
        .agg(
            F.max(F.when(head, F.struct("child", "child_key"))).alias("object"),
            _pick(own & ((label == "step") | (label.isNull() & (F.col("child") == "step")) | label.isin("task_id", "kind"))).alias("name"),
            _pick(label == "status").alias("status"),
            F.coalesce(_pick(label == "seconds").cast("double"), _pick(label == "ms").cast("double") / 1000).alias("seconds"),
            _pick(label == "type").alias("type"),
            _pick(label == "confidence").cast("double").alias("confidence"),
            _pick(own & (F.col("child") == "path") & ((label == "path") | (label == F.col("child_key")))).alias("path"),
            _pick((F.col("child") == "boundary") & ((label == "x_start") | (label.isNull() & own & (ordinal == 0)))).cast("double").alias("x_start"),
            _pick((F.col("child") == "boundary") & ((label == "x_end") | (label.isNull() & own & (ordinal == 1)))).cast("double").alias("x_end"),
        )
    )
    found = joined.where("object IS NOT NULL").select("parent_id", "object.*", *PIVOTED)
    return found.groupBy("parent_id", "child", "child_key").agg(*[F.max(c).alias(c) for c in PIVOTED])


def attributes(nodes: DataFrame) -> DataFrame:
    """One row a scalar of a child object: parent_id, child, child_key, path, kind, value; those of ``children``'s columns too, as written."""
    scalars = nodes.where("child IS NOT NULL AND kind NOT IN ('object', 'list')")
    return scalars.select("parent_id", "child", "child_key", "path", "kind", F.col("scalar").alias("value")).distinct()


def catalog_children(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """The flat table of all children of the catalogue and its pages."""
    nodes = adjacency(catalog, "id", CATALOG_LAYOUT, children_only=True).unionByName(adjacency(pages, "id", PAGE_LAYOUT, children_only=True))
    return children(nodes)


def catalog_attributes(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """The flat table of all scalars of the children of the catalogue and its pages."""
    return attributes(adjacency(catalog, "id", CATALOG_LAYOUT, scalars_only=True).unionByName(adjacency(pages, "id", PAGE_LAYOUT, scalars_only=True)))
