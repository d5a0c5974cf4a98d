"""Small Parquet files copied, block by block, into fewer large ones without decoding.

The bytes of each column chunk are copied as they are; only the footer is written anew, with
the offsets moved. The footer's Thrift structures are read generically, so that fields this
module does not know survive. Page indexes and Bloom filters lie outside the chunks and are
left out, which readers allow. Each output is written by one task under a temporary name and then
renamed: a task that is run again after a loss writes the same file.

Checked for each output: all inputs have the same schema, its number of row groups and of rows is the sum
over its inputs, and its footer reads back.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"PAR1"
REPORT = "output string, files long, row_groups long, rows long, bytes long"

# Thrift compact protocol: type numbers of fields and list elements.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class Reader:
    """Reads a Thrift compact struct as {field id: (type, value)}; lists as (element type, values)."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        n = shift = 0
        while True:
            b = self.byte()
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int, *, element: bool = False):
        if kind in (TRUE, FALSE):
            return self.byte() == TRUE if element else kind == TRUE
        if kind == BYTE:
            return self.byte()
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            self.at += 8
            return self.data[self.at - 8 : self.at]
        if kind == BINARY:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (LIST, SET):
            head = self.byte()
            n, inner = head >> 4, head & 15
            n = self.varint() if n == 15 else n
            return inner, [self.value(inner, element=True) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            if not n:
                return 0, 0, []
            kinds = self.byte()
            return kinds >> 4, kinds & 15, [(self.value(kinds >> 4, element=True), self.value(kinds & 15, element=True)) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"unknown Thrift type {kind}")

    def struct(self) -> dict:
        out, field = {}, 0
        while head := self.byte():
            field = field + (head >> 4) if head >> 4 else self.zigzag()
            out[field] = (head & 15, self.value(head & 15))
        return out


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> bytes:
    return varint(n << 1 if n >= 0 else (-n << 1) - 1)


def write_value(kind: int, x, *, element: bool = False) -> bytes:
    if kind in (TRUE, FALSE):
        return bytes([TRUE if x else FALSE]) if element else b""
    if kind == BYTE:
        return bytes([x])
    if kind in (I16, I32, I64):
        return zigzag(x)
    if kind == DOUBLE:
        return x
    if kind == BINARY:
        return varint(len(x)) + x
    if kind in (LIST, SET):
        inner, items = x
        head = bytes([len(items) << 4 | inner]) if len(items) < 15 else bytes([0xF0 | inner]) + varint(len(items))
        return head + b"".join(write_value(inner, i, element=True) for i in items)
    if kind == MAP:
        a, b, items = x
        body = b"".join(write_value(a, k, element=True) + write_value(b, v, element=True) for k, v in items)
        return varint(len(items)) + (bytes([a << 4 | b]) + body if items else b"")
    return write_struct(x)


def write_struct(fields: dict) -> bytes:
    out, last = bytearray(), 0
    for field in sorted(fields):
        kind, x = fields[field]
        if kind in (TRUE, FALSE):
            kind = TRUE if x else FALSE
        out += bytes([(field - last) << 4 | kind]) if 0 < field - last < 16 else bytes([kind]) + zigzag(field)
        out += write_value(kind, x)
        last = field
    return bytes(out) + b"\0"


def read_footer(file: pa.NativeFile) -> dict:
    """The FileMetaData of an open Parquet file."""
    size = file.size()
    file.seek(size - 8)
    tail = file.read(8)
    if tail[4:] != MAGIC:
        raise ValueError("not a Parquet file")
    length = struct.unpack("<I", tail[:4])[0]
    file.seek(size - 8 - length)
    return Reader(file.read(length)).struct()


# Fields of FileMetaData: 2 schema, 3 rows, 4 row groups, 5 key-value metadata. Of RowGroup: 1 columns, 3 rows, 5 offset, 7 ordinal.
# Of ColumnChunk: 2 offset, 3 metadata, 4-7 page indexes. Of ColumnMetaData: 7 bytes, 9 data, 10 index and 11 dictionary page, 14-15 Bloom filter.


def _moved(group: dict, read, write, at: int, ordinal: int) -> tuple[dict, int]:
    """A row group whose chunks have been copied to ``at``, and where the next one goes."""
    group, chunks, first = dict(group), [], at
    for chunk in group[1][1][1]:
        meta = dict(chunk[3][1])
        start = min([meta[f][1] for f in (9, 11) if f in meta and meta[f][1] > 0], default=0)
        size = meta[7][1]
        write(read(start, size))
        for f in (9, 10, 11):
            if f in meta and meta[f][1] > 0:
                meta[f] = (meta[f][0], meta[f][1] - start + at)
        for f in (14, 15):
            meta.pop(f, None)
        chunk = {k: v for k, v in chunk.items() if k not in (4, 5, 6, 7)} | {2: (chunk[2][0], 0), 3: (STRUCT, meta)}
        chunks.append(chunk)
        at += size
    group[1] = (LIST, (STRUCT, chunks))
    if 5 in group:
        group[5] = (I64, first)
    if 7 in group:
        group.pop(7)
        if ordinal < 32_768:
            group[7] = (I16, ordinal)
    return group, at


def merge_files(paths: list[str], output: str) -> dict:
    """Copies the blocks of ``paths`` into ``output``; the counts of the report. ``output`` appears only when complete."""
    total = {"files": len(paths), "row_groups": 0, "rows": 0}
    fs, target = filesystem(output)
    fs.create_dir(posixpath.dirname(target), recursive=True)
    part, footer, groups, at = f"{target}.part", None, [], 4
    with fs.open_output_stream(part) as out:
        out.write(MAGIC)
        for path in paths:
            source_fs, source = filesystem(path)
            with source_fs.open_input_file(source) as file:
                own = read_footer(file)
                if footer is None:
                    footer = own
                elif own[2] != footer[2]:
                    raise ValueError(f"{path}: its schema differs from that of {paths[0]}")

                def read(start: int, size: int, file=file) -> bytes:
                    file.seek(start)
                    return file.read(size)

                for group in own[4][1][1]:
                    moved, at = _moved(group, read, out.write, at, len(groups))
                    groups.append(moved)
                total["rows"] += own[3][1]
                total["row_groups"] += len(own[4][1][1])
        footer = dict(footer) | {3: (I64, total["rows"]), 4: (LIST, (STRUCT, groups))}
        body = write_struct(footer)
        out.write(body + struct.pack("<I", len(body)) + MAGIC)
    with fs.open_input_file(part) as file:
        back = read_footer(file)
        total["bytes"] = file.size()
    counted = sum(g[3][1] for g in back[4][1][1])
    if (back[3][1], counted, len(back[4][1][1])) != (total["rows"], total["rows"], total["row_groups"]):
        raise ValueError(f"{output}: rows or row groups got lost")
    fs.move(part, target)
    return total


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URL, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def consolidate_parquet(spark: SparkSession, folder: str, output: str, *, target: int = 134_217_728) -> DataFrame:
    """The Parquet files in ``folder`` in files of about ``target`` bytes in ``output``; returns the report, computed eagerly.

    Files larger than ``target`` are copied too. The listing (path and length, no content) is dealt into as many
    parts as it has ``64 * target`` bytes, so that its running sums are parallel; a part's last file may be smaller.
    An empty folder gives an empty report.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length").where("length > 0")
    parts = int((listing.agg(F.sum("length")).first()[0] or 0) // (64 * target)) + 1
    by_path = Window.partitionBy("part").orderBy("path")
    files = listing.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))
    files = files.withColumn("bin", F.floor((F.sum("length").over(by_path) - F.col("length")) / target).cast("int"))
    bins = files.groupBy("part", "bin").agg(F.sort_array(F.collect_list("path")).alias("paths"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, number, paths in zip(frame["part"], frame["bin"], frame["paths"]):
                name = f"{output}/blocks-{part:05d}-{number:05d}.parquet"
                yield pd.DataFrame([{"output": name, **merge_files(list(paths), name)}])

    return spark.createDataFrame(bins.mapInPandas(run, REPORT).collect(), REPORT)
