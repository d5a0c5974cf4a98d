"""Files in and out: listings, ingestion against the index, image and sidecar writers, bundles, reports."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.sources.parquet_blocks import filesystem

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tiff", "tif")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def kind(path: Column) -> Column:
    """'image' or 'pdf' by suffix, null for anything else."""
    s = suffix(path)
    return F.when(s.isin(*IMAGE_SUFFIXES), "image").when(s == "pdf", "pdf")


def list_files(spark: SparkSession, folder: str, *, content: bool = False) -> DataFrame:
    """Images and PDFs in a folder (not below it): path, kind, length, modified; with their bytes if wanted. Without, no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    cols = ["path", kind(F.col("path")).alias("kind"), "length", F.col("modificationTime").alias("modified")]
    return files.select(*cols, *(["content"] if content else [])).where("kind IS NOT NULL")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images with their pixels (struct ``image``); unreadable ones have none."""
    return spark.read.format("image").option("dropInvalid", "false").load(folder)


def expand_pdfs(files: DataFrame, rasterise) -> DataFrame:
    """One row a PDF page: path, page_number, content. ``rasterise(bytes)`` yields the pages' encoded images; it is the caller's, as no PDF library is assumed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                for i, page in enumerate(rasterise(bytes(content)), 1):
                    yield pd.DataFrame([{"path": path, "page_number": i, "content": page}])

    return files.where("kind = 'pdf'").select("path", "content").mapInPandas(run, "path string, page_number int, content binary")


def pdf_images(files: DataFrame, rasterise) -> DataFrame:
    """One row a PDF page: path (with '#' and its number) and image. ``rasterise(bytes)`` yields the pages as BGR arrays; a PDF that it cannot read gives one row without pixels."""
    from scanloom.operators.pages import IMAGE, to_image

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    for i, page in enumerate(rasterise(bytes(content)), 1):
                        yield pd.DataFrame([{"path": f"{path}#{i}", "image": to_image(page, path)}])
                except Exception as broken:  # the caller's library may raise anything
                    yield pd.DataFrame([{"path": path, "image": {"origin": f"{path}: {broken}", "height": -1, "width": -1, "nChannels": -1, "mode": -1, "data": b""}}])

    struct = ", ".join(":".join(x.split(" ", 1)) for x in IMAGE.split(", "))
    return files.where("kind = 'pdf'").select("path", "content").mapInPandas(run, f"path string, image struct<{struct}>")


def new_files(files: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(todo, skipped): files (with content) whose SHA-256 is not, or is, in the index (page_hash)."""
    hashed = files.withColumn("page_hash", F.sha2("content", 256))
    known = index.select("page_hash").where("page_hash IS NOT NULL").distinct()
    return hashed.join(known, "page_hash", "left_anti"), hashed.join(known, "page_hash", "left_semi")


# ---- images


def encode_png(page: np.ndarray, level: int = 6) -> bytes:
    """A PNG of a gray or BGR page."""
    rows = page[..., None] if page.ndim == 2 else page[..., ::-1]
    h, w, n = rows.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rows).reshape(h, w * n)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def encode_tiff(page: np.ndarray, dpi: int = 250) -> bytes:
    """A TIFF of a gray or BGR page, deflated."""
    rows = np.ascontiguousarray(page[..., None] if page.ndim == 2 else page[..., ::-1])
    h, w, n = rows.shape
    data = zlib.compress(rows.tobytes(), 6)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (259, 3, 1, 8), (262, 3, 1, 1 if n == 1 else 2), (277, 3, 1, n), (278, 4, 1, h), (279, 4, 1, len(data)), (296, 3, 1, 2)]
    extra = 8 + 2 + 12 * (len(tags) + 3) + 4
    # Behind the tags: the resolution, the bits of three channels, the pixels.
    tags = [(t, k, n, extra + 8) if t == 258 and n == 3 else (t, k, c, v) for t, k, c, v in tags]
    tags += [(273, 4, 1, extra + 14), (282, 5, 1, extra), (283, 5, 1, extra)]
    body = struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + struct.pack("<I", 0)
    return body + struct.pack("<IIHHH", dpi, 1, 8, 8, 8) + data


def encode_pdf(page: np.ndarray, title: str = "", *, width: float = 612.0, height: float = 792.0, share: float = 0.9) -> bytes:
    """A PDF of one letter page with the image on it, scaled to the share of the page and centred; pixels are deflated, not lossy."""
    rows = np.ascontiguousarray(page[..., None] if page.ndim == 2 else page[..., ::-1])
    h, w, n = rows.shape
    k = min(width / w, height / h) * share
    draw = f"q {w * k:.4f} 0 0 {h * k:.4f} {(width - w * k) / 2:.4f} {(height - h * k) / 2:.4f} cm /I Do Q".encode()
    text = "".join(f"\\{c}" if c in "()\\" else c for c in title).encode("latin-1", "replace")
    pixels = zlib.compress(rows.tobytes(), 6)
    stream = lambda head, data: b"<< " + head + b" /Length " + str(len(data)).encode() + b" >>\nstream\n" + data + b"\nendstream"
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:g} {height:g}] /Resources << /XObject << /I 4 0 R >> >> /Contents 5 0 R >>".encode(),
        stream(f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /{'DeviceGray' if n == 1 else 'DeviceRGB'} /BitsPerComponent 8 /Filter /FlateDecode".encode(), pixels),
        stream(b"", draw),
        b"<< /Title (" + text + b") /Creator (scanloom) /Producer (scanloom) >>",
    ]
    out, at = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = b"".join(f"{p:010d} 00000 n \n".encode() for p in at)
    return out + f"xref\n0 {len(at) + 1}\n0000000000 65535 f \n".encode() + table + f"trailer\n<< /Size {len(at) + 1} /Root 1 0 R /Info 6 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


def encode(df: DataFrame, image: str = "image", *, form: str = "png") -> DataFrame:
    """``df`` with ``content``, its images encoded, in place of the pixels."""
    from scanloom.operators.pages import to_array

    writer = {"png": encode_png, "tiff": encode_tiff, "pdf": encode_pdf}[form]
    keep = [f for f in df.schema if f.name != image]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages = [to_array(x) for x in frame.pop(image)]
            frame["content"] = [None if p is None else writer(p) for p in pages]
            yield frame

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return df.select(*[f.name for f in keep], image).mapInPandas(run, f"{kept}content binary")


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's content to ``folder`` under its name; returns path, length and SHA-256. Written aside and renamed: repeated tasks are harmless."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        fs, base = filesystem(folder)
        for frame in frames:
            out = []
            for n, c in zip(frame[name], frame[content]):
                if n is not None and c is not None:
                    path = posixpath.join(base, posixpath.basename(n))
                    fs.create_dir(base, recursive=True)
                    with fs.open_output_stream(path + ".part") as f:
                        f.write(bytes(c))
                    fs.move(path + ".part", path)
                    out.append({"path": path, "length": len(c), "sha256": hashlib.sha256(bytes(c)).hexdigest()})
            yield pd.DataFrame(out, columns=["path", "length", "sha256"])

    return df.select(name, content).mapInPandas(run, "path string, length long, sha256 string")


def bundle(df: DataFrame, key: str, name: str = "name", content: str = "content", *, most_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """One ZIP a document (or several of at most ``most_bytes`` of content): key, part, content. Parts keep a large document out of a single task."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.length(content)).over(Window.partitionBy(key).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = df.select(key, name, content).withColumn("part", F.floor(before / most_bytes).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in sorted(zip(frame[name], frame[content])):
                z.writestr(zipfile.ZipInfo(n), bytes(c))
        return pd.DataFrame([{key: frame[key].iloc[0], "part": int(frame["part"].iloc[0]), "content": out.getvalue()}])

    return sized.groupBy(key, "part").applyInPandas(pack, f"`{key}` {df.schema[key].dataType.simpleString()}, part int, content binary")


# ---- tables and reports


def append_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("append").option("header", "true").csv(folder)


def sidecars(df: DataFrame, key: str) -> DataFrame:
    """One JSON text a row: (key, value)."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def report(df: DataFrame, title: str, *columns: str) -> DataFrame:
    """One text line a row under a title: 'title: column=value, ...'."""
    return df.select(F.concat_ws("", F.lit(f"{title}: "), F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns])).alias("value"))
