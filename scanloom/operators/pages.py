"""Page operators: kernels in Arrow batches, decisions as expressions.

A page is an image struct as Spark's ``image`` source yields it (height, width, nChannels, data; BGR, row by row).
Measures and corrections of a page are narrow: nothing is shuffled, and pixels never are. Consecutive
corrections are fused into one pass over the pages (``correct``), so that a page is decoded and encoded once. A page
that cannot be read has null measures and status 'failed', and goes on unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions import rules as R
from scanloom.kernels import page as P
from scanloom.kernels import raster as X

IMAGE = "origin string, height int, width int, nChannels int, mode int, data binary"
MEASURES = (
    "width int, height int, brightness double, contrast double, sharpness double, edge_density double, text_share double, white_share double, text_density double, noise double, gradient double, "
    "margin_left int, margin_right int, margin_top int, margin_bottom int, left long, right long, top long, bottom long, grid array<double>, columns int, multipage boolean, orientation_confidence double, "
    "features struct<small:int,medium:int,large:int,complexity:double,form_fields:int,signatures:int,barcodes:int,logos:int,stamps:int,table_score:double,special:array<string>,layout:array<string>>, marks array<struct<x:int,y:int,w:int,h:int,type:string>>, residue struct<dark:int,edges:int>, "
    "votes array<int>, projection double, hough double, hough_confidence int, text double, text_confidence int, box array<int>, pages array<struct<x_start:int,x_end:int>>, phash long, page_hash string, "
    "colour_regions array<struct<type:string,ink:string,x:int,y:int,w:int,h:int,area:double,circularity:double,aspect_ratio:double,solidity:double>>"
)


def to_array(image) -> np.ndarray | None:
    """The pixels of an image struct: (h, w) or (h, w, 3); None if it holds none."""
    if image is None or image["data"] is None:
        return None
    sides = (image["height"], image["width"], image["nChannels"])
    # A batch with null images has its integers as floats.
    if any(x is None or x != x for x in sides):
        return None
    h, w, n = map(int, sides)
    raw = np.frombuffer(image["data"], np.uint8)
    if h <= 0 or w <= 0 or n not in (1, 3, 4) or raw.size != h * w * n:
        return None
    a = raw.reshape(h, w, n)
    return a[..., 0] if n == 1 else a[..., :3]


def to_image(page: np.ndarray, origin: str | None = None) -> dict:
    n = 1 if page.ndim == 2 else page.shape[2]
    return {"origin": origin, "height": page.shape[0], "width": page.shape[1], "nChannels": n, "mode": {1: 0, 3: 16, 4: 24}[n], "data": np.ascontiguousarray(page).tobytes()}


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


_OTHERS: dict[str, Callable[[np.ndarray], object]] = {
    "votes": P.orientation_votes, "agreed": P.agreed_rotation, "box": lambda p: list(P.content_box(p)), "pages": lambda p: [{"x_start": a, "x_end": b} for a, b in P.page_bounds(p)],
    "phash": lambda p: _signed(X.phash(p)), "page_hash": lambda p: page_digest(p), "colour_regions": P.colour_regions, "marks": P.marks,
}
_SKEW = ("projection", "hough", "hough_confidence", "text", "text_confidence")


def all_measures(page: np.ndarray, only: Collection[str] | None = None) -> dict:
    """All measures of a page, or ``only`` those named. ``agreed`` is what the votes agree on, and is only given where it is named."""
    found = P.measures(page, only)
    if only is None or any(n in only for n in _SKEW):
        found |= P.skew_estimates(page, only=only)
    return found | {n: f(page) for n, f in _OTHERS.items() if (n != "agreed" if only is None else n in only)}


def derived(df: DataFrame, image: str, columns: str, compute: Callable[[np.ndarray], tuple], *, keep_image: bool = False) -> DataFrame:
    """``df`` with ``columns`` (DDL) computed from the pages in one pass, null for unreadable ones; without the image unless it is to stay."""
    keep = [f for f in df.schema if f.name != image or keep_image]
    names = [x.split(" ", 1)[0] for x in _fields(columns)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages = [to_array(x) for x in frame[image]]
            found = [(None,) * len(names) if p is None else compute(p) for p in pages]
            if not keep_image:
                frame = frame.drop(columns=[image])
            for i, n in enumerate(names):
                frame[n] = [x[i] for x in found]
            yield frame

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return df.select(*[f.name for f in keep], *([] if keep_image else [image])).mapInPandas(run, kept + columns)


def measure(df: DataFrame, image: str = "image", *, keep_image: bool = False, only: Collection[str] | None = None) -> DataFrame:
    """``df`` with the struct ``measures``, without its image unless it is to stay. Catalyst does not see which fields a Python function may leave out: a caller that reads a few names them in ``only``."""
    fields = [x for x in _fields(MEASURES + ", agreed int") if (x.split(" ", 1)[0] != "agreed" if only is None else x.split(" ", 1)[0] in only)]
    if only is not None and len(fields) != len(set(only)):
        raise ValueError(f"unknown measures among {', '.join(only)}")
    struct = f"measures struct<{', '.join(':'.join(x.split(' ', 1)) for x in fields)}>"
    return derived(df, image, struct, lambda p: (all_measures(p, only),), keep_image=keep_image)


def blankness(df: DataFrame, image: str = "image", *, keep_image: bool = False) -> DataFrame:
    """``df`` with ``is_blank``, by the two measures that this takes; null for unreadable pages."""
    found = derived(df, image, "_density double, _white double", lambda p: (P.blank_density(X.gray(p)), X.share(X.gray(p) > 245)), keep_image=keep_image)
    return found.withColumn("is_blank", F.when(F.col("_density").isNotNull(), R.is_blank(F.col("_density"), F.col("_white")))).drop("_density", "_white")


def page_digest(page: np.ndarray) -> str:
    """SHA-256 of the page as gray pixels, 1024 at most on the longer side."""
    import hashlib

    normal = P.shrink(X.gray(page), 1024)
    return hashlib.sha256(repr(normal.shape).encode() + normal.tobytes()).hexdigest()


def _fields(schema: str) -> list[str]:
    """The fields of a DDL schema, split at the commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def decide(measured: DataFrame) -> DataFrame:
    """``measures`` with the decisions of the rules: blank, rotation, skew, issues, level, reading order, type, layout, status; those whose measures are there."""
    m = lambda n: F.col(f"measures.{n}")
    known = set(measured.schema["measures"].dataType.names)
    rotation = (F.coalesce(m("agreed"), F.lit(0)), "agreed") if "agreed" in known else (R.agreed_rotation(m("votes")), "votes")
    rules = {
        "status": (lambda: F.when(F.col("measures").isNull(), "failed").otherwise("completed"), ()),
        "is_blank": (R.is_blank, ("text_density", "white_share")),
        "rotation": (lambda _: rotation[0], rotation[1:]),
        "skew": (R.skew_angle, _SKEW),
        "issues": (R.quality_issues, ("sharpness", "contrast", "brightness", "noise")),
        "reading_order": (R.reading_order, ("left", "right", "top", "bottom")),
        "document_type": (R.document_type, ("edge_density", "text_share", "width", "height")),
        "orientation": (R.orientation, ("width", "height")),
    }
    decided = measured.withColumns({n: rule(*map(m, needs)) for n, (rule, needs) in rules.items() if known.issuperset(needs)})
    if "issues" not in decided.columns:
        return decided
    score = R.quality_score(F.col("issues"))
    return decided.withColumns({"quality_score": score, "quality_level": R.quality_level(score)})


def _level(page: np.ndarray) -> np.ndarray:
    return P.deskew(page, P.skew_decision(P.skew_estimates(page)))


def _upright(page: np.ndarray) -> np.ndarray:
    turn = P.agreed_rotation(page)
    return X.rotate(page, turn) if turn else page


KERNELS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "orientation": _upright,
    "skew": _level,
    "crop": P.crop,
    "sizing": P.standard_size,
    "denoise": P.denoise,
    "contrast": P.enhance,
    "color": P.gray_with_colour,
}


def correct(df: DataFrame, tasks: tuple[str, ...] | list[str], image: str = "image", kernels: dict[str, Callable] | None = None) -> DataFrame:
    """The raster ``tasks`` in turn, fused into one pass; adds ``outcome`` (task to status: completed, failed or skipped)."""
    known = KERNELS if kernels is None else kernels
    keep = [f for f in df.schema if f.name != image]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            images, outcomes = [], []
            for x in frame[image]:
                page, outcome = to_array(x), {}
                for task in tasks:
                    if page is None:
                        outcome[task] = "skipped"
                        continue
                    try:
                        page, outcome[task] = known[task](page), "completed"
                    except (ValueError, IndexError, ZeroDivisionError):
                        outcome[task] = "failed"
                images.append(x if page is None else to_image(page, x["origin"]))
                outcomes.append(outcome)
            frame[image], frame["outcome"] = images, outcomes
            yield frame

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    schema = f"{kept}`{image}` struct<{', '.join(':'.join(x.split(' ', 1)) for x in IMAGE.split(', '))}>, outcome map<string,string>"
    return df.select(*[f.name for f in keep], image).mapInPandas(run, schema)


def segment(df: DataFrame, image: str = "image", margin: int = 20, *, keep_unreadable: bool = False) -> DataFrame:
    """One row a page found on a scan, with ``part`` (of ``parts``) and its image, of a single page what is of interest on it; unreadable scans give none, or themselves."""
    keep = [f for f in df.schema if f.name != image]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                page = to_array(row[image])
                if page is None and keep_unreadable:
                    yield pd.DataFrame([{**{f.name: row[f.name] for f in keep}, image: row[image], "part": 0, "parts": 1}])
                found = P.parts(page, margin) if page is not None else []
                for i, part in enumerate(found):
                    yield pd.DataFrame([{**{f.name: row[f.name] for f in keep}, image: to_image(part, row[image]["origin"]), "part": i, "parts": len(found)}])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    schema = f"{kept}`{image}` struct<{', '.join(':'.join(x.split(' ', 1)) for x in IMAGE.split(', '))}>, part int, parts int"
    return df.select(*[f.name for f in keep], image).mapInPandas(run, schema)


def synthetic_pages(keys: DataFrame, key: str, width: int = 200, height: int = 280) -> DataFrame:
    """A synthetic page for each key, with what was planted: skew (-12 to 12 degrees), pages (1 or 2), blank (each tenth)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys in (frame[key].iloc[i : i + 100] for frame in frames for i in range(0, len(frame), 100)):
            out = []
            for k in keys:
                skew, pages, blank = int(k) % 5 * 6 - 12, 2 if k % 7 == 0 else 1, bool(k % 10 == 9)
                skew = 0 if pages == 2 else skew
                page = P.synthetic(width * pages, height, skew, pages=pages, seed=int(k), blank=blank)
                out.append({key: k, "planted_skew": float(skew), "planted_pages": pages, "planted_blank": blank, "image": to_image(page, f"synthetic/{k}.png")})
            yield pd.DataFrame(out, columns=[key, "planted_skew", "planted_pages", "planted_blank", "image"])

    schema = f"`{key}` long, planted_skew double, planted_pages int, planted_blank boolean, image struct<{', '.join(':'.join(x.split(' ', 1)) for x in IMAGE.split(', '))}>"
    return keys.select(F.col(key).cast("long")).mapInPandas(run, schema)
