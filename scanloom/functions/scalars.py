"""Small scalar functions over names, times, parameters and results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_timestamp(text: Column) -> Column:
    """An ISO date or time, with Z, an offset or none (UTC), as a timestamp; null for anything else."""
    tidy = F.regexp_replace(F.trim(text), r"[zZ]$", "+00:00")
    full = F.when(tidy.rlike(r"(?:[+-][0-9]{2}:?[0-9]{2})$") & tidy.contains(":"), tidy).otherwise(F.concat(tidy, F.lit("+00:00")))
    dated = F.when(tidy.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(tidy, F.lit("T00:00:00+00:00"))).otherwise(full)
    return F.try_to_timestamp(dated)


def pdf_date(text: Column) -> Column:
    """'D:YYYYMMDDHHMMSS...' as a timestamp without zone; a date alone begins its day."""
    digits = F.regexp_extract(text, r"^D:([0-9]{8}(?:[0-9]{6})?)", 1)
    return F.to_timestamp_ntz(F.when(F.length(digits) == 14, digits).when(F.length(digits) == 8, F.concat(digits, F.lit("000000"))), F.lit("yyyyMMddHHmmss"))


def download_name(url: Column, disposition: Column, content_type: Column) -> Column:
    """The name a download gets: from its header, else the last part of its URL, else a stock name; a suffix by type if it has none."""
    header = F.nullif(F.regexp_extract(disposition, r"(?i)filename\*?=(?:utf-8'')?\"?([^\";]+)", 1), F.lit(""))
    base = F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/(?:[^?#]*/)?([^/?#]+)", 1), F.lit(""))
    name = F.coalesce(F.trim(header), base, F.lit("downloaded_file"))
    kinds = {"image/png": ".png", "image/jpeg": ".jpg", "image/tiff": ".tiff", "image/bmp": ".bmp", "application/pdf": ".pdf"}
    guessed = F.lit("")
    for kind, end in kinds.items():
        guessed = F.when(F.lower(content_type).startswith(kind), end).otherwise(guessed)
    return F.when(name.rlike(r"\.[A-Za-z0-9]{1,5}$"), name).otherwise(F.concat(name, guessed))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def result_name(path: Column, number: Column, of: Column, *, production: bool = False) -> Column:
    """The name of a result: by its source, with a number if it has several parts."""
    end = F.lit(".png") if production else F.when(of > 1, F.concat(F.lit("_result"), number.cast("string"), F.lit(".png"))).otherwise("_result.png")
    return F.concat(stem(path), end)


def parameter_hash(*columns: str) -> Column:
    """MD5 of the columns as JSON with sorted names: equal parameters, equal hashes, whatever their order."""
    return F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def environment_hash(spark) -> Column:
    """MD5 of what a result may depend on besides its parameters: the versions at work. No times, so that it is reproducible."""
    import platform

    import numpy

    return F.lit(hashlib.md5(json.dumps({"numpy": numpy.__version__, "python": platform.python_version(), "spark": spark.version}, sort_keys=True).encode()).hexdigest())


def fitted_box(width: Column, height: Column, page_width: float = 612.0, page_height: float = 792.0, share: float = 0.9) -> dict[str, Column]:
    """Where an image goes on a page: scaled to the share, centred."""
    scale = F.least(page_width / width, page_height / height) * share
    w, h = width * scale, height * scale
    return {"x": (page_width - w) / 2, "y": (page_height - h) / 2, "width": w, "height": h}


def audit_fingerprint(width: Column, height: Column, size: Column, mean: Column, std: Column, edges: Column, name: Column) -> Column:
    """A JSON text with sorted names and rounded measures."""
    return F.to_json(
        F.struct(
            F.round(edges, 4).alias("edge_density"), name.alias("file_name"), size.alias("file_size"), F.concat(width.cast("string"), F.lit("x"), height.cast("string")).alias("image_dimensions"),
            F.round(mean, 2).alias("mean_brightness"), F.round(std, 2).alias("std_brightness"),
        )
    )


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits * 100.0, hits + misses), F.lit(0.0))
