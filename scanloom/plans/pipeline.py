"""All twelve tasks as operators over a table of pages, and the execution of a mode.

A page has a key, an image, and maybe a text. Each operator adds its columns and says in ``outcome`` (task to status) how it
went: completed, skipped (blank pages, and repeats, for which their master stands) or failed (unreadable pages, and kernels that
raised; the page then goes on as it was). Raster tasks that follow each other are one pass over the pages. Whether a page is blank
is found first, by a test of its own. Every task of a chain runs or the chain is refused: ``Registry.run`` raises for a task without operator.

Pixels are shuffled nowhere, but where repeats are many: their keys are joined to the pages, and are broadcast only below Spark's threshold.
"""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions import rules as R
from scanloom.functions import text as T
from scanloom.functions.scalars import environment_hash, result_name
from scanloom.operators import pages
from scanloom.plans import modes
from scanloom.sources import files


def prepared(df: DataFrame, key: str, image: str = "image") -> DataFrame:
    """The pages with ``part`` (0), ``state`` (ready, blank or failed), ``master`` (their own key) and an empty ``outcome``; a page that is not ready gives its image away."""
    tested = pages.blankness(df, image, keep_image=True)
    state = F.when(F.col("is_blank").isNull(), "failed").when(F.col("is_blank"), "blank").otherwise("ready")
    marked = tested.withColumn("state", state).drop("is_blank")
    none = F.lit(None).cast(df.schema[image].dataType)
    return marked.withColumns({image: F.when(F.col("state") == "ready", F.col(image)).otherwise(none), "part": F.lit(0), "parts": F.lit(1), "master": F.col(key), "outcome": F.create_map().cast("map<string,string>")})


def _status(done: Column | None = None) -> Column:
    """What a task says of a page by its state."""
    return F.when(F.col("state") == "ready", F.lit("completed") if done is None else done).when(F.col("state") == "failed", "failed").otherwise("skipped")


def _said(df: DataFrame, task: str, done: Column | None = None) -> DataFrame:
    return df.withColumn("outcome", F.map_concat("outcome", F.create_map(F.lit(task), _status(done))))


def raster(*tasks: str, image: str = "image", dpi: int = 250):
    """An operator of raster tasks that follow each other, fused into one pass; ``dpi``: of the A4 page that sizing makes."""

    def run(df: DataFrame) -> DataFrame:
        kernels = pages.KERNELS | {"sizing": functools.partial(pages.P.standard_size, short=2079 * dpi // 250, long=2923 * dpi // 250)}
        done = pages.correct(df.withColumnRenamed("outcome", "before"), tasks, image, kernels)
        own = F.map_from_arrays(F.array(*map(F.lit, tasks)), F.array(*[_status(F.element_at("outcome", t)) for t in tasks]))
        return done.withColumn("outcome", F.map_concat("before", own)).drop("before")

    return run


def deduplicated(key: str, image: str = "image"):
    """Repeats (by the digest of their pixels) name the least key of their kind as ``master`` and are skipped from then on."""

    def run(df: DataFrame) -> DataFrame:
        digests = pages.derived(df.where("state = 'ready'").select(key, image), image, "digest string", lambda p: (pages.page_digest(p),))
        firsts = digests.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
        repeats = digests.join(firsts, "digest").where(F.col(key) != F.col("first")).select(key, "first")
        found = df.join(repeats, key, "left")
        repeat = F.col("first").isNotNull()
        none = F.lit(None).cast(df.schema[image].dataType)
        said = _said(found, "dedup")
        return said.withColumns({"state": F.when(repeat, "duplicate").otherwise(F.col("state")), image: F.when(repeat, none).otherwise(F.col(image)), "master": F.coalesce("first", "master")}).drop("first")

    return run


def segmented(image: str = "image"):
    def run(df: DataFrame) -> DataFrame:
        return _said(pages.segment(df.drop("part", "parts"), image, keep_unreadable=True), "segment")

    return run


def languages(text: str | None):
    """Script and language of a page's text; without a text column, none."""

    def run(df: DataFrame) -> DataFrame:
        if text is None or text not in df.columns:
            return _said(df.withColumn("language", F.lit(None).cast("string")), "language", F.lit("skipped"))
        found = T.detect(df, text)
        return _said(found.select(*df.columns, "language"), "language")

    return run


#: What the fields of ``metadata`` are made of, where it is not the measure of their name.
_SCORED, _FLAGGED = ("sharpness", "contrast", "brightness", "noise"), ("multipage", "contrast", "sharpness", "orientation_confidence", "projection", "hough", "hough_confidence", "text", "text_confidence")
_MADE_OF = {
    "quality_score": _SCORED, "quality_level": _SCORED, "document_type": ("edge_density", "text_share", "width", "height"), "reading_order": ("left", "right", "top", "bottom"), "orientation": ("width", "height"),
    "flags": _FLAGGED, "advice": _FLAGGED, "overall": _FLAGGED,
}


def described(image: str = "image", fields: tuple[str, ...] | None = None, *, keep_image: bool = True):
    """Measures, decisions, flags and advice of the page as it is now, in the struct ``metadata``; ``fields`` of it, if any are named, from the measures that these take."""

    def run(df: DataFrame) -> DataFrame:
        only = None if fields is None else {m for n in fields for m in _MADE_OF.get(n, (n,))}
        measured = pages.decide(pages.measure(df.withColumnRenamed("state", "_state"), image, keep_image=keep_image, only=only))
        m = lambda n: F.col(f"measures.{n}")
        flags = R.output_flags(m("multipage"), m("contrast"), m("sharpness"), m("orientation_confidence"), F.col("skew"))
        own = ["quality_score", "quality_level", "document_type", "reading_order", "orientation"]
        every = {n: F.col(n) for n in own} | {n: m(n) for n in ("features", "marks", "width", "height")} | {"flags": flags, "advice": R.recommendations(flags), "overall": R.overall_quality(flags)}
        struct = F.struct(*[c.alias(n) for n, c in every.items() if fields is None or n in fields])
        found = measured.withColumn("metadata", F.when(F.col("measures").isNotNull(), struct)).withColumnRenamed("_state", "state")
        return _said(found.select(*[c for c in df.columns if keep_image or c != image], "metadata"), "metadata")

    return run


def exported(key: str, image: str = "image", form: str = "png"):
    """``name`` and ``content`` of each output, and a ``manifest`` (JSON) of what was done to it where."""

    def run(df: DataFrame) -> DataFrame:
        said = _said(df, "export")
        written = files.encode(said, image, form=form)
        name = F.regexp_replace(result_name(F.col(key).cast("string"), F.col("part") + 1, F.col("parts")), "png$", form)
        manifest = F.to_json(F.struct(F.col(key).cast("string").alias("page"), "part", "state", F.col("master").cast("string").alias("master"), "outcome", F.sha2("content", 256).alias("sha256"), environment_hash(df.sparkSession).alias("environment")))
        return written.withColumns({"name": F.when(F.col("content").isNotNull(), name), "manifest": manifest})

    return run


def registry(key: str, image: str = "image", text: str | None = None, form: str = "png", dpi: int = 250) -> modes.Registry:
    """The shipped operators of all tasks."""
    r = modes.Registry()
    for task in pages.KERNELS:
        r.add(task, raster(task, image=image, dpi=dpi))
    for task, operator in (("dedup", deduplicated(key, image)), ("segment", segmented(image)), ("language", languages(text)), ("metadata", described(image)), ("export", exported(key, image, form))):
        r.add(task, operator)
    return r


def run(df: DataFrame, mode: str | list[str], key: str, *, image: str = "image", text: str | None = None, form: str = "png", dpi: int = 250, given: modes.Registry | None = None, compat: bool = False) -> DataFrame:
    """``df`` after all tasks of a mode or transformation (or of a list, taken as it is), with ``state``, ``master``, ``part`` and ``outcome``."""
    if isinstance(mode, str):
        tasks = tuple(modes.TRANSFORMATIONS[mode].split()) if mode in modes.TRANSFORMATIONS else modes.plan(mode, compat=compat)
    else:
        tasks = tuple(mode)
    if tasks is None:
        raise ValueError(f"the chain of mode {mode} is invalid")
    known = given or registry(key, image, text, form, dpi)
    lacking = [t for t in tasks if t not in known.operators]
    if lacking:
        raise ValueError(f"no operator for {', '.join(lacking)}")
    steps: list[tuple[str, ...]] = []
    for t in (t for t in tasks if t not in known.disabled):
        if given is None and t in pages.KERNELS and steps and steps[-1][0] in pages.KERNELS:
            steps[-1] += (t,)
        else:
            steps.append((t,))
    return reduce(lambda x, step: x.transform(raster(*step, image=image, dpi=dpi) if len(step) > 1 else known.operators[step[0]]), steps, prepared(df, key, image))


def log(done: DataFrame, key: str) -> DataFrame:
    """One row a page, part and task: its status."""
    return done.select(key, "part", F.explode("outcome").alias("task", "status"))
