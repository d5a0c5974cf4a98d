"""Decision chains over page measures, as CASE expressions that Catalyst and SQL engines see through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chosen(*pairs: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The first label whose condition holds."""
    out = F.when(*pairs[0])
    for condition, label in pairs[1:]:
        out = out.when(condition, label)
    return out.otherwise(otherwise) if otherwise is not None else out


def labels(*pairs: tuple[Column, str]) -> Column:
    """All labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, label) for condition, label in pairs]))


def is_blank(text_density: Column, white_share: Column) -> Column:
    """Ink keeps a page; an almost white one, or one of hardly any text, is blank. Unreadable pages (null) are blank."""
    return F.when(text_density.isNull() | white_share.isNull(), True).when(text_density > 0.03, False).when(white_share > 0.98, True).otherwise(text_density < 0.005)


def quality_issues(sharpness: Column, contrast: Column, brightness: Column, noise: Column) -> Column:
    return labels((sharpness < 100, "blurred"), (contrast < 50, "low_contrast"), (brightness < 50, "dark"), (brightness > 200, "bright"), (noise > 0.1, "noisy"))


def quality_score(issues: Column) -> Column:
    return F.greatest(F.lit(0), 100 - 20 * F.size(issues))


def quality_level(score: Column) -> Column:
    return chosen((score >= 80, "excellent"), (score >= 60, "good"), (score >= 40, "fair"), (score >= 20, "poor"), otherwise="very_poor")


def overall_quality(flags: Column) -> Column:
    n = F.size(flags)
    return chosen((n == 0, "excellent"), (n == 1, "good"), (n == 2, "fair"), otherwise="poor")


# What a flagged output is told.
ADVICE = {
    "multi_page_detected": "Document may contain multiple pages",
    "low_contrast": "Low contrast detected - consider enhancement",
    "blurred": "Image appears blurred - OCR accuracy may be affected",
    "orientation_issues": "Orientation may need correction",
    "skew_issues": "Document appears skewed - correction recommended",
}


def output_flags(multipage: Column, contrast: Column, sharpness: Column, orientation_confidence: Column, skew: Column) -> Column:
    """What is wrong with an output, in order."""
    return labels(
        (multipage, "multi_page_detected"), (contrast < 50, "low_contrast"), (sharpness < 100, "blurred"), (orientation_confidence < 0.7, "orientation_issues"), (F.abs(skew) > 2, "skew_issues")
    )


def recommendations(flags: Column) -> Column:
    """The advice for each of the flags, in order."""
    known = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return F.transform(flags, lambda f: F.element_at(known, f))


def skew_angle(proj: Column, hough: Column, hough_conf: Column, text: Column, text_conf: Column) -> Column:
    """One angle out of three estimates: a supported projection, a confident second opinion, else the weighted mean of what there is."""
    clear = F.abs(proj) > 3
    supported = (F.abs(hough - proj) < 2) | (F.abs(text - proj) < 2)
    parts = [(clear, proj, 3.0), (hough_conf > 0, hough, 2.0), (text_conf > 0, text, 1.5)]
    weight = sum((F.when(c, w).otherwise(0.0) for c, _, w in parts), F.lit(0.0))
    total = sum((F.when(c, a * w).otherwise(0.0) for c, a, w in parts), F.lit(0.0))
    return (
        F.when(clear & supported, proj)
        .when((hough_conf > 5) & (F.abs(hough) > 3), hough)
        .when((text_conf > 3) & (F.abs(text) > 3), text)
        .otherwise(F.coalesce(F.try_divide(total, weight), proj))
    )


def agreed_rotation(votes: Column) -> Column:
    """The angle all votes (an array) agree on, else 0."""
    return F.when((F.size(F.array_distinct(votes)) == 1) & (F.size(votes) > 0), F.element_at(votes, 1)).otherwise(0)


def optimal_gamma(base: Column, dark: Column, bright: Column, keep: Column) -> Column:
    return F.when(keep, base).when(dark, F.least(base + 0.3, F.lit(2.0))).when(bright, F.greatest(base - 0.2, F.lit(0.8))).otherwise(base)


def gamma_table(gamma: Column) -> Column:
    """256 output levels, truncated."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.floor(F.pow(i / 255.0, 1 / gamma) * 255 + 1e-9).cast("int"))


def brightness_shift(mean: Column, target: Column, tolerance: Column, never_darken: Column) -> Column:
    """Levels to add (or, below zero, to take away) for a mean near the target."""
    gap = target - mean
    usual = F.when(gap > 0, F.least(F.lit(50.0), gap)).otherwise(-F.least(F.lit(50.0), -gap))
    return F.when(F.abs(gap) <= tolerance, 0.0).when(never_darken, F.greatest(F.lit(0.0), F.least(F.lit(100.0), gap))).otherwise(usual).cast("int")


def flow(first: Column, second: Column, first_label: str, second_label: str, factor: float = 1.5) -> Column:
    return chosen((first > second * factor, first_label), (second > first * factor, second_label), otherwise="balanced")


def reading_order(left: Column, right: Column, top: Column, bottom: Column) -> Column:
    across, down = flow(left, right, "left_heavy", "right_heavy"), flow(top, bottom, "top_heavy", "bottom_heavy")
    return chosen(((across == "balanced") & (down == "top_heavy"), "top_to_bottom"), (across == "left_heavy", "left_to_right"), otherwise="standard")


def document_type(edge_density: Column, text_share: Column, width: Column, height: Column) -> Column:
    return chosen(
        ((edge_density > 0.2) & (text_share < 0.3), "form_or_invoice"), (text_share > 0.7, "text_document"), (edge_density > 0.1, "mixed_content"), (height > width * 1.2, "letter_or_report"), otherwise="general_document"
    )


def orientation(width: Column, height: Column) -> Column:
    return chosen((height > width, "portrait"), (width > height, "landscape"), (width == height, "square"))


def size_category(size: Column) -> Column:
    mb = 1024 * 1024
    return chosen((size < mb, "small"), (size < 5 * mb, "medium"), (size < 25 * mb, "large"), (size.isNotNull(), "very_large"))


MB = 1024 * 1024

# Most size in MB (null: any), transformation, seconds.
FALLBACKS = ((10, "enhanced", 60), (50, "deskewing", 120), (100, "basic", 180), (None, "basic", 300))
# Size in MB to stay below (null: any), transformation, cached, batched, memory in MB, seconds.
SIZE_PLANS = ((5, "enhanced", True, False, 512, 60), (25, "deskewing", True, False, 1024, 120), (50, "deskewing", True, True, 2048, 180), (None, "basic", False, True, 4096, 300))


def fallback_strategy(size: Column) -> Column:
    """The transformation that a file of this size still affords, and its time: struct (strategy, timeout); null for null."""
    out = F.lit(None)
    for most, strategy, seconds in reversed(FALLBACKS):
        one = F.struct(F.lit(strategy).alias("strategy"), F.lit(seconds).alias("timeout"))
        out = F.when(size.isNotNull(), one) if most is None else F.when(size <= most * MB, one).otherwise(out)
    return out


def size_plan(size: Column, state: Column) -> Column:
    """How to process a file of this size: struct (transformation, caching, batch, memory, timeout); a short machine gets the basic one."""
    out = F.lit(None)
    for below, name, cached, batched, memory, seconds in reversed(SIZE_PLANS):
        short = state.isin("high_memory_usage", "high_cpu_usage")
        one = F.struct(
            F.when(short, "basic").otherwise(name).alias("transformation"),
            F.lit(cached).alias("caching"),
            F.lit(batched).alias("batch"),
            F.when(state == "high_memory_usage", min(memory, 1024) * MB).otherwise(memory * MB).cast("bigint").alias("memory"),
            F.when(state == "high_cpu_usage", min(seconds, 180)).otherwise(seconds).alias("timeout"),
        )
        out = F.when(size.isNotNull(), one) if below is None else F.when(size < below * MB, one).otherwise(out)
    return out


def streams(size: Column) -> Column:
    """Whether a file is read as a stream."""
    return F.coalesce(size > 25 * MB, F.lit(False))


def resource_state(cpu: Column, memory: Column, disk: Column) -> Column:
    return chosen((cpu > 80, "high_cpu_usage"), (memory > 85, "high_memory_usage"), (disk > 90, "low_disk_space"), ((cpu > 60) | (memory > 70), "moderate_load"), otherwise="optimal")


def progress_percent(done: Column, total: Column) -> Column:
    return F.round(F.try_divide(done * 100.0, total), 1)


def target_size(width: Column, height: Column, short: int = 2079, long: int = 2923) -> tuple[Column, Column]:
    """The page size a page is scaled into: the long side along the page's own, the other in proportion, whole pixels."""
    wide = width > height
    max_w, max_h = F.when(wide, long).otherwise(short), F.when(wide, short).otherwise(long)
    factor = F.least(max_w / width, max_h / height)
    return F.floor(width * factor).cast("int"), F.floor(height * factor).cast("int")


def contrast_level(spread: Column) -> Column:
    return chosen((spread < 0.2, "very_low"), (spread < 0.4, "low"), (spread < 0.7, "normal"), otherwise="high")
