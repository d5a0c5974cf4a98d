"""Execution modes, their validation, and chains of operators as folds over a DataFrame.

A mode is a list of task names. A chain is valid if every task is known and everything it depends on
comes before it; a standalone mode runs one task without them. ``strict`` planning raises for what is unknown or
invalid; ``compat`` planning answers an unknown mode with the full pipeline and an invalid chain with None.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tasks with what they depend on, and the modes' chains by short names.
DEPENDENCIES = {
    "orientation": (), "skew": ("orientation",), "crop": ("skew",), "sizing": ("crop",), "denoise": ("sizing",), "contrast": ("denoise",),
    "segment": ("color",), "color": ("contrast",), "dedup": (), "language": ("dedup",), "metadata": ("language",), "export": ("metadata",),
}
DEFAULT_ORDER = "dedup language metadata orientation skew crop sizing denoise contrast color segment export"
_CHAINS = {
    "full_pipeline": "dedup orientation skew crop sizing denoise contrast color segment language metadata export",
    "orient_only": "orientation",
    "skew_only": "skew",
    "crop_only": "crop",
    "orient_and_skew": "orientation skew",
    "orient_skew_crop": "orientation skew crop",
    "with_dpi_standardization": "orientation skew crop sizing",
    "noise_only": "denoise",
    "with_denoising": "orientation skew crop sizing denoise",
    "contrast_only": "contrast",
    "with_enhancement": "orientation skew crop sizing denoise contrast",
    "segmentation_only": "segment",
    "with_segmentation": "orientation skew crop sizing denoise contrast segment",
    "color_handling_only": "color",
    "with_color_handling": "orientation skew crop sizing denoise contrast color segment",
    "deduplication_only": "dedup",
    "with_deduplication": "dedup orientation skew crop sizing denoise contrast segment color",
    "language_detection_only": "language",
    "metadata_extraction_only": "metadata",
    "output_standardization_only": "export",
    "comprehensive_pipeline": "dedup language metadata orientation skew crop sizing denoise contrast color segment export",
    "production_mode": "orientation skew crop",
}
STANDALONE = {"skew_only", "contrast_only", "segmentation_only", "color_handling_only", "deduplication_only", "language_detection_only", "metadata_extraction_only", "output_standardization_only"}
TRANSFORMATIONS = {"deskewing": "orientation skew crop", "basic": "orientation crop", "enhanced": "orientation skew crop sizing denoise contrast", "comprehensive": _CHAINS["full_pipeline"]}

MODES = {name: tuple(chain.split()) for name, chain in _CHAINS.items()}


def check_chain(tasks: tuple[str, ...] | list[str], dependencies: dict = DEPENDENCIES) -> tuple[bool, str]:
    """(valid, why not)."""
    done: set[str] = set()
    for task in tasks:
        if task not in dependencies:
            return False, f"unknown task {task}"
        lacking = [d for d in dependencies[task] if d not in done]
        if lacking:
            return False, f"{task} needs {', '.join(lacking)} before it"
        done.add(task)
    return True, ""


def valid(mode: str) -> tuple[bool, str]:
    return (True, "") if mode in STANDALONE else check_chain(MODES[mode])


def plan(mode: str, *, compat: bool = False) -> tuple[str, ...] | None:
    """The tasks of a mode."""
    if mode not in MODES and not compat:
        raise ValueError(f"unknown mode {mode}")
    mode = mode if mode in MODES else "full_pipeline"
    ok, why = valid(mode)
    if not ok and not compat:
        raise ValueError(f"mode {mode}: {why}")
    return MODES[mode] if ok else None


def relation(spark: SparkSession) -> DataFrame:
    """The modes as a table: mode, tasks (their number), valid, standalone, chain."""
    rows = [(m, len(t), valid(m)[0], m in STANDALONE, list(t)) for m, t in MODES.items()]
    return spark.createDataFrame(rows, "mode string, tasks int, valid boolean, standalone boolean, chain array<string>")


@dataclass
class Registry:
    """Operators (DataFrame to DataFrame) by task name; tasks can be added, removed and switched off."""

    operators: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    dependencies: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DEPENDENCIES))
    disabled: set[str] = field(default_factory=set)

    def add(self, task: str, operator: Callable[[DataFrame], DataFrame], needs: tuple[str, ...] | None = None) -> None:
        self.operators[task] = operator
        self.dependencies[task] = self.dependencies.get(task, ()) if needs is None else needs

    def remove(self, task: str) -> None:
        self.operators.pop(task, None)

    def enable(self, task: str, on: bool = True) -> None:
        (self.disabled.discard if on else self.disabled.add)(task)

    def run(self, df: DataFrame, tasks: tuple[str, ...] | list[str], *, standalone: bool = False) -> DataFrame:
        """The operators of ``tasks`` applied in turn: one lazy plan, in which Catalyst fuses what it can."""
        ok, why = (True, "") if standalone else check_chain(tasks, self.dependencies)
        if not ok:
            raise ValueError(why)
        missing = [t for t in tasks if t not in self.operators]
        if missing:
            raise ValueError(f"no operator for {', '.join(missing)}")
        return reduce(lambda x, t: x.transform(self.operators[t]), [t for t in tasks if t not in self.disabled], df)


def last_output(*outputs: str):
    """The result of a chain: the last output column that has a value."""
    return F.coalesce(*[F.col(c) for c in reversed(outputs)])
