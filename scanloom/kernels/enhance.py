"""Clean-up of one page: sharpening, background, bleed-through, scanner edges and the contrast chain, on the primitives of ``raster``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from scanloom.kernels import raster as X


def _cross(centre: float, side: float, corner: float = 0.0) -> np.ndarray:
    return np.array([[corner, side, corner], [side, centre, side], [corner, side, corner]], np.float32)


# 3 x 3 kernels by name.
SHARPENERS = {
    "light": _cross(1.4, -0.1),
    "standard": _cross(5, -1),
    "strong": _cross(9, -1, -1),
    "conservative": _cross(2, -0.25),
    "step": _cross(3, -0.5),
    "dark_page": _cross(1.2, -0.05),
    "bright_page": _cross(1.25, -0.05, -0.05),
    "cleanup": _cross(1.8, -0.1, -0.1),
    # A ninth of the strong one, on top of the page itself: brightness stays.
    "mean_strong": _cross(1 + 8 / 9, -1 / 9, -1 / 9),
}


def per_channel(page: np.ndarray, f) -> np.ndarray:
    return f(page) if page.ndim == 2 else np.stack([f(page[..., i]) for i in range(page.shape[2])], -1)


def sharpen(page: np.ndarray, kind: str = "standard") -> np.ndarray:
    return per_channel(page, lambda g: X.filter2(g, SHARPENERS[kind]))


def unsharp(page: np.ndarray, sigma: float = 1.2, strength: float = 0.8, least: float = 0.0) -> np.ndarray:
    """The page set off against its blurred self; differences below ``least`` are left."""

    def one(g: np.ndarray) -> np.ndarray:
        a = g.astype(X.F32)
        mask = a - X.gaussian(a, 2 * round(3 * sigma) + 1, sigma)
        return np.clip(a + strength * np.where(np.abs(mask) < least, 0, mask), 0, 255).astype(np.uint8)

    return per_channel(page, one)


#: By how much a page was enlarged at least: blur, strength of the unsharp mask, kernel, and what share of a pixel stays in any case.
_AFTER_SCALING = ((6.0, 1.0, 0.3, _cross(2.8, -0.3, -0.2), 0.8), (3.0, 0.8, 0.2, _cross(2.2, -0.2, -0.1), 0.85))


def sharpen_scaled(page: np.ndarray, factor: float) -> np.ndarray:
    """What enlarging by ``factor`` has blurred made sharp again, the more the larger it was."""
    for least, sigma, strength, kernel, kept in _AFTER_SCALING:
        if factor > least:

            def one(g: np.ndarray) -> np.ndarray:
                a = g.astype(X.F32) / 255
                masked = a + strength * (a - X.gaussian(a, 3, sigma))
                return (np.clip(np.maximum(X.filter2(masked, kernel), a * kept), 0, 1) * 255).astype(np.uint8)

            return per_channel(page, one)
    return sharpen(page, "mean_strong")


def enlarge(page: np.ndarray, height: int, width: int) -> np.ndarray:
    """In steps of two by Lanczos, slightly sharpened between them."""
    factor = max(height / page.shape[0], width / page.shape[1])
    steps = max(1, int(np.ceil(np.log2(factor))))
    for step in range(steps):
        last = step == steps - 1
        page = X.resize(page, height if last else min(height, page.shape[0] * 2), width if last else min(width, page.shape[1] * 2), "lanczos")
        if not last:
            page = sharpen(page, "step")
    return page


def for_recognition(page: np.ndarray, mode: str = "standard", *, unsharp_by: tuple[float, float] | None = None, kernel: str | None = None, clip: float | None = None) -> np.ndarray:
    """What recognition profits from. ``mode``: standard (gray: dark pages slightly sharpened, bright ones equalised but nowhere darkened, then
    sharpened), moderate (unsharp mask, kernel, lightness equalised if ``clip`` is given) or white (only the given mask and kernel, else nothing).
    """
    if mode in ("white", "moderate"):
        out = unsharp(page, *unsharp_by) if unsharp_by else page
        kernel = kernel or ("light" if mode == "moderate" else None)
        out = sharpen(out, kernel) if kernel else out
        return equalized_lightness(out, clip) if mode == "moderate" and clip else out
    g = X.gray(page)
    if g.mean() <= 128:
        return sharpen(g, "dark_page")
    return sharpen(np.maximum(X.clahe(g, 1.1, 32), g), "bright_page")


def equalized_lightness(page: np.ndarray, clip: float = 1.5) -> np.ndarray:
    """Local equalisation of the lightness; colours keep their a and b."""
    if page.ndim == 2:
        return X.clahe(page, clip)
    lab = X.lab(page)
    lab[..., 0] = X.clahe(np.rint(lab[..., 0] * 2.55).astype(np.uint8), clip) / 2.55
    return X.from_lab(lab)


# ---- background


def clean_background(g: np.ndarray) -> np.ndarray:
    """Bright calm pixels smoothed, and single white ones taken back into their surroundings."""
    slope = X.filter2(g.astype(X.F32), np.array([[1, 0, -1], [0, 0, 0], [-1, 0, 1]], np.float32))
    calm = (slope < np.percentile(slope, 30)) & (g > 200)
    out = np.where(calm, np.rint(X.gaussian(g, 5)).astype(np.uint8), g)
    white = out > 250
    lone = white & ~X.opened(white, 2, 2)
    return np.where(lone, np.rint(X.gaussian(out, 3)).astype(np.uint8), out)


def bleeds_through(g: np.ndarray) -> bool:
    """Whether something from the back shines through: differences from the blurred page are large on the mean and vary."""
    diff = np.abs(g.astype(X.F32) - X.gaussian(g, 31))
    return bool(diff.mean() > 5 and diff.std() > 8)


def without_bleeding(g: np.ndarray, alpha: float = 0.3) -> np.ndarray:
    blur = X.gaussian(g, 31)
    return np.clip(blur + (1 + alpha) * (g - blur), 0, 255).astype(np.uint8)


def scanner_edges(page: np.ndarray) -> tuple[np.ndarray, int]:
    """The page with long straight edges of one pixel, as scanners leave them, blended into their surroundings; and how many pixels these were."""
    edges = X.canny(X.gray(page), 25, 75)
    found = X.dilate(X.opened(edges, 1, 20) | X.opened(edges, 20, 1), 2, 2)
    if not found.any():
        return page, 0
    return per_channel(page, lambda g: np.where(found, X.median3(g), g)), int(found.sum())


def residue(page: np.ndarray) -> dict:
    """What a crop has left: dark pixels and edge pixels."""
    g = X.gray(page)
    return {"dark": int((g <= 120).sum()), "edges": int(X.canny(g, 30, 90).sum())}


# ---- contrast


@dataclass(frozen=True)
class Contrast:
    """``mode``: adaptive, conservative, white (white stays white, nothing is darkened), sharp or moderate. ``white``: level that becomes the background, if any."""

    mode: str = "adaptive"
    target: float = 180
    tolerance: float = 30
    gamma: float = 1.2
    low: float = 2
    high: float = 98
    clip: float = 2.0
    grid: int = 8
    strength: float = 1.5
    white: int | None = None
    lift: float = 1.0


def tone(g: np.ndarray) -> dict:
    mean, spread = float(g.mean()), float(g.std())
    reach = (int(g.max()) - int(g.min())) / 255 if g.size else 0.0
    ratio = spread / mean if mean > 0 else 0.0
    return {"mean": mean, "ratio": ratio, "reach": reach, "low": ratio < 0.3, "dark": mean < 100, "bright": mean > 180, "scanned": reach < 0.8 and 100 < mean < 200}


def brightened(g: np.ndarray, c: Contrast, t: dict) -> np.ndarray:
    gap = c.target - t["mean"]
    if abs(gap) <= c.tolerance:
        return g
    shift = max(0, min(100, gap)) if c.mode == "white" else max(-50, min(50, gap))
    return np.clip(g.astype(int) + int(shift), 0, 255).astype(np.uint8)


def gamma_for(c: Contrast, t: dict) -> float:
    if c.mode == "white":
        return c.gamma
    return min(c.gamma + 0.3, 2.0) if t["dark"] else max(c.gamma - 0.2, 0.8) if t["bright"] else c.gamma


def stretch(g: np.ndarray, low: float = 2, high: float = 98) -> np.ndarray:
    a, b = np.percentile(g, [low, high])
    return g if b <= a else np.clip((g.astype(X.F32) - a) * 255 / (b - a), 0, 255).astype(np.uint8)


def white_background(g: np.ndarray, level: int = 240, lift: float = 1.0, calm: float = 150) -> np.ndarray:
    """Bright pixels made white; with a ``lift`` above 1 those from 150 are raised first and the ones from 160 become white too; bright pixels of calm surroundings in any case."""
    out = np.where(g >= level, 255, g).astype(np.uint8)
    if lift > 1:
        out = np.where((out >= 150) & (out < level), np.clip(out * lift, 0, 255), out).astype(np.uint8)
        out = np.where(out >= 160, 255, out).astype(np.uint8)
    a = out.astype(float)
    spread = X.box(a * a, 15) - X.box(a, 15) ** 2
    return np.where((spread < calm) & (out > 150), 255, out).astype(np.uint8)


def _finished(g: np.ndarray, c: Contrast, t: dict, keeps_white: bool) -> np.ndarray:
    if c.mode == "sharp":
        return sharpen(unsharp(g, 0.8, 1.2), "standard") if c.strength >= 2 else unsharp(g, 0.8, 1.2)
    if c.mode == "moderate":
        out = sharpen(unsharp(g, 1.0, 0.6), "conservative")
        return X.clahe(out, 1.2) if t["ratio"] < 3 else out
    if keeps_white:
        return g
    out = X.bilateral(g, 3, 10, 10) if c.mode != "conservative" else g
    return stretch(out, 0, 100) if t["reach"] < 0.9 else out


def enhance(page: np.ndarray, c: Contrast = Contrast()) -> np.ndarray:
    """Gray: brightness, gamma, stretch, global equalisation where contrast is poor, local equalisation, sharpening, white background, finish."""
    g = X.gray(page)
    t = tone(g)
    keeps_white = c.mode == "white" or c.white is not None
    g = brightened(g, c, t)
    g = ((np.arange(256) / 255.0) ** (1 / gamma_for(c, t)) * 255).astype(np.uint8)[g]
    if not keeps_white:
        g = stretch(g, c.low, c.high)
        if c.mode != "conservative" and t["low"] and t["reach"] < 0.5 and not t["bright"]:
            g = X.equalize(g)
    g = X.clahe(g, min(c.clip, 1.5), 12) if t["scanned"] else X.clahe(g, c.clip, c.grid)
    strength = c.strength * (1.2 if t["low"] else 0.8 if t["scanned"] else 1.0)
    g = X.filter2(g, _cross(1 + 4 * strength, -strength))
    if c.white is not None:
        g = white_background(g, c.white, c.lift)
    return _finished(g, c, t, keeps_white)
