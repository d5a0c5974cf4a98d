"""Measures and corrections of one page, on the primitives of ``raster``. Pages are uint8, gray (h, w) or BGR (h, w, 3)."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from functools import cached_property

import numpy as np

from scanloom.kernels import enhance as E
from scanloom.kernels import features as T
from scanloom.kernels import raster as X


def shrink(page: np.ndarray, most: int) -> np.ndarray:
    h, w = page.shape[:2]
    if max(h, w) <= most:
        return page
    f = most / max(h, w)
    return X.resize(page, max(1, round(h * f)), max(1, round(w * f)), "area")


# ---- blank pages and quality


class View:
    """A page with what several of its measures start from, computed when first asked for."""

    def __init__(self, page: np.ndarray) -> None:
        self.page, self.g = page, X.gray(page)

    @cached_property
    def edges(self) -> np.ndarray:
        return X.canny(self.g)

    @cached_property
    def dark(self) -> np.ndarray:
        return self.g < 200

    @cached_property
    def columns(self) -> np.ndarray:
        return self.g.mean(0)

    @cached_property
    def rows(self) -> np.ndarray:
        return self.g.mean(1)

    @cached_property
    def grid(self) -> list[float]:
        return [float(c.mean()) for r in np.array_split(self.dark, 3, 0) for c in np.array_split(r, 3, 1)]

    @cached_property
    def text_share(self) -> float:
        found = X.extents(self.edges)
        size = found["w"] * found["h"]
        return float(((size > 50) & (size < 5000)).sum() / max(1, len(size)))

    @cached_property
    def gradient(self) -> float:
        return float(np.hypot(*X.sobel(self.g)).mean())


_BASE: dict[str, Callable[[View], object]] = {
    "width": lambda v: v.g.shape[1], "height": lambda v: v.g.shape[0], "brightness": lambda v: float(v.g.mean()), "contrast": lambda v: float(v.g.std()), "sharpness": lambda v: float(X.laplacian(v.g).var()),
    "edge_density": lambda v: X.share(v.edges), "text_share": lambda v: v.text_share, "white_share": lambda v: X.share(v.g > 245),
    "text_density": lambda v: blank_density(v.g), "noise": lambda v: float(np.abs(v.g - X.box(v.g, 5)).mean() / 255), "gradient": lambda v: v.gradient,
    "margin_left": lambda v: _margin(v.columns), "margin_right": lambda v: _margin(v.columns[::-1]), "margin_top": lambda v: _margin(v.rows), "margin_bottom": lambda v: _margin(v.rows[::-1]),
    "left": lambda v: int(v.dark[:, : v.g.shape[1] // 2].sum()), "right": lambda v: int(v.dark[:, v.g.shape[1] // 2 :].sum()), "top": lambda v: int(v.dark[: v.g.shape[0] // 2].sum()), "bottom": lambda v: int(v.dark[v.g.shape[0] // 2 :].sum()),
    "grid": lambda v: v.grid, "columns": lambda v: text_columns(v.g), "multipage": lambda v: looks_multipage(v.g), "orientation_confidence": lambda v: orientation_confidence(v.g),
    "features": lambda v: T.page_features(v.page, v.grid), "residue": lambda v: E.residue(v.page),
}


def measures(page: np.ndarray, only: Collection[str] | None = None) -> dict:
    """What the rules decide upon: brightness, contrast, sharpness, densities, noise, white share, margins, grid, halves; ``only`` those named, if any are."""
    view = View(page)
    return {n: f(view) for n, f in _BASE.items() if only is None or n in only}


def blank_density(g: np.ndarray) -> float:
    """Share of pixels near edges, after smoothing: next to nothing on a blank page."""
    edges = X.canny(np.rint(X.gaussian(g, 5)).astype(np.uint8))
    return X.share(X.dilate(edges, 3, 3))


def _margin(profile: np.ndarray, level: float = 240) -> int:
    """How far from the edge the first line darker than ``level`` is, searched in a quarter and 100 lines at most."""
    reach = min(len(profile) // 4, 100)
    dark = np.nonzero(profile[:reach] < level)[0]
    return int(dark[0]) if len(dark) else reach


def text_columns(g: np.ndarray) -> int:
    """One more than the strict minima of the ink profile below 30 % of its mean; five at most."""
    ink = (255 - g.astype(float)).sum(0)
    low = (ink[1:-1] < ink[:-2]) & (ink[1:-1] < ink[2:]) & (ink[1:-1] < 0.3 * ink.mean())
    return min(int(low.sum()) + 1, 5)


# ---- orientation and skew


def _lines(mask: np.ndarray) -> float:
    return X.share(X.opened(mask, 1, max(3, mask.shape[1] // 30)))


def _structure(g: np.ndarray, ink: np.ndarray) -> float:
    rows = ink.mean(1)
    return 0.3 * _lines(ink) * 10 + 0.3 * float(np.abs(np.diff(rows)).mean()) * 10 + 0.2 / (1 + rows.var() * 100) + 0.2 * X.share(X.canny(g))


def _rows(g: np.ndarray, _: np.ndarray) -> float:
    rows = (g < 128).mean(1)
    return float(rows.var())


def _alignment(g: np.ndarray, ink: np.ndarray) -> float:
    """Boxes of ink that begin at one height: many in text that lies flat."""
    found = X.extents(ink)
    fit = (4 < found["area"]) & (found["area"] < g.size // 20)
    if fit.sum() < 5:
        return 0.0
    return 1 / (1 + float(np.median(found["h"][fit] / found["w"][fit])))


def _zebra(g: np.ndarray, _: np.ndarray) -> float:
    side = min(g.shape)
    profile = (g[:side, :side] < 140).mean(1)
    near = np.stack([np.roll(profile, k) for k in range(-2, 3)]).max(0)
    return float(((profile >= near) & (profile > profile.mean() + 0.1 * profile.std())).sum() and profile.std())


def _votes(page: np.ndarray, scores: tuple[Callable[[np.ndarray, np.ndarray], float], ...]) -> Iterator[int]:
    g = shrink(X.gray(page), 400)
    ink = g < X.otsu(g) + 1
    turned = {a: (X.rotate(g, a), X.rotate(ink, a)) for a in (0, 90, 180, 270)}
    for score in scores:
        yield max(turned, key=lambda a: (round(score(*turned[a]), 9), -a))


def orientation_votes(page: np.ndarray) -> list[int]:
    """Four votes among 0, 90, 180 and 270 degrees; equal scores go to the smaller angle."""
    return list(_votes(page, (_structure, _alignment, _rows, _zebra)))


def agreed_rotation(page: np.ndarray) -> int:
    """The angle that all votes agree on, else 0 (``rules.agreed_rotation``). The quickest vote first, and none after two differ."""
    votes = _votes(page, (_rows, _zebra, _alignment, _structure))
    first = next(votes)
    return first if all(v == first for v in votes) else 0


def skew_estimates(page: np.ndarray, reach: float = 15, only: Collection[str] | None = None) -> dict:
    """Angles in degrees by projection, Hough lines and text lines, with the lines' counts as confidence; ``only`` those named, if any are. The page is turned by minus the angle to level it."""
    asked = lambda *names: only is None or any(n in only for n in names)
    g = shrink(X.gray(page), 600)
    ink = g < X.otsu(g) + 1
    out = {}
    if asked("projection"):
        out["projection"] = _projection(ink, reach)
    if asked("hough", "hough_confidence"):
        out["hough"], out["hough_confidence"] = X.hough_angles(X.canny(g), least=min(120, g.shape[1] // 3), reach=reach)
    if asked("text", "text_confidence"):
        boxes = [r for r in _boxes(X.closed(ink, 1, 10)) if r["w"] > 30 and r["w"] > 3 * r["h"]]
        slopes = [_slope(ink, r) for r in sorted(boxes, key=lambda r: -r["area"])[:100]]
        out |= {"text": float(np.median(slopes)) if slopes else 0.0, "text_confidence": len(slopes)}
    return out if only is None else {n: x for n, x in out.items() if n in only}


def _projection(ink: np.ndarray, reach: float) -> float:
    """The angle at which the ink lies in the fewest lines."""
    ys, xs = np.nonzero(ink)
    ys, xs = ys - ink.shape[0] / 2, xs - ink.shape[1] / 2
    if not len(ys):
        return 0.0

    def spread(angle: float) -> float:
        # The variance.
        lines = X.projection(ys, xs, np.deg2rad(angle))
        away = lines - len(ys) / len(lines)
        return float(np.add.reduce(away * away) / len(lines))

    best = max(np.arange(-reach, reach + 0.25, 0.5), key=spread)
    return round(float(max(np.arange(best - 1, best + 1.05, 0.1), key=spread)), 1)


def _boxes(mask: np.ndarray) -> list[dict]:
    found = X.extents(mask)
    return [dict(zip(found, v)) for v in zip(*(a.tolist() for a in found.values()))]


def _slope(ink: np.ndarray, r: dict) -> float:
    """The angle of the least box around a line's ink."""
    line = ink[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]]
    xs = np.flatnonzero(line.any(0))
    return X.least_box_angle_of(X.around(xs, line.argmax(0)[xs], len(line) - 1 - line[::-1].argmax(0)[xs])) if len(xs) else 0.0


def skew_decision(e: dict) -> float:
    """The one angle that the rule ``rules.skew_angle`` makes of the estimates."""
    proj, hough, text = e["projection"], e["hough"], e["text"]
    if abs(proj) > 3 and (abs(hough - proj) < 2 or abs(text - proj) < 2):
        return proj
    if e["hough_confidence"] > 5 and abs(hough) > 3:
        return hough
    if e["text_confidence"] > 3 and abs(text) > 3:
        return text
    parts = [(proj, 3.0 * (abs(proj) > 3)), (hough, 2.0 * (e["hough_confidence"] > 0)), (text, 1.5 * (e["text_confidence"] > 0))]
    weight = sum(w for _, w in parts)
    return sum(a * w for a, w in parts) / weight if weight else proj


def deskew(page: np.ndarray, angle: float, least: float = 3.0) -> np.ndarray:
    """The page turned level; angles below ``least`` degrees are left."""
    return page if abs(angle) < least else X.rotate(page, angle, fill=255)


# ---- crop, gaps, holes


def content_box(page: np.ndarray, density: float = 0.02, quiet: float = 0.001, reach: tuple[int, int] = (150, 100), window: int = 10) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1) of the ink: rows and columns of enough ink, widened to the next quiet window within reach."""
    g = X.gray(page)
    ink = g < X.otsu(g) + 1

    def span(profile: np.ndarray, most: int) -> tuple[int, int]:
        dense = np.nonzero(profile > density)[0]
        if not len(dense):
            return 0, len(profile)
        lo, hi = int(dense[0]), int(dense[-1]) + 1
        for k in range(0, most):
            if lo - k - window >= 0 and profile[lo - k - window : lo - k].mean() < quiet:
                lo -= k
                break
        for k in range(0, most):
            if hi + k + window <= len(profile) and profile[hi + k : hi + k + window].mean() < quiet:
                hi += k
                break
        return lo, hi

    (x0, x1), (y0, y1) = span(ink.mean(0), reach[0]), span(ink.mean(1), reach[1])
    return x0, y0, x1, y1


def crop(page: np.ndarray, *, fast: bool = False) -> np.ndarray:
    """The ink's box, without punch holes and, unless ``fast``, without the edges that scanners leave."""
    x0, y0, x1, y1 = content_box(page)
    cut = punch_holes(page[y0:y1, x0:x1])
    return cut if fast else E.scanner_edges(cut)[0]


def hole_mask(page: np.ndarray) -> np.ndarray:
    """The mask of dark round spots."""
    g = X.gray(page)
    mask = X.opened(g < 100, 3, 3)
    labels, _ = X.label(mask)
    holes = [i + 1 for i, r in enumerate(X.regions(mask)) if 15 <= r["area"] <= 400 and 4 * np.pi * r["area"] / max(1, r["perimeter"]) ** 2 > 0.5 and 0.7 < r["w"] / r["h"] < 1.4]
    return X.dilate(np.isin(labels, holes), 3, 3) if holes else np.zeros(g.shape, bool)


def punch_holes(page: np.ndarray) -> np.ndarray:
    """Punch holes filled from around them."""
    holes = hole_mask(page)
    return E.per_channel(page, lambda g: X.fill_holes(g, holes)) if holes.any() else page


def page_bounds(page: np.ndarray, bright: float = 0.95, gap: float = 0.05, least: float = 0.2) -> list[tuple[int, int]]:
    """(x_start, x_end) of the pages on a scan: what lies between wide bright gaps."""
    profile = X.gray(page).mean(0) / 255
    w = len(profile)
    edge = np.diff(np.pad((profile > bright).astype(np.int8), 1))
    out, left = [], 0
    for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]):
        if b - a >= int(gap * w):
            if a - left >= int(least * w):
                out.append((left, int(a)))
            left = int(b)
    if w - left >= int(least * w):
        out.append((left, w))
    return out


def split(page: np.ndarray, margin: int = 20) -> list[np.ndarray]:
    return [page[:, max(0, a - margin) : b + margin] for a, b in page_bounds(page)]


# ---- size, noise, contrast


def standard_size(page: np.ndarray, short: int = 2079, long: int = 2923, *, recognition: str | None = None) -> np.ndarray:
    """Scaled into an A4 page at 250 dpi, lying or standing as the page does. Enlarged pages are sharpened; ``recognition`` names a mode of ``for_recognition`` to follow."""
    h, w = page.shape[:2]
    most_w, most_h = (long, short) if w > h else (short, long)
    f = min(most_w / w, most_h / h)
    H, W = max(1, int(h * f)), max(1, int(w * f))
    if f > 4:
        out = E.enlarge(page, H, W)
    else:
        out = X.resize(page, H, W, "lanczos" if f > 1 else "area")
    out = E.sharpen_scaled(out, f) if f > 1 else out
    return E.for_recognition(out, recognition) if recognition else out


def noise_measures(g: np.ndarray) -> dict:
    gx, gy = X.sobel(g)
    slope = np.hypot(gx, gy)
    calm = slope <= np.percentile(slope, 20)
    return {
        "noise": float(X.laplacian(g).var() / 1e4), "background": float(g[calm].var()) if calm.any() else 0.0, "salt_pepper": float(((g == 0) | (g == 255)).mean()),
        "spots": float((np.abs(g.astype(int) - X.median3(g)) > 60).mean()), "bleeds": E.bleeds_through(g), "text_density": float((g < 128).mean()),
    }


def denoise(page: np.ndarray, *, median: bool = True, smooth: bool = True, nlm: bool = True, background: bool = True, cleanup: bool = True, faithful: bool = False) -> np.ndarray:
    """Gray: spots by the median, grain by the bilateral filter, what is left by non-local means; then the background, what shines through, and a last sharpening.

    The median is for spots that stand out from their surroundings; ``faithful`` takes all black and white pixels for such.
    """
    g = X.gray(page)
    found = noise_measures(g)
    if median and found["salt_pepper" if faithful else "spots"] > 0.01:
        g = X.median3(g)
    if smooth:
        g = X.bilateral(g)
    if nlm and found["noise"] > 0.02 and X.laplacian(g).var() / 1e4 > 0.02:
        g = X.nonlocal_means(g)
    if background:
        g = E.clean_background(g)
    if background and found["bleeds"]:
        g = E.without_bleeding(g)
    return E.sharpen(g, "cleanup") if cleanup else g


def enhance(page: np.ndarray, **options) -> np.ndarray:
    """The contrast chain, with the fields of ``Contrast`` as options."""
    return E.enhance(page, E.Contrast(**options))


white_background, clean_background, ink_boxes = E.white_background, E.clean_background, T.ink_boxes


# ---- colour

# Hue ranges of inks, 0 to 179.
INKS = {"red": ((0, 25), (155, 180)), "green": ((40, 85),), "blue": ((85, 145),), "purple": ((145, 170),)}


def ink_masks(page: np.ndarray, least: int = 30) -> dict[str, np.ndarray]:
    c = X.hsv(page).astype(int)
    vivid = (c[..., 1] >= least) & (c[..., 2] >= least)
    return {n: vivid & np.any([(c[..., 0] >= a) & (c[..., 0] <= b) for a, b in spans], 0) for n, spans in INKS.items()}


def colour_regions(page: np.ndarray) -> list[dict]:
    """Stamps (red, green, purple; compact) and signatures (blue, purple; any but near-square-filling) as boxes with measures."""
    if page.ndim == 2:
        return []
    out, masks = [], ink_masks(page)
    h, w = page.shape[:2]
    for kind, inks, areas, fill, grow in (("stamp", ("red", "green", "purple"), (100, 50_000), 0.05, 15), ("signature", ("blue", "purple"), (50, 20_000), 0.03, 10)):
        for ink in inks:
            closed = X.closed(masks[ink], 5, 5)
            labels, _ = X.label(closed)
            for i, r in enumerate(X.regions(closed), 1):
                if not areas[0] <= r["area"] <= areas[1] or r["area"] / (r["w"] * r["h"]) < fill:
                    continue
                ys, xs = np.nonzero(labels[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]] == i)
                aspect, solid = r["w"] / r["h"], r["area"] / max(1.0, X.hull_area(np.stack([xs, ys], 1)))
                round_ = 4 * np.pi * r["area"] / max(1.0, r["perimeter"]) ** 2
                if kind != "stamp" or (round_ > 0.1 and 0.3 <= aspect <= 3 and solid > 0.4):
                    x, y = max(0, r["x"] - grow), max(0, r["y"] - grow)
                    out.append({"type": kind, "ink": ink, "x": x, "y": y, "w": min(w, r["x"] + r["w"] + grow) - x, "h": min(h, r["y"] + r["h"] + grow) - y, "area": float(r["area"]), "circularity": float(min(1.0, round_)), "aspect_ratio": float(aspect), "solidity": float(solid)})
    return out


def gray_with_colour(page: np.ndarray, factor: float = 1.0) -> np.ndarray:
    """A gray copy for recognition in which coloured regions keep their colour: locally equalised and slightly raised, by a tenth of its brightness at most."""
    g = X.gray(page)
    raised = np.clip(X.clahe(g, min(1.2, factor * 1.2), 16) * 1.02, 0, 255)
    if g.mean() > 0 and raised.mean() / g.mean() > 1.1:
        raised = raised * (1.1 * g.mean() / raised.mean())
    out = np.repeat(raised.astype(np.uint8)[..., None], 3, -1)
    for r in colour_regions(page):
        box = np.s_[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]]
        out[box] = page[box]
    return out


# ---- synthetic pages


def synthetic(width: int, height: int, skew: float = 0.0, *, pages: int = 1, gap: float = 0.1, lines: int = 16, seed: int = 0, blank: bool = False) -> np.ndarray:
    """A white page with bars for text lines and rules, turned by a planted skew; several pages side by side with a white gap."""
    rng = np.random.default_rng(seed)
    g = np.full((height, width), 255, np.uint8)
    if not blank:
        each = width * (1 - gap * (pages + 1)) / pages
        # A word with its space takes eight pixels at least; the numbers are those of one draw a word.
        words = iter(rng.integers(4, max(5, int(each / 8)), pages * lines * (max(0, int(each)) // 8 + 1)).tolist())
        for p in range(pages):
            left = int(gap * width + p * (each + gap * width))
            right = int(left + each)
            for i in range(lines):
                y = int(height * 0.1 + i * height * 0.8 / lines)
                x = left
                bar = bytearray(b"\xff" * width)
                while x < left + each - 8:
                    n = next(words)
                    end = min(right, x + n, width)
                    bar[x:end] = b"\x1e" * (end - x)
                    x += n + 4
                rows = g[y : y + max(2, height // 100)]
                np.minimum(rows, np.frombuffer(bar, np.uint8), out=rows)
    return X.rotate(g, -skew, expand=False) if skew else g


# ---- layout, regions of interest, outputs


def thumbnail(page: np.ndarray, most: int = 200) -> np.ndarray:
    return shrink(page, most)


def text_region(page: np.ndarray, margin: int = 20) -> np.ndarray:
    """What is of interest: the text's box on a mostly white page, else the gray page with its colours kept where there are any."""
    g = X.gray(page)
    if (g > 240).mean() > 0.6:
        ink = X.opened(X.closed(g < 200, 5, 5), 2, 2)
        ys, xs = np.nonzero(ink)
        if len(ys):
            h, w = g.shape
            return page[max(0, ys.min() - margin) : min(h, ys.max() + margin + 1), max(0, xs.min() - margin) : min(w, xs.max() + margin + 1)]
        return page
    if page.ndim == 3 and np.any([m.mean() > 0.01 for m in ink_masks(page).values()]):
        return gray_with_colour(page)
    return g


def marks(page: np.ndarray) -> list[dict]:
    """Stamps and signatures among the coloured regions of a page: boxes with their type."""
    if page.ndim == 2:
        return []
    return T.coloured_marks(page, np.any(list(ink_masks(page).values()), 0))


def parts(page: np.ndarray, margin: int = 20) -> list[np.ndarray]:
    """The pages of a scan, or, of a single one, what is of interest on it."""
    found = split(page, margin)
    return found if len(found) > 1 else [text_region(page, margin)]


def looks_multipage(g: np.ndarray) -> bool:
    """More than a tenth of the rows hold next to no ink compared with the mean."""
    ink = (g < 200).mean(1)
    return bool((ink < 0.1 * ink.mean()).mean() > 0.1)


def orientation_confidence(g: np.ndarray) -> float:
    """How much more the page has of horizontal than of vertical strokes."""
    ink = g < X.otsu(g) + 1
    across, down = X.share(X.opened(ink, 1, 15)), X.share(X.opened(ink, 15, 1))
    return min(1.0, across / max(down, 0.001)) if across > down else 0.5


def comparison(before: np.ndarray, after: np.ndarray, gap: int = 10) -> np.ndarray:
    """Two pages side by side, in BGR, the lower one filled up with white."""
    sides = [np.repeat(p[..., None], 3, -1) if p.ndim == 2 else p for p in (before, after)]
    h = max(p.shape[0] for p in sides)
    filled = [np.pad(p, ((0, h - p.shape[0]), (0, 0), (0, 0)), constant_values=255) for p in sides]
    return np.concatenate([filled[0], np.full((h, gap, 3), 255, np.uint8), filled[1]], 1)
