"""What is on a page besides text: objects by size and shape, stamps and signatures by colour, rules, layout labels."""

from __future__ import annotations

import numpy as np

from scanloom.kernels import raster as X

# Hue ranges (0 to 179) with least saturation and value; black by value alone.
REDDISH, BLUISH, BLACK = ((0, 25, 30, 30), (165, 180, 30, 30)), ((100, 130, 50, 50),), 80


def ink_boxes(page: np.ndarray) -> dict[str, list[dict]]:
    """Boxes that by size and shape may be form fields, signatures, barcodes, logos or (round) stamps."""
    g = X.gray(page)
    found = X.regions(X.closed(g < X.otsu(g) + 1, 3, 3))
    fill = lambda r: r["area"] / (r["w"] * r["h"])
    kinds = {
        "form_field": lambda r, a, n: 1000 < n < 50_000 and a > 2,
        "signature": lambda r, a, n: 500 < n < 20_000 and 1.5 < a < 8 and fill(r) < 0.5,
        "barcode": lambda r, a, n: 1000 < n < 30_000 and 2 < a < 10 and fill(r) > 0.5,
        "logo": lambda r, a, n: 1000 < n < 20_000 and 0.5 < a < 2 and fill(r) > 0.3,
    }
    out = {k: [{n: r[n] for n in "xywh"} for r in found if test(r, r["w"] / r["h"], r["w"] * r["h"])] for k, test in kinds.items()}
    return out | {"stamp": circles(g)}


def circles(g: np.ndarray, least: int = 20, most: int = 100) -> list[dict]:
    """Boxes of round outlines with a radius between ``least`` and ``most``: edge pixels vote for centres along their gradient, radius by radius."""
    small = X.resize(g, max(1, g.shape[0] // 2), max(1, g.shape[1] // 2), "area") if max(g.shape) > 600 else g
    f = g.shape[0] / small.shape[0]
    smooth = X.gaussian(small, 7) if min(small.shape) > 7 else small.astype(X.F32)
    ys, xs = np.nonzero(X.canny(np.rint(smooth).astype(np.uint8)))
    if not len(ys):
        return []
    gx, gy = X.sobel(smooth)
    norm = np.hypot(gx, gy)[ys, xs]
    ux, uy = gx[ys, xs] / np.maximum(norm, 1e-6), gy[ys, xs] / np.maximum(norm, 1e-6)
    h, w = small.shape
    found: list[tuple[float, int, int, int]] = []
    for radius in range(max(4, int(least / f)), int(most / f) + 1, 2):
        cy, cx = (np.rint(np.concatenate([c + radius * u, c - radius * u])).astype(int) for c, u in ((ys, uy), (xs, ux)))
        inside = (cy >= 0) & (cy < h) & (cx >= 0) & (cx < w)
        cy, cx = cy[inside], cx[inside]
        # A window of 5 by 5 lies in four cells of that size: where no cell has a quarter of the votes needed, no window has them all.
        if min(h, w) <= 5 or np.bincount(cy // 5 * w + cx // 5, minlength=1).max() < 0.5 * 2 * np.pi * radius / 4:
            continue
        near = X.box(np.bincount(cy * w + cx, minlength=h * w).reshape(h, w), 5) * 25
        at = int(near.argmax())
        # A round outline gives about a vote for each pixel of its circumference.
        if near.flat[at] > 0.5 * 2 * np.pi * radius:
            found.append((float(near.flat[at]) / radius, at // w, at % w, radius))
    out: list[tuple[int, int, int]] = []
    for _, cy, cx, radius in sorted(found, reverse=True):
        if all(np.hypot(cy - y, cx - x) > max(radius, r) for y, x, r in out):
            out.append((cy, cx, radius))
    return [{"x": int((x - r) * f), "y": int((y - r) * f), "w": int(2 * r * f), "h": int(2 * r * f)} for y, x, r in out]


def mark_kind(region: np.ndarray) -> str:
    """'stamp' where red is the most of the inks and more than a tenth, else 'signature'."""
    c = X.hsv(region).astype(int)
    share = lambda spans: np.any([(c[..., 0] >= a) & (c[..., 0] <= b) & (c[..., 1] >= s) & (c[..., 2] >= v) for a, b, s, v in spans], 0).mean()
    red, blue, black = share(REDDISH), share(BLUISH), (c[..., 2] <= BLACK).mean()
    return "stamp" if red > 0.1 and red > blue and red > black else "signature"


def coloured_marks(page: np.ndarray, mask: np.ndarray, least: int = 500, most: float = 0.3, skip: float = 0.2) -> list[dict]:
    """Boxes of coloured regions from ``least`` pixels to a share of the page, with their kind; those of more than ``skip`` of it are background."""
    out = []
    for r in X.regions(X.closed(mask, 5, 5)):
        n = r["w"] * r["h"]
        if least <= r["area"] <= most * mask.size and n <= skip * mask.size:
            out.append({n: r[n] for n in "xywh"} | {"type": mark_kind(page[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]])})
    return out


def objects(g: np.ndarray) -> dict:
    """Dark objects by size (small below 100, medium below 1,000, else large) and how complex that makes the page, 0 to 100."""
    areas = np.array([r["area"] for r in X.regions(g < X.otsu(g) + 1)])
    small, medium = int((areas < 100).sum()), int(((areas >= 100) & (areas < 1000)).sum())
    large, total = len(areas) - small - medium, len(areas)
    return {"small": small, "medium": medium, "large": large, "complexity": min(100.0, 20.0 * (small + 2 * medium + 3 * large) / total) if total else 0.0}


def table_score(g: np.ndarray, *, faithful: bool = False) -> float:
    """How much of the page long rules cover, 0 to 100. ``faithful`` looks at the page as it is, where any bright page scores 100, instead of at its ink."""
    ink = g > 0 if faithful else g < X.otsu(g) + 1
    rules = X.opened(ink, 1, 40).mean() + X.opened(ink, 40, 1).mean()
    return float(min(100.0, 1000.0 * rules))


def special(g: np.ndarray) -> list[str]:
    """Watermarks (equalisation changes much), ruled lines and high contrast."""
    found = []
    if np.abs(g.astype(int) - X.equalize(g)).mean() > 10:
        found.append("possible_watermark")
    if X.opened(g < X.otsu(g) + 1, 1, 40).mean() > 0.01:
        found.append("ruled_lines")
    if g.std() > 80:
        found.append("high_contrast_text")
    return found


def grid_labels(densities: list[float]) -> list[str]:
    return ["dense" if d > 0.3 else "text" if d > 0.1 else "whitespace" for d in densities]


def page_features(page: np.ndarray, grid: list[float]) -> dict:
    """The struct of a page's features: counts of objects, rules, layout and special traits."""
    g = X.gray(page)
    boxes = ink_boxes(page)
    return objects(g) | {f"{k}s": len(v) for k, v in boxes.items()} | {"table_score": table_score(g), "special": special(g), "layout": grid_labels(grid)}
