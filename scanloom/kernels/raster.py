"""Pixel primitives on NumPy arrays: uint8 gray pages (h, w) or colour pages (h, w, 3) in BGR order.

Whole-array operations throughout; no loop over pixels. Borders are reflected unless said otherwise.
"""

from __future__ import annotations

import functools

import numpy as np

F32 = np.float32


def gray(page: np.ndarray) -> np.ndarray:
    if page.ndim == 2:
        return page
    b, g, r = (page[..., i].astype(F32) for i in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)


def hsv(page: np.ndarray) -> np.ndarray:
    """Hue 0 to 179, saturation and value 0 to 255."""
    b, g, r = (page[..., i].astype(F32) for i in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = np.where(top == low, 1, top - low)
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span)) * 30 % 180
    sat = np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0)
    return np.stack([np.where(top == low, 0, np.rint(hue) % 180), np.rint(sat), top], -1).astype(np.uint8)


def _linear(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)


# Linear RGB to XYZ for the D65 white, divided by that white.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]) / np.array([[0.950456], [1.0], [1.088754]])


def lab(page: np.ndarray) -> np.ndarray:
    """Lightness 0 to 100, a and b."""
    xyz = _linear(page[..., ::-1] / 255.0) @ _XYZ.T
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    rgb = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) @ np.linalg.inv(_XYZ).T
    rgb = np.clip(rgb, 0, None)
    out = np.where(rgb > 0.0031308, 1.055 * rgb ** (1 / 2.4) - 0.055, 12.92 * rgb)
    return np.clip(np.rint(out[..., ::-1] * 255), 0, 255).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """The threshold that separates the histogram best."""
    hist = np.bincount(g.ravel(), minlength=256).astype(float)
    w = np.cumsum(hist)
    m = np.cumsum(hist * np.arange(256))
    total, mean = w[-1], m[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean * w / total - m) ** 2 / (w * (total - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def _filter1(a: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    r = len(k) // 2
    pad = [(r, r) if i == axis else (0, 0) for i in range(a.ndim)]
    p = np.pad(a, pad, mode="reflect" if a.shape[axis] > r else "edge")
    n = a.shape[axis]
    return sum(w * _part(p, i, i + n, axis) for i, w in enumerate(k))


def _part(a: np.ndarray, start: int, stop: int, axis: int) -> np.ndarray:
    """A view of the cells from ``start`` to ``stop`` of one axis."""
    return a[start:stop] if axis == 0 else a[:, start:stop]


def separable(a: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _filter1(_filter1(a.astype(F32), k, 0), k, 1)


def gaussian(a: np.ndarray, size: int, sigma: float = 0) -> np.ndarray:
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    return separable(a, (k / k.sum()).astype(F32))


def box(a: np.ndarray, size: int) -> np.ndarray:
    """Mean of a square window, by sums of sums; small windows of uint8 pages in short whole numbers."""
    r, (h, w) = size // 2, a.shape
    if a.dtype == np.uint8 and size % 2 and size * size * 255 < 1 << 15:
        p = np.pad(a, r, mode="reflect" if min(a.shape) > r else "edge").astype(np.int16)
        p = sum(p[i : i + h] for i in range(size))
        return sum(p[:, i : i + w] for i in range(size)).astype(float) / size**2
    p = np.pad(a.astype(float), r, mode="reflect" if min(a.shape) > r else "edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def filter2(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with a small kernel, saturated for uint8."""
    kh, kw = kernel.shape
    p = np.pad(a.astype(F32), ((kh // 2,) * 2, (kw // 2,) * 2), mode="reflect")
    h, w = a.shape
    out = sum(kernel[i, j] * p[i : i + h, j : j + w] for i in range(kh) for j in range(kw) if kernel[i, j])
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if a.dtype == np.uint8 else out


def adaptive(g: np.ndarray, size: int = 11, offset: float = 2, inverse: bool = True) -> np.ndarray:
    dark = g <= gaussian(g, size) - offset
    return dark if inverse else ~dark


def _slide(mask: np.ndarray, n: int, axis: int, pick) -> np.ndarray:
    """Maximum or minimum over n cells, by doubling; cells outside don't count."""
    fill = pick is np.minimum
    before, after = n // 2, n - 1 - n // 2
    sides = list(mask.shape)
    sides[axis] += before + after
    out = np.full(sides, fill, mask.dtype)
    _part(out, before, before + mask.shape[axis], axis)[...] = mask
    done = 1
    while done < n:
        step, cells = min(done, n - done), out.shape[axis]
        out = pick(_part(out, 0, cells - step, axis), _part(out, step, cells, axis))
        done += step
    return out


def dilate(mask: np.ndarray, h: int, w: int) -> np.ndarray:
    return _slide(_slide(mask, h, 0, np.maximum), w, 1, np.maximum)


def erode(mask: np.ndarray, h: int, w: int) -> np.ndarray:
    return _slide(_slide(mask, h, 0, np.minimum), w, 1, np.minimum)


def opened(mask: np.ndarray, h: int, w: int) -> np.ndarray:
    return dilate(erode(mask, h, w), h, w)


def closed(mask: np.ndarray, h: int, w: int) -> np.ndarray:
    return erode(dilate(mask, h, w), h, w)


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    smooth, slope = np.array([1, 2, 1], F32), np.array([-1, 0, 1], F32)
    if g.dtype == np.uint8 and min(g.shape) > 1:
        gx, gy = _slopes(g)
        return gx.astype(F32), gy.astype(F32)
    a = g.astype(F32)
    return _filter1(_filter1(a, smooth, 0), slope, 1), _filter1(_filter1(a, slope, 0), smooth, 1)


def _mirrored(g: np.ndarray) -> np.ndarray:
    """In short whole numbers, with one more cell on each side, reflected."""
    h, w = g.shape
    p = np.empty((h + 2, w + 2), np.int16)
    p[1:-1, 1:-1] = g
    p[0, 1:-1], p[-1, 1:-1] = g[1], g[-2]
    p[:, 0], p[:, -1] = p[:, 2], p[:, -3]
    return p


def share(mask: np.ndarray) -> float:
    """How much of a mask is set."""
    return float(np.count_nonzero(mask) / mask.size)


def _slopes(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sobel`` of uint8 pages in whole numbers, which hold it exactly."""
    p = _mirrored(g)
    down = p[:-2] + 2 * p[1:-1] + p[2:]
    across = p[2:] - p[:-2]
    return down[:, 2:] - down[:, :-2], across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:]


def laplacian(g: np.ndarray) -> np.ndarray:
    if g.dtype == np.uint8 and min(g.shape) > 1:
        p = _mirrored(g)
        return (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).astype(F32)
    return filter2(g.astype(F32), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], F32))


def canny(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges: gradient ridges above ``low`` that are connected to one above ``high``. Only pixels above ``low`` are looked at."""
    gx, gy = _slopes(g) if g.dtype == np.uint8 and min(g.shape) > 1 else sobel(g)
    h, w = g.shape
    wide = w + 2
    mag = np.zeros((h + 2, wide), gx.dtype)
    np.add(np.abs(gx), np.abs(gy), out=mag[1:-1, 1:-1])
    mag = mag.ravel()
    at = np.flatnonzero(mag > low)
    cell = at - wide - 1 - 2 * (at // wide - 1)
    dx, dy = gx.ravel()[cell].astype(F32), gy.ravel()[cell].astype(F32)
    ax, ay = np.abs(dx), np.abs(dy)
    step = np.where(ay < 0.4142 * ax, 1, np.where(ay > 2.4142 * ax, wide, np.where(dx * dy > 0, wide + 1, wide - 1)))
    m = mag[at]
    ridge = (m > mag[at - step]) & (m >= mag[at + step])
    at, cell, strong = at[ridge], cell[ridge], m[ridge] > high
    out = np.zeros(h * w, bool)
    if strong.all():
        out[cell] = True
    elif strong.any():
        # The padding keeps the runs of two rows apart.
        cut = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        root = _joined(at[cut], at[np.append(cut[1:], len(at)) - 1] + 1, wide)
        kept = np.zeros(len(cut), bool)
        kept[root[np.logical_or.reduceat(strong, cut)]] = True
        out[cell] = np.repeat(kept[root], np.diff(np.append(cut, len(at))))
    return out.reshape(h, w)


def _joined(starts: np.ndarray, stops: np.ndarray, wide: int) -> np.ndarray:
    """For each run of cells (places in rows of ``wide`` cells, of which one at least is empty, in order) the least run it is connected to, corners included. Runs are linked to those they touch above, and hooked to the least until stable."""
    n = len(starts)
    first, stop = np.searchsorted(stops, starts - wide), np.searchsorted(starts, stops - wide, "right")
    count = np.maximum(stop - first, 0)
    b = np.repeat(np.arange(n), count)
    a = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and end of each run of a mask's rows, in order."""
    h, w = mask.shape
    p = np.zeros((h, w + 2), np.int8)
    p[:, 1:-1] = mask
    p = p.ravel()
    turns = np.flatnonzero(p[1:] != p[:-1]) + 1
    rows = turns[::2] // (w + 2)
    return rows, turns[::2] - rows * (w + 2) - 1, turns[1::2] - rows * (w + 2) - 1


def _numbered(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """``_runs`` with the number of their component, from 0, and how many there are."""
    rows, starts, ends = _runs(mask)
    if not len(rows):
        return rows, starts, ends, rows, 0
    base = rows * (mask.shape[1] + 2)
    root = _joined(base + starts, base + ends, mask.shape[1] + 2)
    least = root == np.arange(len(root))
    return rows, starts, ends, (np.cumsum(least) - 1)[root], int(least.sum())


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components: numbers from 1."""
    h, w = mask.shape
    rows, starts, ends, number, n = _numbered(mask)
    out = np.zeros((h, w + 1), np.int64)
    out[rows, starts] += number + 1
    out[rows, ends] -= number + 1
    return out.cumsum(1)[:, :w], n


def extents(mask: np.ndarray) -> dict[str, np.ndarray]:
    """x, y, w, h and area of each component, as arrays in the order of their numbers."""
    rows, starts, ends, number, n = _numbered(mask)
    if not n:
        return {k: np.zeros(0, np.int64) for k in ("x", "y", "w", "h", "area")}
    order = np.argsort(number, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=n))[:-1]])
    rows, starts, ends = rows[order], starts[order], ends[order]
    x, y = np.minimum.reduceat(starts, cut), rows[cut]
    last = np.append(cut[1:], len(rows)) - 1
    return {"x": x, "y": y, "w": np.maximum.reduceat(ends, cut) - x, "h": rows[last] - y + 1, "area": np.add.reduceat(ends - starts, cut)}


def regions(mask: np.ndarray) -> list[dict]:
    """x, y, w, h, area (pixels), perimeter (boundary pixels), and centre of each component, in reading order of their numbers."""
    rows, starts, ends, number, n = _numbered(mask)
    if not n:
        return []
    long = ends - starts
    # Sums of whole numbers, exact in any order.
    total = lambda v: np.bincount(number, weights=v, minlength=n)
    rim = np.zeros(mask.size + 1, np.int64)
    np.cumsum(mask & ~erode(mask, 3, 3), out=rim[1:])
    base = rows * mask.shape[1]
    found = extents(mask)
    found |= {"perimeter": total(rim[base + ends] - rim[base + starts]), "cx": total((starts + ends - 1) * long / 2) / found["area"], "cy": total(rows * long) / found["area"]}
    return [dict(zip(found, v)) for v in zip(*(a.tolist() for a in found.values()))]


def hull(points: np.ndarray) -> np.ndarray:
    """The corners (x, y) of the convex hull, counter-clockwise; of points on one line, the ends."""
    p = np.asarray(points)
    if not len(p):
        return p.astype(float)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    # Of each column only the outermost points can be corners.
    first = np.flatnonzero(np.diff(p[:, 0], prepend=p[:1, 0] - 1))
    return around(p[first, 0], p[first, 1], p[np.append(first[1:], len(p)) - 1, 1])


def around(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``hull`` of columns ``x``, in order, each from ``low`` to ``high``."""
    if len(x) < 2:
        return np.array([(a, b) for a, l, u in zip(x, low, high) for b in sorted({l, u})], float).reshape(-1, 2)

    def half(x: np.ndarray, y: np.ndarray) -> list:
        if len(x) > 8:
            # What lies on or inside the line between its neighbours is no corner.
            kept = np.ones(len(x), bool)
            dx, dy = x[1:] - x[:-1], y[1:] - y[:-1]
            kept[1:-1] = dx[:-1] * dy[1:] > dy[:-1] * dx[1:]
            x, y = x[kept], y[kept]
        out: list = []
        for a, b in zip(x.tolist(), y.tolist()):
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (b - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (a - out[-2][0]):
                out.pop()
            out.append((a, b))
        return out

    below, above = half(x, low), half(x[::-1], high[::-1])
    # Where the hull begins or ends with a single point, both halves have it.
    if below[-1] == above[0]:
        above = above[1:]
    if above and above[-1] == below[0]:
        above = above[:-1]
    return np.array(below + above, float)


def hull_area(points: np.ndarray) -> float:
    """Of pixels, each counted with its whole square."""
    corners = np.concatenate([points + d for d in ((0, 0), (0, 1), (1, 0), (1, 1))])
    x, y = hull(corners).T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def least_box_angle(points: np.ndarray) -> float:
    """The angle in degrees, from -45 up to 45, at which the box around the points is smallest: one of its sides lies along the hull."""
    return least_box_angle_of(hull(points))


def least_box_angle_of(h: np.ndarray) -> float:
    """``least_box_angle`` from the hull."""
    if len(h) < 2:
        return 0.0
    sides = np.roll(h, -1, 0) - h
    t = np.arctan2(sides[:, 1], sides[:, 0])
    u, v = np.outer(np.cos(t), h[:, 0]) + np.outer(np.sin(t), h[:, 1]), np.outer(-np.sin(t), h[:, 0]) + np.outer(np.cos(t), h[:, 1])
    best = int(np.argmin(np.ptp(u, axis=1) * np.ptp(v, axis=1)))
    return float((np.rad2deg(t[best]) + 45) % 90 - 45)


def resize(page: np.ndarray, height: int, width: int, method: str = "linear") -> np.ndarray:
    """Half-pixel-centred resampling: area, linear, cubic or lanczos. Separable: one matrix for each axis."""
    a = page.astype(F32)
    a = np.tensordot(_weights(page.shape[0], height, method), a, (1, 0))
    a = np.moveaxis(np.tensordot(_weights(page.shape[1], width, method), a, (1, 1)), 0, 1)
    return np.clip(np.rint(a), 0, 255).astype(np.uint8) if page.dtype == np.uint8 else a


@functools.lru_cache(16)
def _weights(n: int, m: int, method: str) -> np.ndarray:
    scale = n / m
    out = np.zeros((m, n), F32)
    if method == "area" and scale > 1:
        lo, hi = np.arange(m) * scale, (np.arange(m) + 1) * scale
        cells = np.arange(n)
        return (np.clip(np.minimum(hi[:, None], cells + 1) - np.maximum(lo[:, None], cells), 0, None) / scale).astype(F32)
    at = (np.arange(m) + 0.5) * scale - 0.5
    reach = {"lanczos": 4, "cubic": 2}.get(method, 1)
    base = np.floor(at).astype(int)
    for k in range(1 - reach, reach + 1):
        cell = base + k
        np.add.at(out, (np.arange(m), np.clip(cell, 0, n - 1)), _kernel(np.abs(at - cell), method))
    return out / out.sum(1, keepdims=True)


def _kernel(x: np.ndarray, method: str) -> np.ndarray:
    if method == "lanczos":
        return np.where(x < 4, np.sinc(x) * np.sinc(x / 4), 0)
    if method == "cubic":
        a = -0.75
        return np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * (x**3 - 5 * x**2 + 8 * x - 4), 0))
    return np.clip(1 - x, 0, None)


def rotate(page: np.ndarray, degrees: float, *, expand: bool = True, fill: int = 255) -> np.ndarray:
    """Counter-clockwise rotation about the centre, bilinear; multiples of 90 degrees are exact when expanded."""
    if expand and degrees % 90 == 0:
        return np.rot90(page, int(degrees // 90) % 4).copy()
    h, w = page.shape[:2]
    t = np.deg2rad(degrees)
    c, s = float(np.cos(t)), float(np.sin(t))
    H, W = (int(np.ceil(abs(h * c) + abs(w * s))), int(np.ceil(abs(w * c) + abs(h * s)))) if expand else (h, w)
    y, x = np.arange(H, dtype=F32)[:, None] - (H - 1) / 2, np.arange(W, dtype=F32) - (W - 1) / 2
    sx, sy = c * x - s * y + (w - 1) / 2, s * x + c * y + (h - 1) / 2
    x0, y0 = np.floor(sx).astype(np.int32), np.floor(sy).astype(np.int32)
    p = np.pad(page, ((1, 1), (1, 1), *[(0, 0)] * (page.ndim - 2)), constant_values=fill)
    wide = w + 2
    cell = (np.clip(y0 + 1, 0, h) * wide + np.clip(x0 + 1, 0, w)).ravel()
    flat = p.reshape((h + 2) * wide, *page.shape[2:])
    # Between four pixels of the fill there is nothing but the fill.
    other = flat != fill
    other = other.any(1) if page.ndim == 3 else other
    near = other.copy()
    near[:-1] |= other[1:]
    near[:-wide] |= other[wide:]
    near[: -wide - 1] |= other[wide + 1 :]
    inside = (x0 >= -1) & (x0 < w) & (y0 >= -1) & (y0 < h)
    todo = np.flatnonzero(near[cell] & inside.ravel())
    cell, fx, fy = cell[todo], (sx.ravel()[todo] - x0.ravel()[todo].astype(int)), (sy.ravel()[todo] - y0.ravel()[todo].astype(int))
    if page.ndim == 3:
        fx, fy = fx[:, None], fy[:, None]
    at = lambda step: flat[cell + step].astype(F32)
    out = np.full((H * W, *page.shape[2:]), np.clip(fill, 0, 255), np.uint8)
    out[todo] = np.clip(np.rint((at(0) * (1 - fx) + at(1) * fx) * (1 - fy) + (at(wide) * (1 - fx) + at(wide + 1) * fx) * fy), 0, 255)
    return out.reshape(H, W, *page.shape[2:])


#: Added to a number of less than half its size, it rounds as ``rint`` does and leaves the whole number in the low bits.
_ROUND = 1.5 * 2.0**52


def projection(ys: np.ndarray, xs: np.ndarray, t: float) -> np.ndarray:
    """How many of the points lie in each line across at the angle ``t`` (radians), from the first line with a point to the last."""
    v = ys * np.cos(t)
    v -= xs * np.sin(t)
    v += _ROUND
    at = v.view(np.int64)
    at -= at.min()
    return np.bincount(at)


def hough_angles(edges: np.ndarray, *, least: int, reach: float = 15, step: float = 0.5) -> tuple[float, int]:
    """(angle, number of lines) of nearly horizontal lines: the mean of the angles of lines of ``least`` edge pixels, flat ones weighing more."""
    ys, xs = np.nonzero(edges)
    if not len(ys):
        return 0.0, 0
    angles = np.arange(-reach, reach + step / 2, step)
    ys, xs = ys.astype(float), xs.astype(float)
    lines = np.array([np.count_nonzero(projection(ys, xs, t) >= least) for t in np.deg2rad(angles)])
    n, weight = int(lines.sum()), lines / (1 + np.abs(angles))
    return (float((angles * weight).sum() / weight.sum()) if n else 0.0), n


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def phash(page: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest frequencies of a 16 x 16 page exceed their median, row by row from the top bit."""
    c = dct_matrix(16)
    low = (c @ resize(gray(page), 16, 16, "lanczos").astype(float) @ c.T)[:8, :8].ravel()
    return int("".join("1" if b else "0" for b in low > np.median(low)), 2)


def equalize(g: np.ndarray) -> np.ndarray:
    hist = np.bincount(g.ravel(), minlength=256)
    cdf = hist.cumsum()
    low = cdf[cdf > 0][0]
    return np.rint(np.clip((cdf - low) / max(1, cdf[-1] - low), 0, 1) * 255).astype(np.uint8)[g]


def clahe(g: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Equalisation by tiles with clipped histograms, blended between the tiles' centres."""
    h, w = g.shape
    th, tw = -(-h // grid), -(-w // grid)
    p = np.pad(g, ((0, th * grid - h), (0, tw * grid - w)), mode="edge")
    tiles = p.reshape(grid, th, grid, tw).swapaxes(1, 2).reshape(grid * grid, th * tw).astype(np.int64)
    hist = np.stack([np.bincount(t, minlength=256) for t in tiles])
    top = max(1, int(clip * th * tw / 256))
    over = np.clip(hist - top, 0, None).sum(1, keepdims=True)
    luts = ((np.minimum(hist, top) + over / 256).cumsum(1) * 255 / (th * tw)).reshape(grid, grid, 256)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    c = lambda v: np.clip(v, 0, grid - 1)
    at = lambda a, b: luts[c(a)[:, None], c(b)[None, :], g]
    out = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def median3(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, 1, mode="edge")
    h, w = g.shape
    a = [p[i : i + h, j : j + w] for i in range(3) for j in range(3)]
    # A network of exchanges that leaves the median of nine in the middle.
    for i, j in ((1, 2), (4, 5), (7, 8), (0, 1), (3, 4), (6, 7), (1, 2), (4, 5), (7, 8), (0, 3), (5, 8), (4, 7), (3, 6), (1, 4), (2, 5), (4, 7), (4, 2), (6, 4), (4, 2)):
        a[i], a[j] = np.minimum(a[i], a[j]), np.maximum(a[i], a[j])
    return a[4]


def bilateral(g: np.ndarray, size: int = 9, sigma_value: float = 75, sigma_space: float = 75) -> np.ndarray:
    r = size // 2
    a = g.astype(F32)
    p = np.pad(a, r, mode="reflect")
    h, w = g.shape
    total, weight = np.zeros_like(a), np.zeros_like(a)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                b = p[r + dy : r + dy + h, r + dx : r + dx + w]
                k = np.exp(-((b - a) ** 2) / (2 * sigma_value**2) - (dy * dy + dx * dx) / (2 * sigma_space**2))
                total += k * b
                weight += k
    return np.rint(total / weight).astype(np.uint8)


def nonlocal_means(g: np.ndarray, strength: float = 10, patch: int = 7, search: int = 21) -> np.ndarray:
    """Means over a search window, weighted by the likeness of patches; patch distances are box means of squared differences. A shift and its opposite share them."""
    r, h, w = search // 2, *g.shape
    a = np.pad(g.astype(F32), r, mode="reflect" if min(g.shape) > r else "edge")
    total, weight = a.copy(), np.ones_like(a)
    H, W = a.shape
    for dy in range(r + 1):
        for dx in range(-r if dy else 1, r + 1):
            here = np.s_[: H - dy, max(0, -dx) : W - max(0, dx)]
            there = np.s_[dy:, max(0, dx) : W - max(0, -dx)]
            x, y = a[here], a[there]
            k = np.exp(-_box32((x - y) ** 2, patch) / F32(strength**2))
            total[here] += k * y
            weight[here] += k
            total[there] += k * x
            weight[there] += k
    return np.rint((total / weight)[r : r + h, r : r + w]).astype(np.uint8)


def _box32(a: np.ndarray, size: int) -> np.ndarray:
    """``box`` with edges repeated, in single precision: sums of sums, row by row, so that they stay small."""
    r = size // 2
    for axis in (0, 1):
        p = np.pad(a, [(r + 1, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        s = np.cumsum(p, axis=axis, dtype=np.float64)
        a = ((s[size:] - s[:-size]) if axis == 0 else (s[:, size:] - s[:, :-size])).astype(F32) / F32(size)
    return a


def fill_holes(g: np.ndarray, mask: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Masked pixels by diffusion from their surroundings."""
    a = np.where(mask, 255.0, g.astype(float))
    for _ in range(rounds):
        p = np.pad(a, 1, mode="edge")
        a = np.where(mask, (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4, a)
    return np.rint(a).astype(np.uint8)
