import zlib

import numpy as np
import pytest

from scanloom.kernels import page as P
from scanloom.kernels import enhance as E
from scanloom.kernels import features as T
from scanloom.kernels import raster as X
from scanloom.sources.files import encode_png


@pytest.fixture(scope="module")
def text_page():
    return P.synthetic(400, 560, seed=3)


@pytest.mark.parametrize("angle", [0, 2, 5, 10, 15, -3, -7, -12])
def test_planted_skew_is_found(angle):
    page = P.synthetic(400, 560, angle, seed=abs(angle))
    found = P.skew_estimates(page)
    assert abs(found["projection"] - angle) <= 0.5
    if abs(angle) >= 3:
        level = P.deskew(page, found["projection"])
        assert abs(P.skew_estimates(level)["projection"]) <= 0.6


def test_named_measures_equal_those_of_all(text_page):
    """page_decisions reads a part of the measures, and pays for that part only."""
    from scanloom.operators import pages as O

    names = ["agreed", "noise", "text_share", "hough", "text_confidence", "page_hash"]
    for page in (text_page, X.rotate(text_page, 90), P.synthetic(200, 280, 6, seed=4), np.full((60, 50), 255, np.uint8), np.repeat(text_page[:90, :80, None], 3, -1)):
        every, some = O.all_measures(page), O.all_measures(page, names)
        votes = every["votes"]
        assert set(some) == set(names) and "agreed" not in every
        assert some.pop("agreed") == (votes[0] if len(set(votes)) == 1 else 0)
        assert all(every[n] == x for n, x in some.items())


def test_orientation_stops_at_the_first_two_votes_that_differ(monkeypatch):
    """page_corrections turns a page only if all votes agree."""
    from scanloom.operators import pages as O

    made = [P.synthetic(200, 280, k % 5 * 6 - 12, seed=k) for k in range(12)]
    votes = [P.orientation_votes(page) for page in made]
    assert [P.agreed_rotation(page) for page in made] == [v[0] if len(set(v)) == 1 else 0 for v in votes]
    early = [page for page, v in zip(made, votes) if v[2] != v[3]]
    monkeypatch.setattr(P, "_structure", None)
    assert early and all(O._upright(page) is page for page in early)


def test_small_skew_is_left(text_page):
    assert P.deskew(text_page, 2.9) is text_page


def test_crop_finds_the_ink():
    page = np.full((300, 400), 255, np.uint8)
    page[60:200, 90:310] = 20
    x0, y0, x1, y1 = P.content_box(page)
    assert abs(x0 - 90) <= 10 and abs(y0 - 60) <= 10 and abs(x1 - 310) <= 10 and abs(y1 - 200) <= 10
    assert P.crop(np.full((50, 60), 255, np.uint8)).shape == (50, 60)


@pytest.mark.parametrize("gap,pages", [(0.04, 1), (0.06, 2), (0.1, 2)])
def test_gap_decides_about_pages(gap, pages):
    page = np.full((100, 1000), 0, np.uint8)
    middle = int(1000 * gap)
    page[:, 480 : 480 + middle] = 255
    assert len(P.page_bounds(page)) == pages
    assert sum(p.shape[1] for p in P.split(page)) >= 900


def test_blank_and_ink(text_page):
    blank = P.measures(np.full((200, 200), 255, np.uint8))
    assert blank["text_density"] == 0 and blank["white_share"] == 1
    assert P.measures(text_page)["text_density"] > 0.03


def test_phash_is_stable(text_page):
    h = X.phash(text_page)
    near = lambda p: bin(h ^ X.phash(p)).count("1")
    assert near(text_page.copy()) == 0
    assert near(np.clip(text_page.astype(int) + 2, 0, 255).astype(np.uint8)) <= 3
    assert near(P.synthetic(400, 560, seed=77)) > 3


def test_rotation(text_page):
    turned = text_page
    for _ in range(4):
        turned = X.rotate(turned, 90)
    assert (turned == text_page).all()
    assert (X.rotate(X.rotate(text_page, 90), 270) == text_page).all()
    assert X.rotate(text_page, 10).shape[0] > text_page.shape[0]


def test_otsu_and_label():
    g = np.array([[10] * 8 + [200] * 8] * 4, np.uint8)
    assert 10 <= X.otsu(g) < 200
    mask = np.zeros((6, 8), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 2:5] = mask[5, 7] = True
    labels, n = X.label(mask)
    assert n == 3 and labels[0, 0] == labels[1, 1] and len(set(labels[4, 2:5])) == 1
    assert sorted(r["area"] for r in X.regions(mask)) == [1, 2, 3]
    u = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert X.label(u)[1] == 1 and X.label(np.zeros((3, 3), bool))[1] == 0


def test_morphology_against_definition():
    rng = np.random.default_rng(1)
    m = rng.random((12, 15)) > 0.7
    p = np.pad(m, 1)
    expected = np.any([p[i : i + 12, j : j + 15] for i in range(3) for j in range(3)], 0)
    assert (X.dilate(m, 3, 3) == expected).all()
    assert (X.opened(m, 3, 3) <= m).all() and (X.closed(m, 3, 3) >= m).all()


def test_filters_keep_flat_pages():
    flat = np.full((30, 40), 120, np.uint8)
    for f in (X.median3, X.bilateral, lambda g: X.nonlocal_means(g, search=7), lambda g: np.rint(X.gaussian(g, 5)).astype(np.uint8), lambda g: np.rint(X.box(g, 5)).astype(np.uint8), lambda g: X.resize(g, 30, 40, "lanczos")):
        assert (f(flat) == 120).all()
    assert not X.canny(flat).any()


def test_box_equals_definition():
    a = np.random.default_rng(2).random((9, 11))
    p = np.pad(a, 1, mode="reflect")
    assert np.allclose(X.box(a, 3), sum(p[i : i + 9, j : j + 11] for i in range(3) for j in range(3)) / 9)


def test_median_removes_spots(text_page):
    spotted = text_page.copy()
    spots = np.random.default_rng(0).random(spotted.shape) < 0.02
    spotted[spots] = 0
    cleaned = P.denoise(spotted, smooth=False, nlm=False)
    wrong = lambda g: int((np.abs(g.astype(int) - text_page) > 60)[(text_page == 255)].sum())
    assert wrong(cleaned) < wrong(spotted) / 5


def test_contrast(text_page):
    grayish = (text_page // 4 + 90).astype(np.uint8)
    better = P.enhance(grayish)
    assert better.std() > grayish.std() and better.dtype == np.uint8
    assert (P.enhance(grayish, white=240) <= 255).all()
    ramp = np.tile(np.arange(256, dtype=np.uint8), (4, 1))
    assert (np.diff(X.equalize(ramp)[0].astype(int)) >= 0).all()


def test_colour_marks():
    page = np.full((200, 300, 3), 255, np.uint8)
    yy, xx = np.mgrid[:200, :300]
    page[(yy - 100) ** 2 + (xx - 80) ** 2 < 40**2] = (30, 30, 220)
    page[150:165, 150:270] = (200, 60, 30)
    assert [r["type"] for r in P.colour_regions(page)] == ["stamp", "signature"]
    assert P.colour_regions(X.gray(page)) == []
    kept = P.gray_with_colour(page)
    assert tuple(kept[100, 80]) == (30, 30, 220) and len(set(map(int, kept[5, 5]))) == 1


def test_hsv():
    page = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [128, 128, 128]]], np.uint8)
    assert [tuple(map(int, c)) for c in X.hsv(page)[0]] == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 128)]


def test_standard_size():
    assert P.standard_size(np.zeros((300, 200), np.uint8)).shape == (2923, 1948)
    assert P.standard_size(np.zeros((100, 400), np.uint8)).shape[1] == 2923
    assert P.standard_size(np.zeros((4000, 3000), np.uint8)).shape == (2772, 2079)


def test_punch_holes():
    page = np.full((120, 120), 255, np.uint8)
    yy, xx = np.mgrid[:120, :120]
    page[(yy - 30) ** 2 + (xx - 30) ** 2 < 8**2] = 20
    page[60:64, 10:110] = 20
    out = P.punch_holes(page)
    assert out[30, 30] > 150 and out[62, 50] == 20


def test_png_holds_the_pixels(text_page):
    png = encode_png(text_page)
    start = png.index(b"IDAT") + 4
    raw = np.frombuffer(zlib.decompress(png[start : -(4 + 12)]), np.uint8).reshape(560, 401)
    assert (raw[:, 1:] == text_page).all()


def test_regions_of_interest(text_page):
    part = P.text_region(text_page)
    assert part.shape[0] < text_page.shape[0] and part.shape[1] < text_page.shape[1]
    assert P.text_region(np.full((40, 40), 90, np.uint8)).shape == (40, 40)
    assert P.text_region(np.full((40, 40), 255, np.uint8)).shape == (40, 40)
    assert max(P.thumbnail(text_page).shape) == 200
    assert set(P.ink_boxes(text_page)) == {"form_field", "signature", "barcode", "logo", "stamp"}


def test_backgrounds(text_page):
    noisy = np.clip(text_page.astype(int) - 10, 0, 255).astype(np.uint8)
    assert (P.white_background(noisy)[text_page == 255] == 255).mean() > 0.99
    assert P.clean_background(text_page).shape == text_page.shape
    assert P.looks_multipage(text_page) in (True, False)
    assert P.orientation_confidence(text_page) > P.orientation_confidence(X.rotate(text_page, 90)) - 1e-9


def test_comparison(text_page):
    both = P.comparison(text_page, text_page[:100])
    assert both.shape == (560, 810, 3) and (both[:, :400, 0] == text_page).all() and (both[100:, 410:] == 255).all()


def test_hull_and_least_box():
    yy, xx = np.mgrid[:60, :200]
    for angle in (-20, -5, 0, 7, 30):
        t = np.deg2rad(angle)
        u, v = (xx - 100) * np.cos(t) + (yy - 30) * np.sin(t), -(xx - 100) * np.sin(t) + (yy - 30) * np.cos(t)
        ys, xs = np.nonzero((np.abs(u) < 25) & (np.abs(v) < 4))
        points = np.stack([xs, ys], 1)
        assert abs(X.least_box_angle(points) - angle) < 3
        assert 0.8 < 50 * 8 / X.hull_area(points) < 1.25
    assert X.hull_area(np.array([[3, 4]])) == 1 and X.least_box_angle(np.array([[1, 1]])) == 0.0


def test_lab_goes_back():
    page = np.random.default_rng(3).integers(0, 256, (20, 20, 3)).astype(np.uint8)
    assert np.abs(X.from_lab(X.lab(page)).astype(int) - page).max() <= 1
    white = X.lab(np.full((1, 1, 3), 255, np.uint8))[0, 0]
    assert abs(white[0] - 100) < 0.1 and np.abs(white[1:]).max() < 0.1


def test_scanner_edges_and_holes_go(text_page):
    page = np.full((300, 300), 255, np.uint8)
    page[:, 3] = 120
    cleaned, n = E.scanner_edges(page)
    assert n >= 300 and cleaned[:, 3].mean() > 250
    same, n = E.scanner_edges(np.full((50, 50, 3), 255, np.uint8))
    assert n == 0 and (same == 255).all()
    colour = np.full((120, 120, 3), 255, np.uint8)
    yy, xx = np.mgrid[:120, :120]
    colour[(yy - 30) ** 2 + (xx - 30) ** 2 < 8**2] = 20
    assert P.punch_holes(colour)[30, 30].min() > 150 and P.punch_holes(colour).shape == colour.shape


def test_sharpening_keeps_flat_pages(text_page):
    flat = np.full((40, 50), 90, np.uint8)
    for kind in E.SHARPENERS:
        assert (np.abs(E.sharpen(flat, kind)[2:-2, 2:-2].astype(int) - 90) <= (1 if kind not in ("dark_page", "bright_page") else 14)).all()
    assert E.unsharp(flat).shape == flat.shape and (E.unsharp(flat) >= 89).all()
    for mode in ("standard", "moderate", "white"):
        assert E.for_recognition(text_page, mode).shape == text_page.shape
    assert (E.for_recognition(text_page, "white") == text_page).all()
    assert E.for_recognition(np.repeat(text_page[..., None], 3, -1), "moderate", clip=1.5).shape == (*text_page.shape, 3)
    assert E.enlarge(text_page[:50, :40], 450, 360).shape == (450, 360)


def test_bleeding(text_page):
    assert not E.bleeds_through(np.full((80, 80), 255, np.uint8)) and E.bleeds_through(text_page)
    assert E.without_bleeding(text_page).std() >= text_page.std() * 0.9


def test_contrast_modes(text_page):
    grayish = (text_page // 4 + 90).astype(np.uint8)
    for mode in ("adaptive", "conservative", "white", "sharp", "moderate"):
        assert P.enhance(grayish, mode=mode).shape == grayish.shape
    assert P.enhance(text_page, mode="white", white=240)[text_page == 255].mean() > 250
    assert (E.white_background(np.full((40, 40), 170, np.uint8), 240, 1.3) == 255).all()
    assert E.gamma_for(E.Contrast(gamma=1.9), {"dark": True, "bright": False}) == 2.0 and E.gamma_for(E.Contrast(gamma=0.9), {"dark": False, "bright": True}) == 0.8


def test_features(text_page):
    page = np.full((400, 400), 255, np.uint8)
    yy, xx = np.mgrid[:400, :400]
    page[np.abs(np.hypot(yy - 200, xx - 150) - 45) < 3] = 40
    found = T.circles(page)
    assert len(found) == 1 and abs(found[0]["x"] + found[0]["w"] / 2 - 150) < 8 and abs(found[0]["w"] - 90) < 14
    ruled = np.full((300, 300), 255, np.uint8)
    ruled[20::20] = 0
    assert T.table_score(ruled) > 30 and "ruled_lines" in T.special(ruled) and T.table_score(ruled, faithful=True) == 100.0
    assert T.grid_labels([0.4, 0.2, 0.0]) == ["dense", "text", "whitespace"]
    o = T.objects(text_page)
    assert o["small"] + o["medium"] + o["large"] > 0 and 0 < o["complexity"] <= 60 and T.objects(np.full((9, 9), 255, np.uint8))["complexity"] <= 60
    red, blue = np.zeros((10, 10, 3), np.uint8), np.zeros((10, 10, 3), np.uint8)
    red[...], blue[...] = (30, 30, 220), (220, 60, 30)
    assert T.mark_kind(red) == "stamp" and T.mark_kind(blue) == "signature"
    marked = np.full((300, 300, 3), 255, np.uint8)
    marked[50:90, 50:100] = (30, 30, 220)
    assert [m["type"] for m in P.marks(marked)] == ["stamp"] and P.marks(text_page) == []


def test_one_skew_decision(text_page):
    base = {"projection": 0.0, "hough": 0.0, "hough_confidence": 0, "text": 0.0, "text_confidence": 0}
    assert P.skew_decision(base) == 0.0
    assert P.skew_decision(base | {"projection": 5.0, "hough": 4.0}) == 5.0
    assert P.skew_decision(base | {"hough": 4.0, "hough_confidence": 6}) == 4.0
    assert P.skew_decision(base | {"text": -4.0, "text_confidence": 4}) == -4.0
    assert abs(P.skew_decision(base | {"projection": 6.0, "hough": 1.0, "hough_confidence": 1}) - (18 + 2) / 5) < 1e-9


def test_sizing_keeps_brightness(text_page):
    for size in (1.5, 4.0, 7.0):
        out = P.standard_size(text_page[:140, :100], short=int(100 * size), long=int(140 * size))
        # The kernel for enlargements of more than six sums to 0.8.
        assert abs(out.mean() - text_page[:140, :100].mean() * (0.8 if size > 6 else 1)) < 20


def test_nonlocal_means_equals_definition():
    a = np.random.default_rng(4).integers(0, 255, (24, 26)).astype(np.uint8)
    got = X.nonlocal_means(a, 40, 3, 5)
    p = np.pad(a.astype(float), 3, mode="reflect")
    for y, x in ((12, 13), (8, 9), (15, 17)):
        patch = lambda i, j: p[i + 2 : i + 5, j + 2 : j + 5]
        k = {(dy, dx): np.exp(-((patch(y, x) - patch(y + dy, x + dx)) ** 2).mean() / 1600) for dy in range(-2, 3) for dx in range(-2, 3)}
        assert abs(got[y, x] - sum(w * float(a[y + dy, x + dx]) for (dy, dx), w in k.items()) / sum(k.values())) <= 1
