"""Leaks and truncated texts: edge cases, and leaks against a brute-force search."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scanloom.llm import leaks, truncation

ITEM = "In Quor-Vorq, Filed by Zyphxil Oxum; checked by Kvex Jext, paid by Phex & Co with 1,234.56 EUR. Không gấp ngày thứ hai!"


def shares_a_cut(a, b):
    return leaks.CutIndex([b]).matches([a])[0].tolist() == [0]


def test_near():
    for a, b in (("rninder", "minder"), ("clay", "day"), ("modern", "modem"), ("e", "c"), ("word", "word"), ("oo", "00"), ("house", "hause"), ("house", "hxxse"), ("x" * 500, "x" * 499)):
        assert leaks.near(a, b) and leaks.near(b, a) and shares_a_cut(a, b)
    for a, b in (("hxuxe", "house"), ("abcdef", "abc"), ("hoxxxe", "house"), ("", "ab")):
        assert not shares_a_cut(a, b)


def test_cut_index_equals_all_pairs():
    draw = random.Random(3)
    words = sorted({"".join(draw.choice("abđñ") for _ in range(draw.randint(1, 6))) for _ in range(300)})
    given = sorted({"".join(draw.choice("abđñ") for _ in range(draw.randint(0, 7))) for _ in range(300)})
    got = list(zip(*(x.tolist() for x in leaks.CutIndex(words).matches(given))))
    assert got == [(i, j) for i, a in enumerate(given) for j, b in enumerate(words) if a and leaks.near(a, b)]
    assert len(leaks.CutIndex([]).matches(given)[0]) == len(leaks.CutIndex(words).matches([])[0]) == 0


@pytest.mark.parametrize(
    "text,hit",
    [
        ("noise before " + ITEM + " noise after", True),
        (ITEM.upper().replace(",", " , ").replace(";", ""), True),
        ("> " + ITEM.replace("checked by", "checked\n> by").replace("Zyphxil", "Zyph-\n> xil"), True),
        (ITEM.replace("Filed", "Fi1ed").replace("Kvex", "Kvcx").replace("paid", "pald"), True),
        (ITEM.replace("Filed", "Filed\u2003--\u00a0...").replace("Zyphxil", "Zyph\u2010 \r\n\t| xil").replace(" ", "\u202f"), True),
        (ITEM.replace("ngày", "ngay").replace("Không", "KHONG"), True),
        (" ".join(ITEM.split()[3:15]), True),
        (" ".join(ITEM.split()[3:14]), False),
        (ITEM.replace("checked by Kvex", "checked for Xan").replace("EUR", "Dollars"), False),
        (ITEM.replace("Kvex", "Kwwx").replace("with", "wxxx").replace("Filed", "Fxlxd").replace("checked", "xxxcked"), False),
        ("", False),
        (" \n", False),
        (None, False),
    ],
)
def test_leak_cases(spark, text, hit):
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, "too short an item"), (None, ITEM), (9, None), (10, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (1, text), (None, ITEM)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = leaks.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    assert [tuple(r) for r in got] == ([(1, 7)] if hit else [])


DIVIDED = re.compile(r"(?<=\w)[-\xad‐‑\xac]\s*?[\r\n][\s>|]*(?=\w)")


def longest_run(text, item):
    """Dynamic programming over all alignments of two texts; words of punctuation alone at both ends count if both texts have them."""
    given = DIVIDED.sub("", text).split()
    a = [(i, w) for i, w in enumerate(map(leaks.normal, given)) if w]
    b = [(i, w) for i, w in enumerate(map(leaks.normal, item.split())) if w]
    ends = ([i for i, _ in a] + [len(given)], [i for i, _ in b] + [len(item.split())])
    best, before = 0, [None] * (len(b) + 1)
    for x, (_, w) in enumerate(a):
        now = [None] * (len(b) + 1)
        for j, (place, v) in enumerate(b):
            if leaks.near(w, v):
                now[j + 1] = before[j] if before[j] is not None else (x, j)
                i0, j0 = now[j + 1]
                gap = min(a[i0][0] - (a[i0 - 1][0] + 1 if i0 else 0), b[j0][0] - (b[j0 - 1][0] + 1 if j0 else 0))
                after = min(ends[0][x + 1] - a[x][0], ends[1][j + 1] - place) - 1
                best = max(best, gap + place - b[j0][0] + 1 + after)
        before = now
    return best


@pytest.mark.parametrize(
    "text,hit",
    [
        ("x a1 b1 c1 d1 e1 f1 : g1 h1 i1 j1 k1 y", True),
        ("x a1 b1 c1 d1 e1 f1 g1 h1 i1 j1 k1 y", True),
        ("x ! b1 c1 d1 e1 f1 : g1 h1 i1 j1 k1 y", True),
        ("x b1 c1 d1 e1 f1 : g1 h1 i1 j1 k1 ? y", True),
        ("! b1 c1 d1 e1 f1 : g1 h1 i1 j1 k1", True),
        ("x b1 c1 d1 e1 f1 : g1 h1 i1 j1 k1 y", False),
        ("x ! c1 d1 e1 f1 : g1 h1 i1 j1 k1 y", False),
    ],
)
def test_punctuation_alone(spark, text, hit):
    item = "a1 ! b1 c1 d1 e1 f1 : g1 h1 i1 j1 k1 ; z1"
    text, item = (re.sub(r"(\w)\w?", lambda m: m[1] * 9, x) for x in (text, item))
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = leaks.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", items, "item_id", "text").count()
    assert got == (longest_run(text, item) >= 12) == hit


def test_leaks_equal_brute_force(spark, folder, monkeypatch):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{folder}/eval_items.parquet").to_pylist()[:12]}
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist() if r["text"]}
    docs = dict(list(docs.items())[:25])
    for n, (i, t) in enumerate(items.items()):
        docs[10_000 + n] = "A b c. " + " ".join(t.split()[n : n + 8 + n]) + " The end."
    expected = sorted((d, i) for d, x in docs.items() for i, t in items.items() if longest_run(x, t) >= 12)
    left = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    right = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block, most in ((200_000, 10**6), (100, 10**6), (200_000, 5)):
        monkeypatch.setattr(leaks, "MOST_PREFIXES", most)
        got = leaks.leaks(left, "doc_id", "text", right, "item_id", "text", block_words=block).collect()
        assert sorted(tuple(r) for r in got) == expected
    assert len(expected) >= 8
    assert leaks.leaks(left, "doc_id", "text", right.limit(0), "item_id", "text").count() == 0
    assert leaks.leaks(left.limit(0), "doc_id", "text", right, "item_id", "text").count() == 0


WHOLE = ["It was late.", "It was late!\n\n", 'He said "late."', "Text.\nPage 3 of 12", "Text.\nTrang 7 / 20", "Text.\nTotal: $1,234.50", "Text.\nSumme: 99 USD", "Text.\nSigned: Savlom Selmil", "Text.\nGez. Fenvin Bricla", "Text.\nMit freundlichen Grüßen\nOstdro Halost", "Text.\nYours faithfully,\nAda Byron\x0c", "Text.\n[end of sheet]", "Text.\nTel. 091-36491", "Text.\nNo. ZED-12510/51", "P<ZZQA<<B" + "<" * 35 + "\n7BKK4BEEK2ZZQ9156664F3510289<<<<<<<<<<<<<<<4", "the lease  |  42 75.60.", "sent by Drover\nAG.", "on 19.3.2023.", "about $12.50.", "late. ____ ", "late....", "late. [...]"]
CUT = ["It was la", "It was late", "It was late,", "It was late...", "It was la…", "before the\n", "by 4,116. ", "costs $12.", "on 19.", "on 19.3.", "Text.\nTel.", "Text.\nSigned: Sav", "Text.\nPage 3 of", "Karton 79 enthält l", "Text.\nYours faithfully,", "land [...]", "P<ZZQA<<B" + "<" * 35, "the lease ....", "number HUL-", "and the customs slip wei" + " " * 96, "If the sheet that was sent to us cannot be read,\nKroyar Torsav"]


def test_endings(spark):
    texts = WHOLE + CUT + [None, "", " \n", "…", "x" * 50_000 + "."]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "cut he", "s")], "doc_id long, text string, source string").withColumn("evidence", F.lit("clash"))
    got = {r.doc_id for r in truncation.truncated(df).collect()}
    wrong = [texts[i] for i in got if i < len(WHOLE) or i >= len(WHOLE) + len(CUT)] + [t for i, t in enumerate(texts) if len(WHOLE) <= i < len(WHOLE) + len(CUT) and i not in got]
    assert wrong == []
    assert truncation.truncated(df.limit(0)).count() == 0


def test_longer_copies(spark):
    whole = "Box 3 was sent.\nSigned: Savlom Selmil"
    texts = [whole, whole[:-3], whole[:-3], "Box 3 was\nsent.", "About $8.12 more. The end.", "About $8.", "Something else."]
    df = spark.createDataFrame([(i, t, None if i == 1 else "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for parts in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.doc_id: r.evidence for r in truncation.truncated(df).collect()}
        assert got == {1: "copy", 2: "copy", 5: "ending"}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    report = {r.source: r for r in truncation.by_source(df).collect()}
    assert (report[None].truncated_count, report["s"].truncated_count, report["s"].document_count) == (1, 2, 6)


def test_longer_copies_behind_others(spark):
    stop = "Letter.\nTel: 030 123-45"
    texts = [stop + " ...", stop + "67\nBye.", "Text.\nNo. ZED-12510/51", "Text.\nNo. ZED-12510/51 sent.", "Text.\nNo. ZED-12510/51-a.", "Text.\nNo. ZED-12510/517 is it.", "Text.\nNo. ZED-19/51 -", "Text.\nNo. ZED-19/51 # seven."]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r.doc_id: r.evidence for r in truncation.truncated(df).collect()} == {0: "copy", 2: "copy"}


def test_copies_equal_all_pairs(spark):
    draw = random.Random(7)
    texts = {"".join(draw.choice("a1 .-é") for _ in range(draw.randint(1, 7))) for _ in range(700)} | {"a1", "a1 ", "a1-", "a1.", "a1. ", "a1é"}
    expected = sorted(s for s in texts if any(truncation._goes_on(s, t) for t in texts))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for parts in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(r.text for r in truncation.cut_in_copies(df).collect()) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
