"""Evaluation texts inside the corpus: a prefix-filtered join of word windows.

A leak is a run of at least ``WINDOW`` consecutive words (between white space) of an item, each of which may be
misread in one place: one or two letters for one or two, or lost. Words are compared without case, accents and punctuation;
words divided at a line end are joined again; words of punctuation alone count as words of the item between the others, and
at the ends of a run where the document has them too.

A leaked window needs *every* one of its words, so any one of them is a sufficient prefix of the window:

1. The written words of the corpus are counted (grouped, combined before the shuffle) and saved.
2. The distinct written words meet the items' words, misread or not: both sides are hashed under everything that is left of them
   when one place of up to two letters is cut out (``CutIndex``). This is the only place where words are compared with all items.
3. The items' words are ordered by rarity (places of all that may stand for them); each window is represented by its rarest word.
   The written words that may stand for such a prefix word are a table (written, item, position).
4. The documents' words are joined with that table. Pairs whose positions leave no room for a window are dropped, and the rest
   verified exactly by extending the match to both sides within a slice of the document.

The texts are not shuffled as long as the table of prefix words has at most ``MOST_PREFIXES`` rows and is broadcast; a longer one meets the
words that a Bloom filter of it lets through in a salted join. Items are searched in blocks of at most
``BLOCK_WORDS`` words, which bounds what the driver and a worker hold; words are counted once for all blocks.

Defined cases: null, empty and blank texts hold nothing; items of fewer than ``WINDOW`` words cannot be found; null ids give
no rows; repeated rows and repeated items count once; texts are searched whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.orphans import bloom_of, might_contain
from scanloom.plans.skew import salted_join
from scanloom.plans.workspace import Workspace

WINDOW = 12
BLOCK_WORDS = 1_000_000
MOST_PREFIXES = 1_000_000

_LETTER = r"\p{L}\p{N}"
# White space and hyphens that few texts have become blanks and '-' first, so that the patterns all texts go through stay simple.
_RARE_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE_HYPHEN = "\xac\xad\u2010\u2011"
#: Bytes that a text with any of them has: whole characters, or the first two bytes of the general punctuation block.
_RARE_BYTES = tuple(sorted({c.encode()[: 2 if "\u2000" <= c < "\u2040" else 3] for c in _RARE_SPACE + _RARE_HYPHEN}))
_DIVIDED = rf"-(?<=[{_LETTER}_].)\s*?[\r\n][\s>|]*(?=[{_LETTER}_])"
#: White space, unless a word of punctuation alone follows: that stays with the word before it.
_BETWEEN = rf"\s++(?![^{_LETTER}\s]++(?:\s|$))"
_NO_WORD = re.compile(r"[\W_]+")
# Letters that decomposition leaves whole.
_PLAIN = str.maketrans({"đ": "d", "ð": "d", "ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})


def written(text: Column) -> Column:
    """The words of a text between white space, those divided at line ends joined, each with the words of punctuation alone that follow it."""
    rare = F.lit(False)
    for some in _RARE_BYTES:
        rare = rare | F.contains(text.cast("binary"), F.lit(some))
    plain = F.when(rare, F.translate(text, _RARE_SPACE + _RARE_HYPHEN, " " * len(_RARE_SPACE) + "-" * len(_RARE_HYPHEN))).otherwise(text)
    return F.split(F.when(plain.rlike(r"-\s"), F.regexp_replace(plain, _DIVIDED, "")).otherwise(plain), _BETWEEN)


def normal(word: str) -> str:
    """A word without case, accents and punctuation; '' if nothing is left."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word.casefold().translate(_PLAIN)) if not unicodedata.combining(c))
    return _NO_WORD.sub("", word.lower())


@lru_cache(100_000)
def first_word(element: str) -> str:
    """The word itself of an element of ``written``."""
    parts = element.split(None, 1)
    return normal(parts[0]) if parts else ""


def near(a: str, b: str) -> bool:
    """Equal but for one place of at most two letters on either side."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 2:
        return False
    start = 0
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(n, m) - start and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    return n - start - end <= 2 and m - start - end <= 2


def cut_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's index, hash) of what is left of each word when a place of at most two letters is cut out. Misread words share a cut with the word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[owner]
    power = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    # Sums before each letter, with a last one for the end of the last word; of a word: those of its part before, and of its part from a place on.
    ahead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[place])])
    behind = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[lengths[owner] - 1 - place])])
    out = []
    for size in range(3):
        room = lengths - size + 1
        room[room < 0] = 0
        word = np.repeat(np.arange(len(words)), room)
        at = starts[word] + np.arange(len(word)) - np.repeat(np.cumsum(room) - room, room)
        head = ahead[at] - ahead[starts[word]]
        tail = behind[starts[word] + lengths[word]] - behind[at + size]
        out.append((word, head * np.uint64(0xC2B2AE3D27D4EB4F) + (tail ^ (tail >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)))
    return np.concatenate([w for w, _ in out]), np.concatenate([h for _, h in out])


class CutIndex:
    """The words of items under the hashes of their cuts: 12 bytes a cut, three cuts a letter."""

    def __init__(self, words: list[str]):
        self.size = max(1, len(words))
        owner, hashes = cut_hashes(words)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.first = np.unique(hashes[order], return_index=True)
        self.first = np.append(self.first, len(hashes))
        self.owner = owner[order].astype(np.int32)
        self.bits = np.uint64((1 << max(10, int(len(hashes) * 16).bit_length())) - 1)
        self.there = np.zeros(int(self.bits) + 1, dtype=bool)
        self.there[(self.hashes & self.bits).astype(np.int64)] = True

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word's index, number of the item word) of all pairs that share a cut, in order; empty words match nothing."""
        word, hashes = cut_hashes(words)
        likely = np.nonzero(self.there[(hashes & self.bits).astype(np.int64)])[0]
        if not len(likely) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, hashes = word[likely], hashes[likely]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        word, at = word[hit], at[hit]
        many = self.first[at + 1] - self.first[at]
        owner = self.owner[np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        pairs = np.unique(np.repeat(word, many) * self.size + owner)
        given = np.fromiter((w != "" for w in words), dtype=bool, count=len(words))
        pairs = pairs[given[pairs // self.size]]
        return pairs // self.size, pairs % self.size


class Items:
    """Items as word numbers and places in their text. Words of punctuation alone take up places only."""

    def __init__(self, items: list[tuple[int, str]]):
        self.texts: list[tuple[int, list[int], list[int], int]] = []
        number: dict[str, int] = {}
        for item, text in items:
            words, places, given = [], [], text.split()
            for place, raw in enumerate(given):
                if w := normal(raw):
                    words.append(number.setdefault(w, len(number)))
                    places.append(place)
            self.texts.append((item, words, places, len(given)))
        self.words = list(number)

    def prefixes(self, rarity: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
        """(word number, item's index, position, words of the item, least words) of the words that represent windows.

        In each window that is the rarest word, first of equals; least words: of all windows that it represents.
        """
        least: dict[tuple[int, int], int] = {}
        for t, (_, words, places, length) in enumerate(self.texts):
            start = stop = 0
            for place in range(length - window + 1):
                while start < len(places) and places[start] < place:
                    start += 1
                while stop < len(places) and places[stop] < place + window:
                    stop += 1
                if stop > start:
                    chosen = (t, min(range(start, stop), key=lambda p: (rarity.get(words[p], 0), p)))
                    least[chosen] = min(least.get(chosen, window), stop - start)
        return [(self.texts[t][1][p], t, p, len(self.texts[t][1]), n) for (t, p), n in sorted(least.items())]

    def verified(self, t: int, p: int, around: list[str], at: int, window: int = WINDOW) -> bool:
        """Whether position ``p`` of item ``t`` and element ``at`` of ``around`` lie in a common run of a window's length."""
        _, numbers, places, length = self.texts[t]

        def same(i: int) -> bool:
            return near(first_word(around[at + i]), self.words[numbers[p + i]])

        if not same(0):
            return False
        left = right = 0
        while left < min(at, p) and same(-left - 1):
            left += 1
        while right + 1 < min(len(around) - at, len(numbers) - p) and same(right + 1):
            right += 1
        first, last = places[p - left], places[p + right]
        before = first - (places[p - left - 1] + 1 if p > left else 0)
        after = (places[p + right + 1] if p + right + 1 < len(places) else length) - last - 1
        if before:
            marks = around[at - left - 1].split() if at > left else []
            before = min(before, len(marks) - (1 if marks and normal(marks[0]) else 0))
        if after:
            after = min(after, len(around[at + right].split()) - 1)
        return before + last - first + 1 + after >= window


def _blocks(items: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks that each fit a broadcast; the driver holds one block at a time."""
    kept = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).distinct()
    block: list[tuple[int, str]] = []
    size = 0
    for r in kept.orderBy("i", "t").toLocalIterator():
        n = len(r.t.split())
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    if block:
        yield block


def _standing_for(counted: DataFrame, words: list[str]) -> DataFrame:
    """Rows (written, places, numbers): the written words that may stand for some of ``words``, and for which."""
    shared = counted.sparkSession.sparkContext.broadcast(words)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CutIndex(shared.value)
        for batch in batches:
            word, number = index.matches([first_word.__wrapped__(w) for w in batch.column(0).to_pylist()])
            rows, first = np.unique(word, return_index=True)
            offsets = pa.array(np.append(first, len(word)), pa.int32())
            numbers = pa.ListArray.from_arrays(offsets, pa.array(number, pa.int32()))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), numbers], names=["written", "places", "numbers"])

    return counted.mapInArrow(match, "written string, places bigint, numbers array<int>")


def _candidates(texts: DataFrame, prefixes: DataFrame, ws: Workspace, name: str, window: int) -> DataFrame:
    """Rows (doc_id, t, p, around, at): places of prefix words that leave room for a window, with the words around them."""
    prefixes = ws.save(prefixes, name)
    rows = prefixes.count()
    # The outer forms, as the others are given a filter on the words' number that splits all texts again.
    words = texts.select("doc_id", written(F.col("text")).alias("words")).select("doc_id", "words", F.posexplode_outer("words").alias("pos", "written"))
    first = F.greatest(F.col("pos") - window, F.lit(0))
    around = F.slice("words", first + 1, 2 * window + 1)
    room = F.least("pos", "p") + F.least(F.size("words") - F.col("pos"), F.col("n") - F.col("p")) >= F.col("least")
    if rows <= MOST_PREFIXES:
        joined = words.join(F.broadcast(prefixes), "written").where(room)
        return joined.select("doc_id", "t", "p", around.alias("around"), (F.col("pos") - first).alias("at"))
    likely = words.where(might_contain(bloom_of(prefixes, F.xxhash64("written"), rows), F.xxhash64("written")))
    likely = likely.select("doc_id", "pos", "written", F.size("words").alias("size"), around.alias("around"), (F.col("pos") - first).alias("at"))
    room = F.least("pos", "p") + F.least(F.col("size") - F.col("pos"), F.col("n") - F.col("p")) >= F.col("least")
    return salted_join(likely, prefixes, "written").where(room).select("doc_id", "t", "p", "around", "at")


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, item_id): each document with a window of an item."""
    spark, found, counted = corpus.sparkSession, None, None
    ws = Workspace(spark, "leaks")
    texts = corpus.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    for n, block in enumerate(_blocks(items, item, item_text, block_words)):
        if counted is None:
            counted = texts.select(F.explode_outer(written(F.col("text"))).alias("written")).groupBy("written").agg(F.count("*").alias("places"))
            counted = ws.save(counted, "words")
        held = Items(block)
        standing = ws.save(_standing_for(counted, held.words), f"standing-{n}")
        numbers = standing.select("written", "places", F.explode("numbers").alias("number"))
        # At most the words and the windows of a block.
        rarity = {r.number: r.places for r in numbers.groupBy("number").agg(F.sum("places").alias("places")).collect()}
        chosen = spark.createDataFrame(held.prefixes(rarity, window), "number int, t int, p int, n int, least int")
        prefixes = numbers.join(F.broadcast(chosen), "number").select("written", "t", "p", "n", "least")
        shared = spark.sparkContext.broadcast(held)

        def verify(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                pairs, around = set(), batch.column(3)
                # A flat list of all words converts faster than a list of lists.
                flat, first = around.flatten().to_pylist(), around.offsets.to_pylist()
                base = first[0]
                for i, (d, t, p, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)))):
                    pair = (d, held.texts[t][0])
                    if pair not in pairs and held.verified(t, p, flat[first[i] - base : first[i + 1] - base], at, window):
                        pairs.add(pair)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], names=["doc_id", "item_id"])

        part = _candidates(texts, prefixes, ws, f"prefixes-{n}", window).mapInArrow(verify, "doc_id bigint, item_id bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return found.distinct()
