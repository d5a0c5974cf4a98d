"""The corpus encoded by a public byte-level BPE tokenizer, with DuckDB doing the merges.

Each task keeps the texts it reads: nothing is shuffled. Its texts fall into words by the
tokenizer's pattern; words not met before go, all together, to one recursive query in an in-process
DuckDB: rows (word, position, token) join the merge table, each word's pair of least rank is
contracted at its leftmost places, and words without a mergeable pair drop out, until none is left;
an ordered aggregation yields the ids. ``decode`` goes back by an ordered aggregation over the vocabulary.

Contracting all places of the least pair at once equals contracting the leftmost again and again: a
contracted token only occurs in pairs of higher rank.

The driver reads the vocabulary file and broadcasts its merge table (three integers a merge, checked
against ``MOST_MERGES``). A word of more than ``LONG_WORD`` bytes (an unbroken blob) would take
the recursion a step a merge, each over the whole word; such words are contracted by a queue of their pairs in the same order instead.

A task's memory of words is emptied when it holds ``MOST_WORDS``
of them, and forgets pieces longer than ``LONG`` at once; results do not depend on it.

Defined cases: null and empty texts give an empty list of ids; texts are encoded whole, whatever their length and
characters; special tokens' strings are ordinary text; ids absent from the vocabulary, and null lists, decode to null.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
MOST_MERGES = 1_000_000
MOST_WORDS = 300_000
LONG = 200
LONG_WORD = 1_000

# The tokenizer's pattern for words, and the bytes that its vocabulary writes as themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = (range(33, 127), range(161, 173), range(174, 256))

#: A word's text ends before white space. Where plain blanks and line ends are the only white space, a text therefore falls into these chunks, and each chunk into words, on its own.
_CHUNK = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")

ENCODE = """
WITH RECURSIVE step(n, w, pos, t) AS (
  SELECT 0, w, pos, t FROM tokens
  UNION ALL (
    WITH pairs AS (
      SELECT n, w, pos, t, row_number() OVER o AS i, (t::BIGINT << 32) | lead(t) OVER o AS pair
      FROM step WINDOW o AS (PARTITION BY w ORDER BY pos)),
    ranked AS (SELECT p.*, m.rank, m.id FROM pairs p LEFT JOIN merges m ON m.pair = p.pair),
    best AS (SELECT w, min(rank) AS rank FROM ranked GROUP BY w HAVING min(rank) IS NOT NULL),
    hits AS (SELECT w, i, id, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM ranked JOIN best USING (w, rank)),
    taken AS (SELECT w, i, id FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) AS nth FROM hits) WHERE nth % 2 = 1)
    SELECT r.n + 1, r.w, r.pos, coalesce(h.id, r.t)
    FROM ranked r JOIN best b ON b.w = r.w
      LEFT JOIN taken h ON h.w = r.w AND h.i = r.i
      LEFT JOIN taken gone ON gone.w = r.w AND gone.i = r.i - 1
    WHERE gone.i IS NULL))
SELECT w, list(t ORDER BY pos) AS ids
FROM (SELECT w, pos, t, n, max(n) OVER (PARTITION BY w) AS last FROM step) WHERE n = last GROUP BY w ORDER BY w
"""

DECODE = """
SELECT d, CASE WHEN count(*) = count(v.id) THEN string_agg(v.hex, '' ORDER BY pos) END AS hex
FROM tokens LEFT JOIN vocabulary v ON v.id = tokens.t GROUP BY d
"""


@dataclass(frozen=True)
class Vocabulary:
    """Merges as arrays (left, right, result) in order of rank, the ids of the 256 bytes, and each id's bytes in hex."""

    left: np.ndarray
    right: np.ndarray
    result: np.ndarray
    byte_ids: np.ndarray
    hex_of: dict[int, str]

    @staticmethod
    def read(path: str = VOCABULARY) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if len(merges) > MOST_MERGES:
            raise ValueError(f"{len(merges)} merges are too many to broadcast")
        printed = {b for r in PRINTED for b in r}
        shown = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printed)}
        byte_of = {c: b for b, c in shown.items()}
        column = lambda xs: np.array(xs, dtype=np.int32)
        return Vocabulary(
            column([vocab[a] for a, _ in merges]),
            column([vocab[b] for _, b in merges]),
            column([vocab[a + b] for a, b in merges]),
            column([vocab[shown[b]] for b in range(256)]),
            {i: bytes(byte_of[c] for c in s).hex() for s, i in vocab.items() if all(c in byte_of for c in s)},
        )


class Encoder:
    """Encodes texts; keeps the ids of the words and chunks it has met."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(PATTERN)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
        merges = pa.table({"a": vocabulary.left, "b": vocabulary.right, "rank": np.arange(len(vocabulary.left), dtype=np.int32), "id": vocabulary.result})
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT (a::BIGINT << 32) | b AS pair, rank, id FROM given")
        self.db.unregister("given")
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.words: dict[str, array] = {}
        self.chunks: dict[str, array] = {}

    def _contracted(self, raw: bytes) -> array:
        """Ids of one long word: the pair of least rank, leftmost first, again and again; in time n log n."""
        if not self.pairs:
            v = self.vocabulary
            self.pairs = {(a, b): (rank, i) for rank, (a, b, i) in enumerate(zip(v.left.tolist(), v.right.tolist(), v.result.tolist()))}
        tokens = self.vocabulary.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist()
        n, pairs = len(tokens), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(pairs[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in pairs]
        heapify(queue)
        while queue:
            rank, i = heappop(queue)
            j = after[i]
            # Entries of tokens that have since been contracted otherwise no longer have their rank.
            if tokens[i] < 0 or j >= n or pairs.get((tokens[i], tokens[j]), (-1,))[0] != rank:
                continue
            tokens[i], tokens[j], after[i] = pairs[tokens[i], tokens[j]][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (tokens[i], tokens[after[i]])) in pairs:
                    heappush(queue, (pairs[p][0], i))
            if before[i] >= 0 and (p := (tokens[before[i]], tokens[i])) in pairs:
                heappush(queue, (pairs[p][0], before[i]))
        return array("i", [t for t in tokens if t >= 0])

    def _merge(self, words: list[str]) -> None:
        """Ids of new words, of all but the long ones by the recursive query."""
        raw = [w.encode("utf-8") for w in words]
        for w, r in zip(words, raw):
            if len(r) > LONG_WORD:
                self.words[w] = self._contracted(r)
        words, raw = [w for w, r in zip(words, raw) if len(r) <= LONG_WORD], [r for r in raw if len(r) <= LONG_WORD]
        if not words:
            return
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ids = self.vocabulary.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        self.db.register("tokens", pa.table({"w": owner, "pos": np.arange(len(ids), dtype=np.int64), "t": ids}))
        done = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("tokens")
        for w, own in zip(done.column("w").to_pylist(), done.column("ids").to_pylist()):
            self.words[words[w]] = array("i", own)

    def _learn(self, pieces: set[str]) -> None:
        """Ids of new chunks (or of whole texts with other white space)."""
        split = {p: self.pattern.findall(p) for p in pieces}
        unknown = {w for ws in split.values() for w in ws}.difference(self.words)
        if unknown:
            self._merge(sorted(unknown))
        for piece, words in split.items():
            ids = array("i")
            for w in words:
                ids.extend(self.words[w])
            self.chunks[piece] = ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a list column."""
        if len(self.chunks) + len(self.words) > MOST_WORDS:
            self.chunks, self.words = {}, {}
        cut = [[] if not t else [t] if _OTHER_SPACE.search(t) else _CHUNK.findall(t) for t in texts]
        self._learn({p for pieces in cut for p in pieces}.difference(self.chunks))
        ids, offsets, known = array("i"), np.zeros(len(texts) + 1, dtype=np.int32), self.chunks
        for i, pieces in enumerate(cut):
            for p in pieces:
                ids.extend(known[p])
            offsets[i + 1] = len(ids)
        for piece in {p for pieces in cut for p in pieces if len(p) > LONG}:
            del known[piece]
        return offsets, np.frombuffer(ids, dtype=np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encode(df: DataFrame, key: str, text: str, *, vocabulary: str = VOCABULARY, tokens_at_once: int = 2_000_000) -> DataFrame:
    """Rows (``key`` bigint, ids array<int>) for ``df``, one each, in its partitions."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(vocabulary)
        if encoder is None:
            encoder = _ENCODERS[vocabulary] = Encoder(shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= tokens_at_once):
                    size += len(texts[stop] or "")
                    stop += 1
                offsets, ids = encoder.encode(texts[start:stop])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(start, stop - start), lists], schema=schema)
                start = stop

    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS `{key}`", f"`{text}`")
    return rows.mapInArrow(run, f"`{key}` bigint, ids array<int>")


def decode(df: DataFrame, key: str, ids: str, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (``key`` bigint, text string, token_count int); bytes that are no UTF-8 become replacement characters."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary).hex_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import pyarrow.compute as pc

        db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
        known = shared.value
        db.register("vocabulary", pa.table({"id": pa.array(list(known), pa.int32()), "hex": list(known.values())}))
        for batch in batches:
            lists = batch.column(1)
            owner = np.repeat(np.arange(len(lists), dtype=np.int32), np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], dtype=np.int64))
            flat = pc.list_flatten(lists)
            db.register("tokens", pa.table({"d": owner, "pos": np.arange(len(flat), dtype=np.int64), "t": flat}))
            texts: list[str | None] = ["" if x.is_valid else None for x in lists]
            for d, raw in db.execute(DECODE).fetchall():
                texts[d] = None if raw is None else bytes.fromhex(raw).decode("utf-8", "replace")
            db.unregister("tokens")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pc.list_value_length(lists)], names=[key, "text", "token_count"])

    rows = df.selectExpr(f"CAST(`{key}` AS BIGINT) AS `{key}`", f"`{ids}`")
    return rows.mapInArrow(run, f"`{key}` bigint, text string, token_count int")
