"""Texts that were cut short: how they end, and longer copies that go on.

Two kinds of evidence, both over whole texts:

* The ending. What follows the stop (white space, control characters, dots and dashes of omission) is set aside. A text is
  complete if it then ends with a sentence or with a closing line; a number that a point has just divided ends no sentence.
* A longer copy, by a self-join on prefixes: the distinct texts are sorted, so that all that continue a text follow it at once. The texts
  that the present one continues are kept on a stack. If any copy goes on inside a word or number, the text was cut there, however
  complete it looks and whatever other copies go on with. Sorting is by ranges of the text, so the join needs no pairs and no group
  of texts is ever collected; copies of a text count once.

Defined cases: null, empty and blank texts are no cases, nor are texts of marks alone; rows without an id are left out;
repeated rows count once; a source of null is a source of its own in the report.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.operators.orphans import bloom_of, might_contain
from scanloom.plans.skew import salted_join
from scanloom.plans.workspace import Workspace

# Closing lines, as forms rather than lists where the form is enough. \p{L} so that misread letters pass.
_AMOUNT = r"(?:\$ ?[0-9][0-9,]*\.[0-9]{2}|[0-9][0-9,]*\.[0-9]{2} ?(?:EUR|USD|[€£])|[0-9]+ ?(?:EUR|USD|[€£]))"
_NAME = r"\p{Lu}[\p{L}0-9'’\-]+ \p{Lu}[\p{L}0-9'’\-]+"
PAGE = r"(?U)^[\p{L}0-9]{4,7}\.? (?=[^ ]*[0-9])[0-9lIOoSB]+ ?(?:\p{L}[\p{L}0-9]{1,2}|/) ?(?=.*[0-9])[0-9lIOoSB]+$"
TOTAL = rf"(?U)^[\p{{L}}0-9 ]{{3,20}} ?: ?{_AMOUNT}$"
SIGNATURE = rf"(?U)^(?:[\p{{L}}0-9]+(?: [\p{{L}}0-9]+)? ?:|[\p{{L}}0-9]{{1,6}}\.) {_NAME}$"
NUMBER = r"(?U)^[\p{L}0-9]{1,6}[.°º]? ?:? ?\p{Lu}[\p{Lu}0-9]{1,5}-[0-9]{2,}/[0-9]+$"
TELEPHONE = r"(?U)^[\p{L}0-9]{2,9}[.:] ?\+?[0-9lO][0-9lO ()/]*-[0-9lO ()/\-]+$"
END_MARK = r"(?U)^\[\p{L}[\p{L}0-9 ]*\]$"
MACHINE = r"^(?=.*<)(?![A-Z]<)(?:[A-Z0-9<]{30}|[A-Z0-9<]{36}|[A-Z0-9<]{44})$"
CLOSING_LINES = (PAGE, TOTAL, SIGNATURE, NUMBER, TELEPHONE, END_MARK, MACHINE)
#: The line before a bare name: a short greeting, with a comma or in a language that writes none. Wrapped lines are longer.
GREETING = r"(?U)^\p{Lu}[\p{L}0-9 ]{3,28}(?:,|\p{L})$"

# What follows is matched against the text written backwards, so that every search is anchored and stops where it should.
SENTENCE = r"^[\"'”’»“)\]]*[.!?。]"
#: A point that ends no sentence: after a day or a day and month, inside an amount, or in a row of a list.
_DIVIDED = r"^\.(?:(?:(?:[1-9]0?|[0-2]1)\.)?(?:[0-9][12]?|[01]3)\s+[^0-9\s]|[0-9,]*[0-9] ?\$|[0-9]{3},[0-9]|[0-9]+ +[0-9])"
_ABBREVIATIONS = ("Tel.", "Tél.", "No.", "Nr.", "Núm.", "Num.", "Gez.", "Ref.", "Réf.", "Pág.")
_MARKS = r"^(?:[\s\p{Cc}\p{Cf}\xa0 -    　]|…|\.\.\.|\.+(?=\s)|\]\.\.\.\[|\)\.\.\.\(|[\-‐‑–—―~*#_|>\\])*+"


def stop_backwards(text: Column) -> Column:
    """The text up to its last character that is neither white space nor a mark of omission, written backwards."""
    return F.regexp_replace(F.reverse(text), _MARKS, "")


def flat(text: Column) -> Column:
    """White space as single blanks, none at the ends: copies that were wrapped otherwise are equal."""
    return F.btrim(F.regexp_replace(text, r"[\s\x00-\x1f\x7f\xa0　]{2,}|[\t\n\x0b\f\r\x00-\x1f\x7f\xa0　]", " "))


def looks_complete(backwards: Column) -> Column:
    """Whether a text without its trailing marks, written backwards, ends with a sentence or a closing line."""
    lines = F.translate(F.substring_index(backwards, "\n", 4), "\r\f", "\n\n")
    last = F.substring_index(lines, "\n", 1)
    before = F.reverse(F.btrim(F.substring_index(F.ltrim(F.substr(lines, F.length(last) + 1), F.lit(" \n")), "\n", 1)))
    line = F.regexp_replace(F.btrim(F.reverse(last)), r"^(?:[>|]\s*)+", "")
    sentence = backwards.rlike(SENTENCE) & ~backwards.rlike(_DIVIDED) & ~line.isin(*_ABBREVIATIONS)
    closing = F.lit(False)
    for form in CLOSING_LINES:
        closing = closing | line.rlike(form)
    named = line.rlike(rf"(?U)^{_NAME}$") & before.rlike(GREETING)
    return sentence | closing | named


#: Found texts have no place. Of each part: the first text, with the lengths at which later ones leave it inside a word or number, and the texts still open at its end.
CONTINUED = "text string, part int, place string, lengths array<int>"


def _goes_on(shorter: str, longer: str) -> bool:
    """Whether ``longer`` begins with ``shorter`` and goes on inside a word or number."""
    if len(longer) <= len(shorter) or not shorter or not longer.startswith(shorter):
        return False
    last, following = shorter[-1], longer[len(shorter)]
    return following.isalnum() and (last.isalnum() or (last in ".,/-" and shorter[-2:-1].isdigit() and following.isdigit()))


def _continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted part: the texts that another one continues, and what the parts before and after it need."""
    from pyspark import TaskContext

    part, first, common, lengths = TaskContext.get().partitionId(), None, 0, set()
    # [text, found]: each is a prefix of the next. A text that comes goes on as the one above does, if there is one, so only the topmost is compared.
    stack: list[list] = []
    for batch in batches:
        out = []
        for t in batch.column(0).to_pylist():
            if first is None:
                first, common = t, len(t)
            # Texts of earlier parts that this part continues are beginnings of its first text; one of this length goes on with t.
            common = _common(first, t, common)
            if 0 < common < len(first) and common not in lengths and _goes_on(first[:common], t):
                lengths.add(common)
            while stack and not t.startswith(stack[-1][0]):
                stack.pop()
            if stack and not stack[-1][1] and _goes_on(stack[-1][0], t):
                stack[-1][1] = True
                out.append((stack[-1][0], None, None, None))
            stack.append([t, False])
        yield _rows(out)
    if first is not None:
        yield _rows([(first, part, "first", sorted(lengths)), *((t, part, "open", None) for t, found in stack if not found)])


def _common(a: str, b: str, most: int) -> int:
    """How many characters, at most ``most``, two texts begin with in common."""
    if b.startswith(a[:most]):
        return most
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if b.startswith(a[:middle]) else (low, middle)
    return low


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the parts' first and open texts, by part: the open ones that a later part continues."""
    waiting: list[str] = []
    for batch in batches:
        out = []
        for t, _, place, lengths in zip(*(c.to_pylist() for c in batch.columns)):
            if place == "open":
                waiting.append(t)
                continue
            waiting = [s for s in waiting if t.startswith(s)]
            found = {s for s in waiting if len(s) in lengths or _goes_on(s, t)}
            out += [(s, None, None, None) for s in found]
            waiting = [s for s in waiting if s not in found]
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    fields = list(zip(*out)) if out else [[]] * 4
    types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(fields, types)], names=["text", "part", "place", "lengths"])


def cut_in_copies(texts: DataFrame) -> DataFrame:
    """Of the distinct ``texts`` (text): those that some other one continues inside a word or number.

    What continues over the end of a part is settled by one task, which gets of each part its first text and
    those that its last one continues (itself included) and that are not found yet.
    """
    ordered = texts.repartitionByRange("text").sortWithinPartitions("text")
    found = ordered.mapInArrow(_continued, CONTINUED)
    ends = found.where("place IS NOT NULL").repartition(1).sortWithinPartitions("part", "place")
    return found.where("place IS NULL").unionByName(ends.mapInArrow(_across, CONTINUED)).select("text")


def _prepared(documents: DataFrame) -> DataFrame:
    given = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    stopped = given.withColumn("backwards", stop_backwards(F.col("text"))).where("backwards <> ''")
    return stopped.select("doc_id", "source", "text", F.reverse("backwards").alias("stopped"), looks_complete(F.col("backwards")).alias("complete"))


def truncated(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, source, evidence: 'ending' or 'copy') of the texts that stop inside a word or sentence; documents has doc_id, text, source."""
    ended = _prepared(documents)
    ending = ended.where(~F.col("complete")).select("doc_id", "source", F.lit("ending").alias("evidence"))
    both = F.array(flat(F.col("text")), F.when(F.col("complete"), flat(F.col("stopped"))))
    known = ended.select(F.explode(F.array_compact(F.array_distinct(both))).alias("text")).distinct()
    cut = Workspace(documents.sparkSession, "truncated").save(cut_in_copies(known).select(_identity(F.col("text")).alias("hash")), "cut")
    found = cut.count()
    if not found:
        return ending.dropDuplicates(["doc_id"])
    seeming = ended.where("complete").select("doc_id", "source", _identity(flat(F.col("stopped"))).alias("hash"))
    likely = seeming.where(might_contain(bloom_of(cut, F.xxhash64("hash"), found), F.xxhash64("hash")))
    copy = salted_join(likely, cut, "hash", "left_semi").select("doc_id", "source", F.lit("copy").alias("evidence"))
    return ending.unionByName(copy).dropDuplicates(["doc_id"])


def _identity(text: Column) -> Column:
    return F.sha2(text, 256)


def by_source(documents: DataFrame) -> DataFrame:
    """Per source: document_count (texts that could be cut), truncated_count, truncated_share, and the length at which most of its cut texts stop (the least of equals)."""
    could = _prepared(documents).groupBy("source").agg(F.countDistinct("doc_id").alias("document_count"))
    lengths = documents.select("doc_id", F.length("text").alias("length")).dropDuplicates(["doc_id"])
    cut = truncated(documents).join(lengths, "doc_id").groupBy("source", "length").agg(F.count("*").alias("n"))
    per = cut.groupBy("source").agg(F.sum("n").alias("truncated_count"), F.max(F.struct("n", -F.col("length"))).alias("most"))
    joined = could.join(per, could.source.eqNullSafe(per.source), "left").select(could.source, "document_count", F.coalesce("truncated_count", F.lit(0)).alias("truncated_count"), (-F.col("most.col2")).alias("usual_length"))
    return joined.withColumn("truncated_share", F.col("truncated_count") / F.col("document_count"))
