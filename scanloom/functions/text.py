"""Measures of recognised text: script shares, language scores, confidence, special zones. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
VIETNAMESE = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
ENGLISH_WORDS = "the and for are but not you all can had was one our out day get has him his how man new now old see two way who boy did its let put say she too use"
FRENCH_WORDS = "le la les un une des du de et est avec pour dans sur"
MRZ_LINES = (r"^[A-Z0-9<]{30,44}$", r"^P<[A-Z]{3}[A-Z<]{39}$", r"^[ACIV][A-Z0-9<]{30,43}$")
DATES = (r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}", r"[0-9]{2,4}[/-][0-9]{1,2}[/-][0-9]{1,2}")
NUMERIC_SHARE = 0.6

VIETNAMESE_CLASS = f"[{VIETNAMESE}{VIETNAMESE.upper()}]"
WORD = r"[\p{L}\p{N}_]+"


def _share(count: Column, text: Column) -> Column:
    return F.when(F.length(text) > 0, count / F.length(text))


def letters(text: Column, kind: str) -> Column:
    """How many characters of a class a text has: runs of them are taken out at once, which costs a match a run and not a character."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def vietnamese_letters(text: Column) -> Column:
    """Letters of the Vietnamese class. None is ASCII, so the class is only tried on what is left without ASCII."""
    return letters(F.regexp_replace(text, r"[\x00-\x7f]+", ""), VIETNAMESE_CLASS)


def words(text: Column) -> Column:
    return F.split(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")), " ")


def script_shares(text: Column) -> dict[str, Column]:
    """Shares of Latin, Vietnamese and numeric characters, and 1 if a line looks machine-readable; null for empty text."""
    mrz = F.lit(False)
    for line in MRZ_LINES:
        mrz = mrz | text.rlike(f"(?m){line}")
    return {
        "latin": _share(letters(text, "[a-zA-Z]"), text),
        "vietnamese": _share(vietnamese_letters(text), text),
        "numeric": _share(letters(text, "[0-9]"), text),
        "mrz": F.when(F.length(text) > 0, mrz.cast("int").cast("double")),
    }


def first_largest(scores: dict[str, Column], otherwise: str) -> Column:
    """The name of the largest score, the first of equals; scores that are null do not take part."""
    best = F.greatest(*scores.values())
    chosen = F.when(best.isNull(), otherwise)
    for name, score in scores.items():
        chosen = chosen.when(score == best, name)
    return chosen


def dominant_script(text: Column) -> Column:
    return first_largest(script_shares(text), "unknown")


def language_scores(text: Column, tokens: Column | None = None) -> dict[str, Column]:
    """Percent scores by Vietnamese letters, English stop words and French words; null where a language leaves no trace (English: without words).

    ``tokens``: the text's ``words``, if they have been computed already.
    """
    tokens = words(text) if tokens is None else tokens
    known = F.filter(tokens, lambda w: w != "")
    count = F.size(known)
    vie = vietnamese_letters(text)
    hits = lambda listed: F.size(F.filter(tokens, lambda w: w.isin(listed.split())))
    eng, fra = hits(ENGLISH_WORDS), hits(FRENCH_WORDS)
    return {
        "vie": F.when(vie > 0, F.least(F.lit(95.0), vie / F.length(text) * 200)),
        "eng": F.when(count > 0, F.least(F.lit(90.0), eng / count * 100)),
        "fra": F.when((fra > 0) & (count > 0), F.least(F.lit(85.0), fra / count * 100)),
    }


def combined_language(text: Column, recognised: dict[str, Column] | None = None) -> Column:
    """The language of the largest score, patterns and the confidences of a recogniser (``recognised``) together; 'eng' without any."""
    scores = language_scores(text)
    for name, confidence in (recognised or {}).items():
        scores[name] = F.greatest(confidence, scores[name]) if name in scores else confidence
    return first_largest(scores, "eng")


def detect(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``script`` and ``language``, by way of ``measured``."""
    out = measured(df, text)
    shares, scores = [c for c in out.columns if c.startswith("share_")], [c for c in out.columns if c.startswith("score_")]
    script = first_largest({c[6:]: F.col(c) for c in shares}, "unknown")
    language = first_largest({c[6:]: F.col(c) for c in scores}, "eng")
    return out.withColumns({"script": script, "language": language}).drop(*shares, *scores)


def measured(df: DataFrame, text: str) -> DataFrame:
    """``df`` with share_* and score_*: words first, then shares and scores, in projections of their own, so that each is computed once."""
    shares = {f"share_{k}": c for k, c in script_shares(F.col(text)).items()}
    scores = {f"score_{k}": c for k, c in language_scores(F.col(text), F.col("_words")).items()}
    return df.withColumns(shares | {"_words": words(F.col(text))}).withColumns(scores).drop("_words")


def ocr_confidence(text: Column, vietnamese: Column) -> Column:
    """Confidence from length, variety of characters and, for Vietnamese, its letters; at most 95, 0 for blank text."""
    variety = F.size(F.array_distinct(F.split(F.lower(text), "")))
    base = F.least(F.lit(80.0), F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) / 10)
    bonus = F.when(variety > 10, 15.0).when(variety > 5, 10.0).otherwise(0.0)
    accents = F.when(vietnamese & text.rlike(VIETNAMESE_CLASS), 20.0).otherwise(0.0)
    return F.when(text.rlike(r"\S"), F.least(F.lit(95.0), base + bonus + accents)).otherwise(F.when(text.isNotNull(), 0.0))


def date_count(text: Column) -> Column:
    """Dates by both patterns; one that fits both counts twice."""
    return F.regexp_count(text, F.lit(DATES[0])) + F.regexp_count(text, F.lit(DATES[1]))


def mrz_lines(text: Column) -> Column:
    """The machine-readable lines of a text, a line once for each pattern it fits."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\r\t", "  ")))
    fits = lambda pattern: F.filter(lines, lambda x: x.rlike(pattern))
    return F.concat(*[fits(p) for p in MRZ_LINES])


def numeric_heavy(text: Column) -> Column:
    return script_shares(text)["numeric"] > NUMERIC_SHARE


def likely_handwritten(text: Column, edge_density: Column) -> Column:
    return (edge_density > 0.1) & (F.length(text) < 50)


def sample(text: Column, length: int = 200) -> Column:
    return F.substring(text, 1, length)
