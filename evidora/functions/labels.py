"""Values from loosely typed metadata, and the labels, headers and figures that readers see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNREVIEWED = " [UNREVIEWED]"
REVIEW_STATES = ("pending", "approved", "rejected", "needs_review")
STOP = ("para", "como", "with", "from", "that", "this", "document", "documento", "find", "show")


def string_value(raw: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(raw), F.lit(""))


def number_value(raw: Column) -> Column:
    """The finite number that a text is, else null."""
    n = F.trim(raw).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def inert(text: Column, length: int = 160) -> Column:
    """One line without control characters, of at most ``length`` characters; null if empty."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]+", " "), r"\s+", " ")), 1, length), F.lit(""))


def review_state(status: Column) -> Column:
    """A known review status; anything else needs review."""
    return F.when(status.isin(*REVIEW_STATES), status).otherwise("needs_review")


def source_label(project: Column, kind: Column, title: Column, status: Column) -> Column:
    parts = F.concat_ws(" | ", inert(string_value(project)), inert(string_value(kind)), inert(F.coalesce(string_value(title), F.lit("unknown source"))))
    return F.concat(parts, F.when(review_state(status).isin("pending", "needs_review"), UNREVIEWED).otherwise(""))


def source_header(place: Column, project: Column, kind: Column, period: Column, title: Column, authority: Column, status: Column, relevance: Column) -> Column:
    known = lambda c, default: F.coalesce(inert(string_value(c)), F.lit(default))
    share = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), relevance)) * 100).cast("int")
    return F.concat(F.lit("[Source "), place.cast("string"), F.lit("] "), known(project, "?"), F.lit(" | "), known(kind, "?"), F.coalesce(F.concat(F.lit(" | "), inert(string_value(period))), F.lit("")), F.lit(" | "), known(title, "unknown"),
                    F.coalesce(F.concat(F.lit(" | authority "), authority.cast("string")), F.lit("")), F.lit(" | review "), review_state(status), F.lit(" ("), share.cast("string"), F.lit("%)"))


def identifiers(text: Column, most: int = 3) -> Column:
    """The first distinct codes of a text: capitals and digits, two capitals or more ahead of a digit that six others follow in all."""
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z0-9]+)\b")), lambda w: w.rlike("^[A-Z][A-Z][A-Z0-9]*[0-9][A-Z0-9]{5,}$"))), 1, most)


def significant(text: Column) -> Column:
    """Distinct words of four letters or digits and more, without stop words."""
    return F.array_except(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4), F.array(*map(F.lit, STOP)))


def compact(amount: Column, sign: str = "€") -> Column:
    """12.3M, 45K or 678, with the currency's sign."""
    size = F.abs(amount)
    figure = (F.when(size >= 1_000_000, F.concat(F.format_string("%.1f", F.round(size / 1_000_000, 1)), F.lit("M"))).when(size >= 1_000, F.concat(F.format_string("%.0f", F.round(size / 1_000)), F.lit("K")))
              .otherwise(F.format_string("%.0f", F.round(size))))
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit(sign), figure)


def page_of(raw: Column) -> Column:
    """A whole page number from 1."""
    n = number_value(raw)
    return F.when((n >= 1) & (n == F.floor(n)), n.cast("int"))


def verdict(stated: Column, *scores: Column) -> Column:
    """A judge's verdict where it is one, else what the mean of its scores says."""
    mean = sum(scores[1:], scores[0]) / len(scores)
    word = F.lower(F.trim(F.coalesce(stated, F.lit(""))))
    return F.when(word.isin("pass", "weak", "fail"), word).when(mean >= 4, "pass").when(mean >= 3, "weak").otherwise("fail")
