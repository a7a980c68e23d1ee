"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and what is left of them without (fixed values).
MARKED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕŌÚÙÛÜŪÑÇÝ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuncyyAAAAAAAEEEEEIIIIIOOOOOOUUUUUNCY"


def money(column: str | Column) -> Column:
    """An amount as a decimal, so that sums do not depend on their order."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def amount(column: Column) -> Column:
    return F.round(column, 2).cast("double")


def ratio(top: Column, bottom: Column, digits: int = 4) -> Column:
    """top / bottom, null where bottom is 0."""
    return F.round(F.try_divide(top.cast("double"), bottom.cast("double")), digits)


def fold(text: Column) -> Column:
    """Lower case without marks; a text that is plain ASCII, which its length in bytes tells, is not searched for them."""
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, MARKED, PLAIN)))


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct runs of a-z and 0-9 of the folded text with at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda t: F.length(t) >= least))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 6)


def first_rule(text: Column, rules, default=None) -> Column:
    """The value of the first (pattern, value) whose pattern is found in the text."""
    out = F.lit(default)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n words of the lower-case text; none if it has fewer.

    The words are zipped with themselves moved on, because a lambda would split the text anew for every run.
    """
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    runs = words
    for i in range(2, n + 1):
        runs = F.zip_with(runs, F.slice(words, i, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(runs, lambda r: r.isNotNull()))
