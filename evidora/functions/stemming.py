"""Light stemming of folded English and Spanish words by suffix rules, for columns, for plain strings and for SQL alike.

A rule is an expression that finds a word's end and what is left in its place, written
so that Java, RE2 and Python read it alike; a language's rules are applied one after
another.  A word has the stems of both languages, as it is not known which one it is of,
and is left out if either has it as a stop word.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidora.functions.columns import MARKED, PLAIN, fold

LEAST = 3  # characters of a word that counts
ENGLISH = (
    (r"^(.{2,}(?:ss|x|z|ch|sh))es$", r"\1"),       # boxes, classes
    (r"^(.{2,})ies$", r"\1y"),                     # companies
    (r"^(.{2,}[^aius])s$", r"\1"),                 # loans, rates; not business, analysis
    (r"^(.{4,})ations?$", r"\1"),                  # valuation
    (r"^(.*[aeiouy].+)(?:ings?|ed|ly)$", r"\1"),   # lending, signed; not string
    (r"^(?:(.+b)b|(.+d)d|(.+g)g|(.+m)m|(.+n)n|(.+p)p|(.+r)r|(.+t)t)$", r"\1\2\3\4\5\6\7\8"),  # planned
    (r"^(.{2,}?)e+$", r"\1"),                      # value, finance, agree
    (r"^(.{2,}[^aeiou])y$", r"\1i"),               # company, with companies
)
SPANISH = (
    (r"^(.{2,})ces$", r"\1z"),                     # veces
    (r"^(.{3,}[aeiou])s$", r"\1"),                 # contratos, cuentas
    (r"^(.{4,}?)(?:amente|mente)$", r"\1"),        # anualmente
    (r"^(.{4,})acione?$", r"\1"),                  # financiacion, financiaciones
    (r"^(.{3,}?)[aeo]$", r"\1"),                   # contrato, cuenta
    (r"^(.{3,}?)(?:and|iend|aron|ieron|ad|id|ab|ar|er|ir)$", r"\1"),  # firmado, vender, poder
)
STOP_ENGLISH = ("the", "and", "that", "for", "was", "with", "are", "from", "this", "have", "has", "had", "not", "but", "you", "your", "his", "her", "its", "our", "they", "them", "their", "who", "what", "which", "when", "where", "will", "would", "can",
                "could", "should", "been", "were", "does", "did", "than", "then", "there", "these", "those", "into", "about", "all", "any", "how", "why", "also")
STOP_SPANISH = ("los", "las", "una", "unos", "unas", "del", "que", "por", "para", "con", "como", "este", "esta", "estos", "estas", "ese", "esa", "sus", "mas", "pero", "sin", "sobre", "entre", "hasta", "desde", "cuando", "donde", "quien", "cual", "cuales",
                "hay", "han", "ser", "son", "fue", "muy", "tambien", "porque", "todo", "toda", "todos", "todas", "nos", "les")
STOP = STOP_ENGLISH + STOP_SPANISH
LANGUAGES = (ENGLISH, SPANISH)
# The last characters of words that each rule can change; others need not be tried.
_ENDS = {ENGLISH: ("s", "s", "s", "ns", "gsdy", "bdgmnprt", "e", "y"), SPANISH: ("s", "s", "e", "ne", "aeo", "dnbr")}


def stemmed(word: Column, rules) -> Column:
    for found, left in rules:
        word = F.regexp_replace(word, found, left.replace("\\", "$"))
    return word


@lru_cache
def _compiled(rules):
    return tuple((ends, re.compile(found).sub, left) for (found, left), ends in zip(rules, _ENDS[rules], strict=True))


def stem(word: str, rules) -> str:
    for ends, sub, left in _compiled(rules):
        if word[-1:] in ends:
            word = sub(left, word)
    return word


def stem_sql(word: str, rules) -> str:
    for found, left in rules:
        word = f"regexp_replace({word}, '{found}', '{left}')"
    return word


def words(text: Column) -> Column:
    """All words of a text, folded, in order; their places in the array are their positions."""
    return F.split(fold(text), "[^a-z0-9]+")


def counts(word: Column) -> Column:
    return (F.length(word) >= LEAST) & ~word.isin(*STOP)


def lexemes(word: Column) -> Column:
    """The distinct stems of a folded word."""
    return F.array_distinct(F.array(*(stemmed(word, rules) for rules in LANGUAGES)))


def lexemes_of(text: str) -> list[str]:
    """The distinct stems of a string's words, sorted."""
    folded = text.translate(str.maketrans(MARKED, PLAIN)).lower()
    return sorted({stem(w, rules) for w in re.split("[^a-z0-9]+", folded) if len(w) >= LEAST and w not in STOP for rules in LANGUAGES})


FOLDED_SQL = "regexp_split_to_array(lower(translate({}, '" + MARKED + "', '" + PLAIN + "')), '[^a-z0-9]+')"
LEXEMES_SQL = "list_distinct([" + ", ".join(stem_sql("w", rules) for rules in LANGUAGES) + "])"
COUNTS_SQL = f"length(w) >= {LEAST} AND w NOT IN {STOP}"
