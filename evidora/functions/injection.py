"""Text that speaks to a model instead of to a reader, and the fence that such text is quoted in.

A family is a chain of slots, each a list of words, with at most so many other words
between two of them.  The patterns are made from these tables, so a family gets
another language or word by a longer list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERS = ("instruction", "instructions", "prompt", "prompts", "rule", "rules", "message", "messages", "context", "guidance", "directions", "orders")
BEFORE = ("previous", "prior", "earlier", "preceding", "above", "former", "system")
ORDERS_ES = ("instrucciones", "indicaciones", "reglas", "normas", "ordenes", "órdenes", "mensajes", "contexto")
BEFORE_ES = ("previo", "previos", "previa", "previas", "anterior", "anteriores", "del sistema")
STATUS = ("source of record", "source-of-record", "source_of_record", "authoritative", "approved", "verified", "official")
STATUS_ES = ("fuente oficial", "fuente de registro", "oficial", "aprobado", "aprobada", "verificado", "verificada", "autorizado", "autorizada")

# name -> slots, with the number of other words that may stand before each of them but the first
FAMILIES = {
    "discard_en": (("ignore", "disregard", "forget", "skip"), (3, BEFORE), (1, ORDERS)),
    "discard_es": (("ignora", "ignore", "ignorad", "olvida", "olvide", "descarta", "descarte", "omite", "omita"), (2, ORDERS_ES), (1, BEFORE_ES)),
    "persona": (("you are now", "from now on you are", "ahora eres"), (0, ("a", "an", "the", "my", "un", "una", "el", "la"))),
    "new_orders": (("new", "updated"), (1, tuple(f"{x}:" for x in (*ORDERS, "role", "task")))),
    "false_header": (("system", "developer", "administrator"), (0, tuple(f"{x}:" for x in ("prompt", "message", "instruction", "instructions", "note")))),
    "override": (("override", "bypass", "circumvent"), (0, ("your", "the", "all", "any")), (1, (*ORDERS, "guardrail", "guardrails", "safeguards", "policies", "system"))),
    "promote_en": (("mark", "label", "treat", "classify"), (0, ("this", "it", "the following")), (3, STATUS)),
    "promote_es": (("marca", "marque", "trata", "trate", "considera", "considere"), (0, ("esta", "este", "esto", "la siguiente", "lo siguiente")), (2, ("como",)), (0, STATUS_ES)),
    "unbound_role": (("act as", "behave as", "pretend to be", "respond as"), (14, ("not bound", "no restriction", "no restrictions", "unrestricted", "without limits", "jailbreak", "jailbroken"))),
    "conceal": (("do not", "don't", "never"), (0, ("cite", "mention", "disclose", "reveal", "show")), (7, ("source", "sources", "review", "unverified", "limitation", "limitations"))),
}


def pattern(first: tuple[str, ...], *slots: tuple[int, tuple[str, ...]]) -> str:
    """An expression that Java and RE2 read alike: a word of the first slot, then of each next one after at most its number of other words."""

    def any_of(words):
        return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"

    out = r"(?i)\b" + any_of(first)
    for between, words in slots:
        out += (rf"(?:\s+\S+){{0,{between}}}?" if between else "") + r"\s+" + any_of(words)
    return out + ("" if slots and slots[-1][1][0].endswith(":") else r"\b")


PATTERNS = {name: pattern(*slots) for name, slots in FAMILIES.items()}


def families(text: Column) -> Column:
    """The names of the families that a text holds, in the order of the table."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in PATTERNS.items())), lambda x: x.isNotNull())


def fenced(body: Column) -> Column:
    """Text of others between two lines that name its own digest, which it cannot hold: nothing inside can close the quotation."""
    mark = F.substring(F.sha2(body, 256), 1, 24)
    return F.concat(F.lit("[quoted text "), mark, F.lit(" begins]\n"), body, F.lit("\n[quoted text "), mark, F.lit(" ends]"))
