"""URL filter: rules for hosts and paths, and a character language-model ratio for the rest.

URLs that a rule decides are the labelled examples.  Two variable-order Markov
models over characters, one of accepted and one of rejected URLs, are tables of
counts: every gram of a character and its context of up to four characters, from
all labelled URLs but a fifth.  The probability of a character interpolates all
orders, ``p_k = (n(context, c) + s * p_(k-1)) / (n(context) + s)``, so unseen
contexts fall back on shorter ones.  The log-ratio is worked out once for each
distinct gram of the corpus by joins with these tables; a URL's score is the mean
over its characters, calibrated on the labelled URLs that were not counted, with
equal weight for accepted and rejected ones.

Everything is DataFrame functions; there is no Python on the executors.

Cases: a null URL, an empty one and one without ``://`` have empty host and
path, fit no rule and are judged on their whole string (null: as empty, whose
ratio is 0); without both classes of labelled URLs the method allows; a null
page_id is judged like any other; equal URLs are judged once and all get the
verdict; a URL of any length is judged whole; a score of exactly one half allows;
extra columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import staged

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
ORDER = 5             # longest gram: a character and up to four before it
SMOOTHING = 2.0
START = "\x02"        # stands before the first character
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    rest = F.expr(f"coalesce(case when instr({url}, '://') > 0 then substring({url}, instr({url}, '://') + 3) end, '')")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; ``rules`` is a short list."""
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        of, slash, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        name, says = F.when(fits, rule).otherwise(name), F.when(fits, verdict).otherwise(says)
    return name, says


def all_grams(text: Column) -> Column:
    """Every run of ORDER characters.  Characters are zipped with themselves moved on: a substring would count from the start each time."""
    chars = F.split(text, "")
    runs = chars
    for i in range(2, ORDER + 1):
        runs = F.zip_with(runs, F.slice(chars, i, 1 << 30), lambda a, b: F.concat(a, b))
    return F.filter(runs, lambda g: g.isNotNull())


def gram_ratios(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """gram and log P(its last character | accepted) - log P(... | rejected) for all of ``grams``; counts has gram, a and r."""
    total = counts.agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    out = grams.withColumns({"pa": F.lit(1 / 256), "pr": F.lit(1 / 256)})
    for k in range(1, ORDER + 1):
        def summed(start: int, length: int, name: str):
            key = F.substring("gram", start, length)
            return counts.groupBy(key.alias("key")).agg(F.sum("a").alias(f"a_{name}"), F.sum("r").alias(f"r_{name}"))

        out = out.withColumn("key", F.substring("gram", ORDER - k + 1, k)).join(summed(ORDER - k + 1, k, "n"), "key", "left").drop("key")
        if k > 1:
            out = out.withColumn("key", F.substring("gram", ORDER - k + 1, k - 1)).join(summed(ORDER - k + 1, k - 1, "c"), "key", "left").drop("key")
        else:
            out = out.withColumns({"a_c": F.lit(total.a), "r_c": F.lit(total.r)})
        out = out.select("gram", *((F.coalesce(f"{x}_n", F.lit(0)) + SMOOTHING * F.col(f"p{x}")).__truediv__(F.coalesce(f"{x}_c", F.lit(0)) + SMOOTHING).alias(f"p{x}") for x in "ar"))
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def calibrated(labelled: DataFrame) -> tuple[float, float]:
    """Slope and offset of P(accepted) as a logistic function of the ratio: normal classes of equal variance and equal weight; has ratio, a and r.

    How many URLs the rules accept and reject says nothing of those that no rule fits, so both classes weigh alike: the
    threshold stands half-way between their means.
    """
    s = labelled.agg(*(f(x).alias(f"{n}{x}") for x in "ar" for n, f in (
        ("n", F.sum), ("m", lambda w: F.sum(F.col(w) * F.col("ratio"))), ("v", lambda w: F.sum(F.col(w) * F.col("ratio") * F.col("ratio")))))).first()
    if not s.na or not s.nr:
        return 1.0, 0.0
    ma, mr = s.ma / s.na, s.mr / s.nr
    spread = max((s.va - s.na * ma * ma + s.vr - s.nr * mr * mr) / (s.na + s.nr), 1e-6)
    slope = (ma - mr) / spread
    return slope, -slope * (ma + mr) / 2


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's ``score``, the calibrated probability that the URL is accepted."""
    host, path = host_and_path("url")
    split = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    judged = split.withColumns({"rule": rule, "says": says, "text": F.coalesce(F.regexp_replace("url", "^[A-Za-z]+://", ""), F.lit(""))}).drop("url")
    texts = staged(judged.groupBy("text").agg(F.count_if(F.col("says") == "allow").alias("a"), F.count_if(F.col("says") == "block").alias("r"))
                   .select(F.monotonically_increasing_id().alias("id"), "text", "a", "r", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0).alias("fresh")), "urls")
    seen = texts.where("not fresh").agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    if not seen.a or not seen.r:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("says", F.lit("allow")).alias("verdict"), F.lit(1.0).alias("score"))
    grams = texts.where("text != ''").select("id", "a", "r", "fresh", F.explode(all_grams(F.concat(F.lit(START * (ORDER - 1)), F.col("text")))).alias("gram"))
    counts = staged(grams.where("not fresh and a + r > 0").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "grams")
    seen_grams = grams.groupBy("gram").agg(F.count("*").alias("n"))
    ratios = staged(gram_ratios(seen_grams.select("gram"), counts).join(seen_grams, "gram"), "gram-ratios")
    # Of the grams that make a thousandth of all occurrences there are at most a thousand: these are joined by broadcast.
    hot = F.broadcast(ratios.where(F.col("n") > F.lit((ratios.agg(F.sum("n").alias("n")).first().n or 0) / 1000)).select("gram", "ratio"))
    of_url = grams.select("id", "gram")
    found = of_url.join(hot, "gram").unionByName(of_url.join(hot.select("gram"), "gram", "left_anti").join(ratios.select("gram", "ratio"), "gram"))
    means = found.groupBy("id").agg(F.avg("ratio").alias("ratio"))
    scored = staged(texts.join(means, "id", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0))), "ratios")
    slope, offset = calibrated(scored.where("fresh and a + r > 0"))
    return (judged.join(scored.select("text", (1 / (1 + F.exp(-(slope * F.col("ratio") + offset)))).alias("score")), "text")
            .select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score"))
