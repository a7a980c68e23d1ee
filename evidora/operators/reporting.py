"""Reporting over snapshot facts: latest rows, totals, ratios, time buckets and status colours.

Money is summed as decimals; every "now" is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.columns import amount, money, ratio

COLOUR_ORDER = ("Red", "Amber", "Blue", "Green", "Grey")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key: by the largest of ``order``, the last of which should be unique.

    An aggregate keeps one row for each key on the map side, so a key with very many snapshots is no hot group.
    """
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")).select(*keys, "newest.*")


def at_latest_date(rows: DataFrame, key: str, date: str) -> DataFrame:
    """Rows at their key's last date."""
    last = rows.groupBy(key).agg(F.max(date).alias(date))
    return rows.join(last, [key, date])


def totals(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0).cast("decimal(18,2)")).cast("double").alias(n) for n, c in sums.items()))


def cash_flow(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Inflow, outflow and net of signed amounts."""
    m = money("amount")
    return totals(rows, keys, inflow=F.when(m > 0, m), outflow=F.when(m <= 0, m), net=m)


def quarter_label(date: Column) -> Column:
    return F.concat(F.year(date), F.lit(" Q"), F.quarter(date))


def status_colour(status: Column, blocked: Column) -> Column:
    return (F.when(blocked, "Red").when(status == "CP", "Green").when(status.isin("IP", "AT"), "Amber").when(status.isin("BL", "DL"), "Red").otherwise("Grey"))


def worst_colour(colour: Column) -> Column:
    """Aggregate: the worst colour of a group."""
    rank = F.lit(len(COLOUR_ORDER))
    for i, name in enumerate(COLOUR_ORDER):
        rank = F.when(colour == name, i).otherwise(rank)
    return F.element_at(F.array(*map(F.lit, COLOUR_ORDER)), F.min(rank) + 1)


def readiness(rows: DataFrame, key: str) -> DataFrame:
    """Share of the weight that is complete, in whole percent, with the worst colour."""
    done = F.sum(F.when(F.col("status") == "CP", F.col("weight")).otherwise(0))
    return rows.groupBy(key).agg(F.round(F.try_divide(100.0 * done, F.sum("weight"))).cast("long").alias("score"), worst_colour(status_colour(F.col("status"), F.col("blocked"))).alias("worst"))


def variance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Budget, forecast, paid and committed with their ratios, what is left of the contingency, and a colour by the forecast's excess."""
    t = totals(rows, keys, **{m: F.col(m) for m in ("budget", "eac", "paid", "committed", "invoiced", "contingency", "contingency_used")})
    over = ratio(F.col("eac") - F.col("budget"), F.col("budget"), 6)
    return (t.withColumn("variance_pct", over).withColumn("paid_pct", ratio(F.col("paid"), F.col("budget"), 6))
            .withColumn("committed_pct", ratio(F.col("committed"), F.col("budget"), 6)).withColumn("contingency_left", F.round(F.col("contingency") - F.col("contingency_used"), 2))
            .withColumn("colour", F.when(F.col("variance_pct") > 0.05, "Red").when(F.col("variance_pct") > 0.02, "Amber").otherwise("Green")))


def week_grid(rows: DataFrame, start: str, weeks: int = 4) -> DataFrame:
    """Sum of ``value`` by week after ``start`` and weekday, Monday 0."""
    offset = F.datediff("day", F.lit(start).cast("date"))
    return (rows.withColumn("offset", offset).where(F.col("offset").between(0, 7 * weeks - 1)).groupBy((F.floor(F.col("offset") / 7) + 1).alias("week"), F.weekday("day").alias("weekday"))
            .agg(amount(F.sum(money("value"))).alias("value")))


def feed(*sources: DataFrame, k: int = 50) -> DataFrame:
    """The newest rows of several feeds with the columns happened_at, kind and id."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy(F.desc("happened_at"), "kind", "id").limit(k)


def trailing(rows: DataFrame, key: str, date: str, n: int) -> DataFrame:
    """The last n dates of each key; ``rows`` has a row for each key and date."""
    w = Window.partitionBy(key).orderBy(F.desc(date))
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
