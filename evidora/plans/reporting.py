"""Reporting queries over facts derived from orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.functions.columns import money, ratio
from evidora.operators import reporting as r
from evidora.plans.registry import query
from evidora.sources.views import table

CASH = ("cash AS (SELECT concat('P', cast(o_custkey % 6 as varchar)) AS project_id, cast(o_orderdate as date) AS day, CASE WHEN o_orderstatus = 'F' THEN 'Actual' ELSE 'Forecast' END AS confidence, o_orderpriority AS category, "
        "cast(CASE WHEN o_custkey % 3 = 0 THEN o_totalprice ELSE -o_totalprice END as decimal(18,2)) AS amount FROM orders)")


def cash(spark, d):
    sign = F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return table(spark, d, "orders").select(F.concat(F.lit("P"), F.col("o_custkey") % 6).alias("project_id"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "F", "Actual").otherwise("Forecast").alias("confidence"),
                                            F.col("o_orderpriority").alias("category"), sign.cast("decimal(18,2)").alias("amount"))


_FLOW = "cast(coalesce(sum(amount) FILTER (amount > 0), 0) as double) AS inflow, cast(coalesce(sum(amount) FILTER (amount <= 0), 0) as double) AS outflow, cast(sum(amount) as double) AS net"


@query(f"WITH {CASH} SELECT project_id, {_FLOW}, cast(coalesce(sum(amount) FILTER (amount > 0 AND confidence = 'Actual'), 0) as double) AS actual_inflow, cast(coalesce(sum(amount) FILTER (amount <= 0 AND confidence = 'Actual'), 0) as double) AS actual_outflow FROM cash GROUP BY project_id")
def cash_summary(spark, d):
    c = cash(spark, d)
    m = money("amount")
    return r.totals(c, ["project_id"], inflow=F.when(m > 0, m), outflow=F.when(m <= 0, m), net=m, actual_inflow=F.when((m > 0) & (F.col("confidence") == "Actual"), m), actual_outflow=F.when((m <= 0) & (F.col("confidence") == "Actual"), m))


@query(f"WITH {CASH} SELECT concat(year(day), ' Q', quarter(day)) AS quarter, {_FLOW} FROM cash GROUP BY 1 ORDER BY 1")
def cash_by_quarter(spark, d):
    return r.cash_flow(cash(spark, d).withColumn("quarter", r.quarter_label(F.col("day"))), ["quarter"]).orderBy("quarter")


@query(f"WITH {CASH} SELECT project_id, concat(year(day), ' Q', quarter(day)) AS quarter, {_FLOW}, CASE WHEN bool_or(confidence <> 'Actual') THEN 'Forecast' ELSE 'Actual' END AS confidence FROM cash WHERE abs(amount) < 400000 AND day >= date '2000-11-01' GROUP BY 1, 2")
def cash_runway(spark, d):
    """Nine months before a given day, without amounts past the sanity limit."""
    c = cash(spark, d).where((F.abs("amount") < 400_000) & (F.col("day") >= F.add_months(F.lit("2001-08-01").cast("date"), -9))).withColumn("quarter", r.quarter_label(F.col("day")))
    worst = c.groupBy("project_id", "quarter").agg(F.when(F.bool_or(F.col("confidence") != "Actual"), "Forecast").otherwise("Actual").alias("confidence"))
    return r.cash_flow(c, ["project_id", "quarter"]).join(worst, ["project_id", "quarter"])


@query(f"WITH {CASH} SELECT category, cast(coalesce(sum(amount) FILTER (confidence = 'Actual'), 0) as double) AS actual, cast(coalesce(sum(amount) FILTER (confidence <> 'Actual'), 0) as double) AS forecast FROM cash WHERE category IN ('1-URGENT','2-HIGH','3-MEDIUM') GROUP BY category")
def cash_categories(spark, d):
    m = money("amount")
    return r.totals(cash(spark, d).where(F.col("category").isin("1-URGENT", "2-HIGH", "3-MEDIUM")), ["category"], actual=F.when(F.col("confidence") == "Actual", m), forecast=F.when(F.col("confidence") != "Actual", m))


CAPEX = ("capex AS (SELECT p_brand AS category, concat('P', cast(l_suppkey % 6 as varchar)) AS project_id, cast(l_extendedprice as decimal(18,2)) AS budget, cast(l_extendedprice as decimal(12,2)) * cast(1 + l_tax as decimal(5,2)) AS eac, "
         "cast(l_extendedprice as decimal(12,2)) * cast(1 - l_discount as decimal(5,2)) AS paid, cast(l_extendedprice as decimal(12,2)) * cast(0.9 as decimal(5,2)) AS committed, cast(l_extendedprice as decimal(12,2)) * cast(0.7 as decimal(5,2)) AS invoiced, "
         "cast(l_quantity as decimal(12,2)) AS contingency, CASE WHEN l_linestatus = 'F' THEN cast(l_quantity as decimal(12,2)) ELSE cast(0 as decimal(12,2)) END AS contingency_used, l_shipdate AS as_of FROM lineitem JOIN part ON l_partkey = p_partkey)")


def capex(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_discount", "l_shipdate", "l_quantity", "l_linestatus")
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity").cast("decimal(12,2)")
    share = lambda x: price.cast("decimal(12,2)") * F.lit(x).cast("decimal(5,2)")
    return li.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("category"), F.concat(F.lit("P"), F.col("l_suppkey") % 6).alias("project_id"), price.cast("decimal(18,2)").alias("budget"), (price.cast("decimal(12,2)") * (1 + F.col("l_tax")).cast("decimal(5,2)")).alias("eac"),
        (price.cast("decimal(12,2)") * (1 - F.col("l_discount")).cast("decimal(5,2)")).alias("paid"), share(0.9).alias("committed"), share(0.7).alias("invoiced"), quantity.alias("contingency"),
        F.when(F.col("l_linestatus") == "F", quantity).otherwise(F.lit(0).cast("decimal(12,2)")).alias("contingency_used"), F.col("l_shipdate").alias("as_of"))


_MEASURES = ("budget", "eac", "paid", "committed", "invoiced", "contingency", "contingency_used")
_SUMS = ", ".join(f"cast(sum({m}) as double) AS {m}" for m in _MEASURES)


@query(f"WITH {CAPEX} SELECT project_id, {_SUMS} FROM capex GROUP BY project_id")
def capex_summary(spark, d):
    return r.totals(capex(spark, d), ["project_id"], **{m: F.col(m) for m in _MEASURES})


@query(f"WITH {CAPEX}, t AS (SELECT project_id, category, {_SUMS} FROM capex GROUP BY ALL), v AS (SELECT *, round((eac - budget) / nullif(budget, 0), 6) AS variance_pct, round(paid / nullif(budget, 0), 6) AS paid_pct, round(committed / nullif(budget, 0), 6) AS committed_pct, round(contingency - contingency_used, 2) AS contingency_left FROM t) "
       "SELECT *, CASE WHEN variance_pct > 0.05 THEN 'Red' WHEN variance_pct > 0.02 THEN 'Amber' ELSE 'Green' END AS colour FROM v")
def capex_variance(spark, d):
    return r.variance(capex(spark, d), ["project_id", "category"])


_FUND = ("SELECT c_mktsegment AS instrument, cast(sum(cast(o_totalprice as decimal(18,2))) as double) AS committed, cast(coalesce(sum(cast(o_totalprice as decimal(18,2))) FILTER (o_orderstatus = 'F'), 0) as double) AS drawn, count(*) AS orders "
         "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")


@query(f"SELECT *, round(drawn / nullif(committed, 0), 6) AS drawn_ratio, CASE WHEN round(drawn / nullif(committed, 0), 6) > 0.85 THEN 'Amber' ELSE 'Green' END AS colour FROM ({_FUND})")
def funding_status(spark, d):
    m = money("o_totalprice")
    joined = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderstatus").join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("instrument")), F.col("o_custkey") == F.col("c_custkey"))
    t = joined.groupBy("instrument").agg(F.sum(m).cast("double").alias("committed"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", m)), F.lit(0).cast("decimal(18,2)")).cast("double").alias("drawn"), F.count("*").alias("orders"))
    return t.withColumn("drawn_ratio", ratio(F.col("drawn"), F.col("committed"), 6)).withColumn("colour", F.when(F.col("drawn_ratio") > 0.85, "Amber").otherwise("Green"))


SNAP = ("snap AS (SELECT user_id AS item_id, event_type AS task, event_id, ts, cast(ts as date) AS day, value, cast(user_id % 5 + 1 as int) AS weight, concat('W', cast(user_id % 7 as varchar)) AS workstream, concat('P', cast(user_id % 6 as varchar)) AS project_id, "
        "CASE event_id % 6 WHEN 0 THEN 'CP' WHEN 1 THEN 'CP' WHEN 2 THEN 'IP' WHEN 3 THEN 'BL' WHEN 4 THEN 'AT' ELSE 'NS' END AS status, event_type = 'error' AND event_id % 4 = 0 AS blocked, cast(event_id % 40 as int) - 10 AS slip FROM events)")
_STATUS = "case event_id % 6 when 0 then 'CP' when 1 then 'CP' when 2 then 'IP' when 3 then 'BL' when 4 then 'AT' else 'NS' end"


def snapshots(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("task"), "event_id", "ts", F.to_date("ts").alias("day"), "value", (F.col("user_id") % 5 + 1).cast("int").alias("weight"),
                                            F.concat(F.lit("W"), F.col("user_id") % 7).alias("workstream"), F.concat(F.lit("P"), F.col("user_id") % 6).alias("project_id"), F.expr(_STATUS).alias("status"),
                                            ((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0)).alias("blocked"), (F.col("event_id") % 40 - 10).cast("int").alias("slip"))


LATEST = "latest AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY item_id, task ORDER BY ts DESC, event_id DESC) AS r FROM snap) WHERE r = 1)"
COLOUR = "CASE WHEN blocked THEN 'Red' WHEN status = 'CP' THEN 'Green' WHEN status IN ('IP','AT') THEN 'Amber' WHEN status IN ('BL','DL') THEN 'Red' ELSE 'Grey' END"
_RANK = f"CASE {COLOUR} WHEN 'Red' THEN 1 WHEN 'Amber' THEN 2 WHEN 'Blue' THEN 3 WHEN 'Green' THEN 4 ELSE 5 END"
_WORST = f"(['Red','Amber','Blue','Green','Grey'])[min({_RANK})]"


def _latest(spark, d):
    return r.latest(snapshots(spark, d), ["item_id", "task"], "ts", "event_id")


@query(f"WITH {SNAP}, {LATEST} SELECT item_id, task, event_id, status, slip FROM latest")
def latest_snapshot(spark, d):
    return _latest(spark, d).select("item_id", "task", "event_id", "status", "slip")


@query(f"WITH {SNAP} SELECT event_id, project_id, day FROM (SELECT *, max(day) OVER (PARTITION BY project_id) AS last FROM snap) WHERE day = last")
def latest_partition(spark, d):
    return r.at_latest_date(snapshots(spark, d), "project_id", "day").select("event_id", "project_id", "day")


@query(f"WITH {SNAP}, {LATEST} SELECT workstream, cast(round(100.0 * sum(CASE WHEN status = 'CP' THEN weight ELSE 0 END) / sum(weight)) as bigint) AS score, {_WORST} AS worst FROM latest GROUP BY workstream")
def readiness_score(spark, d):
    return r.readiness(_latest(spark, d), "workstream")


@query(f"WITH {SNAP}, {LATEST} SELECT workstream, count(*) AS tasks, count(*) FILTER (slip <= 0 AND NOT blocked) AS on_track, count(*) FILTER (blocked) AS blocked, cast(sum(greatest(slip, 0)) as bigint) AS impact_days, {_WORST} AS worst FROM latest GROUP BY workstream")
def critical_path_kpis(spark, d):
    return _latest(spark, d).groupBy("workstream").agg(F.count("*").alias("tasks"), F.count_if((F.col("slip") <= 0) & ~F.col("blocked")).alias("on_track"), F.count_if("blocked").alias("blocked"),
                                                       F.sum(F.greatest("slip", F.lit(0))).alias("impact_days"), r.worst_colour(r.status_colour(F.col("status"), F.col("blocked"))).alias("worst"))


@query(f"WITH {SNAP}, {LATEST} SELECT project_id, count(*) AS tasks, round(count(*) FILTER (slip <= 0) / count(*), 6) AS on_track, max(slip) AS worst_slip, CASE WHEN count(*) FILTER (slip <= 0) / count(*) >= 0.8 THEN 'Green' WHEN count(*) FILTER (slip <= 0) / count(*) >= 0.6 THEN 'Amber' ELSE 'Red' END AS colour, max(day) AS freshness FROM latest GROUP BY project_id")
def project_kpis(spark, d):
    share = F.count_if(F.col("slip") <= 0) / F.count("*")
    return _latest(spark, d).groupBy("project_id").agg(F.count("*").alias("tasks"), F.round(share, 6).alias("on_track"), F.max("slip").alias("worst_slip"), F.when(share >= 0.8, "Green").when(share >= 0.6, "Amber").otherwise("Red").alias("colour"), F.max("day").alias("freshness"))


@query(f"WITH {SNAP}, {LATEST} SELECT CASE WHEN blocked THEN 'breach' WHEN status IN ('BL','AT') THEN 'warning' ELSE 'ok' END AS state, count(*) AS n FROM latest GROUP BY 1")
def covenant_status(spark, d):
    return _latest(spark, d).groupBy(F.when(F.col("blocked"), "breach").when(F.col("status").isin("BL", "AT"), "warning").otherwise("ok").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS product, p_type AS daypart, min(p_retailprice) AS floor_price, arg_min(p_retailprice, p_partkey) AS base_price, max(p_retailprice) AS ceiling_price, cast(sum(l_quantity) as bigint) AS sold, round(sum(l_quantity) / count(*) / 50, 6) AS occupancy, "
       "cast(sum(cast(l_extendedprice as decimal(18,2))) as double) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def pricing_corridor(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"), F.sum(money("l_extendedprice")).alias("m"))
    return (li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("product"), F.col("p_type").alias("daypart"))
            .agg(F.min("p_retailprice").alias("floor_price"), F.min_by("p_retailprice", "p_partkey").alias("base_price"), F.max("p_retailprice").alias("ceiling_price"), F.sum("q").cast("long").alias("sold"),
                 F.round(F.sum("q") / F.sum("n") / 50, 6).alias("occupancy"), F.sum("m").cast("double").alias("revenue")))


@query("SELECT cast(floor((cast(ts as date) - date '2024-01-03') / 7) + 1 as bigint) AS week, isodow(ts) - 1 AS weekday, cast(sum(cast(value as decimal(18,2))) as double) AS value FROM events WHERE cast(ts as date) - date '2024-01-03' BETWEEN 0 AND 27 GROUP BY 1, 2")
def heatmap_week_dow(spark, d):
    return r.week_grid(table(spark, d, "events").select(F.to_date("ts").alias("day"), "value"), "2024-01-03")


@query("SELECT event_type AS channel, count(*) FILTER (user_id % 2 = 0) AS leads, count(DISTINCT user_id) AS people, cast(sum(cast(value as decimal(18,2))) as double) AS revenue, round(cast(sum(cast(value as decimal(18,2))) as double) / nullif(count(*) FILTER (user_id % 2 = 0), 0), 6) AS roas FROM events GROUP BY 1")
def channel_roas(spark, d):
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count_if(F.col("user_id") % 2 == 0).alias("leads"), F.countDistinct("user_id").alias("people"), F.sum(money("value")).cast("double").alias("revenue"))
    return t.withColumn("roas", ratio(F.col("revenue"), F.col("leads"), 6))


@query("WITH w AS (SELECT event_type AS channel, cast(date_trunc('week', ts) as date) AS week, count(*) AS n, cast(sum(cast(value as decimal(18,2))) as double) AS revenue FROM events GROUP BY 1, 2) SELECT channel, week, n, revenue FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY week DESC) AS r FROM w) WHERE r <= 8")
def weekly_trend(spark, d):
    weekly = table(spark, d, "events").groupBy(F.col("event_type").alias("channel"), F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("n"), F.sum(money("value")).cast("double").alias("revenue"))
    return r.trailing(weekly, "channel", "week", 8)


@query("SELECT n_name AS owner, r_name AS region, count(*) AS tasks, count(*) FILTER (o_orderstatus = 'O') AS open_tasks FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def star_join_tasks(spark, d):
    """Facts are summed by key before the dimensions are joined."""
    facts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    dims = (table(spark, d, "customer").select("c_custkey", "c_nationkey").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"))
    return facts.join(dims, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("owner"), F.col("r_name").alias("region")).agg(F.sum("n").alias("tasks"), F.sum("open").alias("open_tasks"))


@query("SELECT * FROM (SELECT o_orderdate AS happened_at, 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT ts, 'event', event_id FROM events) ORDER BY happened_at DESC, kind, id LIMIT 50")
def activity_feed(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("happened_at"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return r.feed(o, table(spark, d, "events").select(F.col("ts").alias("happened_at"), F.lit("event").alias("kind"), F.col("event_id").alias("id")))


@query(f"WITH {SNAP}, {LATEST} SELECT item_id, task, cast(round(weight * greatest(1, slip / 5.0)) as bigint) AS severity, CASE WHEN round(weight * greatest(1, slip / 5.0)) >= 13 THEN 'Red' WHEN round(weight * greatest(1, slip / 5.0)) >= 6 THEN 'Amber' ELSE 'Green' END AS colour FROM latest")
def risk_severity(spark, d):
    severity = F.round(F.col("weight") * F.greatest(F.lit(1.0), F.col("slip") / 5.0))
    return _latest(spark, d).select("item_id", "task", severity.cast("long").alias("severity"), F.when(severity >= 13, "Red").when(severity >= 6, "Amber").otherwise("Green").alias("colour"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') as bigint) AS k FROM events")
def event_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"WITH {SNAP} SELECT project_id, workstream, status, count(*) AS n FROM snap GROUP BY ROLLUP (project_id, workstream, status)")
def status_rollup(spark, d):
    return snapshots(spark, d).rollup("project_id", "workstream", "status").agg(F.count("*").alias("n"))


@query(f"WITH {CAPEX}, w AS (SELECT project_id, sum(budget) FILTER (as_of >= timestamp '1998-01-01') AS approved, sum(budget) AS baseline FROM capex GROUP BY project_id) SELECT project_id, cast(coalesce(approved, baseline) as double) AS budget FROM w")
def project_budget(spark, d):
    """The approved budget where there is one, else the baseline."""
    t = capex(spark, d).groupBy("project_id").agg(F.sum(F.when(F.col("as_of") >= "1998-01-01", F.col("budget"))).alias("approved"), F.sum("budget").alias("baseline"))
    return t.select("project_id", F.coalesce("approved", "baseline").cast("double").alias("budget"))


@query("WITH w AS (SELECT event_type AS channel, cast(date_trunc('week', ts) as date) AS week, count(*) AS leads, count(*) FILTER (user_id % 3 = 0) AS qualified, cast(sum(cast(value as decimal(18,2))) as double) AS revenue FROM events GROUP BY 1, 2) SELECT sum(leads)::bigint AS leads, sum(qualified)::bigint AS qualified, round(sum(revenue), 2) AS revenue, week FROM w WHERE week = (SELECT max(week) FROM w) GROUP BY week")
def latest_week_kpis(spark, d):
    """One row: the last week's leads, qualified leads and revenue over all channels."""
    weekly = table(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count("*").alias("leads"), F.count_if(F.col("user_id") % 3 == 0).alias("qualified"), F.round(F.sum(money("value")).cast("double"), 2).alias("revenue"))
    return weekly.orderBy(F.desc("week")).limit(1)


@query("SELECT l_linenumber AS daypart, l_returnflag = 'R' AS peak, arg_min(l_extendedprice, struct_pack(a := l_orderkey, b := l_extendedprice)) AS price, cast(sum(l_quantity) as bigint) AS sold FROM lineitem GROUP BY 1, 2")
def pricing_peak(spark, d):
    """First price and units by daypart and peak."""
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("daypart"), (F.col("l_returnflag") == "R").alias("peak")).agg(F.min_by("l_extendedprice", F.struct("l_orderkey", "l_extendedprice")).alias("price"), F.sum("l_quantity").cast("long").alias("sold"))


_SLIP = "date_diff('day', cast(o_orderdate as date), date '1998-06-01')"


@query(f"SELECT o_orderkey, {_SLIP} AS days_left, {_SLIP} < 0 AND o_orderstatus <> 'F' AS future_open, cast(o_orderdate as date) BETWEEN date '1998-06-01' - 55 AND date '1998-06-01' AS recent FROM orders")
def due_dates(spark, d):
    """Days to a given day, what is open past it, and a look-back of 55 days."""
    day, due = F.lit("1998-06-01").cast("date"), F.to_date("o_orderdate")
    left = F.datediff(day, due).cast("long")
    return table(spark, d, "orders").select("o_orderkey", left.alias("days_left"), ((left < 0) & (F.col("o_orderstatus") != "F")).alias("future_open"), due.between(F.date_sub(day, 55), day).alias("recent"))


@query("SELECT event_id, json_exists(props, '$.k') AS has_key, json_extract_string(props, '$.k') IS NULL AS is_null, cast(json_array_length('[' || event_id % 4 || ',2,3]') as integer) AS n, cast(json_extract_string('[' || event_id % 4 || ',2,3]', '$[0]') as integer) AS first FROM events")
def json_shapes(spark, d):
    """A key that is there, a null value, an array's length and its first element."""
    e = table(spark, d, "events").withColumn("a", F.from_json(F.concat(F.lit("["), F.col("event_id") % 4, F.lit(",2,3]")), "array<int>"))
    return e.select("event_id", F.array_contains(F.json_object_keys("props"), "k").alias("has_key"), F.get_json_object("props", "$.k").isNull().alias("is_null"), F.size("a").alias("n"), F.element_at("a", 1).alias("first"))
