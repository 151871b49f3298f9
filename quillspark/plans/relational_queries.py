"""The relational surface: joins of each kind, aggregations, windows, set operations, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational
from ..session import table

_SQL = {
    "join_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_full": "SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, coalesce(nc, 0) AS customers, coalesce(ns, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY s_nationkey) b ON c_nationkey = s_nationkey",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "aggregate_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "window_ranking": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "window_frame": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "set_except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 7000",
    "top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "segment_revenue": "SELECT c_mktsegment, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name",
}


def _sql(spark, d, text):
    """One text for both engines: the tables it names are read from d."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        table(spark, d, t).createOrReplaceTempView(t)
    return spark.sql(text)


def _as_of(s, d):
    e = table(s, d, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return relational.as_of(clicks, e.where("event_type <> 'click'").select("user_id", "ts", "value", F.col("event_id").alias("i")), "user_id", "ts", "value", "i").select("event_id", F.round("value_as_of", 6).alias("value_as_of"))


def queries() -> dict:
    out = {k: lambda s, d, t=v: _sql(s, d, t) for k, v in _SQL.items()}
    return out | {
        "join_as_of": _as_of,
        "join_range": lambda s, d: relational.in_ranges(table(s, d, "events").select("event_id", "value"), table(s, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 20.0).alias("low"), (F.col("n_nationkey") * 20.0 + 25).alias("high")), "value", "low", "high", 20).select("event_id", "n_nationkey"),
        "global_rank": lambda s, d: relational.ranked(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "idx").select("o_orderkey", "idx"),
        "sessions": lambda s, d: relational.sessions(table(s, d, "events"), "user_id", "ts", "1 hour").select("user_id", "start", F.col("n").cast("long").alias("n")),
        "pivot": lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0),
    }


def oracle_sql() -> dict[str, str]:
    return dict(_SQL) | {
        "join_as_of": "SELECT c.event_id, round(o.value, 6) AS value_as_of FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type <> 'click' GROUP BY user_id, ts) o ON c.user_id = o.user_id AND c.ts >= o.ts",
        "join_range": "SELECT event_id, n_nationkey FROM events JOIN nation ON value >= n_nationkey * 20.0 AND value < n_nationkey * 20.0 + 25",
        "global_rank": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders",
        "sessions": "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, g",
        "pivot": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority",
    }
