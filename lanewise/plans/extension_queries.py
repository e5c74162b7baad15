"""Extensions beyond the reference's own operators: joins, cube, set operations, event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewise.plans.registry import query, table


@query("SELECT n_name, count(*) n, round(sum(o_totalprice), 2) total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def ext_orders_by_nation(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) n, CAST(sum(l_quantity) AS BIGINT) quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube_lineitem(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def ext_customers_without_orders(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT l_suppkey k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def ext_intersect_suppliers(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(li.where("l_returnflag = 'A'").select("l_suppkey"))


@query("SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT \"hour\", count(*) n FROM events GROUP BY ALL")
def ext_tumbling_events(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").start.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.unix_timestamp(F.col("w").cast("timestamp")).alias("hour"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END s FROM events),
n AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, s DESC ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, count(DISTINCT k) sessions, count(*) n FROM n GROUP BY user_id""")
def ext_sessions(spark, d):
    ev = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ev.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("k")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("k").alias("n"))


@query("SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) nth, value - lag(value) OVER w delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def ext_event_windows(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("nth"), (F.col("value") - F.lag("value").over(w)).alias("delta"))
