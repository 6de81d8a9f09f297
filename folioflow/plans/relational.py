"""Engine extras over the star schema and the event table: joins, aggregates, windows, set operations. With their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.plans.scalars import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT lang, source, quality, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, source, quality)""")
def corpus_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.cube("lang", "source", "quality").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def orders_by_nation(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) EXCEPT SELECT CAST(s_suppkey AS BIGINT) FROM supplier""")
def customers_without_orders(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.select("c_custkey").exceptAll(read(spark, sf_dir, "supplier").select("s_suppkey")).distinct()


@query("""SELECT o_custkey, o_orderkey, CAST(r AS BIGINT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w).cast("long")).filter("r <= 3").select("o_custkey", "o_orderkey", "r")


@query("""SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_tumbling(spark, sf_dir):
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").cast("long")
    return read(spark, sf_dir, "events").withColumn("w", F.window(F.col("ts").cast("timestamp_ntz"), "1 hour")).groupBy("event_type", hour.alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS begins, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf_dir):
    s = read(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp_ntz"), "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").cast("long").alias("begins"), "n")


@query("""SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events""")
def events_json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(None)
def extension_matrix(spark, sf_dir):
    """Every option with its default in each dialect that reads or writes."""
    from folioflow.operators import options

    return options.matrix(spark)
