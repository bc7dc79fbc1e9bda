"""Relational queries on the star schema and windows of time on the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.operators import sessions
from chronoframe.plans.registry import query
from chronoframe.plans.views import FRAMES, frames, table


@query("""SELECT r_name, n_name, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name""")
def star_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    joined = (
        lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name", "n_name").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.round(F.sum("net"), 2).alias("revenue"))


@query("""SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, grouping(l_returnflag, l_linestatus)::INTEGER AS level, count(*) AS n, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS quantity
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def star_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    found = cube.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
    return found.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "level", "n", "quantity")


@query("""SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(c_nationkey, -1)::INTEGER AS nation, count(*) AS n, sum(c_acctbal::DECIMAL(18, 2))::DOUBLE / count(c_acctbal) AS balance FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")
def star_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), (F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count("c_acctbal")).alias("balance"))
    return found.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("c_nationkey", F.lit(-1)).alias("nation"), "n", "balance")


@query("""SELECT l_returnflag AS a, l_linestatus AS b, grouping(l_returnflag)::INTEGER AS ga, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))""")
def star_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    found = table(spark, sf_dir, "lineitem").groupingSets([[a], [b]], a, b).agg(F.grouping("l_returnflag").cast("int").alias("ga"), F.count("*").alias("n"))
    return found.select(a.alias("a"), b.alias("b"), "ga", "n")


@query("""(SELECT c_nationkey AS nation, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier)
UNION ALL (SELECT n, 'customers' FROM (SELECT c_nationkey AS n FROM customer EXCEPT SELECT s_nationkey FROM supplier))
UNION ALL (SELECT n, 'nobody' FROM (SELECT n_nationkey AS n FROM nation EXCEPT (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)))""")
def star_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    tagged = ((c.intersect(s), "both"), (c.subtract(s), "customers"), (n.subtract(c.union(s)), "nobody"))
    first, *rest = (df.withColumn("side", F.lit(name)) for df, name in tagged)
    for df in rest:
        first = first.unionByName(df)
    return first


@query("""SELECT c_custkey, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY spent DESC, c_custkey LIMIT 20""")
def star_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty customers who spent most."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    known = table(spark, sf_dir, "customer").select("c_custkey")
    return spent.join(known, "c_custkey").orderBy(F.desc("spent"), "c_custkey").limit(20)


@query("""SELECT p_partkey, p_brand FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)
AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_quantity > 45)""")
def star_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    dear = part.withColumn("mean", F.avg("p_retailprice").over(Window.partitionBy("p_brand"))).filter("p_retailprice > mean")
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return dear.join(large, "p_partkey", "left_semi").select("p_partkey", "p_brand")


@query("""SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER w, 2) AS so_far, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)::INTEGER AS rank,
ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def star_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.round(F.sum("o_totalprice").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("so_far"),
        F.dense_rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))).alias("rank"),
        F.ntile(4).over(order).alias("quarter"),
    )


@query("""SELECT coalesce(c_custkey, -1) AS c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) c FULL JOIN (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey""")
def star_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select("c_custkey")
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_custkey", "o_orderkey")
    return rich.join(large, F.col("c_custkey") == F.col("o_custkey"), "full").select(
        F.coalesce("c_custkey", F.lit(-1)).alias("c_custkey"), F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey")
    )


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sessions.tumbling(sessions.in_utc(table(spark, sf_dir, "events")), "1 hour", ["event_type"])
    return counts.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT epoch_us(s) AS start_us, count(*) AS n, round(avg(value), 6) AS mean_value
FROM (SELECT value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1""")
def sliding_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = sessions.sliding(sessions.in_utc(table(spark, sf_dir, "events")), "1 hour", "30 minutes")
    return means.select(F.unix_micros("start").alias("start_us"), "n", F.round("mean_value", 6).alias("mean_value"))


@query("""WITH c AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS c FROM events),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM c)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.by_gap(sessions.in_utc(table(spark, sf_dir, "events")), "user_id", "6 hours")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"""WITH {FRAMES}, c AS (SELECT episode_id, object, frame_idx, CASE WHEN frame_idx - lag(frame_idx) OVER w > 10 THEN 1 ELSE 0 END AS c FROM frames WINDOW w AS (PARTITION BY episode_id, object ORDER BY frame_idx)),
t AS (SELECT *, sum(c) OVER (PARTITION BY episode_id, object ORDER BY frame_idx) AS track FROM c)
SELECT episode_id, object, track::INTEGER AS track, min(frame_idx) AS "start", max(frame_idx) AS "end", count(*) AS n FROM t GROUP BY 1, 2, 3""")
def tracker_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of objects that end after more than ten missed frames."""
    return sessions.tracks(frames(spark, sf_dir), ["episode_id", "object"], "frame_idx", 10)
