"""Driver queries of windows, time and the metrics chain on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import latest, metrics, predicates
from ..sources.tables import table
from .registry import query
from .relational import NOW_EVENTS, NOW_ORDERS


def _now(literal: str):
    return F.lit(literal).cast("timestamp_ntz")


@query("latest_observation", """
    SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_observation(spark, sf):
    """Latest row by arrival for each key."""
    return latest.latest_by(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "event_id")


@query("latest_price_per_key", """
    SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_price_per_key(spark, sf):
    """Latest row by time, ties by id."""
    return latest.latest_by(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "event_id")


@query("latest_vs_not_exists", """
    SELECT e.user_id, e.event_type, e.event_id FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_type = e.event_type AND n.event_id > e.event_id)""")
def latest_vs_not_exists(spark, sf):
    """Rows without a newer one of their key, as an anti-join."""
    return latest.without_newer(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("ranked_spec_affinity", """
    WITH pairs AS (SELECT a.s_suppkey AS suppkey, b.s_suppkey AS sibling, CASE WHEN a.s_suppkey = b.s_suppkey THEN 0 WHEN a.s_suppkey % 5 = b.s_suppkey % 5 THEN 1 ELSE 2 END AS affinity, b.s_acctbal AS acctbal
                   FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND (a.s_suppkey <> b.s_suppkey OR a.s_suppkey % 3 = 0)),
    flagged AS (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = sibling AND l_discount >= 0.1 AND l_quantity >= 49) AS has_rows FROM pairs),
    r AS (SELECT *, row_number() OVER (PARTITION BY suppkey ORDER BY affinity, has_rows DESC, acctbal DESC, sibling DESC) AS rn FROM flagged)
    SELECT suppkey, sibling, affinity, has_rows FROM r WHERE rn = 1""")
def ranked_spec_affinity(spark, sf):
    """Sibling expansion, then the best sibling by affinity, data and recency (J4, W3); a supplier's own row is always nearest, so others count where it asks for them alone."""
    having = table(spark, sf, "lineitem").where("l_discount >= 0.1 and l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"), F.lit(True).alias("has_rows")).distinct()
    s = table(spark, sf, "supplier").where("s_nationkey is not null").select("s_suppkey", "s_nationkey", "s_acctbal")
    s = s.join(having, "s_suppkey", "left").withColumn("has_rows", F.coalesce("has_rows", F.lit(False)))
    # of equal data and affinity only the best two siblings can win: the best, or the next where the best is the row itself
    part = (F.col("s_suppkey") % 5).alias("part")
    best = latest.top_by(s.select("s_nationkey", part, "has_rows", F.struct(F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("sibling")).alias("b")), ["s_nationkey", "part", "has_rows"], [F.desc("b")], 2)
    others = s.select(F.col("s_suppkey").alias("suppkey"), "s_nationkey").join(best, "s_nationkey").where("suppkey != b.sibling")
    others = others.select("suppkey", "b.sibling", F.when(F.col("suppkey") % 5 == F.col("part"), 1).otherwise(2).alias("affinity"), "has_rows", "b.acctbal")
    own = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("suppkey"), F.col("s_suppkey").alias("sibling"), F.lit(0).alias("affinity"), "has_rows", F.col("s_acctbal").alias("acctbal"))
    return latest.top_by(own.unionByName(others), ["suppkey"], [F.asc("affinity"), F.desc("has_rows"), F.desc("acctbal"), F.desc("sibling")]).select("suppkey", "sibling", "affinity", "has_rows")


@query("variant_metrics", f"""
    WITH sales AS (SELECT l_partkey, l_extendedprice, l_returnflag, l_shipdate, count(*) OVER (PARTITION BY l_partkey) AS sale_count,
        sum(CASE WHEN CAST(l_shipdate AS DATE) >= CAST(TIMESTAMP '{NOW_ORDERS}' AS DATE) - 365 THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey) AS sales_12m,
        row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem),
    pop AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS top_count, count(*) AS total FROM lineitem GROUP BY l_partkey)
    SELECT p_partkey, CAST(coalesce(top_count, 0) AS BIGINT) AS top_count, coalesce(total, 0) AS total, CASE WHEN total > 0 THEN round(100.0 * top_count / total, 6) END AS top_rate, round(l_extendedprice, 2) AS latest_price,
           coalesce(sale_count, 0) AS sale_count, CAST(coalesce(sales_12m, 0) AS BIGINT) AS sales_12m, sale_count IS NOT NULL AS has_sales
    FROM part LEFT JOIN pop ON pop.l_partkey = p_partkey LEFT JOIN sales ON sales.l_partkey = p_partkey AND rn = 1""")
def variant_metrics(spark, sf):
    """Population, latest sale, counts over the partition and the share of the top grade for each part."""
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    sales = metrics.ranked_sales(items, ["p_partkey"], "l_shipdate", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], _now(NOW_ORDERS))
    population = items.groupBy("p_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("tops"), F.count("*").alias("all"))
    whole = table(spark, sf, "part").select("p_partkey").join(population, "p_partkey", "left").join(sales, "p_partkey", "left")
    zero = F.lit(0).cast("long")
    return whole.select(
        "p_partkey", F.coalesce("tops", zero).alias("top_count"), F.coalesce("all", zero).alias("total"), F.round(values.gem_rate(F.col("tops"), F.col("all")), 6).alias("top_rate"), F.round("l_extendedprice", 2).alias("latest_price"),
        F.coalesce("sale_count", zero).alias("sale_count"), F.coalesce("sales_12m", zero).alias("sales_12m"), F.col("sale_count").isNotNull().alias("has_sales"))


@query("monthly_median_price", """
    SELECT l_partkey % 100 AS bucket, strftime(l_shipdate, '%Y-%m') AS month, round(median(l_extendedprice), 4) AS median_price, count(*) AS n FROM lineitem GROUP BY l_partkey % 100, strftime(l_shipdate, '%Y-%m')""")
def monthly_median_price(spark, sf):
    """Exact median and count by month."""
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 100).alias("bucket"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice")
    return rows.groupBy("bucket", "month").agg(F.round(F.median("l_extendedprice"), 4).alias("median_price"), F.count("*").alias("n"))


@query("due_terms", f"""
    SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 720 MINUTE <= TIMESTAMP '{NOW_EVENTS}'""")
def due_terms(spark, sf):
    """Keys whose last event is older than their interval."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return last.where(predicates.due(F.col("last_seen"), F.lit(720), _now(NOW_EVENTS)))


@query("throughput_window", """
    SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def throughput_window(spark, sf):
    """Counts in aligned windows of five minutes."""
    stamped = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    return stamped.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "events", "total")


@query("consecutive_failures", """
    WITH s AS (SELECT user_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM s WHERE event_type = 'error' GROUP BY user_id, island) GROUP BY user_id""")
def consecutive_failures(spark, sf):
    """Longest run of errors of each user; any other event ends a run."""
    runs = latest.islands(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "error")
    return runs.where("event_type = 'error'").groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("take_while", """
    SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'error' GROUP BY user_id) s ON s.user_id = e.user_id
    WHERE stop IS NULL OR event_id < stop GROUP BY e.user_id""")
def take_while(spark, sf):
    """Events of each user before the first error."""
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return latest.take_while(rows, ["user_id"], F.col("event_id"), F.col("event_type") == "error").groupBy("user_id").agg(F.count("*").alias("n"))


@query("batch_chunk", """
    WITH r AS (SELECT c_custkey, c_nationkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) / 40.0) AS BIGINT) AS chunk FROM customer)
    SELECT c_nationkey, chunk, count(*) AS n, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM r GROUP BY c_nationkey, chunk""")
def batch_chunk(spark, sf):
    """Batches of 40 in sort order within a key."""
    rows = latest.chunks(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], ["c_acctbal", "c_custkey"], 40)
    return rows.groupBy("c_nationkey", "chunk").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))


@query("quota_day", """
    SELECT CAST(ts - INTERVAL 7 HOUR AS DATE) AS quota_day, count(*) AS calls, count(*) > 300 AS over_limit FROM events GROUP BY 1""")
def quota_day(spark, sf):
    """Calls of each quota day, which begins at seven."""
    return table(spark, sf, "events").groupBy(values.quota_day(F.col("ts")).alias("quota_day")).agg(F.count("*").alias("calls")).withColumn("over_limit", F.col("calls") > 300)


@query("partition_share", """
    SELECT o_orderkey, o_custkey, round(100.0 * o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS share, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders""")
def partition_share(spark, sf):
    """Each order's share of its customer's total and its place."""
    p = Window.partitionBy("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.round(100.0 * F.col("o_totalprice") / F.sum("o_totalprice").over(p), 4).alias("share"), F.row_number().over(p.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("natural_sort_key", """
    SELECT s_suppkey, regexp_replace(lower(s_name), '[0-9]+', '', 'g') || lpad(regexp_extract(s_name, '([0-9]+)', 1), 12, '0') AS sort_key FROM supplier""")
def natural_sort_key(spark, sf):
    """Names with padded digits."""
    return table(spark, sf, "supplier").select("s_suppkey", text.natural_key(F.col("s_name")).alias("sort_key"))
