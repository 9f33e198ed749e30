
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..operators import latest, merge, predicates
from ..sources.tables import table
from .registry import query

#: The clock of the queries that need one.
NOW_ORDERS, NOW_EVENTS = "2001-06-01 00:00:00", "2024-01-30 23:00:00"


@query("facet_values", """
    SELECT 'segment' AS facet, c_mktsegment AS value FROM customer WHERE c_mktsegment <> '' GROUP BY c_mktsegment
    UNION ALL SELECT 'brand', p_brand FROM part WHERE p_brand <> '' GROUP BY p_brand
    UNION ALL SELECT 'type', p_type FROM part WHERE p_type <> '' GROUP BY p_type""")
def facet_values(spark, sf):
    """Distinct filter values, blanks dropped."""
    return predicates.facets({"segment": (table(spark, sf, "customer"), "c_mktsegment"), "brand": (table(spark, sf, "part"), "p_brand"), "type": (table(spark, sf, "part"), "p_type")})


@query("search_page", """
    SELECT p_partkey, p_name, p_brand, p_size, round(p_retailprice, 2) AS price FROM part
    WHERE (p_name ILIKE '%a%' OR p_brand ILIKE '%a%' OR p_type ILIKE '%a%') AND p_size >= 5 AND p_size <= 40
    ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 24 OFFSET 24""")
def search_page(spark, sf):
    """Text search, ranges, a sort with nulls last and one page."""
    found = table(spark, sf, "part").where(predicates.text_search("a", "p_name", "p_brand", "p_type") & predicates.ranges({"p_size": (5, 40)}))
    ordered = found.orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey")
    return predicates.page(ordered, page=2).select("p_partkey", "p_name", "p_brand", "p_size", F.round("p_retailprice", 2).alias("price"))


@query("price_band_rollup", """
    SELECT p_partkey, count(l_orderkey) AS n, round(min(l_extendedprice), 2) AS least, round(avg(l_extendedprice), 6) AS mean, round(max(l_extendedprice), 2) AS most
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 10 GROUP BY p_partkey""")
def price_band_rollup(spark, sf):
    """Price range of each part over matching items; the conditions belong to the join."""
    items = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity >= 10").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.min("l_extendedprice"), 2).alias("least"), F.round(F.avg("l_extendedprice"), 6).alias("mean"), F.round(F.max("l_extendedprice"), 2).alias("most"))
    parts = table(spark, sf, "part").select("p_partkey")
    return parts.join(items, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "least", "mean", "most")


@query("conditional_counts", """
    SELECT o_orderstatus, count(*) AS orders, count(*) FILTER (WHERE o_totalprice > 150000) AS large, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END), 2) AS urgent_value,
           count(DISTINCT CASE WHEN o_totalprice > 150000 THEN o_custkey END) AS large_customers
    FROM orders GROUP BY o_orderstatus""")
def conditional_counts(spark, sf):
    """Conditional counts, sums and distinct counts in one pass."""
    large = F.col("o_totalprice") > 150000
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("orders"), F.count_if(large).alias("large"),
        F.round(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(0)), 2).alias("urgent_value"),
        F.count_distinct(F.when(large, F.col("o_custkey"))).alias("large_customers"))


@query("having_active", f"""
    SELECT o_custkey, min(CASE WHEN o_orderdate > TIMESTAMP '{NOW_ORDERS}' THEN o_orderdate END) AS next_order, count(*) AS orders FROM orders GROUP BY o_custkey
    HAVING count(*) FILTER (WHERE o_orderdate > TIMESTAMP '{NOW_ORDERS}') > 0""")
def having_active(spark, sf):
    """Customers with an order after now and the first such date."""
    later = F.col("o_orderdate") > F.lit(NOW_ORDERS).cast("timestamp_ntz")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.when(later, F.col("o_orderdate"))).alias("next_order"), F.count("*").alias("orders")).where("next_order is not null")


@query("exists_flags", """
    SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_returned,
           EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.1) AS has_discount FROM orders""")
def exists_flags(spark, sf):
    """EXISTS as columns: one aggregate of the many side, joined once."""
    flags = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_discount") >= 0.1).alias("d"))
    orders = table(spark, sf, "orders").select("o_orderkey")
    no = F.lit(False)
    return orders.join(flags, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("r", no).alias("has_returned"), F.coalesce("d", no).alias("has_discount"))


@query("anti_unlabelled", "SELECT doc_id, lang, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_unlabelled(spark, sf):
    """Documents without a label."""
    return table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("scalar_subquery_latest", """
    SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest_order FROM customer""")
def scalar_subquery_latest(spark, sf):
    """Top-1 subquery as a window and a left join."""
    newest = latest.latest_by(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return table(spark, sf, "customer").select("c_custkey").join(newest, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("latest_order"))


@query("scalar_subquery_count", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS open_items FROM orders")
def scalar_subquery_count(spark, sf):
    """Counting subquery as an aggregate and a left join, zero by default."""
    counts = table(spark, sf, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return table(spark, sf, "orders").select("o_orderkey").join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("open_items"))


@query("computed_key_join", """
    SELECT event_type, count(*) AS events, count(DISTINCT c_custkey) AS customers FROM events JOIN customer ON 'user:' || user_id = 'user:' || c_custkey GROUP BY event_type""")
def computed_key_join(spark, sf):
    """Equi-join on a composed key."""
    events = table(spark, sf, "events").select("event_type", F.concat_ws(":", F.lit("user"), "user_id").alias("key"))
    customers = table(spark, sf, "customer").select("c_custkey", F.concat_ws(":", F.lit("user"), "c_custkey").alias("key"))
    return events.join(customers, "key").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("c_custkey").alias("customers"))


@query("json_path_group", """
    SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY json_extract_string(props, '$.k')""")
def json_path_group(spark, sf):
    """Groups by a field of a JSON column, projected once."""
    return table(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("k"), "value").groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("phase_pivot", """
    SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase,
           count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY CAST(ts AS DATE)""")
def phase_pivot(spark, sf):
    """Status matrix with named columns."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))


@query("grade_unpivot", """
    WITH w AS (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_partkey)
    SELECT l_partkey, 'A' AS flag, 1 AS flag_order, a AS items FROM w UNION ALL SELECT l_partkey, 'N', 2, n FROM w UNION ALL SELECT l_partkey, 'R', 3, r FROM w WHERE r > 0""")
def grade_unpivot(spark, sf):
    """Wide counts to one row for each display value; the last only where it is not zero."""
    wide = table(spark, sf, "lineitem").groupBy("l_partkey").agg(*(F.count_if(F.col("l_returnflag") == f).alias(f) for f in "ANR"))
    rows = F.array(*(F.struct(F.lit(f).alias("flag"), F.lit(i).alias("flag_order"), F.col(f).alias("items")) for i, f in enumerate("ANR", 1)))
    return wide.select("l_partkey", F.inline(rows)).where("flag <> 'R' or items > 0")


@query("content_address_dedup", """
    SELECT sha256(text) AS hash, octet_length(encode(any_value(text))) AS bytes, min(doc_id) AS first_seen, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)""")
def content_address_dedup(spark, sf):
    """Content addresses, first seen and copies."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("bytes"))
    return docs.groupBy("hash").agg(F.max("bytes").alias("bytes"), F.min("doc_id").alias("first_seen"), F.count("*").alias("copies"))


@query("union_dedup_priority", """
    WITH p AS (SELECT *, 0 AS pr FROM events WHERE event_type <> 'view' UNION ALL SELECT *, 1 AS pr FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY pr, ts, event_id) AS rn FROM p)
    SELECT user_id, event_type, event_id, pr AS priority FROM r WHERE rn = 1""")
def union_dedup_priority(spark, sf):
    """New before known rows, one of each key."""
    events = table(spark, sf, "events")
    new = events.where("event_type <> 'view'").withColumn("priority", F.lit(0))
    return merge.union_by_priority([new, events.withColumn("priority", F.lit(1))], ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "priority")


@query("set_operations", """
    SELECT 'both' AS kind, user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup')
    UNION ALL SELECT 'only', user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup')
    UNION ALL SELECT 'any', user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'signup')""")
def set_operations(spark, sf):
    """Intersection, difference and union of keys."""
    a, b = (table(spark, sf, "events").where(F.col("event_type") == k).select("user_id") for k in ("purchase", "signup"))
    parts = {"both": a.intersect(b), "only": a.subtract(b), "any": a.union(b).distinct()}
    return reduce(DataFrame.unionByName, (d.select(F.lit(k).alias("kind"), "user_id") for k, d in parts.items()))


@query("price_partition", """
    SELECT CASE WHEN o_totalprice / 50 <= 25 THEN 0 WHEN o_totalprice / 50 <= 50 THEN 1 WHEN o_totalprice / 50 <= 100 THEN 2 WHEN o_totalprice / 50 <= 250 THEN 3 WHEN o_totalprice / 50 <= 500 THEN 4 WHEN o_totalprice / 50 <= 1000 THEN 5
                WHEN o_totalprice / 50 <= 2500 THEN 6 WHEN o_totalprice / 50 <= 5000 THEN 7 ELSE 8 END AS band, count(*) AS orders, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1""")
def price_partition(spark, sf):
    """A fiftieth of orders' prices by price band."""
    return table(spark, sf, "orders").where("o_totalprice is not null").groupBy(values.price_band(F.col("o_totalprice") / 50).alias("band")).agg(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("quality_gate", """
    SELECT 'orphan_items' AS check_name, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
    UNION ALL SELECT 'null_customers', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders
    UNION ALL SELECT 'duplicate_orders', count(*) - count(DISTINCT o_orderkey) FROM orders
    UNION ALL SELECT 'negative_prices', count(*) FILTER (WHERE o_totalprice < 0) FROM orders""")
def quality_gate(spark, sf):
    """Counts that must be zero for a snapshot to be published."""
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    orphans = items.select("l_orderkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan_items").alias("check_name"), "n")
    wide = orders.agg(F.count_if(F.col("o_custkey").isNull()).alias("null_customers"), (F.count("*") - F.count_distinct("o_orderkey")).alias("duplicate_orders"), F.count_if(F.col("o_totalprice") < 0).alias("negative_prices"))
    return orphans.unionByName(wide.unpivot([], ["null_customers", "duplicate_orders", "negative_prices"], "check_name", "n"))


@query("upsert_coalesce", """
    WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
    b AS (SELECT o_orderkey, 'U' AS o_orderstatus, CASE WHEN o_totalprice > 100000 THEN 'late' END AS o_orderpriority, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
    SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderstatus = 'F' THEN 'F' WHEN b.o_orderkey IS NOT NULL THEN b.o_orderstatus ELSE a.o_orderstatus END AS o_orderstatus,
           coalesce(b.o_orderpriority, a.o_orderpriority) AS o_orderpriority, round(CASE WHEN a.o_orderkey IS NOT NULL THEN a.o_totalprice ELSE b.o_totalprice END, 2) AS o_totalprice
    FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey""")
def upsert_coalesce(spark, sf):
    """Two batches merged: last writer wins, null keeps the old value, a state that stays, a value that the first sets."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    old = orders.where("o_orderdate < timestamp_ntz'1999-01-01 00:00:00'").drop("o_orderdate")
    new = orders.where("o_orderdate >= timestamp_ntz'1998-01-01 00:00:00'").select("o_orderkey", F.lit("U").alias("o_orderstatus"), F.when(F.col("o_totalprice") > 100000, "late").alias("o_orderpriority"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return merge.upsert(old, new, ["o_orderkey"], keep_old=["o_orderpriority"], first_wins=["o_totalprice"], sticky={"o_orderstatus": "F"}).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("replace_children", """
    WITH touched AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
    SELECT l_orderkey, count(*) AS items, round(sum(l_quantity), 2) AS quantity FROM (
        SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM touched)
        UNION ALL SELECT l_orderkey, l_quantity * 2 FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM touched)) GROUP BY l_orderkey""")
def replace_children(spark, sf):
    """Items of touched orders are replaced, those of others stay."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    touched = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    new = items.where("l_linenumber = 1").join(touched, "l_orderkey", "left_semi").withColumn("l_quantity", F.col("l_quantity") * 2)
    return merge.replace_children(items, new, ["l_orderkey"], touched).groupBy("l_orderkey").agg(F.count("*").alias("items"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("history_fingerprint", """
    WITH f AS (SELECT event_id, user_id, sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, coalesce(props, ''))) AS fingerprint FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, fingerprint ORDER BY event_id) AS rn FROM f)
    SELECT event_id, user_id, fingerprint FROM r WHERE rn = 1 AND NOT (event_id >= 100 AND EXISTS (SELECT 1 FROM f o WHERE o.event_id < 100 AND o.user_id = r.user_id AND o.fingerprint = r.fingerprint))""")
def history_fingerprint(spark, sf):
    """An append-only history takes each fingerprint once, the first row."""
    events = table(spark, sf, "events").select("event_id", "user_id", values.fingerprint(F.col("user_id"), F.col("event_type"), F.col("props")).alias("fingerprint"))
    history = merge.insert_or_ignore(events.limit(0), events.where("event_id < 100"), ["user_id", "fingerprint"], [F.col("event_id")])
    return merge.append_new(history, events.where("event_id >= 100"), ["user_id", "fingerprint"], [F.col("event_id")])


@query("live_window", f"""
    SELECT o_orderkey, o_orderdate, round(o_totalprice, 2) AS price FROM orders
    WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority <> '5-LOW' AND o_totalprice > 1000 AND o_orderdate > TIMESTAMP '{NOW_ORDERS}' + INTERVAL 30 MINUTE AND o_orderdate <= TIMESTAMP '{NOW_ORDERS}' + INTERVAL 720 HOUR""")
def live_window(spark, sf):
    """Half-open time window after now with a trust predicate."""
    now = F.lit(NOW_ORDERS).cast("timestamp_ntz")
    live = predicates.within(F.col("o_orderdate"), now, margin_minutes=30, hours=720)
    trusted = F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority") != "5-LOW") & (F.col("o_totalprice") > 1000)
    return table(spark, sf, "orders").where(trusted & live).select("o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("price"))


@query("fx_comparison", """
    WITH x AS (SELECT o_orderkey, o_custkey, o_totalprice AS bid, o_totalprice * (1 + (o_orderkey % 5) / 10.0) AS guide, CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' WHEN o_orderkey % 3 = 1 THEN 'USD' ELSE 'GBP' END AS cur FROM orders),
    c AS (SELECT *, CASE cur WHEN 'USD' THEN guide WHEN 'EUR' THEN guide / 2.0 END AS value FROM x)
    SELECT cur AS currency, count(*) AS n, count(value) AS comparable, round(median((value - bid) / value * 100), 4) AS median_discount FROM c GROUP BY cur""")
def fx_comparison(spark, sf):
    """Guide against bid over one exchange rate; median discount."""
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf, "orders").select(F.col("o_totalprice").alias("bid"), (F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 5) / 10.0)).alias("guide"), F.when(k == 0, "EUR").when(k == 1, "USD").otherwise("GBP").alias("currency"))
    rate = spark.range(1).select(F.lit(2.0).alias("rate"), F.lit("2001-06-01").cast("date").alias("rate_date"))
    age = values.rate_age_days(F.col("rate_date"), F.lit(NOW_ORDERS).cast("timestamp_ntz"))
    value, discount, _ = values.compared(F.col("guide"), F.col("bid"), F.col("currency"), F.col("rate"), age <= 7)
    both = rows.crossJoin(F.broadcast(rate)).select("currency", value.alias("value"), discount.alias("discount"))  # one rate
    return both.groupBy("currency").agg(F.count("*").alias("n"), F.count("value").alias("comparable"), F.round(F.median("discount"), 4).alias("median_discount"))


@query("funnel", """
    SELECT c_mktsegment, count(*) AS customers, count(o.o_custkey) AS with_order, count(*) FILTER (WHERE o.open) AS with_open, count(*) FILTER (WHERE o.returned) AS with_return FROM customer
    LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS open, bool_or(coalesce(r, false)) AS returned FROM orders
               LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey) i ON l_orderkey = o_orderkey GROUP BY o_custkey) o ON o.o_custkey = c_custkey GROUP BY c_mktsegment""")
def funnel(spark, sf):
    """Stages that customers reach, counted in one pass over flags."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    flags = orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("open"), F.bool_or(F.coalesce("r", F.lit(False))).alias("returned"))
    whole = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(flags, F.col("o_custkey") == F.col("c_custkey"), "left")
    return whole.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count("o_custkey").alias("with_order"), F.count_if("open").alias("with_open"), F.count_if("returned").alias("with_return"))


@query("targets_and_complement", """
    SELECT c_custkey, 'target' AS side, count(*) AS orders, min(o_orderdate) AS first_order FROM customer JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY c_custkey
    UNION ALL SELECT c_custkey, 'gap', 0, NULL FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000 AND o_orderstatus = 'F')""")
def targets_and_complement(spark, sf):
    """A predicate's matches by key, and the keys without one."""
    trusted = (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F")
    counted = table(spark, sf, "orders").where(trusted).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.min("o_orderdate").alias("first_order"))
    whole = table(spark, sf, "customer").select("c_custkey").join(counted, "c_custkey", "left")
    return whole.select("c_custkey", F.when(F.col("orders").isNull(), "gap").otherwise("target").alias("side"), F.coalesce("orders", F.lit(0)).cast("long").alias("orders"), "first_order")


@query("price_metric_matrix", """
    SELECT p_brand, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, l_returnflag""")
def price_metric_matrix(spark, sf):
    """Two-key rollup over a join chain."""
    joined = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice", "l_discount").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy("p_brand", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("cross_table_counts", """
    SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS items, (SELECT count(*) FROM part) AS parts""")
def cross_table_counts(spark, sf):
    """Counts of several tables in one row."""
    rows = [table(spark, sf, t).agg(F.count("*").alias(n)) for t, n in (("customer", "customers"), ("orders", "orders"), ("lineitem", "items"), ("part", "parts"))]
    return reduce(DataFrame.crossJoin, rows)  # one row each


