"""Driver queries of streams, dirty sets, halts and paged walks on the driver's events and sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds
from ..operators.merge import upsert
from ..sources.publish import current, publish
from ..sources.shared import settled, shared_folder
from ..sources.tables import table
from ..streaming import dirty, history
from .registry import query

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_FILES = 3


def _arriving(spark: SparkSession, events: DataFrame):
    """(a stream over a folder, a file for each batch; a function that lets the first or the second half of the events arrive there)."""
    files = shared_folder(spark, "arriving")

    def arrive(half: int) -> None:
        events.where(F.pmod("event_id", F.lit(2)) == half).repartition(_FILES, "event_id").write.mode("append").parquet(files)

    return spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 1), files, arrive


@query("dirty_stream", """
    SELECT user_id % 40 AS ref, max(ts) FILTER (WHERE event_type <> 'purchase') AS marked_at, max(ts) FILTER (WHERE event_type = 'purchase') AS cleared_to, count(*) FILTER (WHERE event_type <> 'purchase') AS marks,
        coalesce(max(ts) FILTER (WHERE event_type <> 'purchase') > coalesce(max(ts) FILTER (WHERE event_type = 'purchase'), TIMESTAMP '1970-01-01'), FALSE) AS dirty FROM events GROUP BY 1""")
def dirty_stream(spark, sf):
    """Marks and clearings as a stream with a state store, in several batches, stopped and started again between two arrivals: the state that is left."""
    reader, files, arrive = _arriving(spark, table(spark, sf, "events"))
    target, checkpoint = shared_folder(spark, "state"), shared_folder(spark, "offsets")
    for half in (0, 1):
        arrive(half)
        stream = reader.parquet(files).select(F.pmod("user_id", F.lit(40)).cast("string").alias("ref"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("cleared"))
        dirty.run_available(dirty.marked_state(stream), target, checkpoint)
    found = current(spark, target, "state")
    return found.select(F.col("ref").cast("long").alias("ref"), "marked_at", "cleared_to", "marks", "dirty")


@query("dirty_rebuild", """
    SELECT concat('user:', user_id % 40) AS ref, count(*) AS events, max(ts) AS last_at, max_by(event_type, event_id) AS last_type FROM events GROUP BY 1
    UNION ALL SELECT concat('team:', user_id % 5), count(*), max(ts), max_by(event_type, event_id) FROM events GROUP BY 1""")
def dirty_rebuild(spark, sf):
    """Ticks of at most 15 refs over a stream of marks, and then until nothing is dirty: a user's rebuild marks its team, which stays dirty for a later tick. The derived table is that of a full rebuild."""
    events = table(spark, sf, "events")
    reader, files, arrive = _arriving(spark, events)
    derived, checkpoint = shared_folder(spark, "derived"), shared_folder(spark, "offsets")
    waiting = dirty.DirtySet(spark, shared_folder(spark, "dirty"))
    user, team = F.concat(F.lit("user:"), F.pmod("user_id", F.lit(40))), F.concat(F.lit("team:"), F.pmod("user_id", F.lit(5)))
    known = [spark.createDataFrame([], "ref string, events long, last_at timestamp_ntz, last_type string")]

    def rebuild(refs: DataFrame) -> DataFrame:
        rows = events.withColumn("ref", F.explode(F.array(user, team))).join(refs, "ref", "left_semi")
        fresh = rows.groupBy("ref").agg(F.count("*").alias("events"), F.max("ts").alias("last_at"), F.max_by("event_type", "event_id").alias("last_type"))
        publish(spark, derived, {"rows": upsert(known[0], fresh, ["ref"])})
        known[0] = current(spark, derived, "rows")
        return rows.where(F.col("ref").startswith("user:")).groupBy(team.alias("ref")).agg((F.max("ts") + F.make_dt_interval(days=F.lit(999))).alias("marked_at"))

    for half in (0, 1):
        arrive(half)
        waiting.follow(reader.parquet(files).select(user.alias("ref"), F.col("ts").alias("marked_at")), rebuild, 15, checkpoint)
    waiting.drain(rebuild, 15)
    return known[0]


_ATTEMPTS = "SELECT event_id, ts, concat('q', user_id % 5, '-', CAST(floor(event_id / 1500) AS INT)) AS queue, event_type IN ('error', 'view') AS failed, event_type = 'error' AND value > 60 AS limited FROM events"


@query("queue_runs", f"""
    WITH a AS ({_ATTEMPTS}), h AS (SELECT *, coalesce(bool_or(limited) OVER (PARTITION BY queue ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS halted FROM a),
    g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY queue, halted ORDER BY ts, event_id) AS wins FROM h), s AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY queue, halted, wins ORDER BY ts, event_id) AS streak FROM g)
    SELECT event_id, queue, halted, CASE WHEN NOT halted THEN CASE WHEN failed THEN CAST((streak - 1) % 3 + 1 AS BIGINT) ELSE 0 END END AS run, CASE WHEN NOT halted THEN failed AND streak % 3 = 0 END AS cooldown FROM s""")
def queue_runs(spark, sf):
    """Attempts of queues up to their first rate limit, their failures in a row and cooldowns; buckets are hours."""
    events = table(spark, sf, "events").select("event_id", "ts", F.expr("concat('q', user_id % 5, '-', CAST(floor(event_id / 1500) AS INT))").alias("queue"), F.col("event_type").isin("error", "view").alias("failed"), ((F.col("event_type") == "error") & (F.col("value") > 60)).alias("limited"))
    rows = events.withColumn("hour", F.date_trunc("hour", "ts"))
    found = folds.queue_runs(rows, ["queue"], "hour", ["ts", "event_id"], F.col("failed"), F.col("limited"), 3)
    return found.select("event_id", "queue", "halted", "run", "cooldown")


_WALK = """sold AS (SELECT l_partkey AS history_id, concat(l_orderkey, '-', l_linenumber, '-', l_suppkey) AS sale_id, CAST(l_shipdate AS DATE) AS sale_date, l_orderkey % 3 <> 0 AS was, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS place FROM lineitem),
    sales AS (SELECT history_id, sale_id, sale_date, was OR (place > 6 AND history_id % 2 = 0) AS was, CAST(floor((place - 1) / 3) + 1 AS INT) AS page FROM sold),
    pages AS (SELECT history_id, page, CAST(history_id % 7 + page AS DOUBLE) AS seconds FROM (SELECT DISTINCT history_id, page FROM sales UNION SELECT history_id, max(page) + 1 FROM sales GROUP BY history_id)),
    histories AS (SELECT p_partkey AS history_id, CASE WHEN p_partkey % 4 = 1 THEN DATE '1999-01-01' END AS cutoff, p_partkey % 3 <> 1 AS complete, CASE WHEN p_partkey % 3 = 1 AND p_size % 2 = 0 THEN 2 END AS pages_fetched,
        CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN TIMESTAMP '2001-03-01 00:00:00' ELSE TIMESTAMP '2001-05-20 00:00:00' END AS audited_at FROM part)"""


@query("history_walk", f"""
    WITH {_WALK},
    m AS (SELECT *, CASE WHEN NOT complete AND coalesce(pages_fetched, 0) > 0 THEN 'resume' WHEN cutoff IS NULL AND complete AND audited_at > TIMESTAMP '2001-05-02 00:00:00' THEN 'incremental' WHEN cutoff IS NULL THEN 'audit' ELSE 'cutoff' END AS mode, CASE WHEN complete THEN 1 ELSE coalesce(pages_fetched, 0) + 1 END AS first_page FROM histories),
    r AS (SELECT m.*, p.page, p.seconds, count(s.sale_id) AS n, bool_and(s.was) AS all_known, min(s.sale_date) AS oldest FROM m JOIN pages p ON p.history_id = m.history_id AND p.page BETWEEN first_page AND 8 LEFT JOIN sales s ON s.history_id = p.history_id AND s.page = p.page GROUP BY ALL),
    w AS (SELECT *, lag(all_known) OVER o AS before, sum(seconds) OVER (PARTITION BY history_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS spent FROM r WINDOW o AS (PARTITION BY history_id ORDER BY page)),
    j AS (SELECT *, CASE WHEN n = 0 THEN 'source_exhausted' WHEN oldest < cutoff THEN 'user_cutoff' WHEN mode = 'incremental' AND all_known AND before THEN 'known_overlap' WHEN page = 8 THEN 'page_cap_reached' WHEN spent >= 30 THEN 'time_budget' END AS why FROM w),
    e AS (SELECT history_id, min(page) AS last, arg_min(why, page) AS why FROM j WHERE why IS NOT NULL GROUP BY history_id),
    t AS (SELECT j.history_id, count(*) AS walked, max(j.page) AS last_page, sum(n) AS seen, max(spent) AS seconds FROM j LEFT JOIN e ON e.history_id = j.history_id WHERE e.last IS NULL OR j.page <= e.last GROUP BY j.history_id)
    SELECT m.history_id, mode, coalesce(walked, 0) AS walked, CAST(coalesce(last_page, first_page - 1) AS BIGINT) AS pages_fetched, CAST(coalesce(seen, 0) AS BIGINT) AS seen, coalesce(seconds, 0.0)::DOUBLE AS seconds, why AS evidence, coalesce(why IN ('source_exhausted', 'user_cutoff', 'known_overlap'), FALSE) AS complete,
        CASE WHEN mode <> 'incremental' AND cutoff IS NULL THEN TIMESTAMP '2001-06-01 00:00:00' ELSE audited_at END AS audited_at FROM m LEFT JOIN e ON e.history_id = m.history_id LEFT JOIN t ON t.history_id = m.history_id""")
def history_walk(spark, sf):
    """Walks over every part's sales within 30 seconds and eight pages: resumed, incremental, to a cutoff, or an audit."""
    read = lambda name: spark.sql(f"WITH {_WALK} SELECT * FROM {name}".replace("FROM lineitem", "FROM {lineitem}").replace("FROM part)", "FROM {part})"), lineitem=table(spark, sf, "lineitem"), part=table(spark, sf, "part"))
    # written once: pages, sales and known sales would each number all lines again
    sales = settled(read("sales"), "sales")
    pages = sales.groupBy("history_id", "page").count().select("history_id", "page").unionByName(sales.groupBy("history_id").agg((F.max("page") + 1).alias("page")))
    views = {"histories": read("histories"), "pages": pages.select("history_id", "page", (F.col("history_id") % 7 + F.col("page")).cast("double").alias("seconds"))}
    stamped = views["histories"].withColumn("audited_at", F.col("audited_at").cast("timestamp_ntz"))
    found, _ = history.walk(stamped, views["pages"], sales.drop("was"), sales.where("was"), F.lit("2001-06-01 00:00:00").cast("timestamp_ntz"), 30.0, 8)
    return found
