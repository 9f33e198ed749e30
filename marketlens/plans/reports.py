"""Driver queries of reports, queues, curation and matching on the views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import auctions, curation, matching, merge, operations
from ..sources import raw
from ..sources.tables import table
from ..streaming import ledger
from .market import _LATEST, _TARGETS, _TRUSTED, _targets
from .registry import query
from .relational import NOW_EVENTS
from .views import NOW, WITH, now, views

_AT = f"TIMESTAMP '{NOW_EVENTS}'"


def _at():
    return F.lit(NOW_EVENTS).cast("timestamp_ntz")


@query("match_report", f"""
    {WITH} SELECT 'match_tier' AS dimension, match_tier AS value, count(*) AS n FROM listings GROUP BY match_tier UNION ALL SELECT 'match_status', match_status, count(*) FROM listings GROUP BY match_status UNION ALL SELECT 'match_method', match_method, count(*) FROM listings GROUP BY match_method""")
def match_report(spark, sf):
    """Listings by tier, status and method."""
    return operations.match_report(views(spark, sf)["listings"])


@query("listing_gaps", f"""
    {WITH}, {_TARGETS} SELECT match_tier AS gap_type, listing_id, title AS subject FROM listings WHERE match_tier IN ('catalogue-gap', 'card-level', 'flagged', 'review', 'out-of-scope', 'lot')
    UNION ALL SELECT 'psa-identity-gap', NULL, source_set_id FROM counted c JOIN named d ON d.variant_id = c.variant_id WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.variant_id = c.variant_id) GROUP BY source_set_id""")
def listing_gaps(spark, sf):
    """Listings in gap tiers and sets with variants that no spec is known for."""
    v = views(spark, sf)
    return operations.gaps(v["listings"], _targets(v)[1])


@query("coverage_report", f"""
    {WITH}, h AS (SELECT source_set_id, count(*) AS headings, count(*) FILTER (WHERE language <> 'de') AS matched_headings FROM sets WHERE set_id % 4 <> 0 GROUP BY source_set_id),
    p AS (SELECT s.source_set_id, count(*) AS specs FROM specs ps JOIN variants v ON v.variant_id = ps.variant_id JOIN cards c ON c.card_id = v.card_id JOIN sets s ON s.set_id = c.set_id WHERE namespace = 'population' GROUP BY s.source_set_id),
    t AS (SELECT s.source_set_id, count(*) AS cards FROM cards c JOIN sets s ON s.set_id = c.set_id WHERE s.language = 'en' GROUP BY s.source_set_id)
    SELECT source_set_id, coalesce(headings, 0) AS headings, coalesce(matched_headings, 0) AS matched_headings, coalesce(specs, 0) AS specs, coalesce(cards, 0) AS cards FROM h FULL JOIN p USING (source_set_id) FULL JOIN t USING (source_set_id)""")
def coverage_report(spark, sf):
    """Headings, specs and English cards of every set that one of the three knows."""
    v = views(spark, sf)
    headings = v["sets"].where("set_id % 4 <> 0").select(F.col("set_id").alias("heading_id"), "source_set_id", F.when(F.col("language") == "de", "ambiguous").when(F.col("language") == "ja", "manual").otherwise("matched").alias("match_status"))
    return operations.coverage_report(headings, v["specs"], v["variants"], v["cards"], v["sets"])[1]


@query("verify_store", f"""
    {WITH}, objects AS (SELECT sha256(CAST(p_partkey AS STRING)) AS hash, concat('o/', p_partkey) AS storage_path FROM part WHERE p_partkey % 10 <> 0), files AS (SELECT CASE WHEN p_partkey % 20 = 0 THEN concat('tmp/', p_partkey) ELSE concat('o/', p_partkey) END AS storage_path, CASE WHEN p_partkey % 9 = 0 THEN 'broken' ELSE CAST(p_partkey AS STRING) END AS body FROM part WHERE p_partkey % 7 <> 0)
    SELECT 'missing' AS problem, count(*) AS n FROM objects o WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.storage_path = o.storage_path)
    UNION ALL SELECT 'mismatch', count(*) FROM objects o JOIN files f ON f.storage_path = o.storage_path WHERE sha256(f.body) <> o.hash
    UNION ALL SELECT 'orphan', count(*) FROM files f WHERE f.storage_path NOT LIKE 'tmp/%' AND NOT EXISTS (SELECT 1 FROM objects o WHERE f.storage_path = o.storage_path)
    UNION ALL SELECT 'broken_observation', count(*) FROM observations x WHERE NOT EXISTS (SELECT 1 FROM work w WHERE w.work_item_id = x.work_item_id) OR x.hash IN ('h3', 'h5')
    UNION ALL SELECT 'no_evidence', count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) FROM orders UNION ALL SELECT 'expired_lease', count(*) FROM work WHERE state = 'leased' AND lease_expires_at < {_AT}""")
def verify_store(spark, sf):
    """What is wrong with a raw store: files, hashes, references, evidence and leases."""
    v = views(spark, sf)
    key = F.col("p_partkey")
    objects = table(spark, sf, "part").where("p_partkey % 10 <> 0").select(F.sha2(key.cast("string"), 256).alias("hash"), F.concat(F.lit("o/"), key).alias("storage_path"))
    files = table(spark, sf, "part").where("p_partkey % 7 <> 0").select(F.concat(F.when(key % 20 == 0, "tmp/").otherwise("o/"), key).alias("storage_path"), F.when(key % 9 == 0, "broken").otherwise(key.cast("string")).cast("binary").alias("body"))
    # contents of the observations, stored under the hash of their text
    seen = v["observations"].withColumn("hash", F.sha2("hash", 256))
    known = v["observations"].select("hash").where("hash not in ('h3', 'h5')").distinct()
    kept = known.select(F.sha2("hash", 256).alias("hash"), F.concat(F.lit("x/"), "hash").alias("storage_path"))
    bodies = known.select(F.concat(F.lit("x/"), "hash").alias("storage_path"), F.col("hash").cast("binary").alias("body"))
    return operations.verify(objects.unionByName(kept), files.unionByName(bodies), seen, v["work"], table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "complete").alias("status"), F.when(F.col("o_orderkey") % 3 != 0, "page 9").alias("evidence")), _at())


@query("term_funnels", f"""
    {WITH}, {_LATEST}, terms AS (SELECT n_nationkey AS term_id FROM nation WHERE n_nationkey < 12), items AS (SELECT term_id, CASE WHEN listing_id % 8 <> 0 THEN listing_id END AS listing_id FROM listings), targets AS (SELECT listing_id, variant_id AS target_id FROM listings WHERE variant_id IS NOT NULL),
    phases AS (SELECT p_partkey * 4 AS target_id, p_size % 2 = 0 AS population, p_size % 3 = 0 AS guide, p_size % 5 = 0 AS sales FROM part),
    a AS (SELECT i.term_id, count(*) AS found, count(match_tier) AS detailed, count(*) FILTER (WHERE match_tier IN ('exact', 'strong') AND NOT flagged) AS matched FROM items i LEFT JOIN listings e ON e.listing_id = i.listing_id GROUP BY i.term_id),
    b AS (SELECT i.term_id, count(DISTINCT CASE WHEN item_end_date > TIMESTAMP '{NOW}' THEN t.target_id END) AS live_targets, count(DISTINCT CASE WHEN population THEN t.target_id END) AS population, count(DISTINCT CASE WHEN guide THEN t.target_id END) AS guide, count(DISTINCT CASE WHEN sales THEN t.target_id END) AS sales
        FROM items i JOIN targets t ON t.listing_id = i.listing_id LEFT JOIN latest l ON l.listing_id = i.listing_id LEFT JOIN phases p ON p.target_id = t.target_id GROUP BY i.term_id)
    SELECT CAST(term_id AS BIGINT) AS term_id, coalesce(found, 0) AS found, coalesce(detailed, 0) AS detailed, coalesce(matched, 0) AS matched, coalesce(live_targets, 0) AS live_targets, coalesce(population, 0) AS population, coalesce(guide, 0) AS guide, coalesce(sales, 0) AS sales FROM terms LEFT JOIN a USING (term_id) LEFT JOIN b USING (term_id)""")
def term_funnels(spark, sf):
    """Search terms from items found to phases processed."""
    v = views(spark, sf)
    items = v["listings"].select("term_id", F.when(F.col("listing_id") % 8 != 0, F.col("listing_id")).alias("listing_id"))
    targets = v["listings"].where("variant_id is not null").select("listing_id", F.col("variant_id").alias("target_id"))
    kinds = F.array(*(F.struct(F.lit(p).alias("phase"), F.when(F.col("p_size") % k == 0, "processed").otherwise("raw").alias("status")) for p, k in (("population", 2), ("guide", 3), ("sales", 5))))
    coverage = table(spark, sf, "part").select((F.col("p_partkey") * 4).alias("target_id"), F.inline(kinds))
    terms = table(spark, sf, "nation").where("n_nationkey < 12").select(F.col("n_nationkey").cast("long").alias("term_id"))
    return operations.term_funnels(terms, items, v["listings"], targets, v["history"], coverage, now())


_MEMBERS = """m AS (SELECT o_orderkey AS item_id, o_custkey % 10 AS term_id, o_orderkey % 9 = 4 AS missing, CASE o_orderkey % 4 WHEN 0 THEN 'permanent_failed' WHEN 1 THEN 'pending' END AS state, CASE WHEN o_orderkey % 6 = 1 THEN 'HTTP 429' WHEN o_orderkey % 6 = 2 THEN 'Rate Limit' END AS last_error FROM orders),
    told AS (SELECT o_orderkey AS listing_id, phase, CASE WHEN o_orderkey % 3 = 0 THEN 'processed' WHEN o_orderkey % 3 = 1 THEN 'no_data' ELSE 'strange' END AS status, o_orderdate AS created_at FROM orders CROSS JOIN (SELECT 'population' AS phase UNION ALL SELECT 'guide' UNION ALL SELECT 'sales') x WHERE o_custkey % 4 = 0)"""
_STATES = """d AS (SELECT * FROM specs WHERE match_status IN ('matched', 'manual')), l AS (SELECT * FROM listings WHERE listing_id % 9 <> 4),
    s AS (SELECT m.*, l.listing_id IS NOT NULL AS fetched, l.variant_id, l.match_tier, coalesce(l.match_tier IN ('exact', 'strong'), FALSE) AS matched, coalesce(l.match_tier IN ('exact', 'strong') AND NOT l.flagged, FALSE) AND EXISTS (SELECT 1 FROM d WHERE d.variant_id = l.variant_id AND namespace = 'population') AS known,
        EXISTS (SELECT 1 FROM d JOIN population p ON p.spec_pk = d.spec_pk WHERE d.variant_id = l.variant_id) AS hp, EXISTS (SELECT 1 FROM d JOIN prices p ON p.spec_pk = d.spec_pk WHERE d.variant_id = l.variant_id AND grade_key = '10') AS hg, EXISTS (SELECT 1 FROM d JOIN sales p ON p.spec_pk = d.spec_pk WHERE d.variant_id = l.variant_id AND grade_value = 10) AS hs,
        max(CASE WHEN t.phase = 'population' AND status <> 'strange' THEN status END) AS tp, max(CASE WHEN t.phase = 'guide' AND status <> 'strange' THEN status END) AS tg, max(CASE WHEN t.phase = 'sales' AND status <> 'strange' THEN status END) AS ts
        FROM m LEFT JOIN l ON l.listing_id = m.item_id LEFT JOIN told t ON t.listing_id = m.item_id GROUP BY ALL),
    states AS (SELECT term_id, item_id, variant_id, match_tier, CASE WHEN fetched THEN 'fetched' WHEN state IS NOT NULL AND last_error IS NOT NULL THEN 'rate_limited' WHEN state = 'permanent_failed' THEN 'failed' ELSE 'pending' END AS acquisition, matched, CASE WHEN known THEN 'processed' ELSE 'identity_missing' END AS identity,
        coalesce(tp, CASE WHEN NOT known THEN 'identity_missing' WHEN hp THEN 'processed' ELSE 'raw_missing' END) AS population, coalesce(tg, CASE WHEN NOT known THEN 'identity_missing' WHEN hg THEN 'processed' ELSE 'raw_missing' END) AS guide, coalesce(ts, CASE WHEN NOT known THEN 'identity_missing' WHEN hs THEN 'processed' ELSE 'raw_missing' END) AS sales FROM s)"""


def _listing_states(spark, sf):
    v = views(spark, sf)
    rows = {name: spark.sql(f"WITH {_MEMBERS} SELECT * FROM {name}".replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders")) for name in ("m", "told")}
    return auctions.listing_states(rows["m"].select("term_id", "item_id"), v["listings"].where("listing_id % 9 <> 4"), rows["m"].where("state is not null").select("item_id", "state", "last_error"), rows["told"], v["specs"], v["population"], v["prices"], v["sales"])


@query("listing_states", f"{WITH}, {_MEMBERS}, {_STATES} SELECT * FROM states")
def listing_states(spark, sf):
    """Every member of a search with acquisition, identity and the state of each phase."""
    return _listing_states(spark, sf)


@query("campaign_funnel", f"""
    {WITH}, {_MEMBERS}, {_STATES} SELECT term_id, count(*) AS members, count(*) FILTER (WHERE acquisition = 'fetched') AS fetched, count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE matched AND identity = 'identity_missing') AS identity_missing,
        count(*) FILTER (WHERE population = 'processed') AS population, count(*) FILTER (WHERE guide = 'processed') AS guide, count(*) FILTER (WHERE sales = 'processed') AS sales FROM states GROUP BY term_id""")
def campaign_funnel(spark, sf):
    """Members of each search from found to processed."""
    return auctions.funnel(_listing_states(spark, sf), ["term_id"])


@query("stage_status", f"""
    {WITH}, stages AS (SELECT concat('stage', n_nationkey) AS stage, concat('q', n_nationkey) AS queue, n_nationkey * 10 AS items_done, n_nationkey AS window_items, n_nationkey % 3 * 30 AS window_seconds FROM nation WHERE n_nationkey < 7)
    SELECT stage, items_done, CASE WHEN window_seconds > 0 THEN window_items * CAST(60 AS DOUBLE) / window_seconds END AS per_minute, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'leased') AS in_flight, count(*) FILTER (WHERE state = 'retryable_failed') AS retryable, count(*) FILTER (WHERE state = 'permanent_failed') AS failed
    FROM stages LEFT JOIN work ON work.queue = stages.queue GROUP BY stage, items_done, window_items, window_seconds""")
def stage_status(spark, sf):
    """Stages with their queues."""
    k = F.col("n_nationkey")
    stages = table(spark, sf, "nation").where("n_nationkey < 7").select(F.concat(F.lit("stage"), k).alias("stage"), F.concat(F.lit("q"), k).alias("queue"), (k * 10).alias("items_done"), k.alias("window_items"), (k % 3 * 30).alias("window_seconds"))
    return operations.stage_status(stages, views(spark, sf)["work"])


@query("last_executions", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def last_executions(spark, sf):
    """Of each parser's runs over an observation the last one."""
    return operations.last_executions(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("first_manifests", "SELECT o_custkey AS run_id, 1 AS revision, false AS complete, count(DISTINCT o_orderkey) AS new_targets, count(DISTINCT l_partkey) AS listings, min(o_orderdate) AS created_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def first_manifests(spark, sf):
    """A first revision for runs that have none."""
    targets = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("target_id"), F.col("o_orderdate").alias("created_at"))
    return operations.first_manifests(targets, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("target_id"), F.col("l_partkey").alias("listing_id")))


@query("listing_page", f"""
    {WITH}, {_LATEST} SELECT e.listing_id, coalesce(item_end_date > TIMESTAMP '{NOW}', false) AS live, item_end_date FROM listings e LEFT JOIN latest l ON l.listing_id = e.listing_id ORDER BY live DESC, item_end_date NULLS LAST, e.listing_id DESC LIMIT 48""")
def listing_page(spark, sf):
    """The first listings: live ones, soonest end first."""
    v = views(spark, sf)
    rows = v["listings"].select("listing_id").join(auctions.current_prices(v["history"]).select("listing_id", "item_end_date"), "listing_id", "left").withColumn("live", F.coalesce(F.col("item_end_date") > now(), F.lit(False)))
    return operations.listing_page(rows).limit(48).select("listing_id", "live", "item_end_date")


@query("coverage_matrix", f"{WITH} SELECT concat_ws(':', queue, state) AS status_key, count(*) AS n FROM work GROUP BY queue, state")
def coverage_matrix(spark, sf):
    """Counts by phase and status."""
    return operations.coverage_matrix(views(spark, sf)["work"].select(F.col("queue").alias("phase"), F.col("state").alias("status")))


@query("reset_plan", f"{WITH} SELECT 'work' AS table_name, count(*) AS n FROM work WHERE state = 'leased' UNION ALL SELECT 'listings', count(*) FROM listings WHERE match_tier = 'review'")
def reset_plan(spark, sf):
    """What a reset would rewrite."""
    v = views(spark, sf)
    return operations.reset({"work": v["work"], "listings": v["listings"]}, {"work": (F.col("state") == "leased", {"state": "pending"}), "listings": (F.col("match_tier") == "review", {"variant_id": None})})


@query("requeue", f"{WITH} SELECT work_item_id, CASE WHEN state = 'retryable_failed' AND source = 'src1' THEN 'pending' ELSE state END AS state, CASE WHEN state = 'retryable_failed' AND source = 'src1' THEN 0 ELSE priority END AS priority FROM work")
def requeue(spark, sf):
    """Failed work of one source goes back to the queue."""
    work = views(spark, sf)["work"].select("work_item_id", "source", "state", "priority")
    return merge.transition(work, (F.col("state") == "retryable_failed") & (F.col("source") == "src1"), state="pending", priority=0).select("work_item_id", "state", "priority")


@query("cooldowns", """
    WITH s AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
    r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN (sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1) % 2 + 1 ELSE 0 END AS run FROM s)
    SELECT event_id, CAST(run AS BIGINT) AS run, run = 2 AS cooldown FROM r""")
def cooldowns(spark, sf):
    """Failures in a row, set back by a success and by a cooldown after two."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return operations.cooldowns(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2).select("event_id", "run", "cooldown")


@query("publication", f"""
    SELECT event_id, CASE WHEN event_type = 'view' THEN 'nothing' WHEN coalesce(ts <= {_AT} - INTERVAL 120 SECOND, true) OR coalesce(ts + INTERVAL 1 DAY BETWEEN {_AT} AND {_AT} + INTERVAL 6 HOUR, false) THEN 'publish' ELSE 'debounce' END AS decision FROM events""")
def publication(spark, sf):
    """Whether changes go out now."""
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", operations.publication(F.col("event_type") != "view", ts, ts + F.make_dt_interval(days=F.lit(1)), _at()).alias("decision"))


@query("source_status", f"""
    {WITH}, o AS (SELECT DISTINCT source, hash FROM observations), c AS (SELECT source, count(*) AS contents, CAST(sum(CAST(hash[2:] AS INT)) AS BIGINT) AS bytes FROM o GROUP BY source), l AS (SELECT source, max(observed_at) AS last_observed FROM observations GROUP BY source)
    SELECT w.source, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'leased') AS leased, count(*) FILTER (WHERE state = 'succeeded') AS succeeded, any_value(contents) AS contents, any_value(bytes) AS bytes, any_value(last_observed) AS last_observed
    FROM work w LEFT JOIN c ON c.source = w.source LEFT JOIN l ON l.source = w.source GROUP BY w.source""")
def source_status(spark, sf):
    """Work and distinct contents of each source."""
    v = views(spark, sf)
    objects = v["observations"].select("hash").distinct().withColumn("byte_size", F.substring("hash", 2, 9).cast("long"))
    return operations.source_status(v["work"], v["observations"], objects).select("source", "pending", "leased", "succeeded", "contents", "bytes", "last_observed")


@query("run_report", f"""
    {WITH}, f AS (SELECT hash, min(observation_id) AS first FROM observations GROUP BY hash) SELECT source AS run_id, entity_type AS outcome, count(*) AS attempts, CAST(sum(observation_id % 100) AS BIGINT) AS bytes, CAST(sum(CASE WHEN observation_id = first THEN observation_id % 100 ELSE 0 END) AS BIGINT) AS new_bytes
    FROM observations o JOIN f ON f.hash = o.hash GROUP BY source, entity_type""")
def run_report(spark, sf):
    """Attempts and bytes by outcome, and those of contents seen first."""
    v = views(spark, sf)["observations"]
    first = v.groupBy("hash").agg(F.min("observation_id").alias("first"))
    attempts = v.select(F.col("observation_id").alias("attempt_id"), F.col("source").alias("run_id"), F.col("entity_type").alias("outcome"), (F.col("observation_id") % 100).alias("byte_size"))
    return operations.run_report(attempts, v.join(first, "hash").select(F.col("observation_id").alias("attempt_id"), (F.col("observation_id") == F.col("first")).alias("is_first_observation_of_hash")))


@query("failed_attempts", "SELECT event_id, ts FROM events WHERE event_type = 'error' AND user_id % 3 = 1 ORDER BY ts DESC, event_id DESC")
def failed_attempts(spark, sf):
    """Failures of one source, newest first (P20)."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("attempt_id"), F.col("ts").alias("attempted_at"), F.concat(F.lit("src"), F.col("user_id") % 3).alias("source"), F.when(F.col("event_type") == "error", "failed_retryable").otherwise("succeeded").alias("outcome"))
    return operations.failures(rows, "src1").select(F.col("attempt_id").alias("event_id"), F.col("attempted_at").alias("ts"))


@query("claimable_work", f"{WITH} SELECT work_item_id, priority, created_at FROM work WHERE state = 'pending' OR state = 'leased' AND lease_expires_at < {_AT} ORDER BY priority DESC, created_at, work_item_id LIMIT 100")
def claimable_work(spark, sf):
    """The next hundred items by priority and age, with expired leases."""
    work = views(spark, sf)["work"].withColumn("available_at", F.lit(None).cast("timestamp_ntz"))
    return operations.claimable(work, _at()).limit(100).select("work_item_id", "priority", "created_at")


@query("stage_decisions", f"SELECT event_id AS stage, CASE WHEN event_type = 'click' THEN 'run' WHEN ts + INTERVAL 5 DAY > {_AT} THEN 'parked' WHEN ts + INTERVAL 9 DAY > {_AT} THEN 'waiting' ELSE 'run' END AS decision FROM events")
def stage_decisions(spark, sf):
    """A poke before parking before back-off."""
    ts = F.col("ts")
    stages = table(spark, sf, "events").select(F.col("event_id").alias("stage"), (F.col("event_type") == "click").alias("poked"), (ts + F.make_dt_interval(days=F.lit(5))).alias("parked_until"), (ts + F.make_dt_interval(days=F.lit(9))).alias("next_tick_at"))
    return operations.stage_decision(stages, _at())


@query("publish_gate", f"""
    {WITH} SELECT 'trusted_unproven' AS rule, count(*) FILTER (WHERE match_tier IN ('exact', 'strong') AND (variant_id IS NULL OR flagged OR coalesce(match_method = 'cluster-propagate', FALSE))) AS n FROM listings UNION ALL SELECT 'no_tier', count(*) FILTER (WHERE match_tier IS NULL) FROM listings
    UNION ALL SELECT 'campaign_incomplete', count(*) FROM customer WHERE NOT (c_mktsegment <> 'MACHINERY' AND c_custkey % 7 <> 0)
    UNION ALL SELECT 'card_without_set', count(*) FROM cards c WHERE NOT EXISTS (SELECT 1 FROM sets s WHERE s.set_id = c.set_id AND s.set_id <> 3) UNION ALL SELECT 'variant_without_card', count(*) FROM variants v WHERE NOT EXISTS (SELECT 1 FROM cards c WHERE c.card_id = v.card_id)
    UNION ALL SELECT 'listing_without_variant', count(*) FROM listings l WHERE variant_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM variants v WHERE v.variant_id = l.variant_id) UNION ALL SELECT 'spec_without_variant', count(*) FROM specs p WHERE NOT EXISTS (SELECT 1 FROM variants v WHERE v.variant_id = p.variant_id)
    UNION ALL SELECT 'empty_catalogue', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM cards""")
def publish_gate(spark, sf):
    """What must be zero before publication."""
    v = views(spark, sf)
    campaigns = table(spark, sf, "customer").select(F.when(F.col("c_mktsegment") != "MACHINERY", "complete").otherwise("running").alias("status"), F.when(F.col("c_custkey") % 7 != 0, "complete").alias("coverage_status"))
    return operations.gate(v["listings"], v["cards"], v["sets"].where("set_id <> 3"), v["variants"], v["specs"], campaigns)


@query("language_summary", f"{WITH} SELECT s.language, count(DISTINCT s.set_id) AS sets, count(DISTINCT c.card_id) AS cards, count(DISTINCT v.variant_id) AS variants FROM sets s LEFT JOIN cards c ON c.set_id = s.set_id LEFT JOIN variants v ON v.card_id = c.card_id GROUP BY s.language")
def language_summary(spark, sf):
    """Sets, cards and variants of each language."""
    v = views(spark, sf)
    return operations.language_summary(v["sets"], v["cards"], v["variants"])


@query("open_reviews", f"{WITH} SELECT listing_id, match_tier FROM listings WHERE match_tier IN ('review', 'flagged') AND listing_id % 6 <> 0 ORDER BY listing_id DESC LIMIT 200")
def open_reviews(spark, sf):
    """Decisions in review that nobody acted on, newest first."""
    rows = views(spark, sf)["listings"].select("listing_id", "match_tier", F.col("listing_id").alias("decided_at"), F.lit(1).alias("revision"))
    actions = rows.where("listing_id % 6 = 0").select("listing_id", F.lit("dismiss").alias("action"), F.lit(1).alias("acted_at"))
    return operations.open_reviews(rows, actions).select("listing_id", "match_tier")


@query("image_links", f"{WITH}, a AS (SELECT l_partkey AS card_id, max(l_orderkey) AS newest FROM lineitem GROUP BY l_partkey) SELECT c.card_id, coalesce(image_url, 'http://o/' || newest) AS image_url FROM cards c LEFT JOIN a ON a.card_id = c.card_id")
def image_links(spark, sf):
    """Cards without a picture take the newest stored one."""
    assets = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("card_id"), F.col("l_orderkey").alias("stored_at"), F.lit("h").alias("hash"), F.concat(F.lit("http://o/"), "l_orderkey").alias("url"))
    return operations.links_to_images(views(spark, sf)["cards"], assets).select("card_id", "image_url")


@query("specs_by_year", f"""
    {WITH} SELECT p.spec_id, s.source_set_id AS release, concat(s.source_set_id, '-', c.local_id) AS source_card_id, coalesce(v.finish, 'unknown') AS finish, coalesce(v.print_run_marker, 'unknown') AS print_run_marker, v.micro_variant,
        coalesce((SELECT max(x.spec_id) FROM specs x WHERE x.namespace = 'sales' AND x.variant_id = p.variant_id AND x.match_status IN ('matched', 'manual')), p.spec_id) AS sales_spec_id
    FROM specs p JOIN variants v ON v.variant_id = p.variant_id JOIN cards c ON c.card_id = v.card_id JOIN sets s ON s.set_id = c.set_id WHERE p.namespace = 'population' AND p.match_status IN ('matched', 'manual') AND s.language = 'en' AND s.series <> 'SERIES_2' AND s.release_date < '2018-01-01'""")
def specs_by_year(spark, sf):
    """Population specs of printed English cards up to a year, with the spec to ask for sales."""
    v = views(spark, sf)
    sets = v["sets"].withColumn("series", F.when(F.col("series") == "SERIES_2", operations.DIGITAL_SERIES).otherwise(F.col("series")))
    return operations.specs_by_year(v["specs"], v["variants"], v["cards"], sets, 2017)


_COVER = """t AS (SELECT p_partkey AS target_id, concat('P', p_partkey) AS spec_id, CASE WHEN p_size % 4 <> 0 THEN concat('S', p_partkey) END AS sales_spec_id, p_size FROM part),
    k AS (SELECT spec_id, 'population' AS kind, target_id % 3 = 0 AS has_raw, CASE target_id % 5 WHEN 0 THEN 'permanent_failed' WHEN 1 THEN 'retryable_failed' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'leased' END AS state, CASE WHEN target_id % 7 < 3 THEN 'HTTP 429' WHEN target_id % 7 = 3 THEN 'Rate-limit hit' ELSE 'timeout' END AS last_error FROM t
        UNION ALL SELECT sales_spec_id, 'sales', p_size % 2 = 0, CASE p_size % 6 WHEN 0 THEN 'permanent_failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'cancelled' END, CASE WHEN p_size % 5 = 0 THEN 'rate limit' END FROM t WHERE sales_spec_id IS NOT NULL),
    r AS (SELECT concat('P', l_partkey) AS spec_id, 'population' AS phase FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT concat('P', l_partkey), 'guide' FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 20 UNION ALL SELECT concat('S', l_partkey), 'sales' FROM lineitem WHERE l_quantity > 45)"""


@query("coverage_states", f"""
    WITH {_COVER}, p AS (SELECT target_id, 'population' AS phase, 'population' AS kind, spec_id FROM t UNION ALL SELECT target_id, 'guide', 'population', spec_id FROM t UNION ALL SELECT target_id, 'sales', 'sales', sales_spec_id FROM t),
    c AS (SELECT p.target_id, p.phase, (SELECT count(*) FROM r WHERE r.spec_id = p.spec_id AND r.phase = p.phase) AS n, k.* EXCLUDE (spec_id, kind) FROM p LEFT JOIN k ON k.spec_id = p.spec_id AND k.kind = p.kind)
    SELECT target_id, phase, n, CASE WHEN n > 0 THEN 'processed' WHEN has_raw AND phase = 'population' THEN 'raw_present' WHEN has_raw THEN 'no_data' WHEN state = 'permanent_failed' THEN 'failed' WHEN state IS NOT NULL AND regexp_matches(coalesce(last_error, ''), '(?i)429|rate.?limit') THEN 'rate_limited'
        WHEN state IN ('pending', 'leased', 'running', 'retryable_failed', 'partial') THEN 'pending' ELSE 'raw_missing' END AS status FROM c""")
def coverage_states(spark, sf):
    """How far each phase of every target is."""
    rows = {name: spark.sql(f"WITH {_COVER} SELECT * FROM {name}".replace("FROM part", "FROM {part}").replace("FROM lineitem", "FROM {lineitem}"), part=table(spark, sf, "part"), lineitem=table(spark, sf, "lineitem")) for name in ("t", "k", "r")}
    return auctions.coverage_status(rows["t"], rows["r"], rows["k"].where("has_raw"), rows["k"].where("state is not null"))


@query("title_clusters", f"""
    {WITH}, k AS (SELECT listing_id, match_tier, CASE WHEN match_tier <> 'review' OR card_id % 2 = 0 THEN card_id END AS card_id, variant_id, score, regexp_replace(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_'), '_[0-9a-f]{{4,}}$', ''), '_[0-9]+', '', 'g') AS key FROM listings),
    b AS (SELECT key, card_id AS best_card, variant_id AS best_variant, score AS best_score FROM k WHERE card_id IS NOT NULL AND len(key) >= 12 QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(score, 0) DESC, listing_id) = 1)
    SELECT listing_id, CASE WHEN match_tier = 'review' AND card_id IS NULL AND best_card IS NOT NULL THEN 'flagged' ELSE match_tier END AS match_tier, CASE WHEN match_tier = 'review' AND card_id IS NULL AND best_card IS NOT NULL THEN best_card ELSE card_id END AS card_id,
        CASE WHEN match_tier = 'review' AND card_id IS NULL AND best_card IS NOT NULL THEN least(1.0, best_score) ELSE score END AS score FROM k LEFT JOIN b ON b.key = k.key""")
def title_clusters(spark, sf):
    """Listings in review inherit from the best one with the same title but for numbers."""
    v = views(spark, sf)["listings"]
    rows = v.withColumn("card_id", F.when((F.col("match_tier") != "review") | (F.col("card_id") % 2 == 0), F.col("card_id"))).withColumn("title_key", matching.normalize_part(F.col("title")))
    return matching.propagate_clusters(rows).select("listing_id", "match_tier", "card_id", "score")


@query("match_overrides", f"""
    {WITH} SELECT listing_id, CASE WHEN listing_id % 23 = 0 THEN 1 WHEN c.cert IS NOT NULL THEN c.card ELSE e.card_id END AS card_id, CASE WHEN listing_id % 23 = 0 OR c.cert IS NOT NULL THEN 'exact' ELSE match_tier END AS match_tier,
        CASE WHEN listing_id % 23 = 0 THEN 'manual' WHEN c.cert IS NOT NULL THEN 'matched' ELSE match_status END AS match_status, flagged AND NOT (listing_id % 23 = 0 OR c.cert IS NOT NULL) AS flagged
    FROM listings e LEFT JOIN (SELECT concat('C', p_partkey) AS cert, p_partkey AS card FROM part WHERE p_partkey < 50) c ON c.cert = e.cert""")
def match_overrides(spark, sf):
    """A certificate proves a match, a person's decision wins over it."""
    v = views(spark, sf)
    certs = v["cards"].where("card_id < 50").select(F.concat(F.lit("C"), "card_id").alias("cert"), "card_id", (F.col("card_id") * 4).alias("variant_id"))
    manual = v["listings"].where("listing_id % 23 = 0").select("listing_id", F.lit(1).cast("long").alias("card_id"), F.lit(4).cast("long").alias("variant_id"))
    return matching.override(v["listings"], certs, manual).select("listing_id", "card_id", "match_tier", "match_status", "flagged")


@query("minted_specs", f"""
    {WITH}, f AS (SELECT cert, variant_id FROM listings WHERE cert IS NOT NULL AND variant_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cert ORDER BY listing_id) = 1), n AS (SELECT concat('C', p_partkey) AS cert, CASE WHEN p_partkey % 2 = 0 THEN concat('P', p_partkey) ELSE concat('N', p_partkey % 30) END AS spec_id FROM part)
    SELECT 'population' AS namespace, spec_id, min(variant_id) AS variant_id, 'certificate' AS match_method FROM f JOIN n ON n.cert = f.cert WHERE NOT EXISTS (SELECT 1 FROM specs s WHERE s.spec_id = n.spec_id) GROUP BY spec_id""")
def minted_specs(spark, sf):
    """Specs that certificates name and nobody has."""
    v = views(spark, sf)
    k = F.col("card_id")
    named = v["cards"].select(F.concat(F.lit("C"), k).alias("cert"), F.when(k % 2 == 0, F.concat(F.lit("P"), k)).otherwise(F.concat(F.lit("N"), k % 30)).alias("spec_id"))
    return curation.mint_specs(v["listings"], named, v["specs"])


@query("paired_specs", "SELECT min_by(l_partkey, (l_shipdate, l_partkey)) AS spec_id, l_suppkey AS sales_spec_id FROM lineitem GROUP BY l_suppkey")
def paired_specs(spark, sf):
    """A sales spec belongs to the population spec that named it first."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("psaSpecId"), F.col("l_suppkey").alias("salesSpecId"), F.col("l_shipdate").alias("fetchedAt"))
    return curation.paired_specs(rows)


_WANTED = """own AS (SELECT *, variant_id % 5 <> 0 AS own, coalesce(micro_variant, '') AS micro, coalesce(print_run_marker, '') AS run FROM variants),
    w AS (SELECT o_orderkey AS row_id, o_custkey % 100 AS card_id, CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'holo' ELSE 'reverse' END END AS finish, CASE WHEN o_orderkey % 4 = 1 THEN 'first_edition' WHEN o_orderkey % 4 = 2 THEN 'unlimited' ELSE '' END AS run,
        CASE WHEN o_orderkey % 5 = 1 THEN 'full_art' ELSE '' END AS micro FROM orders)"""
_STAGE = "{a} AS (SELECT *, bool_or({fit}) OVER (PARTITION BY row_id) AS met FROM {b}), {c} AS (SELECT * EXCLUDE (met) FROM {a} WHERE ({fit}) OR NOT met)"


def _wanted(spark, sf):
    k = F.col("o_orderkey")
    finish = F.when(k % 6 == 5, "").when(k % 3 == 0, "Normal").when(k % 3 == 1, "holo").otherwise("reverse")
    wanted = table(spark, sf, "orders").select(k.alias("row_id"), (F.col("o_custkey") % 100).alias("card_id"), finish.alias("finish"), F.when(k % 4 == 1, "First Edition").when(k % 4 == 2, "unlimited").alias("print_run_marker"), F.when(k % 5 == 1, "German-Full Art").when(k % 5 == 2, "Japanese").alias("micro_variant"))
    return wanted, views(spark, sf)["variants"].withColumn("source", F.when(F.col("variant_id") % 5 == 0, "report").when(F.col("variant_id") % 5 == 1, curation.CATALOGUE))


@query("strict_variants", f"""
    {WITH}, {_WANTED}, p AS (SELECT w.row_id, w.run AS wish, o.variant_id, o.own, o.run FROM w JOIN own o ON o.card_id = w.card_id AND o.micro = w.micro AND (w.finish = '' OR o.finish = w.finish)),
    {_STAGE.format(a="p1", b="p", c="p2", fit="own")}, {_STAGE.format(a="p3", b="p2", c="p4", fit="wish <> '' AND run = wish")}
    SELECT w.row_id, CASE WHEN count(p4.row_id) = 1 THEN min(variant_id) END AS variant_id FROM w LEFT JOIN p4 ON p4.row_id = w.row_id GROUP BY w.row_id""")
def strict_variants(spark, sf):
    """The variant that a row describes exactly: small variant and finish must be as wanted, the catalogue's go first, the print run decides between those still tied."""
    return curation.resolve_variants(*_wanted(spark, sf), exact=True)


@query("lenient_variants", f"""
    {WITH}, {_WANTED}, p AS (SELECT w.row_id, w.finish AS f, w.run AS r, CASE WHEN w.row_id % 5 = 1 THEN 'german_full_art' WHEN w.row_id % 5 = 2 THEN 'japanese' ELSE '' END AS m, o.variant_id, o.finish, o.run, o.micro FROM w JOIN own o ON o.card_id = w.card_id AND o.own),
    {_STAGE.format(a="p1", b="p", c="p2", fit="f <> '' AND finish = f")}, {_STAGE.format(a="p3", b="p2", c="p4", fit="r <> '' AND run = r")}, {_STAGE.format(a="p5", b="p4", c="p6", fit="m <> '' AND micro = m")}
    SELECT w.row_id, CASE WHEN count(p6.row_id) = 1 THEN min(variant_id) END AS variant_id FROM w LEFT JOIN p6 ON p6.row_id = w.row_id GROUP BY w.row_id""")
def lenient_variants(spark, sf):
    """The catalogue's variant that is left when wishes that somebody meets narrow."""
    return curation.resolve_variants(*_wanted(spark, sf))


@query("report_rows", f"""
    {WITH}, r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, concat('S', min(l_suppkey) % 9) AS source_set_id, CASE l_linenumber WHEN 1 THEN 'de' WHEN 2 THEN NULL ELSE 'en' END AS language, CAST(min(l_partkey) % 12 AS STRING) AS number FROM lineitem GROUP BY l_orderkey, l_linenumber),
    m AS (SELECT DISTINCT r.row_id, c.card_id FROM r JOIN sets s ON s.source_set_id = r.source_set_id AND s.language = r.language JOIN cards c ON c.set_id = s.set_id AND c.local_id = r.number)
    SELECT DISTINCT row_id, CASE WHEN r.language IS NULL THEN 'skipped' WHEN m.card_id IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS match_status, m.card_id FROM r LEFT JOIN m USING (row_id)""")
def report_rows(spark, sf):
    """Report rows to cards by number within their set and language."""
    v = views(spark, sf)
    line = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey")).select(
        (F.col("l_orderkey") * 10 + line).alias("row_id"), F.concat(F.lit("S"), F.col("l_suppkey") % 9).alias("source_set_id"), F.lit("en").alias("language"), F.lit("Pikachu-Holo").alias("subject"),
        F.when(line == 1, "German-Secret").when(line == 2, "French").alias("variety"), F.lpad((F.col("l_partkey") % 12).cast("string"), 3, "0").alias("number"))
    return matching.match_report_rows(rows, v["cards"], v["sets"]).select("row_id", "match_status", "card_id")


@query("heading_sets", f"""
    {WITH}, h AS (SELECT n_nationkey AS heading_id, CASE WHEN n_nationkey % 3 = 1 THEN concat('Pokemon German S', CAST((n_nationkey - n_nationkey % 3) / 3 AS INT), '-Any Name') ELSE concat('Pokemon Cards ', n_name) END AS name FROM nation)
    SELECT CAST(heading_id AS BIGINT) AS heading_id, CASE WHEN name LIKE '%German%' THEN (SELECT set_id FROM sets WHERE set_id = heading_id AND language = 'de') WHEN heading_id % 3 = 0 THEN heading_id END AS set_id, CASE WHEN heading_id % 3 = 2 THEN 'ambiguous' ELSE 'matched' END AS match_status,
        CASE WHEN name LIKE '%German%' THEN 'heading-set-code' WHEN heading_id % 3 = 0 THEN 'token-overlap' END AS method, CASE heading_id % 3 WHEN 0 THEN CASE WHEN series = sets.name THEN 0.7 ELSE 1.0 END WHEN 2 THEN round(0.65 / 2 + 0.35 / 3, 6) END::DOUBLE AS score FROM h JOIN sets ON sets.set_id = h.heading_id""".replace("name LIKE", "h.name LIKE"))
def heading_sets(spark, sf):
    """Report headings to sets by code or by name; a set that is called as its series counts less."""
    v = views(spark, sf)
    n = F.col("n_nationkey")
    name = F.when(n % 3 == 1, F.concat(F.lit("Pokemon German S"), ((n - n % 3) / 3).cast("int"), F.lit("-Any Name"))).otherwise(F.concat(F.lit("Pokemon Cards "), "n_name"))
    return matching.match_headings(table(spark, sf, "nation").select(n.cast("long").alias("heading_id"), name.alias("name")), v["sets"]).withColumn("score", F.round("score", 6))


@query("learned_aliases", f"""
    {WITH} SELECT DISTINCT trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_') AS alias_text, s.language, s.source_set_id, 'learned' AS origin FROM orders JOIN cards c ON c.card_id = o_custkey % 100 JOIN sets s ON s.set_id = c.set_id WHERE o_orderkey % 10 = 0 AND NOT (o_orderpriority = '1-URGENT' AND s.language = 'en')""")
def learned_aliases(spark, sf):
    """Set texts of listings that people decided become aliases."""
    v = views(spark, sf)
    orders = table(spark, sf, "orders")
    manual = orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("listing_id"), (F.col("o_custkey") % 100).alias("card_id"))
    evidence = orders.select(F.col("o_orderkey").alias("listing_id"), F.array(matching.normalize_part(F.col("o_orderpriority"))).alias("set_keys"))
    known = v["sets"].where("language = 'en'").select(F.lit("1_urgent").alias("alias_text"), "language", "source_set_id")
    return matching.set_aliases(manual, evidence, v["cards"], v["sets"], known)


@query("stale_variants", f"{WITH} SELECT variant_id, card_id FROM variants WHERE NOT (card_id % 2 = 0 AND variant_id % 4 <> 0)")
def stale_variants(spark, sf):
    """Variants of touched cards that the new catalogue lacks go."""
    v = views(spark, sf)["variants"].select("variant_id", "card_id")
    return merge.drop_stale(v, v.where("card_id % 2 = 0 and variant_id % 4 = 0"), ["variant_id"], ["card_id"])


@query("primary_pictures", f"{WITH} SELECT variant_id, card_id, row_number() OVER (PARTITION BY card_id ORDER BY variant_id DESC) = 1 AS is_primary FROM variants")
def primary_pictures(spark, sf):
    """One primary row of each card."""
    return merge.single_primary(views(spark, sf)["variants"].select("variant_id", "card_id"), ["card_id"], [F.desc("variant_id")])


@query("appended_revisions", f"{WITH} SELECT hash, source, min(observation_id) AS observation_id FROM observations WHERE observation_id >= 500 AND hash NOT IN (SELECT hash FROM observations WHERE observation_id < 500 AND hash < 'h2') GROUP BY hash, source")
def appended_revisions(spark, sf):
    """New revisions of what the history has not."""
    v = views(spark, sf)["observations"].select("hash", "source", "observation_id")
    old = v.where("observation_id < 500 and hash < 'h2'").select("hash").distinct()
    sources = v.where("observation_id >= 500").join(old, "hash", "left_anti")
    return merge.insert_or_ignore(sources.limit(0), sources, ["hash", "source"], [F.asc("observation_id")])


@query("known_pages", f"""
    {WITH}, p AS (SELECT user_id, CAST((event_id - event_id % 40) / 40 AS BIGINT) AS page, bool_and(event_id % 7 < 5 OR event_id >= 160) AS all_known FROM events GROUP BY 1, 2), r AS (SELECT *, all_known AND coalesce(lag(all_known) OVER (PARTITION BY user_id ORDER BY page), false) AS done FROM p)
    SELECT user_id, page, all_known FROM r WHERE page <= coalesce((SELECT min(page) FROM r s WHERE s.user_id = r.user_id AND done), 1000000000)""")
def known_pages(spark, sf):
    """Pages of each history up to the second known one in a row."""
    rows = table(spark, sf, "events").select("user_id", ((F.col("event_id") - F.col("event_id") % 40) / 40).cast("long").alias("page"), "event_id")
    return ledger.known_pages(rows, rows.where("event_id % 7 < 5 or event_id >= 160").select("event_id"), "event_id", ["user_id"])


@query("dead_letters", """
    WITH old AS (SELECT DISTINCT user_id AS work_item_id FROM events WHERE event_type = 'signup'), f AS (SELECT user_id AS work_item_id, max(ts) AS failed_at FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT coalesce(f.work_item_id, old.work_item_id) AS work_item_id, failed_at, CASE WHEN f.work_item_id IS NOT NULL THEN 'open' ELSE 'resolved' END AS status FROM old FULL JOIN f ON f.work_item_id = old.work_item_id""")
def dead_letters(spark, sf):
    """Failures once for each item; one that fails again is open again."""
    events = table(spark, sf, "events")
    old = events.where("event_type = 'signup'").select(F.col("user_id").alias("work_item_id"), F.lit(None).cast("timestamp_ntz").alias("failed_at"), F.lit("x").alias("error"), F.lit("resolved").alias("status")).distinct()
    failed = events.where("event_type = 'error'").select(F.col("user_id").alias("work_item_id"), F.col("ts").alias("failed_at"), F.lit("e").alias("error"))
    return ledger.dead_letters(old, failed).select("work_item_id", "failed_at", "status")


@query("incremental_state", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def incremental_state(spark, sf):
    """The state after a batch of changes equals a full rebuild."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    before = ledger.rebuild_latest(rows.where("event_id < 700"), rows.where("event_id < 700"), None, ["user_id"], "event_id")
    return ledger.rebuild_latest(rows, rows.where("event_id >= 700"), before, ["user_id"], "event_id").select("user_id", "event_id", "value")


@query("latest_observations", f"{WITH} SELECT entity_type, scope_key, observation_id, hash FROM observations QUALIFY row_number() OVER (PARTITION BY entity_type, scope_key ORDER BY observation_id DESC) = 1")
def latest_observations(spark, sf):
    """The last arrival of each key."""
    return raw.latest_observations(views(spark, sf)["observations"]).select("entity_type", "scope_key", "observation_id", "hash")
