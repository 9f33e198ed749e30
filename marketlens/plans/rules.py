"""Driver queries of redirects, review logs, JSON rewrites and bucketed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import operations, reviews
from ..sources import buckets, raw
from ..sources.shared import shared_folder, spread
from ..sources.tables import table
from .registry import query
from .views import WITH, views

_HOPS = "SELECT CAST(c_custkey AS STRING) AS source, CAST((c_custkey * 7 + c_nationkey) % (SELECT count(*) FROM {customer}) AS STRING) AS target FROM {customer} WHERE c_custkey % 3 <> 0"


@query("redirect_chains", f"""
    WITH RECURSIVE hops AS ({_HOPS.format(customer="customer")}), walk AS (
        SELECT CAST(c_custkey AS STRING) AS title, CAST(c_custkey AS STRING) AS spot, [CAST(c_custkey AS STRING)] AS seen, 0 AS step FROM customer
        UNION ALL SELECT w.title, h.target, list_append(w.seen, h.target), step + 1 FROM walk w JOIN hops h ON h.source = w.spot WHERE NOT list_contains(w.seen[:step], w.spot))
    SELECT title, arg_max(spot, step) AS canonical, max(step) AS hops, array_to_string(arg_max(seen, step), '>') AS chain FROM walk GROUP BY title""")
def redirect_chains(spark, sf):
    """Chains of redirects between customers, some of them cycles."""
    customer = table(spark, sf, "customer")
    found = raw.redirect_chains(customer.select(F.col("c_custkey").cast("string").alias("title")), spark.sql(_HOPS, customer=customer))
    return found.select("title", "canonical", "hops", F.array_join("chain", ">").alias("chain"))


_ACTIONS = """SELECT event_id AS action_id, user_id AS record_id, CASE event_type WHEN 'click' THEN 'resolve' WHEN 'purchase' THEN 'dismiss' WHEN 'error' THEN 'revoke' WHEN 'signup' THEN 'resolve' ELSE 'look' END AS action,
    CASE WHEN event_type IN ('click', 'signup') AND event_id % 13 <> 0 THEN event_id % 900 END AS variant_id, CASE WHEN event_id % 17 <> 0 THEN concat('r', event_id % 4) ELSE ' ' END AS reviewer, 'seen' AS note, ts AS acted_at FROM {events}"""
_REVIEWS = "SELECT user_id AS record_id, 'review' AS tier, min(ts) AS opened_at FROM {events} WHERE user_id % 6 <> 0 GROUP BY user_id"
_GOOD = f"""a AS ({_ACTIONS.format(events="events")}), r AS ({_REVIEWS.format(events="events")}),
    j AS (SELECT a.*, CASE WHEN NOT EXISTS (SELECT 1 FROM r WHERE r.record_id = a.record_id) THEN 'no such review' WHEN action = 'look' THEN 'no such action' WHEN reviewer = ' ' THEN 'no reviewer' WHEN action = 'resolve' AND NOT coalesce(variant_id > 0, FALSE) THEN 'no variant'
        WHEN action = 'resolve' AND NOT EXISTS (SELECT 1 FROM variants v WHERE v.variant_id = a.variant_id) THEN 'no such variant' END AS reason FROM a), g AS (SELECT * FROM j WHERE reason IS NULL)"""


def _log(spark, sf):
    events = table(spark, sf, "events")
    opened = spark.sql(_REVIEWS, events=events)
    return opened, *reviews.checked(spark.sql(_ACTIONS, events=events), opened, views(spark, sf)["variants"])


@query("review_states", f"""
    {WITH}, {_GOOD}, times AS (SELECT CAST(min(ts) + d * INTERVAL '6' DAY AS TIMESTAMP) AS at FROM events CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 2 UNION ALL SELECT 4) x GROUP BY d)
    SELECT r.record_id, t.at, CASE (SELECT arg_max(action, (acted_at, action_id)) FROM g WHERE g.record_id = r.record_id AND acted_at <= t.at AND action IN ('resolve', 'dismiss')) WHEN 'resolve' THEN 'resolved' WHEN 'dismiss' THEN 'dismissed' ELSE 'open' END AS status,
        (SELECT arg_max(reviewer, (acted_at, action_id)) FROM g WHERE g.record_id = r.record_id AND acted_at <= t.at AND action IN ('resolve', 'dismiss')) AS resolved_by,
        (SELECT CASE WHEN arg_max(action, (acted_at, action_id)) = 'resolve' THEN arg_max(coalesce(variant_id, -1), (acted_at, action_id)) END FROM g WHERE g.record_id = r.record_id AND acted_at <= t.at AND action IN ('resolve', 'revoke')) AS variant_id FROM r JOIN times t ON r.opened_at <= t.at""")
def review_states(spark, sf):
    """The review queue as it stood at three times, replayed from the log of actions."""
    opened, good, _ = _log(spark, sf)
    begin = table(spark, sf, "events").agg(F.min("ts").alias("begin"))
    out = None
    for days in (0, 12, 24):
        at = F.col("begin") + F.make_dt_interval(days=F.lit(days))
        timed = lambda df: df.crossJoin(F.broadcast(begin))  # noqa: E731  # one row
        one = reviews.reviews_at(timed(opened), timed(good), at).crossJoin(F.broadcast(begin)).select("record_id", at.alias("at"), "status", "resolved_by", "variant_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("review_rejections", f"{WITH}, {_GOOD} SELECT reason, count(*) AS n, min(action_id) AS first FROM j WHERE reason IS NOT NULL GROUP BY reason")
def review_rejections(spark, sf):
    """Imported actions that cannot be applied, by reason."""
    return _log(spark, sf)[2].groupBy("reason").agg(F.count("*").alias("n"), F.min("action_id").alias("first"))


@query("json_rewrites", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('c', user_id) AS campaign, event_id % 2 AS refresh, CASE WHEN user_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) + 1 END AS inner_k, 'new' AS made FROM events""")
def json_rewrites(spark, sf):
    """Work items rewritten for another campaign, at the top and deep in the text, and read again."""
    rows = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    nested = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "deep": {"k": 0, "x": [1, {"y": null}]}}'))).otherwise(F.col("props"))
    out = values.json_set(values.json_set(nested, "$.campaignId", F.concat(F.lit("c"), "user_id")), "$.refreshDetails", F.col("event_id") % 2)
    deep = lambda x: F.when(F.col("user_id") % 3 == 0, values.json_set(x, "$.deep.k", k + 1)).otherwise(x)
    out = values.json_set(text.let(out, deep), "$.a.b.c", F.lit("new"))
    got = lambda path: F.get_json_object("done", path)
    # few files hold many events
    return spread(rows).select("event_id", out.alias("done")).select("event_id", got("$.k").cast("long").alias("k"), got("$.campaignId").alias("campaign"), got("$.refreshDetails").cast("long").alias("refresh"), F.when(got("$.deep.x[1].y").isNull(), got("$.deep.k").cast("long")).alias("inner_k"), got("$.a.b.c").alias("made"))


@query("json_members", """
    WITH o AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, 'lines' AS part, CAST(generate_subscripts(lines, 1) - 1 AS INT) AS at, NULL AS key, CAST(unnest(lines) AS STRING) AS value FROM o
    UNION ALL SELECT l_orderkey, 'whole', 0, 'lines', concat('[', array_to_string(lines, ','), ']') FROM o UNION ALL SELECT l_orderkey, 'whole', 1, 'order', concat('{"id":', l_orderkey, '}') FROM o""")
def json_members(spark, sf):
    """Members of arrays and objects of texts without a schema."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_linenumber"])
    texts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.col("l_orderkey").alias("id")).alias("order"), lines.alias("lines"))).alias("x"))
    parts = [values.json_each(texts, "x", ["l_orderkey"], path).select("l_orderkey", F.lit(name).alias("part"), "at", "key", "value") for name, path in (("lines", "$.lines"), ("whole", "$"))]
    return parts[0].unionByName(parts[1])


@query("bucketed_catalogue", f"""
    {WITH} SELECT variant_id, card_id, finish FROM variants WHERE card_id % 50 <> 7 UNION ALL SELECT p_partkey * 4 + 3, p_partkey, 'etched' FROM part WHERE p_partkey % 100 = 7""")
def bucketed_catalogue(spark, sf):
    """Variants in buckets of their card; a publication that touches few cards rewrites their buckets alone."""
    variants = views(spark, sf)["variants"].select("variant_id", "card_id", "finish")
    store = buckets.BucketedTable(spark, shared_folder(spark, "catalogue"), variants.schema, "card_id", 64)
    store.replace(variants)
    touched = table(spark, sf, "part").where("p_partkey % 50 = 7").select(F.col("p_partkey").alias("card_id"))
    fresh = touched.where("card_id % 100 = 7").select((F.col("card_id") * 4 + 3).alias("variant_id"), "card_id", F.lit("etched").alias("finish"))
    store.replace(fresh, touched)
    return store.read()


_FOUND = """f_obs AS (SELECT event_id AS observation_id, event_id % 700 AS work_item_id, CASE WHEN event_id % 29 = 0 THEN 'set:1' ELSE concat('card:', event_id * 7 % 400) END AS scope_key, concat('h', event_id % 90) AS hash FROM {events} WHERE event_type <> 'view'),
    f_att AS (SELECT event_id AS attempt_id, event_id % 700 AS work_item_id, concat('h', event_id % 90) AS hash, concat('http://found/', event_id) AS url, CASE WHEN event_id % 3 = 0 THEN 'fallback' END AS match_kind FROM {events} WHERE event_type <> 'signup'),
    f_obj AS (SELECT DISTINCT concat('h', event_id % 90) AS hash, CASE WHEN event_id % 90 < 40 THEN 'image/png' ELSE 'image/webp' END AS media_type FROM {events} WHERE event_id % 90 <> 11),
    f_assets AS (SELECT p_partkey AS card_id, 'old' AS hash, concat('http://old/', p_partkey) AS url, 'wiki' AS rendition, 'image/png' AS media_type, p_partkey % 2 = 0 AS is_primary FROM {part})"""
_LINKED = f"""{_FOUND.format(events="events", part="part")},
    newest AS (SELECT *, TRY_CAST(regexp_extract(scope_key, '^card:([0-9]+)$', 1) AS BIGINT) AS card_id FROM f_obs o WHERE NOT EXISTS (SELECT 1 FROM f_obs n WHERE n.scope_key = o.scope_key AND n.observation_id > o.observation_id)),
    linked AS (SELECT n.card_id, n.hash, a.url, concat('finder:', coalesce(match_kind, 'exact')) AS rendition, media_type FROM newest n JOIN f_att a ON a.attempt_id = (SELECT max(attempt_id) FROM f_att x WHERE x.work_item_id = n.work_item_id AND x.hash = n.hash) JOIN f_obj b ON b.hash = n.hash JOIN cards c ON c.card_id = n.card_id AND c.image_url IS NULL WHERE n.card_id > 0)"""


def _linked(spark, sf):
    known = {"events": table(spark, sf, "events"), "part": table(spark, sf, "part")}
    rows = {name: spark.sql(f"WITH {_FOUND} SELECT * FROM {name}", **known) for name in ("f_obs", "f_att", "f_obj", "f_assets")}
    return operations.link_assets(views(spark, sf)["cards"], rows["f_assets"], rows["f_obs"], rows["f_att"], rows["f_obj"], "finder")


@query("linked_assets", f"""
    {WITH}, {_LINKED} SELECT a.card_id, a.hash, a.url, a.rendition, a.media_type, a.is_primary AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.card_id = a.card_id AND l.url <> a.url) AS is_primary FROM f_assets a UNION ALL SELECT *, TRUE FROM linked""")
def linked_assets(spark, sf):
    """Assets of cards after a source's pictures are linked: one primary for each card that took one."""
    return _linked(spark, sf)[1]


@query("linked_cards", f"{WITH}, {_LINKED} SELECT c.card_id, coalesce(c.image_url, l.url) AS image_url FROM cards c LEFT JOIN linked l ON l.card_id = c.card_id")
def linked_cards(spark, sf):
    """Cards with the pictures that they took."""
    return _linked(spark, sf)[0].select("card_id", "image_url")


@query("work_transitions", f"""
    {WITH}, w AS (SELECT work_item_id, queue, CASE WHEN queue IN ('q1', 'q2') AND state NOT IN ('succeeded') THEN 'cancelled' ELSE state END AS state, priority FROM work)
    SELECT work_item_id, queue, CASE WHEN queue = 'q2' AND state = 'cancelled' THEN 'pending' ELSE state END AS state, CASE WHEN queue = 'q2' AND state = 'cancelled' THEN 0 ELSE priority END AS priority FROM w""")
def work_transitions(spark, sf):
    """Work of two queues is cancelled, then one of them is resumed with its attempts set back."""
    work = views(spark, sf)["work"].select("work_item_id", "queue", "state", "priority")
    return operations.resume(operations.cancel(work, F.col("queue").isin("q1", "q2")), F.col("queue") == "q2", priority=0)
