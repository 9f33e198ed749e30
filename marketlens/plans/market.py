"""Driver queries of search, figures and auctions: the library's operators on the views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import auctions, metrics, search
from ..operators.predicates import page
from .registry import query
from .views import NOW, WITH, now, views

_BASE = """base AS (SELECT c.card_id, c.set_id, c.local_id, c.name, c.category, c.rarity, c.detail_status, c.image_url, s.language, s.source_set_id, s.name AS set_name, s.series, s.release_date,
    CASE WHEN detail_status = 'hydrated' THEN coalesce(n, 0) END AS variant_count FROM cards c JOIN sets s ON s.set_id = c.set_id LEFT JOIN (SELECT card_id, count(*) AS n FROM variants GROUP BY card_id) v ON v.card_id = c.card_id)"""

_EXPANDED = """SELECT * FROM (SELECT sv.variant_id, ps.spec_pk, ps.fetched_at, CASE WHEN sv.variant_id = ps.variant_id THEN 0 WHEN coalesce(sv.finish, '') = coalesce(ps.finish, '') AND coalesce(sv.micro_variant, '') = coalesce(ps.micro_variant, '') THEN 1 ELSE 2 END AS affinity,
    EXISTS (SELECT 1 FROM {rows} r WHERE r.spec_pk = ps.spec_pk) AS has_rows FROM specs ps JOIN variants pv ON pv.variant_id = ps.variant_id JOIN variants sv ON sv.card_id = pv.card_id WHERE ps.namespace = '{namespace}' AND ps.match_status IN ('matched', 'manual'))
    QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY affinity, has_rows DESC, fetched_at DESC, spec_pk DESC) = 1"""

_METRICS = f"""lp AS ({_EXPANDED.format(rows="population", namespace="population")}), ls AS ({_EXPANDED.format(rows="sales", namespace="sales")}),
    pop AS (SELECT lp.variant_id, max(total_population) AS total, sum(CASE WHEN grade_value = 10 AND NOT qualified THEN population_count ELSE 0 END) AS tens FROM lp JOIN population p ON p.spec_pk = lp.spec_pk GROUP BY lp.variant_id),
    guide AS (SELECT lp.variant_id, psa_price AS guide_price, average_price FROM lp JOIN prices p ON p.spec_pk = lp.spec_pk WHERE grade_key = '10'),
    sold AS (SELECT ls.variant_id, sale_price, sale_date, row_number() OVER (PARTITION BY ls.variant_id ORDER BY sale_date DESC, sale_item_id DESC) AS rn, count(*) OVER (PARTITION BY ls.variant_id) AS sale_count,
        sum(CASE WHEN grade_value = 10 AND sale_date >= DATE '2001-06-01' - 365 THEN 1 ELSE 0 END) OVER (PARTITION BY ls.variant_id) AS sales_12m FROM ls JOIN sales s ON s.spec_pk = ls.spec_pk),
    metrics AS (SELECT v.variant_id, CAST(coalesce(tens, 0) AS BIGINT) AS population10, CAST(coalesce(total, 0) AS BIGINT) AS total_population, CASE WHEN total > 0 THEN 100.0 * tens / total END AS gem_rate, guide_price, average_price, sale_price AS latest_sale_price, sale_date AS latest_sale_date,
        coalesce(sale_count, 0) AS sale_count, CAST(coalesce(sales_12m, 0) AS BIGINT) AS sales_12m, lp.variant_id IS NOT NULL AS population_available, ls.variant_id IS NOT NULL AS sales_available
        FROM variants v LEFT JOIN pop ON pop.variant_id = v.variant_id LEFT JOIN guide ON guide.variant_id = v.variant_id LEFT JOIN sold ON sold.variant_id = v.variant_id AND rn = 1 LEFT JOIN lp ON lp.variant_id = v.variant_id LEFT JOIN ls ON ls.variant_id = v.variant_id)"""

_LATEST = "latest AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY observed_at DESC, observation_id DESC) = 1)"
_TRUSTED = "match_status IN ('matched', 'manual') AND match_tier IN ('exact', 'strong') AND NOT flagged AND (match_method IS NULL OR match_method <> 'cluster-propagate')"
_HOURS = 30 * 24
_LIVE = f"""{_LATEST}, live AS (SELECT e.listing_id, e.variant_id, e.title, coalesce(current_bid, price) AS bid, currency, bid_count, item_end_date, observed_at, guide_price,
        CASE currency WHEN 'USD' THEN guide_price WHEN 'EUR' THEN guide_price / 0.5 END AS comparable, guide_price / 0.5 AS guide_euros
        FROM listings e JOIN latest l ON l.listing_id = e.listing_id LEFT JOIN metrics m ON m.variant_id = e.variant_id
        WHERE e.variant_id IS NOT NULL AND grade = 10 AND NOT is_lot AND {_TRUSTED} AND options LIKE '%AUCTION%' AND bid_count >= 1 AND item_end_date > TIMESTAMP '{NOW}' AND item_end_date <= TIMESTAMP '{NOW}' + INTERVAL {_HOURS} HOUR),
    auctions AS (SELECT *, CASE WHEN comparable > 0 THEN (comparable - bid) / comparable * 100 END AS discount FROM live)"""
_LISTED = "SELECT a.listing_id, b.name, b.local_id, b.set_name, b.source_set_id, b.language, a.title, bid, currency, guide_price, guide_euros, discount, item_end_date FROM auctions a JOIN variants v ON v.variant_id = a.variant_id JOIN base b ON b.card_id = v.card_id"


def _base(v):
    return search.card_base(v["cards"], v["sets"], v["variants"])


def _figures(v):
    return metrics.variant_metrics(v["variants"], v["specs"], v["population"], v["prices"], v["sales"], now())


def _live(v):
    return auctions.live_auctions(v["listings"], v["history"], _figures(v), v["rates"], now(), hours=_HOURS)


_CARD = ["card_id", "name", "set_name", "language", "local_id", "rarity", "variant_count"]


@query("card_search", f"""
    {WITH}, {_BASE}, found AS (SELECT * FROM base WHERE (name ILIKE '%a%' OR set_name ILIKE '%a%' OR local_id ILIKE '%a%') AND language = 'en'), n AS (SELECT count(*) AS total FROM found)
    SELECT {", ".join(_CARD)}, total FROM found, n ORDER BY lower(name) NULLS LAST, lpad(local_id, 12, '0'), card_id LIMIT 24 OFFSET 24""")
def card_search(spark, sf):
    """One page of cards by text and language with the total."""
    found, total = search.card_search(_base(views(spark, sf)), {"q": "a", "language": "en"}, "name_asc", 2)
    return found.select(*_CARD, F.lit(total).cast("long").alias("total"))


@query("variant_search", f"""
    {WITH}, {_BASE}, {_METRICS} SELECT v.variant_id, v.finish, b.name, b.set_name, population10, guide_price FROM variants v JOIN base b ON b.card_id = v.card_id LEFT JOIN metrics m ON m.variant_id = v.variant_id
    WHERE population10 >= 1 AND guide_price <= 90000 ORDER BY population10 DESC NULLS LAST, lpad(b.local_id, 12, '0'), v.variant_id LIMIT 60""")
def variant_search(spark, sf):
    """Variants by ranges of their figures, sorted by one with nulls last."""
    v = views(spark, sf)
    found, _ = search.variant_search(_base(v), v["variants"], _figures(v), {}, {"population10": (1, None), "guide_price": (None, 90000)}, "population10_desc", 1, 60)
    return found.select("variant_id", "finish", "name", "set_name", "population10", "guide_price")


@query("card_printings", f"""
    {WITH}, {_BASE} SELECT a.card_id, b.card_id AS other, b.language AS other_language FROM base a JOIN base b ON b.source_set_id = a.source_set_id AND b.local_id = a.local_id AND b.card_id <> a.card_id""")
def card_printings(spark, sf):
    """The same number of the same set in other languages."""
    return search.also_printed(_base(views(spark, sf)))


@query("card_page", f"""
    {WITH}, {_BASE} SELECT card_id, name, set_name, variant_count, (SELECT count(*) FROM variants v WHERE v.card_id = base.card_id) AS variants,
        (SELECT count(*) FROM base o WHERE o.source_set_id = base.source_set_id AND o.local_id = base.local_id AND o.card_id <> base.card_id) AS printings FROM base WHERE card_id = 7""")
def card_page(spark, sf):
    """One card with its variants and printings."""
    v = views(spark, sf)
    found = search.card_detail(_base(v), v["variants"], 7)
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return found.select("card_id", "name", "set_name", "variant_count", n("variants").alias("variants"), n("also_printed").alias("printings"))


@query("variant_pages", f"""
    {WITH}, {_BASE}, {_METRICS}, links AS (SELECT spec_pk AS source_record_id, 'variant' AS target_type, variant_id AS target_id, match_status, spec_id FROM specs)
    SELECT v.variant_id, b.name, coalesce(nullif(concat_ws(' · ', CASE print_run_marker WHEN 'unlimited' THEN 'Unlimited' WHEN 'first_edition' THEN '1st Edition' END, upper(finish[1]) || finish[2:], CASE WHEN micro_variant = 'full_art' THEN 'Full Art' END, CASE WHEN size = 'jumbo' THEN 'Jumbo' END,
        CASE stamp_list WHEN 'staff' THEN 'Staff' WHEN 'set_logo,staff' THEN 'Set Logo · Staff' END), ''), 'Standard') AS label, sale_count, (SELECT count(*) FROM links WHERE target_id = v.variant_id AND match_status IN ('matched', 'manual')) AS matched_sources,
        (SELECT min(spec_id) FROM links WHERE target_id = v.variant_id) AS first_reference FROM variants v JOIN base b ON b.card_id = v.card_id LEFT JOIN metrics m ON m.variant_id = v.variant_id""")
def variant_pages(spark, sf):
    """Variants with label, figures and references of their type."""
    v = views(spark, sf)
    links = v["specs"].select(F.col("spec_pk").alias("source_record_id"), F.lit("variant").alias("target_type"), F.col("variant_id").alias("target_id"), "match_status")
    links = links.unionByName(links.withColumn("target_type", F.lit("card")))
    records = v["specs"].select(F.col("spec_pk").alias("source_record_id"), F.lit("psa").alias("source"), F.lit("all").alias("namespace"), F.col("spec_id").alias("source_key"))
    assets = v["cards"].select(F.lit("card").alias("target_type"), F.col("card_id").alias("target_id"))
    found = search.variant_detail(v["variants"], _base(v), _figures(v), links, records, assets)
    return found.select("variant_id", "name", "label", "sale_count", "matched_sources", F.array_min(F.transform("references", lambda r: r["source_key"])).alias("first_reference"))


@query("missing_images", f"{WITH}, {_BASE} SELECT card_id, source_set_id FROM base WHERE language = 'ja' AND detail_status = 'hydrated' AND image_url IS NULL AND source_set_id IN ('S1', 'S2', 'S3')")
def missing_images(spark, sf):
    """Complete Japanese cards of some sets without a picture."""
    from ..operators.predicates import missing_image

    return _base(views(spark, sf)).where(missing_image(["S1", "S2", "S3"])).select("card_id", "source_set_id")


@query("variant_figures", f"{WITH}, {_METRICS} SELECT * FROM metrics")
def variant_figures(spark, sf):
    """Population, guide, sales and availability of every variant through its nearest specs."""
    return _figures(views(spark, sf))


_OWN = """SELECT ps.variant_id, ps.spec_pk FROM specs ps WHERE ps.namespace = '{0}' AND ps.match_status IN ('matched', 'manual') QUALIFY row_number() OVER (PARTITION BY ps.variant_id ORDER BY {1} fetched_at DESC, spec_pk DESC) = 1"""
_OWNS = f"op AS ({_OWN.format('population', '')}), os AS ({_OWN.format('sales', 'EXISTS (SELECT 1 FROM sales s WHERE s.spec_pk = ps.spec_pk) DESC,')})"


@query("market_summary", f"""
    {WITH}, {_OWNS}, sold AS (SELECT os.variant_id, count(*) AS n, min(sale_date) AS first_sale, max(sale_date) AS last_sale, count(*) FILTER (WHERE sale_date >= DATE '2001-06-01' - 365) AS recent FROM os JOIN sales s ON s.spec_pk = os.spec_pk WHERE grade_value = 10 GROUP BY os.variant_id),
    tens AS (SELECT spec_pk, sum(CASE WHEN NOT qualified THEN population_count ELSE 0 END) AS n, max(total_population) AS total FROM population WHERE grade_value = 10 GROUP BY spec_pk)
    SELECT coalesce(op.variant_id, os.variant_id) AS variant_id, op.variant_id IS NOT NULL AS population_available, g.spec_pk IS NOT NULL AS guide_available, os.variant_id IS NOT NULL AS sales_available, psa_price AS guide_price, average_price, CAST(coalesce(tens.n, 0) AS BIGINT) AS population10,
        CAST(coalesce(total, 0) AS BIGINT) AS total_population, CASE WHEN total > 0 THEN 100.0 * tens.n / total END AS gem_rate, coalesce(recent, 0) AS sales_12m, coalesce(sold.n, 0) AS sales, first_sale, last_sale
    FROM op FULL JOIN os ON os.variant_id = op.variant_id LEFT JOIN prices g ON g.spec_pk = op.spec_pk AND g.grade_key = '10' LEFT JOIN tens ON tens.spec_pk = op.spec_pk LEFT JOIN sold ON sold.variant_id = os.variant_id""")
def market_summary(spark, sf):
    """Every variant's market page but its lists (M5)."""
    v = views(spark, sf)
    return metrics.market(v["specs"], v["population"], v["prices"], v["sales"], now())[0]


@query("market_months", f"""
    {WITH}, {_OWNS} SELECT os.variant_id, strftime(sale_date, '%Y-%m') AS month, median(sale_price) AS median_price, count(*) AS sales FROM os JOIN sales s ON s.spec_pk = os.spec_pk WHERE grade_value = 10 AND sale_date IS NOT NULL AND sale_price IS NOT NULL GROUP BY 1, 2""")
def market_months(spark, sf):
    """Median price and sales by month of grade ten."""
    v = views(spark, sf)
    return metrics.market(v["specs"], v["population"], v["prices"], v["sales"], now())[2]


@query("population_ladder", f"""
    {WITH}, {_OWNS}, r AS (SELECT op.variant_id, p.spec_pk, p.grade_key, max(grade_value) AS grade_value, CAST(sum(CASE WHEN NOT qualified THEN population_count ELSE 0 END) AS BIGINT) AS population, CAST(sum(CASE WHEN qualified THEN population_count ELSE 0 END) AS BIGINT) AS qualified,
        max(half_grade_count) AS half_grades, max(total_population) AS total_population FROM op JOIN population p ON p.spec_pk = op.spec_pk AND p.grade_key <> '5' GROUP BY op.variant_id, p.spec_pk, p.grade_key), g AS (SELECT spec_pk, grade_key, most_recent_price, average_price, psa_price FROM prices)
    SELECT op.variant_id, op.spec_pk, x.* EXCLUDE (spec_pk) FROM op JOIN (SELECT spec_pk, grade_key, grade_value, population, qualified, half_grades, total_population, most_recent_price, average_price, psa_price FROM (SELECT * EXCLUDE (variant_id) FROM r) FULL JOIN g USING (spec_pk, grade_key)) x ON x.spec_pk = op.spec_pk""")
def population_ladder(spark, sf):
    """Grades with plain, qualified and half counts and prices; of grade five, say, prices alone are known."""
    v = views(spark, sf)
    return metrics.population_ladder(v["specs"], v["population"].where("grade_key <> '5'"), v["prices"])


@query("price_comparison", f"""
    {WITH}, {_LATEST} SELECT v.variant_id, c.card_id, c.name AS card_name, s.set_id, s.name AS set_name, s.language,
        (SELECT psa_price FROM prices p JOIN specs ps ON ps.spec_pk = p.spec_pk WHERE ps.variant_id = v.variant_id AND grade_key = '10' ORDER BY p.observed_at DESC, p.spec_pk DESC LIMIT 1) AS guide_price,
        (SELECT population_count FROM population p JOIN specs ps ON ps.spec_pk = p.spec_pk WHERE ps.variant_id = v.variant_id AND grade_value = 10 AND NOT qualified ORDER BY p.observed_at DESC, p.spec_pk DESC LIMIT 1) AS population10,
        count(e.listing_id) AS listings, min(l.price) AS least, round(avg(l.price), 8) AS mean, max(l.price) AS most, max(l.observed_at) AS last_observed
    FROM variants v JOIN cards c ON c.card_id = v.card_id JOIN sets s ON s.set_id = c.set_id LEFT JOIN listings e ON e.variant_id = v.variant_id AND e.grade = 10 AND e.match_status IN ('matched', 'manual') AND NOT e.is_lot LEFT JOIN latest l ON l.listing_id = e.listing_id
    GROUP BY v.variant_id, c.card_id, c.name, s.set_id, s.name, s.language""")
def price_comparison(spark, sf):
    """Asking prices against guide price and population for every variant."""
    v = views(spark, sf)
    return metrics.price_comparison(v["variants"], v["cards"], v["sets"], v["listings"], v["history"], v["prices"], v["population"], v["specs"]).withColumn("mean", F.round("mean", 8))


@query("live_auctions", f"{WITH}, {_METRICS}, {_LIVE} SELECT listing_id, bid, currency, bid_count, item_end_date, guide_price, comparable, guide_euros, discount, observed_at < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR AS stale FROM auctions")
def live_auctions(spark, sf):
    """Live auctions with bid, guide in both currencies and discount."""
    return _live(views(spark, sf)).select("listing_id", "bid", "currency", "bid_count", "item_end_date", "guide_price", "comparable", "guide_euros", "discount", "stale")


@query("auction_list", f"""
    {WITH}, {_BASE}, {_METRICS}, {_LIVE}, listed AS ({_LISTED}) SELECT listing_id, name, set_name, language, bid, discount FROM listed
    WHERE (title ILIKE '%o%' OR name ILIKE '%o%' OR set_name ILIKE '%o%' OR local_id ILIKE '%o%') AND item_end_date <= TIMESTAMP '{NOW}' + INTERVAL 72 HOUR AND bid >= 100 AND language IN ('en') ORDER BY discount DESC NULLS LAST, item_end_date, listing_id""")
def auction_list(spark, sf):
    """The auction list's text, language, bid and time filters in its default order."""
    v = views(spark, sf)
    every = auctions.with_catalogue(_live(v), v["variants"], _base(v))
    return auctions.filtered(every, now(), q="o", bids=(100, None), language="en").select("listing_id", "name", "set_name", "language", "bid", "discount")


@query("auction_orders", f"""
    {WITH}, {_METRICS}, {_LIVE}, soon AS (SELECT * FROM auctions WHERE item_end_date <= TIMESTAMP '{NOW}' + INTERVAL 72 HOUR)
    SELECT sort, listing_id, place FROM (SELECT 'bid_asc' AS sort, listing_id, row_number() OVER (ORDER BY bid NULLS LAST, listing_id) AS place FROM soon UNION ALL SELECT 'psa_price_desc', listing_id, row_number() OVER (ORDER BY guide_price DESC NULLS LAST, listing_id) FROM soon) WHERE place <= 60""")
def auction_orders(spark, sf):
    """The first page of two other orders."""
    every = _live(views(spark, sf))
    pages = []
    for sort in ("bid_asc", "psa_price_desc"):
        direction, column = auctions.SORTS[sort]
        first = page(auctions.filtered(every, now(), sort=sort).select("listing_id", column), 1, 60)  # at most 60 rows
        pages.append(first.select(F.lit(sort).alias("sort"), "listing_id", F.row_number().over(Window.orderBy(direction(column), "listing_id")).alias("place")))
    return pages[0].unionByName(pages[1])


@query("auction_summary", f"""
    {WITH}, {_METRICS}, {_LIVE} SELECT count(*) AS live, count(guide_price) AS with_guide, count(discount) AS comparable, round(median(discount), 6) AS median_discount, count(*) FILTER (WHERE item_end_date <= TIMESTAMP '{NOW}' + INTERVAL 24 HOUR) AS ending_24h, max(observed_at) AS last_observed FROM auctions""")
def auction_summary(spark, sf):
    """Counts and median discount of all live auctions."""
    return auctions.summary(_live(views(spark, sf)), now()).withColumn("median_discount", F.round("median_discount", 6))


@query("auction_facets", f"""
    {WITH}, {_BASE}, {_METRICS}, {_LIVE}, listed AS ({_LISTED}) SELECT DISTINCT 'language' AS facet, language AS id, language AS name, language FROM listed UNION ALL SELECT DISTINCT 'set', source_set_id, set_name, language FROM listed""")
def auction_facets(spark, sf):
    """Languages and sets of live auctions."""
    v = views(spark, sf)
    return auctions.auction_facets(auctions.with_catalogue(_live(v), v["variants"], _base(v)))


@query("auction_page", f"{WITH} SELECT observation_id, observed_at, price, bid_count FROM history WHERE listing_id = 5 ORDER BY observed_at, observation_id")
def auction_page(spark, sf):
    """One auction's prices in order."""
    return auctions.auction_history(views(spark, sf)["history"], 5).select("observation_id", "observed_at", "price", "bid_count")


_TARGETS = f"""{_LATEST}, counted AS (SELECT variant_id, count(DISTINCT e.listing_id) AS listings, min(CASE WHEN item_end_date > TIMESTAMP '{NOW}' THEN item_end_date END) AS next_end FROM listings e LEFT JOIN latest l ON l.listing_id = e.listing_id
        WHERE variant_id IS NOT NULL AND grade = 10 AND NOT is_lot AND {_TRUSTED} GROUP BY variant_id),
    newest AS (SELECT variant_id, spec_pk, spec_id FROM specs WHERE variant_id IS NOT NULL AND namespace = 'population' QUALIFY row_number() OVER (PARTITION BY variant_id ORDER BY fetched_at DESC, spec_pk DESC) = 1),
    named AS (SELECT variant_id, source_set_id, local_id, coalesce(finish, 'unknown') AS finish, coalesce(print_run_marker, 'unknown') AS print_run_marker FROM variants v JOIN cards c ON c.card_id = v.card_id JOIN sets s ON s.set_id = c.set_id)"""


def _targets(v):
    return auctions.matched_targets(v["listings"], v["history"], v["specs"], v["variants"], v["cards"], v["sets"], now())


@query("matched_targets", f"{WITH}, {_TARGETS} SELECT spec_id, spec_pk, c.variant_id, source_set_id, local_id, finish, print_run_marker, listings, next_end FROM counted c JOIN newest n ON n.variant_id = c.variant_id JOIN named d ON d.variant_id = c.variant_id ORDER BY next_end NULLS LAST, source_set_id, local_id, spec_id")
def matched_targets(spark, sf):
    """Specs behind trusted listings, each once, soonest end first."""
    return _targets(views(spark, sf))[0]


@query("identity_gaps", f"{WITH}, {_TARGETS} SELECT source_set_id, count(*) AS variants, CAST(sum(listings) AS BIGINT) AS listings FROM counted c JOIN named d ON d.variant_id = c.variant_id WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.variant_id = c.variant_id) GROUP BY source_set_id")
def identity_gaps(spark, sf):
    """Sets of trusted variants without a spec: the complement."""
    return _targets(views(spark, sf))[1]


@query("target_snapshot", f"""
    {WITH}, {_TARGETS}, t AS (SELECT spec_id, listings, next_end FROM counted c JOIN newest n ON n.variant_id = c.variant_id), m AS (SELECT spec_id, 1 AS revision, listings - (spec_pk % 2) AS listings, next_end FROM counted c JOIN newest n ON n.variant_id = c.variant_id WHERE spec_pk % 3 = 0)
    SELECT t.spec_id, CAST(coalesce(m.revision, 0) + 1 AS INTEGER) AS revision, t.listings, t.next_end FROM t LEFT JOIN m ON m.spec_id = t.spec_id WHERE m.spec_id IS NULL OR m.listings IS DISTINCT FROM t.listings OR m.next_end IS DISTINCT FROM t.next_end""")
def target_snapshot(spark, sf):
    """Targets that are new or changed against a manifest, with the next revision."""
    targets = _targets(views(spark, sf))[0]
    old = targets.where("spec_pk % 3 = 0").select("spec_id", F.lit(1).alias("revision"), (F.col("listings") - F.col("spec_pk") % 2).alias("listings"), "next_end")
    return auctions.snapshot_manifest(old, targets.select("spec_id", "listings", "next_end"))
