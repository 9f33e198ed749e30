"""Hand-checked values of functions, curation, figures, auctions, operations, sources and streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.functions import text, values
from marketlens.operators import auctions, curation, merge, metrics, operations, predicates, search
from marketlens.sources import publish, raw
from marketlens.streaming import ledger


def one(spark, column, **cells):
    kinds = {str: "string", float: "double", int: "long", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in cells.items()) or "x int"
    return spark.createDataFrame([tuple(cells.values()) or (1,)], schema).select(column.alias("v")).head().v


@pytest.mark.parametrize(("given", "key"), [("Pokémon  Card!", "poke_mon_card"), (" A--B ", "a_b"), ("ピカチュウ", ""), ("Ｆｕｌｌ 1", "full_1"), (None, None), ("", "")])
def test_normalize_part(spark, given, key):
    assert spark.createDataFrame([(given,)], "x string").select(text.normalize_part(F.col("x"))).head()[0] == key


@pytest.mark.parametrize(("given", "forms"), [("011", {"011", "11"}), ("4", {"4", "004"}), ("TG12", {"TG12", "TG012"}), ("tg7", {"TG7", "TG07", "TG007"})])
def test_number_forms(spark, given, forms):
    assert set(one(spark, text.number_forms(F.col("x")), x=given)) == forms


def test_text_functions(spark):
    assert one(spark, text.natural_key(F.col("x")), x="SM10b") == "sm000000000010b"
    assert one(spark, text.pretty(F.col("x")), x="reverse_holo") == "Reverse Holo"
    assert [one(spark, c, x="swsh12-1-TG") for c in text.split_card_id(F.col("x"))] == ["swsh12-1", "TG"]
    assert one(spark, text.plain_text(F.col("x")), x="<p>a&amp;b</p><script>x</script>  c&foo;d") == "a&b c d"
    assert [tuple(r) for r in one(spark, text.fractions(F.col("x")), x="PSA 10 / OVP 4/102 and 25 /102")] == [("4", "102"), ("25", "102")]
    assert one(spark, text.jaccard(F.split("x", " "), F.split("y", " ")), x="a b c", y="b c d") == 0.5
    assert one(spark, text.looks_like_code(F.col("x")), x="cp6") and not one(spark, text.looks_like_code(F.col("x")), x="promo")


def test_plain_text_is_whole(spark):
    assert one(spark, text.plain_text(F.col("x")), x="<p>" + "word " * 1000 + "</p>") == ("word " * 1000).strip()
    assert one(spark, text.plain_text(F.col("x"), 2000), x="<p>" + "word " * 1000 + "</p>") == "word " * 400


def test_values(spark):
    assert one(spark, values.parse_money(F.col("x")), x="$1,234.50") == 1234.5 and one(spark, values.parse_money(F.col("x")), x="n/a") is None and one(spark, values.parse_money(F.col("x")), x="abc") is None
    assert one(spark, values.grade_value(F.col("x")), x="GEM MT 10 (3)") == 10 and one(spark, values.grade_value(F.col("x"), clean=False), x="GEM MT 10 (3)") == 3 and one(spark, values.grade_value(F.col("x")), x="AUTH") is None
    assert [one(spark, values.number_text(F.col("x")), x=v) for v in (199.0, 257.14, 1e7)] == ["199", "257.14", "10000000"]
    assert [one(spark, values.http_class(F.col("x")), x=v) for v in (200, 404, 429, 503)] == ["success", "permanent", "retryable", "retryable"]
    assert values.split_range(10.0, 20.0) == [(10.0, 15.0), (15.01, 20.0)] and values.split_range()[-1] == (5000.01, None) and values.split_range()[1] == (25.01, 50)
    assert [one(spark, values.price_band(F.col("x")), x=v) for v in (0.0, 25.0, 25.01, 5000.0, 5000.5)] == [0, 0, 1, 7, 8]
    assert one(spark, values.quota_day(F.col("x").cast("timestamp")), x="2024-01-02 06:59:00") == dt.date(2024, 1, 1)


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", "stub", 1), (2, "b", "hydrated", 2)], "k int, v string, s string, c int")
    new = spark.createDataFrame([(2, None, "stub", 9), (3, "c", "stub", 3)], "k int, v string, s string, c int")
    got = {r.k: (r.v, r.s, r.c) for r in merge.upsert(old, new, ["k"], keep_old=["v"], first_wins=["c"], sticky={"s": "hydrated"}).collect()}
    assert got == {1: ("a", "stub", 1), 2: ("b", "hydrated", 2), 3: ("c", "stub", 3)}
    again = merge.upsert(merge.upsert(old, new, ["k"]), new, ["k"])
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in merge.upsert(old, new, ["k"]).collect()}
    assert {r.k for r in merge.drop_stale(old, new.where("k = 3"), ["k"], ["s"]).collect()} == {2}
    assert {(r.k, r.v) for r in merge.replace_children(old, new.where("k = 2"), ["k"]).collect()} == {(1, "a"), (2, None)}
    assert [r.v for r in merge.transition(old, F.col("k") == 1, v="z").orderBy("k").collect()] == ["z", "b"]
    assert sorted(r.is_primary for r in merge.single_primary(old.withColumn("g", F.lit(1)), ["g"], [F.desc("k")]).collect()) == [False, True]


@pytest.fixture(scope="module")
def market(spark):
    variants = spark.createDataFrame([(1, 1, "k1", "holo", "unlimited", "", "standard", [], "confirmed", 7), (2, 1, "k2", "holo", "first", "", "standard", [], "inferred", 0), (3, 2, "k3", "normal", "", "", "standard", [], "confirmed", 0)], schemas.VARIANTS)
    t = dt.datetime(2026, 8, 1)
    specs = spark.createDataFrame([(1, "population", "pop-1", 1, "matched", "holo", None, t), (2, "sales", "sales-1", 1, "matched", "holo", "", t), (3, "sales", "sales-2", 1, "matched", "holo", "", dt.datetime(2026, 8, 2)), (4, "population", "pop-2", 2, "unmatched", "holo", "", t)], schemas.SPECS)
    population = spark.createDataFrame([(1, "10", 10.0, False, 7, 100, 0, t), (1, "9", 9.0, False, 5, 100, 1, t), (1, "9", 9.0, True, 2, 100, None, t), (4, "10", 10.0, False, 99, 999, 0, t)], schemas.POPULATION)
    prices = spark.createDataFrame([(1, "10", 1000.0, 900.0, 800.0, t)], schemas.PRICES)
    sales = spark.createDataFrame([(2, "a", dt.date(2026, 8, 1), 1200.0, 10.0), (2, "b", dt.date(2026, 8, 15), 1000.0, 10.0), (2, "c", dt.date(2024, 8, 15), 10.0, 10.0), (2, "d", dt.date(2026, 8, 15), 5.0, 9.0)], schemas.SALES)
    return variants, specs, population, prices, sales


def now():
    return F.lit("2026-09-01 00:00:00").cast("timestamp")


def test_metrics(spark, market):
    variants, specs, population, prices, sales = market
    got = {r.variant_id: r for r in metrics.variant_metrics(variants, specs, population, prices, sales, now()).collect()}
    assert (got[1].population10, got[1].total_population, got[1].gem_rate, got[1].guide_price) == (7, 100, 7.0, 800.0)
    # the newer, empty sales spec changes nothing; all grades count and can be latest, a year's sales are of grade ten
    assert (got[1].sale_count, got[1].sales_12m, got[1].latest_sale_price, got[1].average_price) == (4, 2, 5.0, 900.0)
    assert got[2].population10 == 7 and got[2].population_available and got[2].sales_available  # through its card's spec, as its own is not matched
    assert (got[3].total_population, got[3].population10, got[3].gem_rate, got[3].guide_price, got[3].sale_count, got[3].population_available, got[3].sales_available) == (0, 0, None, None, 0, False, False)
    summary, listed, months = metrics.market(specs, population, prices, sales, now())
    one = summary.where("variant_id = 1").head()
    assert (one.sales, one.sales_12m, one.first_sale, one.guide_price, one.population10, one.total_population, one.gem_rate) == (3, 2, dt.date(2024, 8, 15), 800.0, 7, 100, 7.0) and summary.count() == 1
    assert [r.sale_item_id for r in listed.collect()] == ["c", "a", "b"] and {r.month: (r.median_price, r.sales) for r in months.collect()} == {"2026-08": (1100.0, 2), "2024-08": (10.0, 1)}
    ladder = {r.grade_key: (r.population, r.qualified, r.half_grades, r.psa_price) for r in metrics.population_ladder(specs, population, prices).collect()}
    assert ladder == {"10": (7, 0, 0, 800.0), "9": (5, 2, 1, None)}


def test_curation(spark):
    files = spark.createDataFrame([(605243, '{"Results":[{"Counts":[{"Grade10":3,"Grade9":1,"Auth":1,"Grade9_5":2,"Grade9Q":1}]}]}', [("GEM MT 10", "$1,000.00", "-", "$80.00")], "2026-01-01", 544022), (1, "<html>", [], "2026-01-01", 544022)],
        "psaSpecId long, populationRaw string, priceRows array<struct<gradeText:string,mostRecentText:string,averageText:string,psaPriceText:string>>, fetchedAt string, salesSpecId long")
    rows = curation.populations(files).collect()
    assert len(rows) == 13 and {r.total_population for r in rows} == {8} and next(r.population_count for r in rows if r.grade_key == "10") == 3
    assert [(r.grade_key, r.qualified) for r in rows if r.qualified] == [("9", True)] and next(r.half_grade_count for r in rows if r.grade_key == "9" and not r.qualified) == 2
    price = curation.price_rows(files).head()
    assert (price.grade_key, price.most_recent_price, price.average_price, price.psa_price) == ("10", 1000.0, None, 80.0)
    assert [tuple(r) for r in curation.paired_specs(files).collect()] == [(1, 544022)]
    cards = spark.createDataFrame([("de", "base1-1", "base1", None, [("normal", "unlimited", None, None), ("Normal", "first-edition", None, ["1st-edition"]), ("normal", "shadowless", "standard", None)]), ("en", "x-1", "x", {"holo": True, "reverse": False, "firstEdition": True}, None)],
        "language string, id string, sid string, variants map<string,boolean>, variants_detailed array<struct<type:string,subtype:string,size:string,stamp:array<string>>>").withColumn("set", F.struct(F.col("sid").alias("id")))
    years = spark.createDataFrame([("de", "base1", 1999), ("en", "x", 2020)], "language string, source_set_id string, year int")
    got = {(r.language, r.variant_key) for r in curation.variants_of(cards, years).collect()}
    assert got == {("de", "normal|first_edition||standard|"), ("de", "normal|unlimited||standard|"), ("en", "holo|||standard|"), ("en", "holo|first_edition||standard|")}
    wanted = spark.createDataFrame([(1, 1, "holo", "first", None), (2, 1, "other", None, None)], "row_id long, card_id long, finish string, print_run_marker string, micro_variant string")
    variants = spark.createDataFrame([(1, 1, "holo", "unlimited", ""), (2, 1, "holo", "first", "")], "variant_id long, card_id long, finish string, print_run_marker string, micro_variant string")
    assert {r.row_id: r.variant_id for r in curation.resolve_variants(wanted, variants).collect()} == {1: 2, 2: None}
    assert {r.row_id: r.variant_id for r in curation.resolve_variants(wanted, variants, exact=True).collect()} == {1: 2, 2: None}
    listings = spark.createDataFrame([(1, "c1", 10), (2, "c1", 20), (3, "c2", 30), (4, None, 40)], "listing_id long, cert string, variant_id long")
    minted = curation.mint_specs(listings, spark.createDataFrame([("c1", "s1"), ("c2", "s2")], "cert string, spec_id string"), spark.createDataFrame([("s2",)], "spec_id string"))
    assert [(r.spec_id, r.variant_id) for r in minted.collect()] == [("s1", 10)]


def test_detailed_variants(spark):
    """Editions, shadowless issues, German names and the English card's word for a variant of the same id."""
    def v(kind, subtype=None, size=None, stamp=None, languages=None, vid=None):
        return kind, subtype, size, stamp, languages, vid

    cards = [
        ("en", "a-1", "a", [v("holo", "Shadowless", stamp=["1st-edition"]), v("holo", "shadowless"), v("normal", "Red Cheeks", vid="x1"), v("normal", "unlimited", languages=["de"])]),
        ("de", "a-1", "a", [v("holo", "Schattenlos"), v("normal", "Rote Backen", stamp=["Staff"], vid="x1"), v("reverse", None, stamp=["1. Auflage", "Vorveröffentlichung"]), v("holo", "Unbegrenzt", languages=["de"])]),
        ("de", "base1-1", "base1", [v("normal", "Schattenlos", stamp=["Staff"]), v("normal", None, "jumbo"), v("normal", None, "jumbo", languages=["de"])]),
    ]
    df = spark.createDataFrame([(a, b, c, None, d) for a, b, c, d in cards], "language string, id string, sid string, variants map<string,boolean>, variants_detailed array<struct<type:string,subtype:string,size:string,stamp:array<string>,languages:array<string>,variantId:string>>").withColumn("set", F.struct(F.col("sid").alias("id")))
    got = {(r.language, r.source_card_id, r.variant_key) for r in curation.variants_of(df, spark.createDataFrame([("en", "a", 2000), ("de", "a", 2000), ("de", "base1", 1999)], "language string, source_set_id string, year int")).collect()}
    assert got == {
        ("en", "a-1", "holo|shadowless_first_edition||standard|"), ("en", "a-1", "holo|shadowless||standard|"), ("en", "a-1", "normal|unlimited|red_cheeks|standard|"),
        ("de", "a-1", "holo|unlimited||standard|"), ("de", "a-1", "normal|unlimited||standard|"), ("de", "a-1", "reverse|first_edition||standard|vorvero_ffentlichung"),
        ("de", "base1-1", "normal|unlimited||standard|"), ("de", "base1-1", "normal|||jumbo|"),
    }
    sets = spark.createDataFrame([("en", "a", "http://l/logo/", None), ("de", "b", "x.webp", "y")], "language string, id string, logo string, symbol string")
    assert {(r.source_set_id, r.kind, r.url) for r in curation.set_images(sets).collect()} == {("a", "logo", "http://l/logo.webp"), ("b", "logo", "x.webp"), ("b", "symbol", "y.webp")}


@pytest.fixture(scope="module")
def live(spark):
    end = dt.datetime(2026, 9, 1, 1)
    listings = spark.createDataFrame([(1, "PSA 10 Alakazam", 1, 1, 10.0, False, False, "matched", "strong", "multi-signal", 1.2), (2, "flagged", 1, 1, 10.0, False, True, "matched", "strong", "multi-signal", 1.2), (3, "copied", 1, 1, 10.0, False, False, "matched", "strong", "cluster-propagate", 1.0), (4, "lot", 3, 2, 10.0, True, False, "matched", "strong", "x", 1.0), (5, "no spec", 3, 2, 10.0, False, False, "manual", "exact", None, 1.0)], schemas.LISTINGS)
    history = spark.createDataFrame([(i, i, dt.datetime(2026, 8, 30), 450.0, 400.0, "EUR", 3, ["AUCTION"], end) for i in range(1, 5)] + [(9, 1, dt.datetime(2026, 8, 29), 10.0, None, "EUR", 1, ["AUCTION"], end), (10, 5, dt.datetime(2026, 8, 29), 10.0, None, "USD", 0, ["FIXED_PRICE"], None)], schemas.PRICE_HISTORY)
    rates = spark.createDataFrame([(dt.date(2026, 8, 31), "EUR", "USD", 2.0), (dt.date(2026, 8, 1), "EUR", "USD", 9.0)], schemas.RATES)
    return listings, history, rates, spark.createDataFrame([(1, 800.0)], "variant_id long, guide_price double")


def test_live_auctions(spark, live, market):
    listings, history, rates, guide = live
    rows = auctions.live_auctions(listings, history, guide, rates, now()).collect()
    assert [(r.listing_id, r.bid, r.comparable, r.guide_euros, r.discount, r.stale_rate, r.stale) for r in rows] == [(1, 400.0, 400.0, 400.0, 0.0, False, True)]
    assert auctions.live_auctions(listings, history, guide, rates, F.lit("2026-09-01 01:00:00").cast("timestamp")).count() == 0
    found = auctions.live_auctions(listings, history, guide, rates, now())
    assert auctions.filtered(found, now(), q="alaka", ending_hours=24, guide=True).count() == 1 and auctions.filtered(found, now(), least_discount=5.0).count() == 0
    assert auctions.summary(found, now()).head().asDict() == {"live": 1, "with_guide": 1, "comparable": 1, "median_discount": 0.0, "ending_24h": 1, "last_observed": dt.datetime(2026, 8, 30)}
    variants, specs, *_ = market
    cards, sets = spark.createDataFrame([(1, 1, "1"), (2, 1, "2")], "card_id long, set_id long, local_id string"), spark.createDataFrame([(1, "base1")], "set_id long, source_set_id string")
    targets, rest = auctions.matched_targets(listings, history, specs, variants, cards, sets, now())
    assert [(r.variant_id, r.listings, r.finish) for r in targets.collect()] == [(1, 1, "holo")] and [(r.source_set_id, r.variants) for r in rest.collect()] == [("base1", 1)]
    manifest = spark.createDataFrame([], "spec_id string, revision int, listings long, next_end timestamp")
    first = auctions.snapshot_manifest(manifest, targets)
    assert [r.revision for r in first.collect()] == [1] and auctions.snapshot_manifest(first, targets).count() == 0


def test_price_history_appends_changes_alone(spark, live):
    history = live[1]
    same = history.where("observation_id = 1").withColumn("observation_id", F.lit(100).cast("long"))
    changed = same.withColumn("price", F.lit(199.0)).withColumn("observation_id", F.lit(101).cast("long"))
    assert auctions.append_price(history, same).count() == history.count()
    assert auctions.append_price(history, same.unionByName(changed)).agg(F.min("price")).head()[0] == 10.0
    assert auctions.append_price(history, changed).count() == history.count() + 1


def test_search_and_operations(spark, market, live):
    variants = market[0]
    sets = spark.createDataFrame([(1, "en", "base1", "Base", "Base", "1999-01-09", 102, 102), (2, "de", "base1", "Grundset", "Base", None, 102, 102)], schemas.SETS)
    cards = spark.createDataFrame([(1, 1, "1", "Alakazam", None, "Rare", [65], 80, None, None, "hydrated"), (2, 1, "10", "Mewtwo", None, None, None, None, None, None, "stub"), (3, 1, "2", "Blastoise", None, None, None, None, None, "u", "hydrated"), (4, 2, "1", "Simsala", None, None, None, None, None, None, "stub")], schemas.CARDS)
    base = search.card_base(cards, sets, variants)
    page, total = search.card_search(base, {"language": "en"}, "number_asc")
    assert total == 3 and [r.local_id for r in page.collect()] == ["1", "2", "10"]
    assert {r.card_id: r.variant_count for r in base.collect()} == {1: 2, 2: None, 3: 0, 4: None}
    assert [r.card_id for r in search.card_search(base, {"q": "ALAKA", "set": "Base"})[0].collect()] == [1]
    assert len(search.card_search(base, {}, number=99, size=2)[0].collect()) == 2  # the last page
    metric = metrics.variant_metrics(*market, now())
    found, n = search.variant_search(base, variants, metric, {}, {"population10": (5, None)}, "gem_rate_desc")
    assert n == 2 and {r.variant_id for r in found.collect()} == {1, 2}
    detail = search.card_detail(base, variants, 1).head()
    assert len(detail.variants) == 2 and [tuple(x) for x in detail.also_printed] == [(4, "de")]
    listings = live[0]
    assert {r.rule: r.n for r in operations.gate(listings, cards, sets).collect()} == {"trusted_unproven": 2, "no_tier": 0, "card_without_set": 0, "empty_catalogue": 0}
    proven = listings.where("not (match_tier in ('exact', 'strong') and (flagged or variant_id is null or match_method = 'cluster-propagate'))")
    schemas.require(operations.gate(proven, cards, sets))
    with pytest.raises(ValueError, match="card_without_set"):
        schemas.require(operations.gate(proven, cards, sets.where("set_id = 2")))
    assert {(r.dimension, r.value): r.n for r in operations.match_report(listings).collect()}[("match_tier", "strong")] == 4
    assert {r.language: (r.sets, r.cards, r.variants) for r in operations.language_summary(sets, cards, variants).collect()} == {"en": (1, 3, 3), "de": (1, 1, 0)}
    stages = spark.createDataFrame([("a", True, dt.datetime(2030, 1, 1), None), ("b", None, dt.datetime(2030, 1, 1), None), ("c", None, None, dt.datetime(2030, 1, 1)), ("d", None, None, None)], "stage string, poked boolean, parked_until timestamp, next_tick_at timestamp")
    assert {r.stage: r.decision for r in operations.stage_decision(stages, now()).collect()} == {"a": "run", "b": "parked", "c": "waiting", "d": "run"}
    assert predicates.page(cards.orderBy("card_id"), 2, 3).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "s1", "fetchedAt": "2026-01-01", "aliases": ["x", "y"]}')
    (tmp_path / "b.json").write_text('{"id": "s1", "fetchedAt": "2026-01-02"}')
    (tmp_path / "c.json").write_text("<html>no json")
    found = raw.read_json(spark, str(tmp_path), "id string, fetchedAt string, aliases array<string>").cache()
    good, bad = raw.split_corrupt(found)
    assert good.count() == 2 and bad.count() == 1
    assert [r.fetchedAt for r in raw.latest_files(good, "id").collect()] == ["2026-01-02"]
    rate = one(spark, raw.exchange_rate(F.col("x")), x="<Cube time='2026-08-28'><Cube currency='USD' rate='1.25'/></Cube>")
    assert (rate.rate_date, rate.rate) == (dt.date(2026, 8, 28), 1.25) and one(spark, raw.exchange_rate(F.col("x")), x="<Cube/>") is None
    assert one(spark, raw.spec_of_page(F.col("x")), x='<a href="/spec/psa/544022">') == "544022"
    assert one(spark, raw.infobox_image(F.col("x")), x="{{Karte Infobox\n| bild = Glurak.png\n|x=1}}") == "Glurak.png"
    pages = spark.createDataFrame([(1, '<table><tr><th>Grade</th><th>Most Recent Price</th><th>Average Price</th><th>PSA Price</th><th>Population</th><th>POP Higher</th></tr><tr><td>10</td><td>$5</td><td>-</td><td>$4</td><td>7</td><td>0</td></tr></table><table><tr><th>Pos</th><th>Grade</th><th>Thumbnail</th><th>Pedigree and History</th></tr><tr><td>1</td><td>MINT 9</td><td></td><td>A. Owner</td></tr></table><a href="/pop/1999">1999</a><a href="/pop/1999">again</a><a href="/h/12">Base</a>')], "page_id long, html string")
    assert [(r.grade, r.most_recent_price, r.psa_price, r.population) for r in raw.price_table(pages).collect()] == [("10", "$5", "$4", "7")]
    assert [tuple(r) for r in raw.census_table(pages).collect()] == [(1, 1, "MINT 9", "A. Owner")]
    assert {(r.href, r.text, r.kind) for r in raw.classified_links(pages).collect()} == {("/pop/1999", "1999", "year"), ("/h/12", "Base", "heading")}
    bodies = spark.createDataFrame([("p1", "same", 1), ("p2", "same", 2), ("p3", "known", 3)], "path string, body string, observed_at int")
    known = spark.createDataFrame([("known",)], "b string").select(F.sha2("b", 256).alias("hash"))
    assert [(r.path, r.byte_size) for r in raw.store_objects(bodies, known).collect()] == [("p1", 4)]
    titles = spark.createDataFrame([("A",), ("D",)], "title string")
    hops = spark.createDataFrame([("A", "B"), ("B", "C")], "source string, target string")
    assert {r.title: r.canonical for r in raw.canonical_titles(titles, hops).collect()} == {"A": "C", "D": "D"}
    images = raw.card_images(spark.createDataFrame([(1, "http://x/y/")], "card_id long, image string"))
    assert images.count() == 6 and images.orderBy("place").head().url == "http://x/y/high.webp"
    rows, rejected = raw.report_rows(spark.createDataFrame([("a", '{"recordsTotal":1,"data":[{"SpecID":5,"SubjectName":"n","CardNumber":"1"}]}'), ("b", "<html>")], "path string, body string"))
    assert [r.spec_id for r in rows.collect()] == [5] and [r.path for r in rejected.collect()] == ["b"]


def test_redirects_are_followed_to_their_end(spark):
    titles = spark.createDataFrame([("t0",), ("x",), ("a",), ("end",), (None,)], "title string")
    hops = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(8)] + [("x", "a"), ("a", "b"), ("b", "a")], "source string, target string")
    assert {r.title: r.canonical for r in raw.canonical_titles(titles, hops).collect()} == {"t0": "t8", "x": "a", "a": "a", "end": "end", None: None}


def test_convergence_fails_aloud(spark):
    calls = []
    with pytest.raises(RuntimeError):
        ledger.converge(lambda: (calls.append(1), spark.range(len(calls)))[1], ["id"])
    assert len(calls) == 3


def test_publish_moves_the_pointer_last(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    publish.publish(spark, folder, {"t": spark.range(3)})
    publish.publish(spark, folder, {"t": spark.range(4)})

    def refuse(tables):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        publish.publish(spark, folder, {"t": spark.range(5)}, refuse)
    assert publish.current(spark, folder, "t").count() == 4 and len(publish.generations(spark, folder)) == 2
    for n in (6, 7, 8):
        publish.publish(spark, folder, {"t": spark.range(n)})
    assert len(publish.generations(spark, folder)) == 3 and publish.current(spark, folder, "t").count() == 8


def test_stream_equals_full_rebuild(spark, tmp_path):
    folder, schema = f"{tmp_path}/ledger", "k string, id long, ts timestamp, v int"
    t = dt.datetime(2026, 1, 1)
    for n, rows in enumerate([[("a", 1, t, 1), ("b", 2, t, 1)], [("a", 3, t + dt.timedelta(minutes=6), 2), ("a", 3, t + dt.timedelta(minutes=6), 2)], [("c", 4, t, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream, states = ledger.ledger_stream(spark, folder, schema, 1), []

    def rebuild(batch, number):
        state = spark.read.parquet(states[-1]) if states else None
        out = f"{tmp_path}/state-{number}"
        ledger.rebuild_latest(spark.read.schema(schema).parquet(folder).where(F.col("id") > 0), batch, state, ["k"], "id").write.mode("overwrite").parquet(out)
        states.append(out)

    ledger.incremental(stream, rebuild, f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = {(r.k, r.id) for r in spark.read.parquet(states[-1]).collect()}
    assert got == {("a", 3), ("b", 2), ("c", 4)}
    for name, query, mode in (("latest", ledger.latest_state(stream, ["k"], "id"), "complete"), ("unique", ledger.deduplicated(stream, ["k", "id"], "ts"), "append"), ("counts", ledger.throughput(stream, "ts"), "complete")):
        query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert {(r.k, r.id) for r in spark.table("latest").collect()} == got and spark.table("unique").count() == 4
    assert {r.start.minute: r.events for r in spark.table("counts").collect()} == {0: 3, 5: 2}


def test_known_pages_and_convergence(spark):
    pages = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("a", 3, 12), ("a", 4, 13), ("b", 1, 13), ("b", 2, 14), ("b", 3, 11)], "h string, page int, id long")
    known = spark.createDataFrame([(11,), (12,), (13,), (13,)], "id long")
    assert [(r.h, r.page) for r in ledger.known_pages(pages, known, "id", ["h"]).orderBy("h", "page").collect()] == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]
    calls = []
    ledger.converge(lambda: (calls.append(1), spark.range(min(len(calls), 2)))[1], ["id"], 5)
    assert len(calls) == 3
