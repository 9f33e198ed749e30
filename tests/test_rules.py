"""Rules of resolution, gates, coverage, text and numbers, with the rows that they must give written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import text
from marketlens.operators import auctions, curation, matching, metrics, operations

VARIANTS = "variant_id long, card_id long, finish string, print_run_marker string, micro_variant string, source string"
WANTED = "row_id long, card_id long, finish string, print_run_marker string, micro_variant string"


def resolved(spark, wanted, variants, exact):
    rows = [(i, 1, *w) for i, w in enumerate(wanted)]
    found = curation.resolve_variants(spark.createDataFrame(rows, WANTED), spark.createDataFrame(variants, VARIANTS), exact).collect()
    return [r.variant_id for r in sorted(found)]


def test_forgiving_resolution(spark):
    lone = [(5, 1, "holo", None, None, None)]
    assert resolved(spark, [("reverse", "", ""), ("", "", "")], lone, False) == [5, 5], "a lone variant is taken unseen"
    some = [(1, 1, "holo", "unlimited", None, "catalogue"), (2, 1, "holo", "first_edition", None, None), (3, 1, "Reverse", None, "full art", "catalogue"), (4, 1, "reverse", None, None, "report")]
    wishes = [("holo", "First Edition", ""), ("holo", "", ""), ("reverse", "none has it", ""), ("cosmos", "unlimited", None), ("", "", "full_art"), ("holo", "", "full art"), ("", "", "")]
    assert resolved(spark, wishes, some, False) == [2, None, 3, 1, 3, None, None]
    assert resolved(spark, [("holo", "", "")], [(9, 2, "holo", None, None, None)], False) == [None], "no variant of the card"
    assert resolved(spark, [("holo", "", "")], [(9, 1, "holo", None, None, "report")], False) == [None], "only the catalogue's count"


def test_exact_resolution(spark):
    some = [(1, 1, "holo", "unlimited", None, "catalogue"), (2, 1, "holo", "unlimited", None, "report"), (3, 1, "reverse", None, "master_ball", "report"), (4, 1, "normal", "unlimited", None, None), (5, 1, "normal", "first_edition", None, None)]
    wishes = [
        ("holo", "unlimited", ""),  # the catalogue's of two
        ("reverse", "", "German-Master Ball"),  # words for languages come off
        ("holo", "", "master ball"),  # nearest misses are none
        ("normal", "first edition", "Japanese"),  # the print run decides a tie
        ("normal", "", ""),  # still tied
        ("normal", "shadowless", ""),  # a print run that none has decides nothing
        ("", "unlimited", ""),  # 1 and 4 are left
        ("reverse", "anything", "master_ball"),  # alone, so the print run is not asked
    ]
    assert resolved(spark, wishes, some, True) == [1, 3, None, 5, None, None, None, 3]
    assert resolved(spark, [("holo", "", "")], [(6, 1, "holo", "a", None, "report"), (7, 1, "holo", "b", None, "report")], True) == [None]


def test_plain_flags(spark):
    rows = spark.createDataFrame([(1, {"holo": True, "reverse": True, "firstEdition": True, "wPromo": True}), (2, {"firstEdition": True}), (3, {"normal": False, "wPromo": True}), (4, None), (5, {"Holo": True, "firstEdition": None})], "i int, flags map<string,boolean>")
    found = {r.i: [tuple(p) for p in r.parts] for r in rows.select("i", curation.plain_parts(F.col("flags")).alias("parts")).collect()}
    assert sorted(found[1]) == [("holo", ""), ("holo", "first_edition"), ("reverse", ""), ("reverse", "first_edition")]
    assert found[2] == [("normal", ""), ("normal", "first_edition")] and found[3] == found[4] == [("normal", "")] and found[5] == [("holo", "")]


def test_gate_sees_flagged_and_propagated_rows(spark):
    listings = spark.createDataFrame([(1, "strong", False, "multi-signal", 1), (2, "strong", True, None, 1), (3, "exact", False, "cluster-propagate", 1), (4, "exact", None, None, None), (5, "review", True, None, None), (6, None, False, None, 7)], "listing_id long, match_tier string, flagged boolean, match_method string, variant_id long")
    cards, sets, variants = spark.createDataFrame([(1, 1)], "card_id long, set_id long"), spark.createDataFrame([(1,)], "set_id long"), spark.createDataFrame([(1, 1), (2, 9)], "variant_id long, card_id long")
    specs, campaigns = spark.createDataFrame([(1, 1), (2, 5), (3, None)], "spec_pk long, variant_id long"), spark.createDataFrame([("complete", "complete"), ("complete", None), ("running", "complete")], "status string, coverage_status string")
    found = {r.rule: r.n for r in operations.gate(listings, cards, sets, variants, specs, campaigns).collect()}
    assert found == {"trusted_unproven": 3, "no_tier": 1, "campaign_incomplete": 2, "card_without_set": 0, "variant_without_card": 1, "listing_without_variant": 1, "spec_without_variant": 1, "empty_catalogue": 0}


def test_coverage_states(spark):
    targets = spark.createDataFrame([(i, f"p{i}", f"s{i}" if i != 6 else None) for i in range(1, 8)], "target_id int, spec_id string, sales_spec_id string")
    rows = spark.createDataFrame([("p1", "population"), ("p1", "population"), ("s1", "sales")], "spec_id string, phase string")
    raw = spark.createDataFrame([("p1", "population"), ("p2", "population"), ("s2", "sales"), ("s2", "sales")], "spec_id string, kind string")
    work = spark.createDataFrame([("p3", "population", "permanent_failed", "HTTP 429"), ("p4", "population", "retryable_failed", "Rate limit"), ("p5", "population", "leased", "timeout"), ("p6", "population", "succeeded", None)], "spec_id string, kind string, state string, last_error string")
    found = {(r.target_id, r.phase): r.status for r in auctions.coverage_status(targets, rows, raw, work).collect()}
    states = {i: [found[i, p] for p in ("population", "guide", "sales")] for i in range(1, 8)}
    assert states == {1: ["processed", "no_data", "processed"], 2: ["raw_present", "no_data", "no_data"], 3: ["failed", "failed", "raw_missing"], 4: ["rate_limited", "rate_limited", "raw_missing"], 5: ["pending", "pending", "raw_missing"], 6: ["raw_missing"] * 3, 7: ["raw_missing"] * 3}


def test_entities_are_decoded_once(spark):
    cases = {"&amp;lt;b&amp;gt;": "&lt;b&gt;", "a &AMP; b&NBSP;c": "a & b c", "x &eacute; y & z &": "x y & z &", "<p>1 &lt; 2</p><SCRIPT>no</script>&#39;&quot;": "1 < 2 '\"", "&;&a b;": "&;&a b;"}
    rows = spark.createDataFrame([(k,) for k in cases], "h string").select("h", text.plain_text(F.col("h")).alias("p"))
    assert {r.h: r.p for r in rows.collect()} == cases


def test_the_word_before_a_fraction_may_be_far(spark):
    cases = {"PSA" + " " * 60 + "10/10": [], "a" * 90 + "psa 10/10": [("10", 10)], "P.S.A. 9/10 4/102": [("4", 102)], "psa\t\n 10/10 and 25/102": [("25", 102)], "4/102 10/psa 7/64": [("4", 102)], "8 / bgs 9 / 9": [], "BGS10/10": [], "9/9": [("9", 9)]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.filter(text.readings(F.col("t"), "title"), lambda r: r["kind"] == "fraction").alias("r"))
    assert {r.t: [(x.value, x.total) for x in r.r] for r in rows.collect()} == cases


def test_prices_without_population_stay(spark):
    specs = spark.createDataFrame([(1, "population", "P1", 10, "matched", None), (2, "population", "P2", 10, "unmatched", None)], "spec_pk long, namespace string, spec_id string, variant_id long, match_status string, fetched_at timestamp")
    population = spark.createDataFrame([(1, "10", 10.0, False, 4, 9, 0)], "spec_pk long, grade_key string, grade_value double, qualified boolean, population_count long, total_population long, half_grade_count long")
    prices = spark.createDataFrame([(1, "10", 1.0, 2.0, 3.0), (1, "7", 4.0, 5.0, 6.0), (2, "9", 1.0, 1.0, 1.0)], "spec_pk long, grade_key string, most_recent_price double, average_price double, psa_price double")
    found = {(r.variant_id, r.grade_key): (r.population, r.psa_price) for r in metrics.population_ladder(specs, population, prices).collect()}
    assert found == {(10, "10"): (4, 3.0), (10, "7"): (None, 6.0)}


def test_a_code_of_another_language_is_unknown(spark):
    """208/SM-P is a promo of one language; a set of that code in another is not it."""
    sets = spark.createDataFrame([(1, "en", "smp", "Promos", None, "2017-01-01", 250, 250)], "set_id long, language string, source_set_id string, name string, series string, release_date string, total_cards int, official_cards int")
    cards = spark.createDataFrame([(1, 1, "208", "Pikachu", None, None, None, None)], "card_id long, set_id long, local_id string, name string, rarity string, dex_ids array<int>, hp int, illustrator string")
    variants = spark.createDataFrame([(1, 1, "holo", None, None, [], 3)], "variant_id long, card_id long, finish string, print_run_marker string, micro_variant string, stamps array<string>, population10 long")
    listings = spark.createDataFrame([(1, "PSA 10 Pokemon Pikachu 208/SM-P Japanese"), (2, "PSA 10 Pokemon Pikachu 208/SM-P English"), (3, "PSA 10 Pokemon Pikachu 208/SM-P"), (4, "PSA 10 Pokemon Pikachu 208/XY-P")], "listing_id long, title string")
    listings = listings.withColumns({"description": F.lit(""), "quantity": F.lit(1), "condition_id": F.lit(""), "aspects": F.array(F.struct(F.lit("x").alias("name"), F.lit("y").alias("value")))})
    aliases = spark.createDataFrame([], "alias_text string, language string, source_set_id string")
    found = {r.listing_id: (r.match_tier, r.match_method, r.gap_subject) for r in matching.match(listings, sets, cards, variants, aliases).collect()}
    assert found[1] == ("catalogue-gap", "catalogue-gap", "SM-P") and found[4] == ("catalogue-gap", "catalogue-gap", "XY-P")
    assert found[2][0] == found[3][0] == "strong" and found[2][1] == "multi-signal"


def test_rare_keys_lose_no_set(spark):
    """The sets found by keys are those of comparing all pairs, with many sets of one year, one total and one common word."""
    rows = [(i, ["en", "de"][i % 2], f"C{i}", f"Common {'Shared ' if i % 3 else ''}Name{i % 40}", None, f"{2000 + i % 2}-01-01", 100, 100 + i % 2) for i in range(120)]
    sets = spark.createDataFrame(rows, "set_id long, language string, source_set_id string, name string, series string, release_date string, total_cards int, official_cards int")
    titles = ["Pokemon common name7 1/100", "Pokemon common shared", "Pokemon german name3 5/101", "Pokemon 2000 1/100 C77", "Pokemon japanese", "Pokemon common shared name11 german"]
    listings = spark.createDataFrame(list(enumerate(titles)), "listing_id long, title string")
    year = F.struct(F.lit("year").alias("name"), F.when(F.col("listing_id") % 2 == 0, "2000").alias("value"))
    evidence = matching.build_evidence(listings.withColumns({"description": F.lit(""), "quantity": F.lit(1), "condition_id": F.lit(""), "aspects": F.array(year)}))
    aliases = spark.createDataFrame([], "alias_text string, language string, source_set_id string")
    found = matching.resolve_sets(evidence, sets, aliases)
    pairs = matching.set_pairs

    def every(e, known, limit):
        return e.select("listing_id").crossJoin(known.select("set_id"))

    matching.set_pairs = every
    try:
        wanted = matching.resolve_sets(evidence, sets, aliases).collect()
    finally:
        matching.set_pairs = pairs
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted)) and len(wanted) > 30
    met = pairs(matching.set_evidence(evidence), matching.known_sets(sets, aliases), matching.TOP_SETS).count()
    assert met < len(titles) * 120 / 2
