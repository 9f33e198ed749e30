"""Findings of the third round: what each one was about, on tables small enough for a test."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from marketlens.operators import matching, reviews
from marketlens.plans.library import ORACLES, QUERIES
from tests.oracle import connection, oracle_rows, rows_of

SMALL = "/root/testdata/sf0.001"


def folder_with(path, **tables) -> str:
    """A folder of the driver's smallest tables in which the named ones are others."""
    for f in os.listdir(SMALL):
        if f.removesuffix(".parquet") not in tables:
            os.symlink(f"{SMALL}/{f}", f"{path}/{f}")
    for name, df in tables.items():
        df.toPandas().to_parquet(f"{path}/{name}.parquet", coerce_timestamps="us")
    return str(path)


def same(spark, name: str, folder: str) -> None:
    assert rows_of(spark, QUERIES[name], folder) == oracle_rows(connection(folder), ORACLES[name])


def test_asset_urls_of_numbers_wider_than_their_set(spark, tmp_path):
    part = spark.range(60).selectExpr("id * 3001 as p_partkey", "'hot bolt' as p_name", "'Brand#1' as p_brand", "'SMALL' as p_type", "cast(id % 50 as int) as p_size", "1D as p_retailprice")
    same(spark, "asset_urls", folder_with(tmp_path, part=part))


def test_prefixes_behind_letters_beyond_ascii(spark, tmp_path):
    texts = ["\u00e9lan\u00e9BER81 x", "\u00fcN73\u00fc", "#12\u00e9 \u00e9RE-33", "plain AB12 25/102", "AB12_ _AB13", None]
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    same(spark, "extract_numbers", folder_with(tmp_path, documents=documents))


def test_sets_that_share_a_code_or_a_name_are_not_all_met(spark):
    """Two hundred sets of one code and two hundred whose names share all tokens but one; only those that can win are scored."""
    sets = [(i, ("ja", "en")[i % 2], "AX-P" if i < 200 else f"SX{i}", f"Great Hall Q{i}" if i < 200 else f"Blue Moon Q{i}", None, f"{1999 + i % 5}-05-01", 90 + i % 3, 90 + i % 4) for i in range(400)]
    sets = spark.createDataFrame(sets, "set_id long, language string, source_set_id string, name string, series string, release_date string, total_cards int, official_cards int")
    aliases = spark.createDataFrame([], "alias_text string, language string, source_set_id string")
    titles = ["Pokemon Pikachu 4/AX-P Japanese", "Pokemon Pikachu 4/AX-P", "Pokemon Pikachu 4/91 Blue Moon", "Pokemon 4/AX-P Great Hall 4/91 Japanese", "Pokemon Blue Moon Q250 SX320", "Pokemon 4/AX-P Great Hall Q77", "Pikachu"]
    rows = [(i, t, None, 1, None, [("Year", str(2000 + i % 3))] if i % 2 else []) for i, t in enumerate(titles)]
    listings = spark.createDataFrame(rows, "listing_id long, title string, description string, quantity int, condition_id string, aspects array<struct<name:string,value:string>>")
    evidence = matching.build_evidence(listings)
    known = matching.known_sets(sets, aliases)
    pairs = matching.set_pairs(matching.set_evidence(evidence), known, 8).groupBy("listing_id").count().collect()
    assert all(r["count"] < 200 for r in pairs), pairs
    found = {(r.listing_id, r.place): (r.set_id, r.set_score) for r in matching.resolve_sets(evidence, sets, aliases).collect()}
    every = {(r.listing_id, r.place): (r.set_id, r.set_score) for r in matching.resolve_sets(evidence, sets, aliases, 400).collect() if r.place <= 8}
    assert found == every and len(found) > 40


def test_actions_without_a_variant_do_not_meet_in_one_task(spark):
    actions = spark.range(4000).selectExpr("id as action_id", "id % 50 as record_id", "if(id % 4 = 0, 'resolve', 'dismiss') as action", "if(id % 8 = 0, id % 40, null) as variant_id", "'r' as reviewer", "'seen' as note", "timestamp_seconds(id) as acted_at")
    opened = spark.range(50).selectExpr("id as record_id", "'review' as tier", "timestamp_seconds(0) as opened_at")
    variants = spark.range(20).selectExpr("id * 8 as variant_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        good, bad = reviews.checked(actions, opened, variants)
        most = good.unionByName(bad.drop("reason")).where("variant_id is null").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 1500 and good.count() + bad.count() == 4000
        states = reviews.reviews_at(opened, good, F.timestamp_seconds(F.lit(5000)))
        assert "Window" not in states._jdf.queryExecution().executedPlan().toString() and states.where("status = 'dismissed'").count() == 45
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_json_is_parsed_once_for_each_rewrite(spark):
    plan = QUERIES["json_rewrites"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 8


def test_pairs_of_one_key_are_dealt_out(spark, tmp_path):
    supplier = spark.range(1200).selectExpr("id * 50 as s_suppkey", "'x' as s_name", "1 as s_nationkey", "1D as s_acctbal")
    part = spark.range(300).selectExpr("id * 10 as p_partkey", "'hot bolt' as p_name", "if(id = 9, null, 'Brand#1') as p_brand", "if(id % 3 = 0, 'ECONOMY', 'SMALL') as p_type", "1 as p_size", "cast(id * 10 as double) as p_retailprice")
    folder = folder_with(tmp_path, supplier=supplier, part=part)
    pairs = QUERIES["blocking_union"](spark, folder)
    most, every = pairs.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert every > 300_000 and most < every / 4
    same(spark, "blocking_union", folder)
    same(spark, "weighted_score_decide", folder)
    parts = QUERIES["weighted_score_decide"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in parts


def test_walks_number_the_lines_once(spark):
    plan = QUERIES["history_walk"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan


def test_no_step_of_the_chain_plans_those_before_it(spark, monkeypatch):
    sizes = {}

    def planned(df, name):
        sizes[name] = len(df._jdf.queryExecution().analyzed().toString().splitlines())
        return spark.createDataFrame([], df.schema)

    monkeypatch.setattr(matching, "settled", planned)
    planned(QUERIES["match_chain"](spark, SMALL), "decided")
    assert len(sizes) > 5 and max(sizes.values()) < 300, sizes


def test_no_hop_of_a_redirect_goes_through_the_driver(spark):
    plan = QUERIES["redirect_chains"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_report_rows_of_one_wording_meet_the_cards_once(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(matching, "settled", lambda df, name: written.setdefault(name, df))
    sets = spark.createDataFrame([(1, "ja", "SV8"), (2, "en", "SV8")], "set_id long, language string, source_set_id string")
    cards = spark.range(40).selectExpr("id as card_id", "1L as set_id", "if(id < 30, '08', '9') as local_id", "if(id in (7, 8, 31), 'Dark Squirtle', 'Nobody') as name")
    wording = [("Squirtle", None, "8"), ("Nobody", None, "008"), ("Squirtle-Holo", None, "9"), ("Squirtle", "French", "9"), ("Squirtle", None, None), (None, "German", "9"), (None, None, None)]
    rows = [(i, "SV8" if i % 9 else None, "ja", *wording[i % 7]) for i in range(1, 700)]
    table = spark.createDataFrame(rows, "row_id long, source_set_id string, language string, subject string, variety string, number string")
    found = {r.row_id: (r.match_status, r.card_id) for r in matching.match_report_rows(table, cards, sets).collect()}
    assert written["wordings"].count() == 14 and len(found) == 699
    expected = [("ambiguous", None), ("ambiguous", None), ("matched", 31), ("skipped", None), ("unmatched", None), ("unmatched", None), ("unmatched", None)]
    assert found == {i: expected[i % 7] if i % 9 or i % 7 == 3 else ("unmatched", None) for i in range(1, 700)}


def test_texts_are_read_once_and_counted_where_they_are(spark, tmp_path):
    texts = ["red fox in the old wood", "the the of of an x", "Red FOX; old-wood 12", None, "", "a b c", "fox"]
    documents = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")  # ids and rows repeat
    benchmark = spark.createDataFrame([(1, "red fox wood"), (1, "old fox"), (2, "the of an"), (2, "the of an"), (3, "x y"), (4, None), (5, "nothing alike here at all")], "item_id long, text string")
    folder = folder_with(tmp_path, documents=documents, benchmark=benchmark)
    same(spark, "token_jaccard", folder)
    plan = QUERIES["token_jaccard"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and plan.count("Relation [") == 2, plan
