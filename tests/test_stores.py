"""Review logs, JSON rewrites, bucketed tables, redirect chains, and functions of sources."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from marketlens.functions import values
from marketlens.operators import matching, reviews
from marketlens.sources import buckets, raw

ACTIONS = "action_id long, record_id long, action string, variant_id long, reviewer string, note string, acted_at timestamp_ntz"


def day(n):
    return dt.datetime(2001, 1, 1) + dt.timedelta(days=n)


def test_reviews_are_replayed(spark):
    opened = spark.createDataFrame([(1, "review", day(0)), (2, "flagged", day(3)), (3, "review", day(0))], "record_id long, tier string, opened_at timestamp_ntz")
    variants = spark.createDataFrame([(10,), (20,)], "variant_id long")
    rows = [
        (1, 1, "resolve", 10, "ann", "n", day(1)), (2, 1, "revoke", None, "bob", "n", day(2)), (3, 1, "dismiss", None, "cy", "n", day(4)), (4, 1, "resolve", 20, "dee", "n", day(5)), (5, 3, "resolve", 10, "ann", "n", day(2)), (6, 3, "resolve", 20, "ann", "n", day(2)),
        (7, 9, "dismiss", None, "x", "n", day(1)), (8, 1, "resolve", 99, "x", "n", day(9)), (9, 1, "resolve", None, "x", "n", day(9)), (10, 1, "close", 10, "x", "n", day(9)), (11, 1, "dismiss", None, " ", "n", day(9)), (12, 1, "dismiss", None, "x", None, day(9)), (13, 1, "revoke", None, "x", "n", None),
    ]
    good, bad = reviews.checked(spark.createDataFrame(rows, ACTIONS).repartition(3), opened, variants)
    assert {r.action_id: r.reason for r in bad.collect()} == {7: "no such review", 8: "no such variant", 9: "no variant", 10: "no such action", 11: "no reviewer", 12: "no note", 13: "no time"}
    state = lambda n: {r.record_id: (r.status, r.resolved_by, r.variant_id) for r in reviews.reviews_at(opened, good, F.lit(day(n)).cast("timestamp_ntz")).collect()}
    assert state(0) == {1: ("open", None, None), 3: ("open", None, None)}
    assert state(1)[1] == ("resolved", "ann", 10) and state(2)[1] == ("resolved", "ann", None), "a revoked choice leaves the review resolved"
    assert state(2)[3] == ("resolved", "ann", 20), "of two at one time the later action"
    assert state(4) == {1: ("dismissed", "cy", None), 2: ("open", None, None), 3: ("resolved", "ann", 20)} and state(9)[1] == ("resolved", "dee", 20)
    assert [(r.revision, r.action, r.variant_id) for r in sorted(reviews.revisions(good).where("record_id = 1").collect(), key=lambda r: r.revision)] == [(1, "activate", 10), (2, "revoke", None), (3, "dismiss", None), (4, "activate", 20)]


def test_json_set(spark):
    def put(text, path, value):
        node, names = json.loads(text), path[2:].split(".")
        if not isinstance(node, dict):
            return node
        whole = node
        for name in names[:-1]:
            if not isinstance(node.setdefault(name, {}), dict):
                return whole
            node = node[name]
        node[names[-1]] = value
        return whole

    texts = ['{"a": 1, "b": {"c": [1, {"d": null}], "e": "x"}}', "{}", '{"b": 5}', "[1, 2]", "7", '{"é": "ü", "a.b": 2}', '{"a": null}']
    df = spark.createDataFrame([(t,) for t in [*texts, None, "{broken"]], "t string")
    for path, value in (("$.a", "new"), ("$.b.c", "deep"), ("$.b.x.y", "made"), ("$.z", None)):
        found = {r.t: r.x for r in df.select("t", values.json_set(F.col("t"), path, F.lit(value).cast("string")).alias("x")).collect()}
        assert {t: json.loads(found[t]) for t in texts if value is not None} == {t: put(t, path, value) for t in texts if value is not None}
        assert found[None] is None and found["{broken"] is None
    number = df.select(values.json_set(F.lit('{"b": 1, "a": 2}'), "$.c", F.lit(3)).alias("x")).head().x
    assert json.loads(number) == {"b": 1, "a": 2, "c": 3}
    rows = spark.createDataFrame([(1, '{"x": [true, {"a": 1}, "s"], "y": {"k": 1.5}}'), (2, "[]"), (3, None), (4, "5")], "i int, t string")
    assert [(r.i, r.at, r.key, r.value) for r in values.json_each(rows, "t", ["i"], "$.x").orderBy("i", "at").collect()] == [(1, 0, None, "true"), (1, 1, None, '{"a":1}'), (1, 2, None, '"s"')]
    assert sorted((r.i, r.key) for r in values.json_each(rows, "t", ["i"]).collect() if r.key) == [(1, "x"), (1, "y")]


def size(folder):
    return sum(os.path.getsize(os.path.join(root, f)) for root, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_buckets(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 500).alias("parent"), "id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    store = buckets.BucketedTable(spark, f"file://{tmp_path}", rows.schema, "parent", 32)
    assert store.read().count() == 0 and len(store.replace(rows)) == 32
    first, before, held = size(tmp_path), store.read(), store.children([7])
    assert held.count() == 8 and before.count() == 4000
    fresh = spark.createDataFrame([(7, 1, "new")], rows.schema)
    touched = spark.createDataFrame([(7,), (8,)], "parent long")
    written = store.replace(fresh, touched)
    assert 1 <= len(written) <= 2 and size(tmp_path) - first < first * 4 / 32, "only the touched buckets are written"
    now = store.read()
    assert now.count() == 4000 - 15 and [(r.parent, r.x) for r in now.where("parent in (7, 8)").collect()] == [(7, "new")]
    assert before.count() == 4000, "a reader keeps its generation"
    every = now.select("parent").distinct()
    store.replace(now.limit(0), every)
    assert store.read().count() == 0 and store.replace(fresh.limit(0)) == []
    for n in range(4):
        store.replace(spark.createDataFrame([(n, n, "y")], rows.schema))
    assert sorted(r.id for r in store.read().collect()) == [0, 1, 2, 3]
    assert len([f for f in os.listdir(tmp_path) if f.startswith("gen=")]) <= 6


def test_redirect_chains(spark):
    titles = spark.createDataFrame([(t,) for t in ("a", "b", "x", "s", "end", "two", "a")], "title string")
    hops = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s"), ("two", "q"), ("two", "p"), (None, "a"), ("d", None)] + [(f"n{i}", f"n{i + 1}") for i in range(150)]
    titles = titles.unionByName(spark.createDataFrame([("n0",)], "title string"))
    found = {r.title: (r.canonical, r.hops, r.chain) for r in raw.redirect_chains(titles, spark.createDataFrame(hops, "source string, target string")).collect()}
    assert found.pop("n0")[:2] == ("n150", 150)
    assert found == {"a": ("d", 3, ["a", "b", "c", "d"]), "b": ("d", 2, ["b", "c", "d"]), "x": ("x", 2, ["x", "y", "x"]), "s": ("s", 1, ["s", "s"]), "end": ("end", 0, ["end"]), "two": ("p", 1, ["two", "p"])}


def test_sources_that_nothing_else_calls(spark, tmp_path):
    stub = [("base1", "Base", [("base1-1", "1", "Alakazam", "u1"), ("base1-2", "2", "Blastoise", None)]), ("empty", "None", [])]
    sets = spark.createDataFrame(stub, "id string, name string, cards array<struct<id:string,localId:string,name:string,image:string>>")
    assert [(r.source_set_id, r.at, r.source_card_id, r.local_id, r.image) for r in raw.sets_and_cards(sets).orderBy("at").collect()] == [("base1", 0, "base1-1", "1", "u1"), ("base1", 1, "base1-2", "2", None)]
    images = raw.card_images(spark.createDataFrame([(1, "http://i/a/"), (2, "http://i/b"), (3, None)], "card_id long, image string"))
    urls = {r.place: r.url for r in images.where("card_id = 1").collect()}
    stored = spark.createDataFrame([(urls[4],), (urls[2],), ("http://i/b/none",)], "url string")
    assert [(r.card_id, r.place) for r in raw.first_available(images, stored).collect()] == [(1, 2)]
    graded = spark.createDataFrame([("PSA", 10.0), ("psa grading", 10.0), ("PSA", 9.0), ("upsale", 10.0), (None, 10.0)], "g string, n double").select(matching.is_psa10(F.col("g"), F.col("n")).alias("x"))
    assert [bool(r.x) for r in graded.collect()] == [True, True, False, False, False]
