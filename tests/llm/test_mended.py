"""Columns of any name, rows alike but for further columns, long WARC headers, lexicon by a plain computation, folders of a thread."""

from __future__ import annotations

import math
import random
import threading

import pytest
from pyspark.sql import functions as F

from marketlens.llm import common, quality, simhash, substring, toxicity, warc

CLASH = "doc_id long, text string, row string, f string, votes string, score double, __score double, key string, __key string, ord long, tag long, hash long, runs string, new string, place int, `a.b` string, __f string, __bucket int"
NAMES = ["doc_id", "text", "row", "f", "votes", "score", "__score", "key", "__key", "ord", "tag", "hash", "runs", "new", "place", "a.b", "__f", "__bucket"]


def wide(spark, rows):
    rest = ("r", "f", "v", 1.5, 2.5, "k", "kk", 3, 4, 5, "runs", "n", 6, "dot", "ff", 7)
    return spark.createDataFrame([(*r, *rest) for r in rows], CLASH).repartition(3), rest


def test_columns_of_any_name_stay(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    good = "A plain sentence with several quite common words stands here, and it goes on for a while. " * 6
    df, rest = wide(spark, [(1, good + "one"), (2, passage), (3, passage + " tail"), (None, good + "null"), (4, "short")])
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for out in (quality.keep_good(df), toxicity.keep_clean(df, labels), simhash.keep_one(df), substring.strip(df)):
        assert out.columns == NAMES
        rows = out.collect()
        assert rows and all(tuple(r)[2:] == rest for r in rows)


def test_rows_alike_but_for_further_columns(spark):
    rows = [(1, "same text of some words", x) for x in ("b", "a", "c")] + [(1, "same text of some words", "a")]
    for parts in (1, 3):
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(parts)).collect()
        assert len(kept) == 1
        seen = {kept[0].more} if parts == 1 else seen | {kept[0].more}
    assert len(seen) == 1


def test_long_headers(spark, tmp_path):
    url = "http://x/" + "".join(random.Random(1).choices("abcdefghijklmnop0123456789", k=3_000_000))
    rows = [(1, "http://a", "one"), (2, url, "two" * 900), (3, "http://c", None)]
    found = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w"))
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in found.collect()) == [(i, u, h or "") for i, u, h in rows]


def test_lexicon_by_a_plain_computation(spark):
    rng = random.Random(4)
    words = ["plain", "common", "garden", "weather", "dreadfulness", "dreadful", "nastiest", "nasty", "incompletely", "x", "antidisestablishmentarianism"]
    rows = []
    for _ in range(300):
        toxic = rng.random() < 0.3
        rows.append((" ".join(rng.choices(words[:4] + (words[4:8] + words[10:] if toxic else words[8:10]), k=9)), int(toxic)))
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))

    def stems(text):
        w = {x for x in text.split() if len(x) >= 4}
        return {x[:k] for x in w for k in range(4, min(len(x), 8) + 1)} | w

    n1, n0 = sum(t for _, t in rows), sum(1 - t for _, t in rows)
    t, c = {}, {}
    for text, toxic in rows:
        for s in stems(text):
            (t if toxic else c)[s] = (t if toxic else c).get(s, 0) + 1
    weight = {s: math.log((n + 0.5) / (n1 + 1)) - math.log((c.get(s, 0) + 0.5) / (n0 + 1)) for s, n in t.items() if n >= toxicity.LEAST_DOCS}
    wanted = {}
    for s in sorted((s for s, w in weight.items() if w >= toxicity.LEAST_WEIGHT), key=lambda s: (len(s), s)):
        below = [wanted[s[:k]] for k in range(4, len(s)) if s[:k] in wanted]
        if not below or weight[s] > max(below) + toxicity.LONGER:
            wanted[s] = weight[s]
    found = dict(model["stems"])
    assert set(found) == set(wanted) and len(found) >= 3 and all(found[s] == pytest.approx(w) for s, w in wanted.items())
    assert "antidisestablishmentarianism" in toxicity.stems_of("antidisestablishmentarianism")


def test_folders_of_a_thread(spark):
    with common.collected() as mine:
        mark = common.scratch(spark, "mine")
        other = threading.Thread(target=lambda: common.scratch(spark, "other"))
        other.start()
        other.join()
    common.scratch(spark, "later")
    assert mine == [mark]
    spark.range(3).write.parquet(mark)
    common.delete(spark, mine)
    with pytest.raises(Exception):
        spark.read.parquet(mark).count()
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_no_side_of_the_anchor_join_goes_through_the_driver(spark, tmp_path):
    spark.range(3000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/classes")
    for level in (0, 3):
        found = simhash.links(spark.read.parquet(f"{tmp_path}/classes"), level)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [anchor" in plan and "Broadcast" not in plan, plan
