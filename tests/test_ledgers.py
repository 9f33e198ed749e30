"""Folds, walks and dirty sets against plain loops."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from marketlens.operators import folds
from marketlens.streaming import dirty, history

DAY = dt.datetime(2001, 1, 1)


def loop(rows, after):
    """The runner: one attempt after the other, a sleep after so many failures in a row, an end at the first rate limit."""
    out, failures, halted = {}, {}, set()
    for key, _, n, failed, limited in sorted(rows, key=lambda r: (r[0], r[2])):
        if key in halted:
            out[key, n] = (True, None, None)
            continue
        failures[key] = failures.get(key, 0) + 1 if failed else 0
        out[key, n] = (False, failures[key], failures[key] == after)
        if failures[key] == after:
            failures[key] = 0
        if limited:
            halted.add(key)
    return out


def test_queue_runs_are_the_loops(spark):
    for seed in range(4):
        rng = random.Random(seed)
        rows = []
        for key in "abcd":
            at = 0
            for n in range(rng.choice([1, 5, 150])):
                at += rng.choice([0, 1, 1, 30])
                failed = rng.random() < rng.choice([0.2, 0.9, 1.0])
                rows.append((key, at // 10, n, failed, failed and rng.random() < 0.01))
        df = spark.createDataFrame(rows, "queue string, bucket int, n int, failed boolean, limited boolean").repartition(4)
        for after in (1, 3):
            found = folds.queue_runs(df, ["queue"], "bucket", ["n"], F.col("failed"), F.col("limited"), after).collect()
            assert len(found) == len(rows) and {(r.queue, r.n): (r.halted, r.run, r.cooldown) for r in found} == loop(rows, after)


def walk(h, pages, sales, known, now, budget, most):
    """One history as the collector walks it."""
    history_id, cutoff, complete, fetched, audited = h
    due = cutoff is None and (not complete or audited is None or now - audited >= dt.timedelta(days=30))
    incremental = cutoff is None and complete and not due
    page, spent, overlap, evidence, done = (fetched or 0) if not complete else 0, 0.0, 0, None, False
    first, walked, seen = page + 1, 0, 0
    for page in range(first, most + 1):
        if (history_id, page) not in pages:
            page -= 1
            break
        mine, spent, walked = sales.get((history_id, page), []), spent + pages[history_id, page], walked + 1
        if not mine:
            evidence, done = "source_exhausted", True
            break
        seen += len(mine)
        if incremental:
            overlap = overlap + 1 if all((history_id, s) in known for s, _ in mine) else 0
            if overlap >= 2:
                evidence, done = "known_overlap", True
        if cutoff is not None and min(d for _, d in mine) < cutoff:
            evidence, done = "user_cutoff", True
        if done:
            break
        if spent >= budget:
            evidence = "time_budget"
            break
    else:
        page = most if first <= most else first - 1
    if not done and walked and page >= most:
        evidence = "page_cap_reached"
    if not incremental and cutoff is None:
        audited = now
    return walked, page if walked else first - 1, seen, evidence, done, audited


def test_walks_are_the_collectors(spark):
    rng, now = random.Random(7), dt.datetime(2001, 6, 1)
    histories, pages, sales, known = [], {}, {}, set()
    for h in range(120):
        complete = rng.random() < 0.6
        histories.append((h, rng.choice([None, None, dt.date(2001, 2, 1)]), complete, rng.choice([None, 0, 2]) if not complete else 3, rng.choice([None, now - dt.timedelta(days=5), now - dt.timedelta(days=30), now - dt.timedelta(days=90)])))
        last, day, odds = rng.randrange(0, 9), dt.date(2001, 5, 1), rng.choice([0.0, 0.7, 1.0])
        for page in range(1, last + 1 + rng.choice([0, 1])):
            pages[h, page] = float(rng.choice([1, 5, 11]))
            if page <= last:
                sales[h, page] = [(f"{page}-{k}", day - dt.timedelta(days=20 * page + k)) for k in range(3)]
                known |= {(h, s) for s, _ in sales[h, page] if rng.random() < odds}
    found, taken = history.walk(
        spark.createDataFrame(histories, "history_id int, cutoff date, complete boolean, pages_fetched int, audited_at timestamp_ntz"), spark.createDataFrame([(h, p, s) for (h, p), s in pages.items()], "history_id int, page int, seconds double"),
        spark.createDataFrame([(h, p, s, d) for (h, p), rows in sales.items() for s, d in rows], "history_id int, page int, sale_id string, sale_date date"), spark.createDataFrame(sorted(known), "history_id int, sale_id string"),
        F.lit("2001-06-01 00:00:00").cast("timestamp_ntz"), 20.0, 6,
    )
    got = {r.history_id: (r.walked, r.pages_fetched, r.seen, r.evidence, r.complete, r.audited_at) for r in found.collect()}
    assert got == {h[0]: walk(h, pages, sales, known, now, 20.0, 6) for h in histories}
    assert len({g[3] for g in got.values()}) == 6 and taken.count() == sum(g[0] for g in got.values())


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def test_refs_marked_again_stay_dirty(spark, tmp_path):
    waiting, seen = dirty.DirtySet(spark, f"file://{tmp_path}/d"), []
    marks = lambda *rows: spark.createDataFrame([(r, at(s)) for r, s in rows], dirty.MARKS)

    def rebuild(refs):
        mine = sorted(r.ref for r in refs.collect())
        seen.append(mine)
        return marks(("a", 50), ("b", 1)) if mine == ["a", "b"] else None

    waiting.tick(0, marks(("b", 2), ("a", 1), ("c", 9), ("a", 0)), rebuild, 2)
    assert seen == [["a", "b"]] and sorted((r.ref, r.marked_at) for r in waiting.rows().collect()) == [("a", at(50)), ("c", at(9))]
    waiting.tick(0, marks(("z", 3)), rebuild, 2)
    assert len(seen) == 1, "a tick that runs again does nothing"
    assert waiting.drain(rebuild, 1) == 2 and seen[1:] == [["c"], ["a"]] and waiting.last_tick() == 2
    waiting.tick(3, marks(), rebuild, 5)
    assert waiting.rows().isEmpty()


def test_a_stream_of_marks_goes_on_after_a_restart(spark, tmp_path):
    waiting, seen, arriving = dirty.DirtySet(spark, f"file://{tmp_path}/d"), [], f"{tmp_path}/in"

    def rebuild(refs):
        seen.extend(sorted(r.ref for r in refs.collect()))

    for start in (0, 10):
        spark.createDataFrame([(f"r{i}", at(i)) for i in range(start, start + 10)], dirty.MARKS).coalesce(1).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(dirty.MARKS).option("maxFilesPerTrigger", 1).parquet(arriving)
        waiting.follow(stream, rebuild, 7, f"{tmp_path}/offsets")
    waiting.drain(rebuild, 7)
    assert sorted(seen) == sorted(f"r{i}" for i in range(20)) and waiting.rows().isEmpty()
