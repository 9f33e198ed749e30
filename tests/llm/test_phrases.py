"""Phrase mining against a plain count of all phrases, over chunks and documents that are split."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from marketlens.llm import phrases

SCHEMA = "doc_id long, text string, lang string, id long, phrase string, f long, n long"


def plain(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        found = []
        for p in candidates:
            longer = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * f[q] >= 80 * f[p] for q in longer):
                continue
            score, _, l, r = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in phrases.mine(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng, words = random.Random(5), ["the", "The", "New", "york", "city", "é", "漢字", "İ", "\x1c", "\xa0x", "a", "ǅ"]
    texts = ["new york city hall is. " * 9, "a a a a a a a,a", None, "", " \t", "!!..", "same line\nsame line\r\n\x0bsame\tline", "x" * 5000]
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 40))) + rng.choice(["", ".", "!\n", ", end"]) for _ in range(150)]
    return [(t, rng.choice(["en", "de", None, "und", ""])) for t in texts] * 2


@pytest.mark.parametrize("how", [{}, {"chunk_bytes": 300}, {"chunk_bytes": 300, "most_words": 7}, {"top": 5}])
def test_phrases(spark, rows, how):
    df = spark.createDataFrame([(None if i % 5 == 0 else i, t, lang, 1, "x", 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    wanted = plain(rows, 6, how.get("top", 2000))
    assert len(wanted) > (15 if "top" in how else 60) and mined(df, least=6, **how) == wanted


def test_phrases_of_hot_words_and_nothing(spark):
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.mine(spark.createDataFrame([(1, "only once", "en", 1, "x", 1, 1)], SCHEMA)).count() == 0
    hot = [("again and again " * 400, "en")] * 30 + [(f"rare{i} words{i}", "en") for i in range(300)]
    df = spark.createDataFrame([(i, t, lang, 1, "x", 2, 3) for i, (t, lang) in enumerate(hot)], SCHEMA).repartition(16)
    assert mined(df, chunk_bytes=2000) == plain(hot, 30, 2000)


def test_cuts_are_exact(spark):
    """Products that pass 64 bits, quotients next to an integer, the shortest first part on ties."""
    cases = [(10**15 + 7, 10**15 + 7, 10**15 + 8), (3, 6, 7), (10**17, 10**17, 2 * 10**17), (499_999_999_999, 999_999_999_999, 10**12)]
    grams = spark.createDataFrame([(a, [l], [r]) for a, l, r in cases], "f long, pre array<long>, suf array<long>")
    assert [r["cut"]["score"] for r in phrases.scored(grams, 2).collect()] == [2_000_000 * a // (l + r) for a, l, r in cases]
    tied = spark.createDataFrame([(30, [40, 50, 35], [35, 50, 40])], "f long, pre array<long>, suf array<long>")
    assert tuple(phrases.scored(tied, 4).first()["cut"]) == (2_000_000 * 30 // 100, 2, 50, 50)
    tied = spark.createDataFrame([(30, [40, 45, 50], [40, 45, 50])], "f long, pre array<long>, suf array<long>")
    assert phrases.scored(tied, 4).first()["cut"]["k"] == 1


def test_packing_of_numbers():
    for ids in (np.zeros(0, np.int64), np.array([0, 1, -1, 1 << 30, -(1 << 62)]), np.arange(100_000)):
        assert phrases.unpacked(phrases.packed(ids)).tolist() == ids.tolist()
        assert [c.tolist() for c in phrases.unpacked_all(phrases.packed_all([ids, ids[::-1]]))] == [ids.tolist(), ids[::-1].tolist()]
    left, right = np.arange(1000) << 40, np.arange(1000)[::-1]
    shards = phrases.shard_of(left, right, 7)
    assert set(shards.tolist()) == set(range(7)) and np.bincount(shards).min() > 90
