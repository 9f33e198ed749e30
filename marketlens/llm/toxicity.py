"""Operator 9: toxicity by a weighted lexicon.

Texts are folded (lower case; full-width and mathematical letters, homoglyphs and digit substitutions to plain letters;
invisible characters and marks out; everything else to spaces) in two readings of equal length: letters with marks as
they are and 1 for i, and without marks and 1 for l. Both are matched by an Aho-Corasick automaton against stems at word starts. Stems and weights are learnt from labelled rows: stems are
prefixes of words of toxic documents, weighed by smoothed log-odds of their document frequencies among toxic and
other documents. A hit within an exception phrase (a hit with its neighbouring word that occurs in documents labelled
clean) does not count. The sum of weights, divided by the root of the number of words, goes through a logistic curve.

Bound: the model is fitted on at most LABELLED labelled documents, those whose ids have the least hashes. Nothing else
is cut: all stems that LEAST_DOCS toxic ones of these documents share are weighed, and those that weigh LEAST_WEIGHT, and LONGER more
than any shorter stem they begin with, are the lexicon, with every exception phrase.
Defined cases: null and empty text score as a text without hits; null doc_id is not held out and has no label;
repeated rows get a row each; without labelled toxic rows nothing is a hit and every score is the share of toxic labels
(zero without any label); further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_batch, cut, documents, keeps, own, pa_schema, tidy, whole

LABELLED, HELD = 50_000, 300_000
LEAST_WEIGHT, LONGER, LEAST_DOCS, LEAST_LETTERS, MOST_LETTERS = 2.5, 0.5, 5, 4, 8
THRESHOLD = 0.7
#: Look-alike letters and substitutions, each with the letter meant.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ո": "n", "օ": "o", "ս": "u", "һ": "h", "ӏ": "i", "ԛ": "q", "ԝ": "w", "ү": "y", "ø": "o", "ł": "l", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "|": "i",
}
#: Ranges of letters with marks, of letters in other forms, and of characters that show nothing.
MARKED, FORMS, INVISIBLE = ((0xC0, 0x250), (0x1E00, 0x1F00)), ((0x2100, 0x2150), (0xFF10, 0xFF5B), (0x1D400, 0x1D800)), ((0xAD, 0xAE), (0x300, 0x370), (0x200B, 0x2010), (0x2060, 0x2065), (0xFE00, 0xFE10), (0xFEFF, 0xFF00))


@functools.lru_cache(2)
def _folding(other: bool = False) -> dict[int, str | None]:
    """What is no letter goes to a space, what shows nothing goes, letters by rule and look-alikes go to their plain letter. other is the second reading."""
    table: dict[int, str | None] = {c: " " for c in range(0x2000, 0x3100)} | {c: " " for c in range(0x300) if not chr(c).isalpha()}
    for first, end in (*FORMS, *(MARKED if other else ())):
        for c in range(first, end):
            plain = unicodedata.normalize("NFKD", chr(c))[0].lower()
            if plain.isascii() and plain.isalnum():
                table[c] = LOOKALIKES.get(plain, plain)
    table |= {c: None for first, end in INVISIBLE for c in range(first, end)}
    return table | {ord(k): v for k, v in LOOKALIKES.items()} | ({ord("1"): "l", ord("|"): "l"} if other else {})


def fold(text: str | None, other: bool = False) -> str:
    return f" {(text or '').lower().translate(_folding(other))} "


def stems_of(text: str | None) -> set[str]:
    """Prefixes of LEAST_LETTERS to MOST_LETTERS letters of the words, and the words."""
    words = {w for w in fold(text).split() if len(w) >= LEAST_LETTERS}
    return {w[:k] for w in words for k in range(LEAST_LETTERS, min(len(w), MOST_LETTERS) + 1)} | words


@functools.lru_cache(4)
def _automaton(stems: tuple[tuple[str, float], ...]):
    machine = ahocorasick.Automaton()
    for stem, weight in stems:
        machine.add_word(f" {stem}", (len(stem), weight))
    if stems:
        machine.make_automaton()
    return machine


keeps("toxicity", _automaton.cache_clear)


_WORD = re.compile(r"\S+")


def hits_of(text: str | None, stems: tuple) -> list[tuple[str, str, float]]:
    """(word hit, next word, weight): the heaviest stem of each word that starts with one in either reading; words are those of the first."""
    machine, best = _automaton(stems), {}
    if not stems:
        return []
    folded, other = fold(text), fold(text, True)
    for reading in (folded,) if other == folded else (folded, other):
        for end, (length, weight) in machine.iter(reading):
            start = end - length + 1
            if weight > best.get(start, 0.0):
                best[start] = weight
    out = []
    for start, weight in sorted(best.items()):
        word = _WORD.match(folded, start)
        after = _WORD.search(folded, word.end())
        out.append((word[0], after[0] if after else "", weight))
    return out


def density_of(text: str | None, stems: tuple, exceptions: frozenset[str]) -> float:
    total = sum(weight for word, after, weight in hits_of(text, stems) if f"{word} {after}" not in exceptions)
    return total / max(20, len(fold(text).split())) ** 0.5 if total else 0.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(rows: DataFrame, function) -> DataFrame:
    """(key, n): in how many rows function(text) has the key; counted in each task, up to HELD keys at a time, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, counts = pa_schema("key string, n long"), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(function(text))
                if len(counts) > HELD:
                    yield as_batch({"key": list(counts), "n": list(counts.values())}, target)
                    counts.clear()
        if counts:
            yield as_batch({"key": list(counts), "n": list(counts.values())}, target)

    return rows.select("text").mapInArrow(tidy(run, "toxicity"), "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame) -> dict:
    """labelled: text, toxic (1 or 0). The model: stems with weights, exception phrases, logistic curve."""
    labelled = cut(labelled.select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    toxic, clean = labelled.where("toxic = 1"), labelled.where("toxic = 0")
    n1, n0 = toxic.count(), clean.count()
    prior = n1 / (n1 + n0) if n1 + n0 else 0.0
    if not n1 or not n0:
        return {"stems": (), "exceptions": frozenset(), "curve": (0.0, 0.0), "prior": prior}
    # of at most LABELLED documents, each stem in LEAST_DOCS or more of them
    t = {r.key: r.n for r in _count(toxic, stems_of).where(F.col("n") >= LEAST_DOCS).collect()}
    candidates = frozenset(t)
    c = {r.key: r.n for r in _count(clean, lambda text: stems_of(text) & candidates).collect()}
    weight = {s: float(np.log((t[s] + 0.5) / (n1 + 1)) - np.log((c.get(s, 0) + 0.5) / (n0 + 1))) for s in t}
    good = [s for s in weight if weight[s] >= LEAST_WEIGHT]
    kept: dict[str, float] = {}
    for s in sorted(good, key=lambda s: (len(s), s)):  # a longer stem adds nothing where a prefix of it is nearly as heavy
        shorter = [kept[s[:k]] for k in range(LEAST_LETTERS, len(s)) if s[:k] in kept]
        if not shorter or weight[s] > max(shorter) + LONGER:
            kept[s] = weight[s]
    stems = tuple(sorted(kept.items(), key=lambda x: (-x[1], x[0])))
    heard = _count(clean, lambda text: {f"{w} {a}" for w, a, _ in hits_of(text, stems)}).where("n >= 2").withColumnRenamed("n", "c")
    angry = _count(toxic, lambda text: {f"{w} {a}" for w, a, _ in hits_of(text, stems)}).withColumnRenamed("n", "t")
    rarer = F.col("c") / n0 > 2 * F.coalesce("t", F.lit(0)) / n1
    exceptions = frozenset(r.key for r in heard.join(angry, "key", "left").where(rarer).select("key").collect())
    density = F.arrow_udf(lambda a: pa.array([density_of(x.as_py(), stems, exceptions) for x in a], pa.float64()), "double")
    sample = labelled.select(density("text").alias("d"), "toxic").collect()  # two numbers for each labelled document
    return {"stems": stems, "exceptions": exceptions, "curve": _logistic(np.array([r.d for r in sample]), np.array([r.toxic for r in sample])), "prior": prior}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton's method, slightly damped so that separable labels have an answer."""
    design, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * len(x) * np.array([0, beta[1]]) * 0.1
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-9, ridge * len(x) * 0.1])
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score(model: dict):
    """A UDF from text to the score. What the lexicon can hold is bounded by LABELLED texts."""
    stems, exceptions, (a, b), prior = model["stems"], model["exceptions"], model["curve"], model["prior"]

    def scored(texts: pa.Array) -> pa.Array:
        own("toxicity")
        if not stems:
            return pa.array([prior] * len(texts), pa.float64())
        d = np.array([density_of(t.as_py(), stems, exceptions) for t in texts], float)
        return pa.array(1 / (1 + np.exp(-np.clip(a + b * d, -500, 500))), pa.float64())

    return F.arrow_udf(scored, "double")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Learns from the labelled rows of docs that are not held out."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    return learn(documents(docs).join(F.broadcast(known), "doc_id").select("text", "toxic"))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    rows = documents(docs).select("doc_id", score(train(docs, labels))("text").alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of the rows of docs whose score stays under THRESHOLD, each row for itself also where a doc_id is repeated or null."""
    scored = whole(docs).withColumn("score", score(train(docs, labels))(F.col("row.text").cast("string")))
    return scored.where(F.col("score") < THRESHOLD).select("row.*")
