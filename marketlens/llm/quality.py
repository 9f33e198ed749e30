"""Operator 2: quality by weak supervision.

Ten rules each vote good (1), junk (-1) or abstain (0) on a text. How often each vote pattern occurs is counted
in Spark; at most 3^10 patterns exist, so this histogram is bounded whatever the corpus. Expectation-maximisation
over it estimates the share of good documents and each rule's accuracy in either class (votes are taken as
independent given the class), and the posterior probability of good decides.

Defined cases: null and empty text have no words, fail the base rule and are not kept; repeated rows and null
doc_id get a row each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, own, whole

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the and of to in is that it for was with as on be at by this from are or an have not "
    "le la les de des et un une que qui dans pour est pas sur au en il elle ou "
    "der die das und ist nicht ein eine mit von zu den dem auf für sich im des auch "
    "el los las y que del se por con una para es lo como más su al".split()
)
RULES = ("symbols", "duplicate_lines", "repeats", "distinct", "capitals", "function_words", "word_length", "sentences", "letters", "top_word")
#: (junk from, good up to) or, for rules where high is good, (junk up to, good from).
LIMITS = {
    "symbols": (0.1, 0.02), "duplicate_lines": (0.3, 0.0), "repeats": (0.3, 0.1), "distinct": (0.3, 0.6), "capitals": (0.3, 0.06),
    "function_words": (0.01, 0.06), "word_length": (7.0, 5.9), "sentences": (0.01, 0.04), "letters": (0.7, 0.95), "top_word": (0.25, 0.12),
}
HIGH_IS_GOOD = {"distinct", "function_words", "sentences", "letters"}
KEEP_FROM = 0.5
_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("votes", pa.string())]


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def votes_of(share: dict[str, float]) -> str:
    """One character a rule: + good, - junk, 0 abstains."""
    out = []
    for rule in RULES:
        junk, good = LIMITS[rule]
        x = share[rule]
        if rule in HIGH_IS_GOOD:
            out.append("-" if x <= junk else "+" if x >= good else "0")
        else:
            out.append("-" if x >= junk else "+" if x <= good else "0")
    return "".join(out)


def features_of(text: str | None) -> tuple[int, int, int, int, int, str]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    if not n:
        return 0, 0, symbols, dup, 0, "0" * len(RULES)
    joined = b"".join(words).decode("utf-8", "surrogatepass")
    rep, counts = repeat_words(words), Counter(words)
    letters = sum(c for w, c in counts.items() if any(map(str.isalpha, w.decode("utf-8", "surrogatepass"))))
    common = sum(c for w, c in counts.items() if len(w) < 7 and w.decode("utf-8", "surrogatepass").lower() in FUNCTION_WORDS)
    ends = sum(c for w, c in counts.items() if w[-1:] in b".!?")
    share = {
        "symbols": symbols / n, "duplicate_lines": dup / max(1, len(lines)), "repeats": rep / n, "distinct": len(counts) / n, "word_length": len(joined) / n,
        "capitals": sum(map(str.isupper, joined)) / len(joined), "function_words": common / n, "sentences": ends / n, "letters": letters / n, "top_word": max(counts.values()) / n,
    }
    votes = votes_of(share)
    if not dup:  # no duplicate line says little about a text of a line or two
        votes = votes[0] + ("+" if len(lines) > 3 else "0") + votes[2:]
    if share["sentences"] > 0.5:
        votes = votes[:7] + "-" + votes[8:]
    return n, len(joined), symbols, dup, rep, votes


_TYPE = T.StructType([T.StructField(name, T.StringType() if name == "votes" else T.LongType()) for name, _ in _FIELDS])


@F.arrow_udf(_TYPE)
def features(texts: pa.Array) -> pa.Array:
    own("quality")
    columns = list(zip(*(features_of(t.as_py()) for t in texts), strict=True)) or [[] for _ in _FIELDS]
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True)], fields=[pa.field(*f) for f in _FIELDS])


def fit(histogram: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, by EM from mild trust in every rule."""
    if not histogram:
        return {}
    patterns = sorted(histogram)
    weight = np.array([histogram[p] for p in patterns], float)
    vote = np.array([[{"+": 1, "-": -1}.get(c, 0) for c in p] for p in patterns])
    prior, good, junk = 0.8, np.full(vote.shape[1], 0.9), np.full(vote.shape[1], 0.7)
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        logit = np.log(prior / (1 - prior)) + (vote == 1) @ np.log(good / (1 - junk)) + (vote == -1) @ np.log((1 - good) / junk)
        new = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        done, post = np.abs(new - post).max() < 1e-9, new
        if done:
            break
        w1, w0 = weight * post, weight * (1 - post)
        prior = np.clip((w1.sum() + 8) / (weight.sum() + 10), 0.01, 0.99)
        # eight pseudo-votes hold a rule that says little at its start; no rule is trusted less than chance
        good = np.clip(((w1 @ (vote == 1)) + 7.2) / ((w1 @ (vote != 0)) + 8), 0.55, 0.999)
        junk = np.clip(((w0 @ (vote == -1)) + 5.6) / ((w0 @ (vote != 0)) + 8), 0.55, 0.999)
    return dict(zip(patterns, post.tolist(), strict=True))


def _posteriors(rows: DataFrame) -> dict[str, float]:
    """rows: a column votes. The histogram has at most 3^10 rows."""
    return fit({r.votes: r.n for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()})


def _failed(f: str) -> Column:
    return (F.col(f"{f}n_words") < 50) | (100 * F.col(f"{f}n_repeat_words") > 50 * F.col(f"{f}n_words"))


def _lookup(spark, posterior: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(posterior.items()), "votes string, p_good double")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, votes, p_good, base_failed, kept: one row for each row of docs."""
    measured = cut(documents(docs).select("doc_id", features("text").alias("f")).select("doc_id", "f.*"), "quality")
    table = F.broadcast(_lookup(docs.sparkSession, _posteriors(measured)))  # at most 3^10 rows
    out = measured.join(table, "votes", "left").withColumn("base_failed", _failed(""))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= KEEP_FROM))


def keep_good(docs: DataFrame) -> DataFrame:
    """All columns of the rows that judge() keeps, each row for itself also where a doc_id is repeated or null.

    Features are measured once and written beside their rows, so no text is shuffled or measured again.
    """
    measured = cut(whole(docs).withColumn("f", features(F.col("row.text").cast("string"))), "quality")
    good = [v for v, p in _posteriors(measured.select("f.votes")).items() if p >= KEEP_FROM]
    table = F.broadcast(docs.sparkSession.createDataFrame([(v,) for v in sorted(good)], "votes string"))  # at most 3^10 rows
    kept = measured.where(~_failed("f.")).join(table, F.col("f.votes") == F.col("votes"), "left_semi")
    return kept.select("row.*")
