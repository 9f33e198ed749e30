"""Operator 8: substring dedup over windows of 20 words by Rabin-Karp hashes.

A word is removed where a window of 20 consecutive words covers it whose word sequence also starts earlier: in a
smaller doc_id, or in the same document further ahead. Every window has a Rabin-Karp hash (64 bits, an odd base,
words hashed by XXH64). Counting all of them would move several times the corpus, so Spark counts in two steps:

1. of the sixteen 5-word hashes inside each window, the least one; equal windows have equal least hashes, so a
   window whose least hash occurs once in the corpus is not repeated. These are about a seventh as many.
2. of the windows left, all hashes; each occurrence but the first of a hash that occurs twice is removed. Within a
   batch only the first occurrence is sent; later ones are removed by what the batch itself shows, as runs. Of windows
   whose least hash is in HOT or more documents a task sends only what comes before all that it has sent, and as it
   meets documents in order, a passage that fills the corpus costs about one row for each task.

Of rows with the same whole text only the first goes through step 2; the others lose every word (from 20 words on).
Overlapping removed windows merge into maximal intervals as they are applied.

Defined cases: null and empty text have no words; null doc_id comes after all others (the id 2^63-1 is reserved for
it); rows with the same doc_id are one document for the order, so identical rows remove nothing from each other;
rows keep their number; further columns are ignored. Windows are taken as equal where two hashes of different bases
agree, 64 and 31 bits: below one expected case up to about 2e14 windows. Texts of one ord are told apart by a tag: zero
where the ord has one text, else the text's 64-bit hash (below one expected case up to about 6e9 texts of one ord).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, as_batch, cut, keeps, own, pa_schema, salted, tidy, whole, words_of

WINDOW, INNER = 20, 5
LAST = (1 << 63) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SLICE, AT_ONCE = 1024, 32 << 20
WHOLE = 1 << 30
BUCKETS = 1 << 18
#: Documents with a least hash, from which on tasks remember the windows that have it; most windows that they remember.
HOT, REMEMBERED = 2000, 1 << 18
#: Texts of fewer bytes have fewer than WINDOW words.
LEAST_BYTES = 2 * WINDOW - 1


@functools.lru_cache(1)
def _word_hashes() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w, 0x5EED))


keeps("substring", _word_hashes.cache_clear)


class _Powers:
    """Powers of a base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in zip(("up", "down"), self.bases, strict=True):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = tuple(map(_Powers, BASES))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def rolling(hashes: np.ndarray, length: int, powers: _Powers) -> np.ndarray:
    """The Rabin-Karp hash of each window of so many words."""
    n = len(hashes)
    up, down = powers.to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return _mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))


def least_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all windows of INNER words, and for each window of WINDOW words the least of them in it."""
    if len(hashes) < WINDOW:
        return (np.zeros(0, np.uint64),) * 2
    least = inner = rolling(hashes, INNER, _powers[0])
    span = WINDOW - INNER + 1
    width = 1
    while width < span:  # running minimum of `span` values by doubling
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return inner, least


def _least_rows(batches):
    """(m, ord, tag, twice): the distinct least hashes of each document, and whether one stands at two places."""
    target = pa_schema("m long, ord long, tag long, twice boolean")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            ms, ords, tags, twices = [], [], [], []
            for text, ord_, tag in zip(*(batch.slice(at, SLICE).column(c).to_pylist() for c in ("text", "ord", "tag")), strict=True):
                inner, least = least_hashes(word_hashes(words_of(text)))
                if len(least):
                    m, by = np.unique(least), np.sort(inner)
                    ms.append(m)
                    ords.append(np.full(len(m), ord_, np.int64))
                    tags.append(np.full(len(m), tag, np.int64))
                    twices.append(np.searchsorted(by, m, "right") - np.searchsorted(by, m) > 1)
            if ms:
                yield pa.record_batch([pa.array(np.concatenate(ms).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (ords, tags, twices))], schema=target)


class _First:
    """The first place that this task has sent of each hot window; forgotten as a whole beyond REMEMBERED, which only costs rows."""

    def __init__(self):
        self.places: dict[tuple[int, int], tuple[int, int]] = {}

    def news(self, keys: Iterator[tuple[int, int]], places: Iterator[tuple[int, int]]) -> tuple[list[bool], list[bool]]:
        """(whether to send each, whether it stands after one sent)."""
        send, after = [], []
        for key, place in zip(keys, places, strict=True):
            known = self.places.get(key)
            send.append(known is None or place < known)
            after.append(known is not None and place > known)
            if send[-1]:
                if len(self.places) >= REMEMBERED:
                    self.places.clear()
                self.places[key] = place
        return send, after


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of up to AT_ONCE bytes or one that is larger; the more documents are seen together, the fewer rows are sent."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > AT_ONCE:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def _window_rows(batches):
    """(key, ord, tag, at): windows to compare, at = second hash and place; and as rows of negative at the runs that the task itself shows to be repeats: -1 - (length and place)."""
    target, first_sent = pa_schema("key long, ord long, tag long, at long"), _First()
    for batch in _larger(batches):
        columns = [batch.column(c).to_pylist() for c in ("text", "ord", "tag", "ms", "hot")]
        hashes, second, where, row, hot = [], [], [], [], []
        for i, (text, ms, hs) in enumerate(zip(columns[0], columns[3], columns[4], strict=True)):
            of_words = word_hashes(words_of(text))
            _, least = least_hashes(of_words)
            at = np.flatnonzero(np.isin(least, np.array(ms, np.int64).view(np.uint64)))
            hashes.append(rolling(of_words, WINDOW, _powers[0])[at])
            second.append(rolling(of_words, WINDOW, _powers[1])[at] >> np.uint64(33))
            where.append(at)
            row.append(np.full(len(at), i))
            hot.append(np.isin(least[at], np.array(hs, np.int64).view(np.uint64)) if hs else np.zeros(len(at), bool))
        if not sum(map(len, hashes)):
            continue
        h, c, pos, row, hot = np.concatenate(hashes), np.concatenate(second), np.concatenate(where).astype(np.int64), np.concatenate(row), np.concatenate(hot)
        ords, tags = np.array(columns[1], np.int64), np.array(columns[2], np.int64)
        order = np.lexsort((pos, ords[row], c, h))
        hs, cs, ps, rs, hot = h[order], c[order], pos[order], row[order], hot[order]
        new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (ords[rs] > ords[rs[first]]) | (ps > ps[first])
        sent = ~later
        known = np.flatnonzero(new & hot)
        if len(known):
            send, after = first_sent.news(zip(hs[known].tolist(), cs[known].tolist(), strict=True), zip(ords[rs[known]].tolist(), ps[known].tolist(), strict=True))
            group = np.cumsum(new) - 1  # what goes for the first of a window goes for all its occurrences here
            quiet, repeat = np.zeros(group[-1] + 1, bool), np.zeros(group[-1] + 1, bool)
            quiet[group[known]], repeat[group[known]] = ~np.array(send), after
            sent &= ~quiet[group]
            later |= repeat[group]
        n = int(sent.sum())
        yield pa.record_batch([pa.array(hs[sent].view(np.int64)), pa.array(ords[rs[sent]]), pa.array(tags[rs[sent]]), pa.array(cs[sent].view(np.int64) << 32 | ps[sent])], schema=target)
        p, r = ps[later], rs[later]
        order = np.lexsort((p, r))
        p, r = p[order], r[order]
        if len(p):
            start = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1))))
            length = np.diff(np.concatenate((start, [len(p)])))
            r, p = r[start], p[start]
            yield pa.record_batch([pa.array(p << 32 ^ ords[r] ^ tags[r]), pa.array(ords[r]), pa.array(tags[r]), pa.array(-1 - (length << 32 | p))], schema=target)


def _ord(of: str = "") -> Column:
    return F.coalesce(F.col(f"{of}doc_id").cast("long"), F.lit(LAST))


def _hash(of: str = "") -> Column:
    return F.xxhash64(F.col(f"{of}text").cast("string"))


def _marks(docs: DataFrame) -> DataFrame:
    """ord, hash and digest of each row's text; texts that are too short for a window have no digest."""
    return cut(docs.select(_ord().alias("ord"), _hash().alias("hash"), F.when(F.octet_length(F.col("text").cast("string")) >= LEAST_BYTES, F.unhex(F.md5(F.col("text").cast("string")))).alias("digest")), "marks")


def _bucket(ord_: str) -> Column:
    return F.pmod(F.xxhash64(ord_), F.lit(BUCKETS)).cast("int")


def _shared(marks: DataFrame) -> DataFrame:
    """Buckets with an ord that stands on several texts: at most BUCKETS rows, however many such ords there are."""
    several = marks.groupBy("ord").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least != most")
    return cut(several.select(_bucket("ord").alias("__bucket")).distinct(), "shared")


def _tagged(rows: DataFrame, shared: DataFrame, ord_: str, hash_: str, tag: str) -> DataFrame:
    """rows with the tag that tells apart the texts of an ord; it is zero, and so costs little, for ords outside the shared buckets."""
    found = rows.join(F.broadcast(shared), _bucket(ord_) == F.col("__bucket"), "left")
    return found.withColumn(tag, F.when(F.col("__bucket").isNotNull(), F.col(hash_)).otherwise(F.lit(0).cast("long"))).drop("__bucket", hash_)


def _keyed(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """ord orders documents, (ord, tag) tells rows of different texts apart."""
    rows = docs.select(_ord().alias("ord"), _hash().alias("hash"), F.col("text").cast("string").alias("text"))
    return _tagged(rows, shared, "ord", "hash", "tag").select("ord", "tag", "text")


def _copies(marks: DataFrame, shared: DataFrame) -> DataFrame:
    """(ord, tag) of the rows whose whole text a row of smaller ord has; a common text's rows are dealt to several tasks."""
    texts = _tagged(marks.where(F.col("digest").isNotNull()), shared, "ord", "hash", "tag")
    firsts = texts.groupBy("digest").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("last > first").select("digest", "first")
    return salted(texts, firsts, "digest", F.xxhash64("ord", "tag")).where("ord > first").select("ord", "tag").distinct()


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, tag, runs), the runs of removed windows of each document that has some; and the shared buckets that its tags go by."""
    marks = _marks(docs)
    shared = _shared(marks)
    keyed = _keyed(docs, shared)
    copies = cut(_copies(marks, shared), "copies")
    least = cut(keyed.mapInArrow(tidy(_least_rows, "substring"), "m long, ord long, tag long, twice boolean"), "least")
    repeated = least.groupBy("m").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1").select("m", (F.col("n") >= HOT).alias("is_hot"))
    # sets, so that rows that are equal throughout do not add up
    inside = least.select("m", "ord", "tag").join(repeated, "m").groupBy("ord", "tag").agg(F.collect_set("m").alias("ms"), F.collect_set(F.when(F.col("is_hot"), F.col("m"))).alias("hot")).join(copies, ["ord", "tag"], "left_anti")
    found = keyed.join(inside, ["ord", "tag"]).select("text", "ord", "tag", "ms", "hot").mapInArrow(tidy(_window_rows, "substring"), "key long, ord long, tag long, at long")
    # dealt before it is grouped: hardly a window is twice in a task; a window has one row for each batch, or if hot about one for each task, that has it
    groups = found.repartition("key").groupBy("key", F.shiftright("at", 32).alias("second")).agg(F.collect_list(F.struct("ord", "at", "tag")).alias("all"))
    rows = groups.where("second < 0 or size(all) > 1").select("second", F.array_min("all").alias("first"), F.explode("all").alias("x"))
    later = rows.where("second < 0 or x.ord > first.ord or x.at > first.at")
    place = F.when(F.col("second") < 0, -1 - F.col("x.at")).otherwise(F.lit(1 << 32).cast("long").bitwiseOR(F.col("x.at").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))
    runs = later.select("x.ord", "x.tag", place.alias("run"))
    single = runs.groupBy("ord", "tag").agg(F.collect_set("run").alias("runs"))
    return single.unionByName(copies.select("ord", "tag", F.array(F.lit(WHOLE << 32).cast("long")).alias("runs"))), shared


def kept_words(text: str | None, runs: list[int] | None) -> tuple[int, list[bytes]]:
    """Number of words and the words left after the removed windows' maximal intervals are taken out. A run is its number of windows and its place."""
    words = words_of(text)
    if not runs or len(words) < WINDOW:
        return len(words), words
    edge, run = np.zeros(len(words) + 1, np.int64), np.array(runs, np.int64)
    starts = run & 0xFFFFFFFF
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + (run >> 32) + WINDOW - 1, len(words)), -1)
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _digests(batches):
    target = pa_schema("doc_id long, n_words long, n_removed long, kept_sha256 string")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            out = {name: [] for name in target.names}
            for ord_, text, runs in zip(*(batch.slice(at, SLICE).column(c).to_pylist() for c in ("ord", "text", "runs")), strict=True):
                n, kept = kept_words(text, runs)
                for name, value in zip(target.names, (None if ord_ == LAST else ord_, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    out[name].append(value)
            yield as_batch(out, target)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each row of docs."""
    found, shared = removals(docs)
    joined = _keyed(docs, shared).join(found, ["ord", "tag"], "left").select("ord", "text", "runs")
    return joined.mapInArrow(tidy(_digests, "substring"), "doc_id long, n_words long, n_removed long, kept_sha256 string")


@F.arrow_udf(T.StringType())
def _cut_text(texts: pa.Array, runs: pa.Array) -> pa.Array:
    own("substring")
    return pa.array([b" ".join(kept_words(*x)[1]).decode("utf-8", "surrogatepass") for x in zip(texts.to_pylist(), runs.to_pylist(), strict=True)], pa.string())


def strip(docs: DataFrame) -> DataFrame:
    """All columns of docs, each row once also where a doc_id is repeated or null; where words go, text is the kept words joined by a space and n_chars, if there, its length."""
    found, shared = removals(docs)
    text = F.col("row.text").cast("string")
    keyed = _tagged(whole(docs).select("row", _ord("row.").alias("ord"), _hash("row.").alias("hash")), shared, "ord", "hash", "tag")
    joined = keyed.join(found, ["ord", "tag"], "left")
    new = joined.withColumn("new", F.when(F.col("runs").isNotNull(), _cut_text(text, "runs")).otherwise(text))
    out = [F.col("new").alias("text") if c == "text" else F.length("new").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return new.select(*out)
