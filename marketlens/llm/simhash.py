"""Operator 3: SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at three or fewer differing bits. Such a pair differs in at most one bit in one of
the two 32-bit halves. The lowest 31 bits of a half are covered by the perfect Hamming [31,26] code: each point
has exactly one codeword (anchor) within the covering radius 1, its home. Where x and y differ in at most one
bit there, y is within 1 + 1 of x's home; so every fingerprint is replicated to its at most 16 anchors within
radius 2, is compared with the fingerprints at home there, and no linked pair is missed. Rows with equal
fingerprints are one node throughout, so groups of copies of any size cost one row.

A half has 2^26 anchors. So that an anchor's fingerprints do not grow in number with the corpus, an anchor is split by
bits of the other half, which differs in at most three bits: of its `blocks` blocks, `same` are equal. Each choice of
so many blocks is an anchor of its own with the blocks' bits. LEVELS has the choices; the first that leaves at most
CROWD fingerprints to an anchor on average is taken, and all of them find the same pairs:
level 0 (34 rows a fingerprint) up to 2^28 fingerprints, level 1 (136 rows) up to 2^36, level 2 (340 rows) up to 2^40.

Defined cases: null and empty text have fingerprint zero and link like any other; null doc_id takes part, and a
component whose ids are all null has a null component_id; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, own, whole, words_of

SEED = 42
RADIUS = 3
CHUNK = 1 << 16
ANCHORS, CROWD = 1 << 26, 4
#: (blocks of the other half, blocks taken as equal)
LEVELS = ((1, 0), (4, 1), (5, 2), (6, 3))


def fingerprint_of(text: str | None, k: int = 3) -> int:
    """Unsigned fingerprint over k-word shingles, repeats included."""
    words = words_of(text)
    if not words:
        return 0
    words = [w.lower() for w in words]  # bytes.lower() lowers A-Z only
    n = len(words) - k + 1
    if n < 1:
        words, n = [b" ".join(words)], 1
        k = 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        part = words[start : min(start + CHUNK, n) + k - 1]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(k)), strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    own("simhash")
    return pa.array(np.array([fingerprint_of(t.as_py()) for t in texts], np.uint64).view(np.int64))


def _syndrome(half: Column) -> Column:
    """XOR of the positions 1 to 31 of the set bits."""
    total = F.lit(0).cast("long")
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        total = total + (F.bit_count(half.bitwiseAND(F.lit(mask))) % 2).cast("long") * (1 << k)
    return total


def _halves(level: int) -> Column:
    """Array of (half, bits, other, s): both halves' lowest 31 bits with their syndrome and, for each choice of blocks, the other half's bits there."""
    low = F.col("fp").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    high = F.shiftrightunsigned(F.col("fp"), 32).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    whole_low, whole_high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(F.col("fp"), 32)
    return F.array(*(F.struct(F.lit(i).alias("half"), bits.alias("bits"), _parts(other, level).alias("parts"), _syndrome(bits).alias("s")) for i, (bits, other) in enumerate(((low, whole_high), (high, whole_low)))))


def _parts(other: Column, level: int) -> Column:
    """For each choice of blocks a number of its own with their bits, above the 32 bits of half and anchor."""
    blocks, same = LEVELS[level]
    edges = [32 * i // blocks for i in range(blocks + 1)]
    out = []
    for index, chosen in enumerate(itertools.combinations(range(blocks), same)):
        value, at = F.lit(index).cast("long"), 5
        for k in chosen:
            width = edges[k + 1] - edges[k]
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(other, edges[k]).bitwiseAND(F.lit((1 << width) - 1).cast("long")), at))
            at += width
        out.append(F.shiftleft(value, 32))
    return F.array(*out)


_ANCHOR = "p | shiftleft(cast(x.half as bigint), 31) | (x.bits ^ {})"


def homes(points: DataFrame, level: int = 0) -> DataFrame:
    """Each fingerprint with its one anchor in each half, for each choice of blocks."""
    at = _ANCHOR.format("if(x.s = 0, 0L, shiftleft(1L, cast(x.s - 1 as int)))")
    rows = points.select("fp", F.explode(_halves(level)).alias("x")).select("fp", "x", F.explode("x.parts").alias("p"))
    return rows.select("fp", F.expr(at).alias("anchor"))


def replicas(points: DataFrame, level: int = 0) -> DataFrame:
    """Each fingerprint with every anchor within radius 2: errors of two positions i, j with i xor j = syndrome; 0 is no error."""
    flip = "if({0} = 0, 0L, shiftleft(1L, cast({0} - 1 as int)))"
    errors = "transform(filter(sequence(0L, 31L), i -> if(x.s = 0, i = 0, i < (i ^ x.s))), i -> " + f"{flip.format('i')} ^ {flip.format('(i ^ x.s)')})"
    rows = points.select("fp", F.explode(_halves(level)).alias("x")).select("fp", "x", F.explode(F.expr(errors)).alias("e"))
    return rows.select("fp", "x", "e", F.explode("x.parts").alias("p")).select("fp", F.expr(_ANCHOR.format("e")).alias("anchor"))


def level_for(count: int) -> int:
    """The first level that leaves at most CROWD of so many fingerprints to an anchor; the last one if none does."""
    bits = [min(sum(sorted((32 * (i + 1) // blocks - 32 * i // blocks for i in range(blocks)))[:same]), 32) for blocks, same in LEVELS]
    return next((i for i, b in enumerate(bits) if count <= CROWD * ANCHORS << b), len(LEVELS) - 1)


def links(points: DataFrame, level: int | None = None) -> DataFrame:
    """Pairs a < b of distinct fingerprints at RADIUS or fewer differing bits.

    Spark sizes what an explode gives by the rows before it, 34 to 340 times too low here, and would broadcast it: both sides are merged.
    """
    level = level_for(points.count()) if level is None else level
    a, b = homes(points, level).withColumnRenamed("fp", "a"), replicas(points, level).withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return a.join(b.hint("merge"), "anchor").where((F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: alternating large-star and small-star, each round written to the shared folder.

    Every round keeps connectivity and moves nodes toward the smallest of their component; it ends when nothing changes.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "star")  # v < u
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(star.select("e.u", "e.v").where("u != v").distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == seen:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        seen = now


def _rooted(classes: DataFrame) -> DataFrame:
    """fp, first, root for each distinct fingerprint of classes."""
    roots = components(links(classes.select("fp")))
    return classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), component_id, root: one row for each row of docs."""
    prints = cut(documents(docs).select("doc_id", F.coalesce(fingerprint("text"), F.lit(0)).cast("long").alias("fp")), "fingerprints")
    rooted = _rooted(cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = cut(rooted.join(smallest, "root").select("fp", "root", "component_id"), "components")
    return prints.join(found, "fp", "left").select("doc_id", "fp", "component_id", "root")


def _text_digest(of: str = "") -> Column:
    """Tells texts of one doc_id apart; null text has a digest of its own."""
    return F.coalesce(F.md5(F.col(f"{of}text").cast("string")), F.lit("null"))


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of one row of each component: its smallest doc_id, nulls last, of that the smallest text digest, of that the smallest digest of the whole row."""
    prints = documents(docs).select(F.coalesce(fingerprint("text"), F.lit(0)).cast("long").alias("fp"), "doc_id", _text_digest().alias("digest"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnumbered"), "doc_id", "digest")).alias("first")
    rooted = _rooted(cut(prints.groupBy("fp").agg(first), "classes"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))
    # equal texts have one root, so no two roots keep the same doc_id and digest; one column for both, so that rows are dealt once
    key = lambda doc_id, digest: F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")), digest))
    kept = cut(kept.select(key(F.col("first.doc_id"), F.col("first.digest")).alias("key")), "kept")
    rows = whole(docs).withColumn("key", key(F.col("row.doc_id"), _text_digest("row."))).join(kept, "key", "left_semi")
    same = Window.partitionBy("key").orderBy(F.md5(F.to_json("row")))
    return rows.withColumn("place", F.row_number().over(same)).where("place = 1").select("row.*")
