"""The pipeline against its stages done by brute force on the driver's smallest table."""

from __future__ import annotations

import hashlib
import os

import pytest

import corpus_pipeline
from marketlens.llm import packing, quality, toxicity
from tests.llm.test_operators import check_packing, classes, fingerprint, removed, words

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")


def without_repeats(rows):
    """Texts after removal; windows are judged on the input."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - 19):
            seen.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, t in rows:
        w = words(t)
        gone = {k + d for k in range(len(w) - 19) if seen[tuple(w[k : k + 20])] < (i, k) for d in range(20)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    return out


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    first = docs.where(docs.doc_id.isin(list(good)))
    clean = {r.doc_id for r in toxicity.detect(first, labels).where("predicted = 0").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in clean]
    prints = [(i, fingerprint(t)) for i, t in rows]
    single = [x for x, c in zip(rows, classes(prints), strict=True) if x[0] == c]
    stripped = without_repeats(single)
    got = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == set(stripped)
    assert check_packing(list(stripped.items()), packing_rows(got)) == 0
    assert len(corpus_pipeline.STAGES) == 5


def packing_rows(packed):
    return packed.select("doc_id", "start", "length", packing._crc("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset").collect()


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert out.count() <= docs.count()


def test_stages_take_an_empty_table(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name


def test_repeated_and_null_ids(spark):
    """One row of each component goes through the stages behind the filters, whatever its id; every id's tokens are packed once."""
    a, b, c, d, e = (" ".join(f"{x}{i} word{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(None, a), (None, a), (None, b), (5, c), (None, c.upper()), (7, d), (7, e), (3, e), (None, f"{a} and some more {b}")]
    stages, table = dict(corpus_pipeline.STAGES), spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()
    single = stages["near_duplicates"](spark, table, SMALL).cache()
    kept = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (None, b), (5, c), (7, d), (3, e), rows[-1]], key=str)
    stripped = stages["substrings"](spark, single, SMALL).cache()
    assert stripped.columns == table.columns and stripped.count() == len(kept)
    texts = [(r.doc_id, r.text) for r in stripped.collect()]
    # null ids are one document for the order: what one row has further ahead goes from another
    assert sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts) == sorted((str(i), digest) for i, _, _, digest in removed(kept))
    got = stages["packing"](spark, stripped, SMALL)
    assert check_packing(texts, packing_rows(got)) == 0


def test_a_stage_clears_the_one_before(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    stages["quality"](spark, docs, SMALL).count()
    first = corpus_pipeline._left.folders[0].removeprefix("file://")
    assert os.path.isdir(first)
    stages["near_duplicates"](spark, docs, SMALL).count()
    assert not os.path.exists(first)
