"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and further columns."""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import bpe, common, licenses, packing, quality, simhash, substring, tokens, toxicity, vptree, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"passage{i}" for i in range(30))
LONG = "".join(random.Random(3).choice("abcdefgé漢1.'") for _ in range(20_000))
TEXTS = [
    None, "", " \n\t ", "one", "Released under the MIT License.", f"start here {PASSAGE} and an end", f"another {PASSAGE} end of it", "the cat sat on the mat. " * 40, f"A first line.\nA first line.\n{PASSAGE}\n", LONG,
    "Étude ÇA va  bien\r\n\n\x1cfin ǰJ̌ İ", "<|endoftext|> plain <|startoftext|>x", "it's they're 12 345 !!'s", "a b c d e " * 9, "the quick brown fox jumps over the lazy dog " * 12, "the quick brown fox jumps over the lazy dog " * 12,
    "This work is licensed under the GNU General Public License, version 3. " + PASSAGE,
]
EXTRA = "doc_id long, text string, votes string, fp string, ord int, tag int, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 % 17 + 100, t, "x", "y", 1, 2, 5) for i, t in enumerate(TEXTS)] + [(None, PASSAGE, None, None, 1, 2, 5), (100, None, None, None, 1, 2, 5)]
    return spark.createDataFrame(rows, EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EXTRA)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words(text):
    return WORD.findall(text or "")


def key(row):
    return tuple((x is None, str(x)) for x in row)


def same(df, wanted):
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(wanted, key=key)


def test_quality_base(docs, none):
    def base(text):
        w, t = words(text), text or ""
        lines, seen, dup = [x for x in t.split("\n") if words(x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)

    same(quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), [(i, *base(t)) for i, t in pairs(docs)])
    judged = quality.judge(docs)
    assert judged.where("kept and base_failed").count() == 0
    shown = {r.votes for r in judged.collect()}
    assert len(shown) > 3
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == judged.where("kept").count()
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0


def votes_of(text):
    """The ten votes by counting one thing after the other, with the limits as they stand in the operator."""
    w, t = words(text), text or ""
    if not w:
        return "0" * 10
    lines = [x for x in t.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    repeated = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    duplicates = sum(x in lines[:i] for i, x in enumerate(lines))
    ends = sum(x[-1] in ".!?" for x in w) / len(w)
    share = {
        "symbols": sum(c in "#*$%&|<>" for c in t) / len(w), "duplicate_lines": duplicates / max(1, len(lines)), "repeats": len(repeated) / len(w), "distinct": len(set(w)) / len(w),
        "capitals": sum(c.isupper() for x in w for c in x) / sum(map(len, w)), "function_words": sum(len(x.encode()) < 7 and x.lower() in quality.FUNCTION_WORDS for x in w) / len(w),
        "word_length": sum(map(len, w)) / len(w), "sentences": ends, "letters": sum(any(c.isalpha() for c in x) for x in w) / len(w), "top_word": max(map(w.count, w)) / len(w),
    }
    out = {}
    for rule, x in share.items():
        junk, good = quality.LIMITS[rule]
        high = rule in quality.HIGH_IS_GOOD
        out[rule] = "-" if (x <= junk if high else x >= junk) else "+" if (x >= good if high else x <= good) else "0"
    if not duplicates:
        out["duplicate_lines"] = "+" if len(lines) > 3 else "0"
    if ends > 0.5:
        out["sentences"] = "-"
    return "".join(out[r] for r in quality.RULES)


def posterior_of(patterns):
    """Expectation-maximisation row by row, without a histogram."""
    prior, good, junk = 0.8, [0.9] * 10, [0.7] * 10
    for _ in range(200):
        post = []
        for p in patterns:
            a, b = prior, 1 - prior
            for k, v in enumerate(p):
                if v != "0":
                    a *= good[k] if v == "+" else 1 - good[k]
                    b *= 1 - junk[k] if v == "+" else junk[k]
            post.append(a / (a + b))
        prior = min(max((sum(post) + 8) / (len(post) + 10), 0.01), 0.99)
        for k in range(10):
            seen = [(x, p[k]) for x, p in zip(post, patterns, strict=True) if p[k] != "0"]
            good[k] = min(max((sum(x for x, v in seen if v == "+") + 7.2) / (sum(x for x, _ in seen) + 8), 0.55), 0.999)
            junk[k] = min(max((sum(1 - x for x, v in seen if v == "-") + 5.6) / (sum(1 - x for x, _ in seen) + 8), 0.55), 0.999)
    return post


def test_quality_verdicts(spark, docs):
    rows = pairs(docs) + [(1000 + i, " ".join(rng.choice(["the", "and", "of", "stone.", "Bird", *(["x#", "77"] * (i % 3)), *(f"leaf{k}"[: 5 + k % 3] + "abcdefghij"[k % 10] * 2 for k in range(60))]) for _ in range(80))) for i in range(60) for rng in [random.Random(i)]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    votes = [votes_of(t) for _, t in rows]
    wanted = posterior_of(votes)
    got = {}
    for r in quality.judge(table).collect():
        got.setdefault(r.doc_id, []).append((r.votes, r.p_good, r.base_failed, r.kept))
    for (i, _), v, p in zip(rows, votes, wanted, strict=True):
        mine = [x for x in got[i] if x[0] == v]
        assert mine and all(abs(x[1] - p) < 1e-5 and x[3] == (not x[2] and x[1] >= 0.5) for x in mine)
    assert sum(x[3] for v in got.values() for x in v) not in (0, len(rows))


def test_quality_finds_rule_accuracies():
    rng = random.Random(1)
    truth = [rng.random() < 0.8 for _ in range(20_000)]
    votes = ["".join(rng.choices("+-0", (0.8, 0.05, 0.15) if good else (0.1, 0.75, 0.15))[0] for _ in quality.RULES) for good in truth]
    histogram: dict[str, int] = {}
    for v in votes:
        histogram[v] = histogram.get(v, 0) + 1
    posterior = quality.fit(histogram)
    assert np.mean([(posterior[v] >= 0.5) == good for v, good in zip(votes, truth, strict=True)]) > 0.99


def fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values):
    """Smallest doc_id reachable over links at three or fewer bits."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(values)), 2):
        if (values[a][1] ^ values[b][1]).bit_count() <= 3:
            root[find(a)] = find(b)
    return [min((values[k][0] for k in range(len(values)) if find(k) == find(i) and values[k][0] is not None), default=None) for i in range(len(values))]


def test_simhash(docs, none):
    rows = [(i, fingerprint(t)) for i, t in pairs(docs)]
    found = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    same(found, [(i, f"{f:016x}", c) for (i, f), c in zip(rows, classes(rows), strict=True)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(classes(rows)))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_keeps_one_of_each_component(spark):
    """Null ids are as many documents as they have texts, and one id may stand on texts of two components."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(None, a), (None, a), (None, b), (5, c), (None, c.upper()), (7, d), (7, e), (3, e), (9, ""), (9, None)]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted((x for x in kept if x[0] != 9), key=str) == sorted([(None, a), (None, b), (5, c), (7, d), (3, e)], key=str)
    assert len(kept) == 6


def test_simhash_loses_no_link(spark):
    rng, points = random.Random(5), []
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            points.append(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    points = list(dict.fromkeys(points))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    table, wanted = spark.createDataFrame([(p,) for p in signed], "fp long"), {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    for level, (blocks, same) in enumerate(simhash.LEVELS):
        assert {tuple(r) for r in simhash.links(table, level).collect()} == wanted
        choices = len(list(itertools.combinations(range(blocks), same)))
        assert simhash.homes(table, level).count() == 2 * choices * len(points) and simhash.replicas(table, level).count() <= 32 * choices * len(points)
    assert [simhash.level_for(n) for n in (0, 1 << 28, 1 << 29, 1 << 36, 1 << 37)] == [0, 0, 1, 1, 2]


def library(path):
    made = Tokenizer.from_file(path)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_bpe(docs, none):
    encode, made = library(bpe.WORD_BPE), Tokenizer.from_file(bpe.WORD_BPE)
    wanted = []
    for i, t in pairs(docs):
        ids = encode(t)
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(made.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(bpe.digest(docs), wanted)
    assert bpe.digest(none).count() == 0


@pytest.mark.parametrize("path", [bpe.WORD_BPE, bpe.BYTE_BPE])
def test_joins_are_exact(path):
    rng, made, encode = random.Random(7), bpe.Encoder(path), library(path)
    for alphabet in ("ab", "abcdefghij'st", "aé'sœ漢字かな😀x12!.,", "ABCΣςß̇", "".join(map(chr, range(33, 900)))):
        for n in (4097, 9000, 30_000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert np.frombuffer(made.texts([text])[0], "<u4").tolist() == encode(text)
            assert np.frombuffer(made.texts([f"x {text[:50]}  {text} <|endoftext|>{text}"])[0], "<u4").tolist() == encode(f"x {text[:50]}  {text} <|endoftext|>{text}")


@pytest.mark.parametrize("path", [bpe.WORD_BPE, bpe.BYTE_BPE])
def test_short_texts_equal_the_library(path, monkeypatch):
    """Blanks before special tokens, letters whose lower case has a mark, all white space; what is known is trimmed many times on the way."""
    monkeypatch.setattr(bpe, "MEMO_BYTES", 60_000)
    rng, made, encode = random.Random(11), bpe.Encoder(path), library(path)
    blanks = [chr(c) for c in (9, 10, 11, 12, 13, 32, 32, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x1C, 0x200B)]
    chars = [*"aabcdeXYZ.,'!?0123-éÉßİIıǰΣσςКñ字漢かな😀ﬁ", "J\u030c", "A\u030a", "\u0307", "'s", "İ.", "İ,", "word", "Word", "it's", "\u212a"]
    for _ in range(60):
        texts = ["".join(rng.choice(made.special) if (r := rng.random()) < 0.04 else rng.choice(blanks) if r < 0.35 else rng.choice(chars) for _ in range(rng.randint(0, 25))) for _ in range(200)]
        texts += ["\n\n<|endoftext|>", " \xa0<|endoftext|>", "\n\xa0<|endoftext|>", "a İ, b", "İstanbul'İ."]
        for text, ids in zip(texts, made.texts(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encode(text), text


def test_what_is_known_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    made = bpe.Encoder(bpe.WORD_BPE)
    for i in range(20):
        made.texts([" ".join(f"w{i}x{k} always" for k in range(400))])
        size = made.known.units.nbytes + made.known.ids.nbytes
        assert size < 20_000 and len(made.known.ends) == len(made.known.units) + 1
    assert "always" in made.known.units.to_pylist()


def test_long_texts_keep_blanks_before_long_units(spark):
    rows = [(1, "a  \n" + "x" * 5000 + " \n\n b <|endoftext|>" + "y" * 5000 + "\t\t"), (2, " " * 5000 + "z" * 4097)]
    for path in (bpe.WORD_BPE, bpe.BYTE_BPE):
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
        assert got == {i: library(path)(t) for i, t in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs, none, tmp_path):
    encode, wanted, at = library(bpe.BYTE_BPE), [], 0
    rows = [(i, encode(t) + [2]) for i, t in pairs(docs)]
    got = sorted((tuple(r) for r in tokens.digest(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r[1] == at
        at += r[2]
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((i, len(x), crc(x)) for i, x in rows if i is not None)
    assert at == sum(len(x) for _, x in rows) and wanted == []
    path = f"file://{tmp_path}/ids"
    tokens.write(docs, path)
    assert tokens.read(spark, path).where("doc_id = 103").count() == 1
    assert tokens.digest(none).count() == 0


def test_token_file_format(spark, tmp_path, monkeypatch):
    """Stripes, row indexes, run-length version and Bloom filters, and that both prune."""
    from pyarrow import orc

    monkeypatch.setattr(tokens, "ORC", tokens.ORC | {"orc.stripe.size": "20000", "orc.row.index.stride": "1000", "orc.rows.between.memory.checks": "1000"})
    path, n = f"file://{tmp_path}/ids", 30_000
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(50)]
    tokens.write(spark.createDataFrame([(2 * i, texts[i % 50]) for i in range(n)], "doc_id long, text string").coalesce(1), path)
    files = [orc.ORCFile(str(f)) for f in (tmp_path / "ids").glob("*.orc")]
    assert sum(f.nrows for f in files) == n and max(f.nstripes for f in files) > 1
    assert {(f.row_index_stride, str(f.compression).upper(), str(f.file_version)) for f in files} == {(1000, "ZSTD", "0.12")}  # 0.12 writes run lengths of version 2
    plain = n * 13 * 4
    assert sum(f.stat().st_size for f in (tmp_path / "ids").glob("*.orc")) < plain / 2

    def rows_read(doc_id):
        df = spark.read.schema(tokens.SCHEMA).orc(path).where(F.col("doc_id") == doc_id).select("doc_id")
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return len(found), sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    found, read = rows_read(2 * 17_000)
    assert found == 1 and read <= 1000
    assert rows_read(2 * 17_000 + 1) == (0, 0)  # within the bounds of a row group, so only its Bloom filter can tell


def test_null_ids_are_written_to_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_BYTES", 1 << 10)
    table = spark.createDataFrame([(None if i % 3 else i, f"text {i}") for i in range(900)], "doc_id long, text string").repartition(4)
    table.write.parquet(f"file://{tmp_path}/docs")
    path = f"file://{tmp_path}/ids"
    tokens.write(spark.read.parquet(f"file://{tmp_path}/docs"), path)
    rows = spark.read.schema(tokens.SCHEMA).orc(path)
    assert rows.where("doc_id is null").select("file").distinct().count() > 1
    ordered = [r.doc_id for r in rows.orderBy("file", "before").collect()]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0))


def check_packing(docs, rows):
    encode = library(bpe.WORD_BPE)
    ids: dict = {}
    for i, t in docs:
        ids.setdefault(i, []).append(encode(t) + [1])
    by_doc, by_sequence, sizes = {}, {}, {}
    for r in rows:
        assert any(len(x) == r.doc_tokens and crc(x[r.start : r.start + r.length]) == r.ids_crc32 for x in ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sorted(x) for i, x in by_doc.items()} == {i: sorted(k for x in v for k in range(len(x))) for i, v in ids.items()}
    for s, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes[s] = at
        assert at <= 2048
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values())


def test_packing(docs, none):
    assert check_packing(pairs(docs), packing.digest(docs).collect()) == 0
    assert packing.digest(none).count() == 0


def test_step_groups_have_equal_tokens(spark, monkeypatch):
    """Over several shards every group of a tier but the last is full, and tails have none."""
    monkeypatch.setattr(packing, "SHARD_BYTES", 1 << 16)
    rng = random.Random(5)
    table = spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([20, 200, 700, 3000])))) for i in range(400)], "doc_id long, text string").cache()
    assert 1 < table.count() and common.parts_for(table, 1 << 16) > 3
    rows = packing.digest(table).collect()
    assert len({r.sequence_id >> 0 for r in rows}) == max(r.sequence_id for r in rows) + 1
    size, steps = {}, {}
    for r in rows:
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
        steps.setdefault((r.tier, r.step), set()).add(r.sequence_id)
    assert all(size[s] == tier for (tier, _), members in steps.items() for s in members)
    for tier in packing.TIERS:
        groups = [len(m) for (t, _), m in steps.items() if t == tier]
        assert sum(n != packing.STEP_TOKENS // tier for n in groups) <= 1
    assert all((step is None) == (tier < packing.TIERS[-1]) for tier, step in steps)
    assert len({r.tier for r in rows}) > 3


def test_packer_fills_windows():
    rng, packer, sizes = random.Random(2), packing.Packer(), [random.Random(i).choice([1, 30, 300, 900, 1500, 2048, 5000]) for i in range(400)]
    windows = [w for i, n in enumerate(sizes) for w in packer.add(i, n)] + list(packer.rest())
    assert all(sum(p[2] for p in pieces) == tier for tier, pieces in windows)
    spans = sorted((d, a, a + n) for _, pieces in windows for d, a, n in pieces)
    assert {d: sum(b - a for x, a, b in spans if x == d) for d in range(len(sizes))} == dict(enumerate(sizes)) and rng
    assert len({t for t, _ in windows}) > 3


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1500)]
    rows += [(1500 + i, rows[7][1]) for i in range(60)] + [(1560, [1.0] * 8)] * 3
    odd = [(20, None), (40, [0.0] * 8), (60, [None] * 8), (80, [float("nan")] * 8), (100, [1.0, 2.0]), (None, [1.0] * 8)]
    rows = [r for r in rows if r[0] not in (20, 40, 60, 80, 100)] + odd
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    exact = {}
    for q in (i for i in fine if i % 20 == 0):
        exact[q] = sorted(((-float(np.einsum("d,d->", fine[q], v)), i) for i, v in fine.items() if i != q))[:20]
    got: dict = {}
    for r in vptree.search(df, factor=1.0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == exact.keys()
    for q, wanted in exact.items():
        assert [got[q][k][0] for k in range(1, 21)] == [i for _, i in wanted]
        assert np.allclose([got[q][k][1] for k in range(1, 21)], [-s for s, _ in wanted], atol=1e-12)
    near = vptree.search(df).collect()
    assert sum(r.vec_id in {i for _, i in exact[r.query_id]} for r in near) >= 0.9 * sum(map(len, exact.values()))
    assert vptree.search(df.limit(0)).count() == 0
    few = vptree.search(df.where("vec_id in (120, 121, 122)")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(120, 1), (120, 2)]


def test_nearest_over_many_shards(spark, monkeypatch):
    """Several pivots, shards and blocks; two vectors under one id; factor 1 stays exact and sends fewer rows than all queries to all shards."""
    monkeypatch.setattr(vptree, "SHARD_ROWS", 100)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 6)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.3).astype(np.float32).astype(float).tolist()) for i in range(1500)] + [(40, [3.0] * 6), (77, [-3.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    exact = {}
    for q, v in rows:
        if q % 20 == 0:
            for at, (i, w) in enumerate(rows):
                if i != q:
                    exact.setdefault(q, {})[at] = max(exact.get(q, {}).get(at, -np.inf), float(np.dot(v, w)))
    got: dict = {}
    for r in vptree.search(df, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == exact.keys()
    for q, wanted in exact.items():
        best = sorted(((-s, rows[at][0]) for at, s in wanted.items()))[:20]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, 21)) and np.allclose([x[2] for x in mine], [-s for s, _ in best]) and [x[1] for x in mine] == [i for _, i in best]
    points = vptree.usable(df)
    index = vptree.Index(points.cache())
    assert index.shards > 10 and len(index.pivots) > 5
    asking = points.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    homes = index.routed(asking, 1.0)
    far = homes.select("query_id", "v", F.col("shard").alias("home"), F.lit(30.0).alias("least"))
    assert index.routed(far, 1.0).count() < asking.count() * (index.shards - 1)


def test_relaxed_search_skips_more():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(4000, 3))
    most = float((points * points).sum(axis=1).max())
    tree = vptree.Tree.build(points, np.arange(4000), np.zeros(4000, np.int64), most)
    assert len(tree.nodes) == vptree.nodes_of(4000) and sorted(tree.ids) == list(range(4000))
    seen = {}
    for factor in (1.0, 0.3):
        class Counting(vptree.Search):
            scanned = 0

            def scan(self, a, b, q):
                self.scanned += (b - a) * len(q)
                super().scan(a, b, q)

        found = Counting(tree, points[:50], np.arange(50), np.full(50, -np.inf), 5, factor, most)
        seen[factor] = found.scanned
    assert seen[0.3] < seen[1.0] < 50 * 4000


def removed(rows):
    """Kept words by comparing word sequences; rows with one doc_id are one document."""
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        w = words(t)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            seen[x] = min(seen.get(x, ((i is None, i or 0), k)), ((i is None, i or 0), k))
    for i, t in order:
        w = words(t)
        gone = {k + d for k in range(len(w) - 19) if seen[tuple(w[k : k + 20])] < ((i is None, i or 0), k) for d in range(20)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_substrings(spark, docs, none):
    same(substring.digest(docs), removed(pairs(docs)))
    rng = random.Random(9)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(15, 60))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(passages) if rng.random() < 0.6 else " ".join(str(rng.random()) for _ in range(9)) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, "x y z u v " * 6), (2001, "x y z u v " * 5)]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(substring.digest(many), removed(rows))
    stripped = substring.strip(docs)
    assert stripped.columns == docs.columns and stripped.count() == docs.count() and substring.digest(none).count() == 0 and substring.strip(none).count() == 0


def test_substrings_tell_texts_of_one_id_apart(spark):
    """Two texts of one doc_id whose 64-bit hashes have equal low halves share no runs: neither where one holds a passage, nor where it is a copy."""
    low = lambda t: xxhash.xxh64_intdigest(t, 42) & 0x7FFFFFFF
    held = {low(f"{PASSAGE} end{i}"): f"{PASSAGE} end{i}" for i in range(200_000)}
    clean = (" ".join(f"clean{j}x{k}" for k in range(30)) for j in itertools.count())
    other = next(t for t in clean if low(t) in held)
    twin = held[low(other)]
    assert twin != other and low(twin) == low(other)
    for first in (f"{PASSAGE} elsewhere", twin):
        for shared in (None, 900):
            rows = [(1, first), (shared, twin), (shared, other), (shared, "few words"), (shared, None), (2, f"an own {PASSAGE}")]
            table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
            same(substring.digest(table), removed(rows))
            stripped = [r.text for r in substring.strip(table).collect()]
            assert len(stripped) == len(rows) and other in stripped and stripped.count(twin) == (first == twin)


def test_substrings_of_hot_windows(spark, monkeypatch):
    """Windows in many documents, in any order of rows and with little memory of them."""
    monkeypatch.setattr(substring, "HOT", 3)
    monkeypatch.setattr(substring, "SLICE", 7)
    rng = random.Random(4)
    common = [" ".join(f"c{k}w{i}" for i in range(40)) for k in range(5)]
    rows = [(i, " ".join([f"own{i}", rng.choice(common), f"mid{i}", rng.choice(common)])) for i in range(300)] + [(None, common[0])] * 7 + [(None, f"{common[1]} tail")] * 5 + [(9, common[2])] * 4
    rng.shuffle(rows)
    wanted = removed(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        same(substring.digest(table), wanted)
        monkeypatch.setattr(substring, "REMEMBERED", 3)
        same(substring.digest(table), wanted)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_sends_a_hot_window_once():
    first = substring._First()
    assert first.news([(1, 1), (2, 2)], [(5, 0), (5, 1)]) == ([True, True], [False, False])
    assert first.news([(1, 1), (1, 1), (2, 2)], [(6, 0), (4, 9), (5, 1)]) == ([False, True, False], [True, False, False])


def test_windows_with_one_equal_hash_are_told_apart(spark, monkeypatch):
    """Where all first hashes are equal, the second alone decides."""
    real = substring.rolling
    texts = [" ".join(f"w{i}x{k}" for k in range(25)) for i in range(6)] + [" ".join(f"w2x{k}" for k in range(25)) + " end"]
    seen = []
    monkeypatch.setattr(substring, "rolling", lambda h, n, p: real(h, n, p) if n != substring.WINDOW or p is not substring._powers[0] else np.zeros(len(h) - n + 1, np.uint64))
    _, least = substring.least_hashes(substring.word_hashes(words(texts[0])))
    assert len(least)
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(texts), "ord": pa.array(range(7), pa.int64()), "tag": pa.array([0] * 7, pa.int64()), "ms": pa.array([np.unique(substring.least_hashes(substring.word_hashes(x.encode().split()))[1]).view(np.int64).tolist() for x in texts]), "hot": pa.array([[]] * 7, pa.list_(pa.int64()))})
    for out in substring._window_rows([batch]):
        seen += out.to_pylist()
    assert {r["ord"] for r in seen if r["at"] < 0} == {6} and len([r for r in seen if r["at"] >= 0]) == 6 * 6 + 1


def test_toxicity(spark, none):
    rng = random.Random(6)
    plain, bad = ["table", "river", "morning", "letter", "window", "garden", "winter", "summer"], ["scumbag", "moronic", "vermin"]
    rows, labels = [], []
    for i in range(900):
        text, toxic = [rng.choice(plain) for _ in range(40)], i % 5 == 0
        if toxic:
            for _ in range(4):
                text[rng.randrange(40)] = rng.choice([rng.choice(bad), rng.choice(bad).replace("o", "0"), rng.choice(bad).replace("a", "а").upper()])
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(toxic)))
    rows += [(5000, None, "en"), (5001, "", "en"), (None, "table", None), (0, rows[0][1], "en")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.detect(docs, known).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.predicted for r in got if r.doc_id in (5000, 5001)} == {0}
    kept = toxicity.keep_clean(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert {r.score for r in toxicity.detect(docs, known.limit(0)).collect()} == {0.0} and toxicity.detect(none, known).count() == 0


def test_toxicity_scores(spark):
    """Every score from the model by comparing each word with each stem."""
    rng = random.Random(8)
    plain, bad = ["table", "river", "morning", "garden", "winter"], ["scumbag", "moronic"]
    rows = [(i, " ".join([rng.choice(plain) for _ in range(rng.randint(0, 60))] + [rng.choice(bad) for _ in range(rng.randint(1, 4) if i % 4 == 0 else 0)] + ["scumbag moss"] * (i % 60 == 1))) for i in range(600)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    (a, b), stems = model["curve"], dict(model["stems"])
    assert stems and any(p.endswith(" moss") for p in model["exceptions"])
    table = toxicity._folding()
    got = {r.doc_id: r.score for r in toxicity.detect(docs, labels).collect()}
    for i, t in rows:
        folded = "".join(table.get(ord(c), c) or "" for c in t.lower()).split()
        total = 0.0
        for k, w in enumerate(folded):
            weights = [x for s, x in stems.items() if w.startswith(s)]
            if weights and f"{w} {folded[k + 1] if k + 1 < len(folded) else ''}" not in model["exceptions"]:
                total += max(weights)
        d = total / max(20, len(folded)) ** 0.5
        assert abs(got[i] - 1 / (1 + np.exp(-(a + b * d)))) < 1e-9
    held = [(got[i], int(i % 4 == 0)) for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.95


def test_toxicity_folding():
    assert toxicity.fold("Sсum-b4g!").split() == ["scum", "bag"]
    for hidden in ("ｖｅｒｍｉｎ", "ver\u200bmin", "vérmïn", "v\u0435rm1n", "VERM|N", "𝐯𝐞𝐫𝐦𝐢𝐧", "ver\u00admin"):
        assert ["vermin"] in [toxicity.fold(hidden, other).split() for other in (False, True)], hidden
    for hidden in ("1oathe", "|oathing", "lo\u0301athe", "lóathe"):
        assert toxicity.hits_of(f"we {hidden} it", (("loath", 3.0),))[0][2] == 3.0
    stems = (("scum", 3.0),)
    assert [h[0] for h in toxicity.hits_of("scumbags, not discum", stems)] == ["scumbags"]
    assert toxicity.density_of("scum on water", stems, frozenset({"scum on"})) == 0.0 < toxicity.density_of("scum on water", stems, frozenset())


PAGES = [(1, "http://a/1", "x" * 1500), (2, "http://a/2", "x" * 1500), (3, None, "x" * 1500), (4, "http://a\r\n/4", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (8, "u", "é" * 499), (9, "u", "é" * 500), (10, "u", "é" * 500), (None, "u", "x" * 1500), (11, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 100)]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, "q", 1) for p in PAGES], "page_id long, url string, html string, payload string, record_type int").repartition(3)
    largest: dict = {}
    for i, _, h in PAGES:
        if len((h or "").encode()) >= 1000 and i is not None:
            largest[h] = max(largest.get(h, i), i)
    wanted = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        to = largest.get(h) if len(b) >= 1000 else None
        revisit = to is not None and to != i
        wanted.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    same(warc.digest(pages), wanted)
    assert warc.digest(pages.limit(0)).count() == 0


def test_warc_ranges_own_records():
    rng, data, starts = random.Random(8), b"", []
    for i in range(60):
        payload = base64.b64encode(rng.randbytes(rng.randint(0, 3000)))
        if i % 7 == 0:
            payload = rng.randbytes(500) + warc.MAGIC + rng.randbytes(500)
        starts.append(len(data))
        data += warc.page_record(i, f"http://x/{i}", payload, None)
    for step in (1, 64, 777, 5000, len(data)):
        if step == 1:
            ranges = [(s, s + 1) for s in starts] + [(s + 1, s + 2) for s in starts]
        else:
            ranges = [(a, min(a + step, len(data))) for a in range(0, len(data), step)]
        found = [f["WARC-Record-ID"] for a, b in ranges for f, _ in warc.records_in(io.BytesIO(data), len(data), a, b)]
        assert found == [f"<urn:page:{i}>" for i in range(60)]
    with pytest.raises(ValueError, match="ends within the record"):
        torn = data[: starts[4] - 9]
        list(warc.records_in(io.BytesIO(torn), len(torn), 0, len(torn)))


def test_warc_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 16 << 10)
    rng = random.Random(2)
    pages = spark.createDataFrame([(i, f"http://x/{i}", base64.b64encode(rng.randbytes(2000)).decode()) for i in range(300)], "page_id long, url string, html string").repartition(2)
    archives = warc.write(pages, f"file://{tmp_path}/warc")
    records = warc.read(archives)
    ranges = archives.selectExpr("sum(ceil(bytes / 16384)) as n").head().n
    assert ranges > 10 and records.rdd.getNumPartitions() == ranges
    assert records.select(F.spark_partition_id().alias("p")).distinct().count() > ranges / 3
    assert sorted(r.page_id for r in records.collect()) == list(range(300))


def test_licenses(spark, docs, none):
    edited = licenses.TEMPLATES["MIT-grant"].replace("charge, to", "charge to")
    twisted = " ".join(reversed(licenses.TEMPLATES["BSD-clauses"].split()))
    rows = [(500 + i, f"{'word ' * i}{t}{' tail' * (i % 5)}", None, None, 1, 2, 5) for i, t in enumerate([*licenses.TEMPLATES.values(), edited, twisted])]
    every = docs.unionByName(spark.createDataFrame(rows, EXTRA))

    def shingles(t):
        w = [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    wanted = set()
    for i, t in pairs(every):
        for name, template in licenses.TEMPLATES.items():
            share = len(shingles(t) & shingles(template)) / len(shingles(template))
            if share >= 0.8:
                wanted.add((i, name, round(share, 6)))
    same(licenses.scan(every), list(wanted))
    assert {x[1] for x in wanted} == set(licenses.TEMPLATES)
    nodes = licenses.scan(every)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", nodes)
    assert licenses.scan(none).count() == 0
    assert nodes.count("BroadcastExchange") == 2
    many = {f"t{i}": "word " * 30_000 for i in range(8)}
    assert "ResolvedHint" not in licenses.scan(every, many)._jdf.queryExecution().analyzed().toString() and licenses.MOST_CHARACTERS < 8 * 30_000 * 5


def test_license_words_lower_ascii_alone(spark):
    text = "Re\u212aeased under the MIT License. Permission \u0130s granted to all of you"
    assert spark.createDataFrame([(text,)], "t string").select(licenses.words(F.col("t"))).head()[0] == "re eased under the mit license permission s granted to all of you".split()


def test_scratch_wants_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Session, "x")
