"""Operator 12: mining of collocations by hierarchical pair naming.

A phrase of k words that occurs often is a pair of phrases of k - 1 words that occur often and stand one word apart. So
words get ids first, and each further level replaces adjacent ids by the id of their pair, which Spark finds by one
shuffle of all pairs. A pair's two ids are its parent pointers: through them a phrase finds the counts of all its
beginnings and endings (for the cuts), and the phrases one word longer that hold it (for subsumption; one that is two
words longer holds one in between that is at least as frequent).

Texts are dealt to chunks of about CHUNK_BYTES of one lang, written once with their words as numbers. A chunk counts its own
pairs and sends them to shards (a pair's shard goes by its ids, their number by the input's size), each shard's in one packed
row; the shard counts a pair over all chunks and tells those that sent it its id, in the order sent. Nothing is broadcast;
a pair comes to a shard at most once from each chunk, so no key is hot.

Defined cases: null texts are empty, null langs are `und`; null doc_ids and repeated rows count like others; documents of
over MOST_WORDS words are split with an overlap of three words, of which no phrase is counted twice; bytes that are no
UTF-8 are kept; further columns are ignored; an empty table, and langs without frequent phrases, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, as_batch, cut, pa_schema, parts_for, tidy

LEAST, LONGEST, TOP, SUBSUMED = 30, 4, 2000, 80
SCALE = 2_000_000
CHUNK_BYTES, MOST_WORDS, PART_BYTES = 16 << 20, 1 << 22, 8 << 20
END = b"\xff"
#: A-Z to a-z, the separators of pieces to END (which UTF-8 does not have), tabs to blanks.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")
CHUNKS = "chunk long, lang string, n long, own long, words array<binary>, counts array<long>, body binary, sizes binary"
PAIRS = "shard int, chunk long, pairs binary, own long, body binary, sizes binary"
NAMES = "chunk long, shard int, told binary, id long, left long, right long, f long"


class Numbers(dict):
    """Words by number in the order they are met; END is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words, END between pieces."""
    return (text or b"").translate(FOLD).replace(END, b" \xff ").split()


def packed(ids: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes, behind their number."""
    planes = np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(ids).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(body: bytes) -> np.ndarray:
    size = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(pa.decompress(body[8:], size * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view("<i8").ravel()


def packed_all(columns: list[np.ndarray]) -> bytes:
    """Several columns of one length, the first one (ascending) by its differences."""
    return packed(np.concatenate([np.diff(columns[0], prepend=0), *columns[1:]]) if len(columns[0]) else columns[0]) + len(columns).to_bytes(1, "little")


def unpacked_all(body: bytes) -> list[np.ndarray]:
    first, *rest = np.split(unpacked(body[:-1]), body[-1])
    return [np.cumsum(first), *rest]


class Chunk:
    def __init__(self):
        self.numbers, self.parts, self.bytes = Numbers(), [], 0

    def add(self, words: list[bytes], size: int) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.bytes += size

    def row(self, chunk: int, lang: str, own: int | None = None) -> pa.RecordBatch:
        """Only phrases that begin at the first `own` places count."""
        body = np.concatenate(self.parts)
        own = len(body) if own is None else own
        counts = np.bincount(body[:own], minlength=len(self.numbers))[1:]
        words = pa.array([list(self.numbers)[1:]], pa.list_(pa.binary()))
        values = {"chunk": [chunk], "lang": [lang], "n": [int(counts.sum())], "own": [own], "counts": [counts], "body": [packed(body)], "sizes": [None]}
        schema = pa_schema(CHUNKS)
        return pa.record_batch([words if f.name == "words" else pa.array(values[f.name], f.type) for f in schema], schema=schema)


def _chunks(chunk_bytes: int, most_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, place = 0, TaskContext.get().partitionId() << 32
        open_: dict[str, Chunk] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = text.as_py()
                words = tokens(text)
                if len(words) > most_words:
                    for start in range(0, len(words), most_words):
                        part = Chunk()
                        part.add(words[start : start + most_words + LONGEST - 1], 0)
                        made += 1
                        yield part.row(place + made, lang, min(most_words, len(words) - start))
                    continue
                open_.setdefault(lang, Chunk()).add(words, len(text or b"") + 1)
                if sum(c.bytes for c in open_.values()) >= chunk_bytes:
                    largest = max(open_, key=lambda k: open_[k].bytes)
                    made += 1
                    yield open_.pop(largest).row(place + made, largest)
        for lang, chunk in open_.items():
            made += 1
            yield chunk.row(place + made, lang)

    return run


def chunks_of(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES, most_words: int = MOST_WORDS) -> DataFrame:
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    # a row may have megabytes, so the writer looks at its memory after each one
    return cut(texts.mapInArrow(tidy(_chunks(chunk_bytes, most_words), "phrases"), CHUNKS), "chunks", **{"parquet.block.size.row.check.min": "1", "parquet.block.size": str(32 << 20)})


def named(rows: DataFrame, keys: list[str], parts: int, least: int) -> DataFrame:
    """Rows of frequent words with the word's count `f` and id; `first` marks one row of each. A word's rows meet in one task, which takes the least of its row marks for the id."""
    same = Window.partitionBy(*keys)
    marked = rows.repartition(parts, *keys).withColumn("mark", F.monotonically_increasing_id())
    counted = marked.withColumn("f", F.sum("cnt").over(same)).withColumn("id", F.min("mark").over(same)).where(F.col("f") >= least)
    return cut(counted.select("chunk", "no", *keys, "f", "id", (F.col("mark") == F.col("id")).alias("first")), "words")


def shard_of(left: np.ndarray, right: np.ndarray, shards: int) -> np.ndarray:
    """Where a pair of ids is counted."""
    x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)


def paired(places: np.ndarray, ids: np.ndarray, own: int, shards: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct pairs of adjacent places (none negative) by shard, left and right id: their shards, [left, right, how often each begins before `own`], and the pair at each place (-1: none)."""
    first, second = places[:-1], places[1:]
    there = (first >= 0) & (second >= 0)
    pairs, at = np.unique((first[there] << 32) | second[there], return_inverse=True)
    left, right = ids[pairs >> 32], ids[pairs & 0xFFFFFFFF]
    counts = np.bincount(at[np.flatnonzero(there) < own], minlength=len(pairs))
    shard = shard_of(left, right, shards)
    order = np.lexsort((right, left, shard))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    found = np.full(len(first), -1, np.int64)
    found[there] = rank[at]
    return shard[order], [x[order] for x in (left, right, counts)], found


def _step(shards: int, words: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk's pairs, one row for each shard, and its body with the pairs' numbers in the order sent (shard -1, with how many pairs each shard got). What is known of the numbers in the body comes as rows for words, packed by shard for pairs."""

    def step(bodies: pa.Table, names: pa.Table) -> pa.Table:
        schema = pa_schema(PAIRS)
        if not bodies.num_rows or not names.num_rows:
            return schema.empty_table()
        chunk, own, body, sizes = (bodies[c][0].as_py() for c in ("chunk", "own", "body", "sizes"))
        if words:
            numbers, ids = names["no"].to_numpy(), names["id"].to_numpy()
        else:
            starts = np.concatenate([[0], np.cumsum(unpacked(sizes))])
            told = [(starts[r["shard"]], *unpacked_all(r["told"])) for r in names.to_pylist()]
            numbers, ids = np.concatenate([start + at for start, at, _ in told]), np.concatenate([i for _, _, i in told])
        body = unpacked(body)
        place = np.full(max(int(body.max(initial=0)), int(numbers.max())) + 2, -1, np.int64)
        place[numbers] = np.arange(len(numbers))
        shard, columns, found = paired(place[body], ids, own, shards)
        ends = np.searchsorted(shard, np.arange(shards + 1))
        used = np.flatnonzero(np.diff(ends))
        stay = found >= 0
        stay[1:] |= stay[:-1].copy()
        rows = {
            "shard": [*used.tolist(), -1], "chunk": [chunk] * (len(used) + 1), "pairs": [*(packed_all([c[ends[k] : ends[k + 1]] for c in columns]) for k in used), None],
            "own": [*[None] * len(used), int(stay[:own].sum())], "body": [*[None] * len(used), packed(found[stay])], "sizes": [*[None] * len(used), packed(np.diff(ends))],
        }
        return pa.Table.from_batches([as_batch(rows, schema)])

    return step


def pairs_of(bodies: DataFrame, names: DataFrame, parts: int, words: bool) -> DataFrame:
    sides = [df.repartition(parts, "chunk").groupBy("chunk") for df in (bodies.select("chunk", "own", "body", "sizes"), names)]
    return cut(sides[0].cogroup(sides[1]).applyInArrow(_step(parts, words), PAIRS), "pairs")


def _named(least: int) -> Callable[[pa.Table], pa.Table]:
    """Counts the pairs of one shard. Frequent ones get ids; each chunk is told which of those that it sent have one."""

    def name(sent: pa.Table) -> pa.Table:
        shard, chunks = sent["shard"][0].as_py(), sent["chunk"].to_numpy()
        blocks = [unpacked_all(p) for p in sent["pairs"].to_pylist()]
        sizes = [len(b[0]) for b in blocks]
        left, right, counts = (np.concatenate([b[k] for b in blocks]) for k in range(3))
        order = np.lexsort((right, left))
        new = np.ones(len(order), bool)
        new[1:] = (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1])
        begins = np.flatnonzero(new)
        f = np.add.reduceat(counts[order], begins)
        often = f >= least
        ids = np.where(often, (shard << 32) + np.cumsum(often) - 1, -1)
        named_ = np.empty(len(order), np.int64)
        named_[order] = ids[np.cumsum(new) - 1]
        rows, start = {"chunk": [], "told": []}, 0
        for chunk, size in zip(chunks.tolist(), sizes):
            mine = named_[start : start + size]
            start += size
            at = np.flatnonzero(mine >= 0)
            if len(at):
                rows["chunk"].append(chunk)
                rows["told"].append(packed_all([at, mine[at]]))
        told, known = len(rows["chunk"]), order[begins[often]]
        schema = pa_schema(NAMES)
        nothing = {c: [None] * told for c in ("id", "left", "right", "f")}
        back = as_batch({**rows, "shard": [shard] * told, **nothing}, schema)
        numbers = [pa.array(x, pa.int64()) for x in (ids[often], left[known], right[known], f[often])]
        kept = pa.record_batch([pa.nulls(len(known), pa.int64()), pa.nulls(len(known), pa.int32()), pa.nulls(len(known), pa.binary()), *numbers], schema=schema)
        return pa.Table.from_batches([back, kept])

    return name


def named_pairs(pairs: DataFrame, parts: int, least: int) -> DataFrame:
    """What each chunk is told (chunk, shard, told), and the frequent pairs (id, left, right, f)."""
    sent = pairs.where("shard >= 0").select("shard", "chunk", "pairs").repartition(parts, "shard")
    return cut(sent.groupBy("shard").applyInArrow(_named(least), NAMES), "names")


def scored(grams: DataFrame, words: int) -> DataFrame:
    """l, r and score of the lowest-scoring cut, the shortest first part on ties."""
    whole = "decimal(20,0)"

    def after(k: int) -> Column:
        l, r = F.col("pre")[k - 1], F.col("suf")[words - k - 1]
        score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * F.col("f").cast(whole), l.cast(whole) + r.cast(whole))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    return grams.withColumn("cut", F.array_min(F.array(*[after(k) for k in range(1, words)])) if words > 2 else after(1))


def first_ranks(found: DataFrame, top: int, parts: int) -> DataFrame:
    """The first rows of each lang: first those of each part of a lang, then those of the lang."""
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(max(parts, SALTS))))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)


def mine(documents: DataFrame, least: int = LEAST, top: int = TOP, chunk_bytes: int = CHUNK_BYTES, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each lang."""
    parts = parts_for(documents, PART_BYTES)
    chunks = chunks_of(documents, chunk_bytes, most_words)
    words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "it"))
    words = words.select("chunk", (F.col("at") + 1).cast("long").alias("no"), "lang", F.col("it.words").alias("word"), F.col("it.counts").alias("cnt"))
    one = named(words, ["lang", "word"], parts, least)
    pairs, told, levels = chunks, one.select("chunk", "no", "id"), []
    for level in range(2, LONGEST + 1):
        pairs = pairs_of(pairs if level == 2 else pairs.where("shard < 0"), told, parts, level == 2)
        names = named_pairs(pairs, parts, least)
        levels.append(names.where("chunk is null").select("id", "left", "right", "f"))
        told = names.where("chunk is not null").select("chunk", "shard", "told")

    single = F.array("f")
    known = one.where("first").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", single.alias("pre"), single.alias("suf"))
    found = None
    for words_, grams in enumerate(levels, 2):
        left = known.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), "pre")
        right = known.select(F.col("id").alias("right"), "last", "suf")
        joined = grams.join(left, "left").join(right, "right")
        phrase = F.concat("start", F.lit(b" "), "last")
        known = cut(joined.select("id", "left", "right", "lang", phrase.alias("phrase"), "last", "f", F.concat("pre", single).alias("pre"), F.concat("suf", single).alias("suf")), "grams")
        if words_ < LONGEST:
            longer = levels[words_ - 1]
            held = longer.select(F.col("left").alias("id"), "f").unionAll(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("most"))
            kept = known.join(held, "id", "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * SUBSUMED))
        else:
            kept = known
        some = scored(kept, words_).select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        found = some if found is None else found.unionAll(some)
    n = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = first_ranks(found, top, parts).join(n, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine_sql() -> str:
    """The same rows by counting every phrase of every piece (DuckDB)."""
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, list_aggregate(ws[i:i + {k - 1}], 'string_agg', ' ') AS p FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM pieces WHERE len(ws) >= {k})" for k in range(1, LONGEST + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, p, f, {k} AS k, array_to_string(ws[1:{k}], ' ') AS start, array_to_string(ws[{k + 1}:], ' ') AS rest FROM split WHERE len(ws) > {k}" for k in range(1, LONGEST))
    inside = " UNION ALL ".join(f"SELECT lang, array_to_string(ws[{i}:{i + k - 1}], ' ') AS p, f FROM split WHERE len(ws) > {k} AND len(ws) >= {i + k - 1}" for k in range(2, LONGEST) for i in range(1, LONGEST - k + 2))
    return f"""
        WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents)),
        counts AS (SELECT lang, k, p, count(*) AS f FROM ({grams}) GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
        split AS (SELECT lang, p, f, string_split(p, ' ') AS ws FROM counts WHERE k > 1 AND f >= {LEAST}),
        held AS (SELECT lang, p, max(f) AS most FROM ({inside}) GROUP BY ALL),
        cuts AS (SELECT c.lang, c.p, c.f, c.k, a.f AS l, b.f AS r, (({SCALE}::HUGEINT * c.f) // (a.f + b.f))::BIGINT AS score FROM ({cuts}) c
            JOIN counts a ON a.lang = c.lang AND a.p = c.start JOIN counts b ON b.lang = c.lang AND b.p = c.rest),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        ranked AS (SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.f DESC, w.p) AS rank FROM lowest w
            LEFT JOIN held h ON h.lang = w.lang AND h.p = w.p WHERE h.most IS NULL OR 100 * h.most < {SUBSUMED} * w.f)
        SELECT lang, rank, p AS phrase, f AS a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}"""
