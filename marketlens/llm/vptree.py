"""Operator 7: nearest neighbours by inner product through vantage-point trees.

The largest inner product is made a metric question: each vector gets one more component, the root of the greatest
squared norm minus its own, and a query gets zero there; then the nearest in Euclidean distance has the largest inner
product. Every vector is indexed: it belongs to the nearest of at most PIVOTS vectors, and the vectors of a pivot are
dealt to shards of about SHARD_ROWS by a hash. A shard's tree is built once and written to the shared folder: it splits
vectors at the median distance from a vantage point, down to leaves.

A query first searches one shard of its own pivot, whose k-th distance bounds what is left to find. It is then sent to
the shards of each pivot whose ball (between the least and greatest distance of its vectors) can hold something nearer;
inside, the triangle inequality skips subtrees. Both allow `factor` times the k-th distance: factor 1 is exact, smaller
ones skip more. A task holds one tree and streams its queries; only every BLOCK_ROWS queries a shard's tree is sent to a
further task. Vectors stay where they are.

Defined cases: vectors that are null, zero, of another length than most rows' or hold null or non-finite components
take no part; a null vec_id takes no part; repeated rows count once; vectors under one vec_id but different each take
part, none as its own neighbour, and such a query's neighbours are the nearest to any of them; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pa_schema

K, FACTOR = 20, 0.9
LEAF = 256
PIVOTS, SHARD_ROWS, BLOCK_ROWS = 256, 8192, 1 << 18
BATCH = 2048
EVERY = 20
INDEX = "shard int, ids binary, tags binary, vectors binary, nodes binary"
FOUND = "query_id long, vec_id long, tag long, score double"


def _distances(difference: np.ndarray, lift: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("nd,nd->n", difference, difference) + lift * lift)


class Tree:
    """Splits by distance ranks, so vectors that lie alike split evenly too. A node is the vantage point's place and the bounds of both halves; nodes stand in preorder, so that ranks alone tell which is whose."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, tags: np.ndarray, nodes: np.ndarray):
        self.vectors, self.ids, self.tags, self.nodes = vectors, ids, tags, nodes

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, tags: np.ndarray, most: float) -> Tree:
        order, nodes = np.arange(len(ids)), []
        lift = np.sqrt(np.maximum(most - np.einsum("nd,nd->n", vectors, vectors), 0))

        def split(a: int, b: int) -> None:
            if b - a <= LEAF:
                order[a:b] = np.sort(order[a:b])
                return
            some = order[a:b]
            vantage = some[(b - a) // 2]
            d = _distances(vectors[some] - vectors[vantage], lift[some] - lift[vantage])
            by = np.argsort(d, kind="stable")
            order[a:b], d, middle = some[by], d[by], (b - a) // 2
            nodes.append([vantage, d[0], d[middle - 1], d[middle], d[-1]])
            split(a, a + middle)
            split(a + middle, b)

        split(0, len(ids))
        table = np.array(nodes, float).reshape(-1, 5)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        table[:, 0] = place[table[:, 0].astype(np.int64)]
        return cls(vectors[order], ids[order], tags[order], table)


def nodes_of(rows: int) -> int:
    """Nodes of a tree of so many rows."""
    return 0 if rows <= LEAF else 1 + nodes_of(rows // 2) + nodes_of(rows - rows // 2)


class Search:
    """The k best of a tree for a block of queries, none with a score under the query's `least`."""

    def __init__(self, tree: Tree, queries: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int, factor: float, most: float):
        self.tree, self.queries, self.own, self.k, self.factor = tree, queries, ids, k, factor
        self.norms = np.einsum("nd,nd->n", queries, queries) + most
        self.least, self.score = least, np.full((len(ids), k), -np.inf)
        self.at = np.full((len(ids), k), -1, np.int64)
        self.visit(0, 0, len(tree.ids), np.arange(len(ids)))

    def visit(self, node: int, a: int, b: int, q: np.ndarray) -> None:
        if not len(q):
            return
        if b - a <= LEAF:
            return self.scan(a, b, q)
        vantage, *bounds = self.tree.nodes[node]
        middle = a + (b - a) // 2
        d = np.sqrt(np.maximum(self.norms[q] - 2 * (self.queries[q] @ self.tree.vectors[int(vantage)]), 0))
        sides = ((node + 1, a, middle, bounds[0], bounds[1]), (node + 1 + nodes_of(middle - a), middle, b, bounds[2], bounds[3]))
        inner = d <= (bounds[1] + bounds[2]) / 2
        for into_inner in (True, False):
            mine = inner == into_inner
            for n, x, y, low, high in sides if into_inner else sides[::-1]:
                gap = np.maximum(d[mine] - high, low - d[mine])
                self.visit(n, x, y, q[mine][gap <= self.factor * self.reach(q[mine]) + 1e-9])

    def reach(self, q: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far, here or elsewhere."""
        return reach(np.maximum(self.score[q, -1], self.least[q]), self.norms[q])

    def scan(self, a: int, b: int, q: np.ndarray) -> None:
        score = products(self.queries[q], self.tree.vectors[a:b])
        ids = self.tree.ids[a:b]
        worst = np.maximum(self.score[q, -1], self.least[q])
        at, col = np.nonzero((score >= worst[:, None]) & (ids[None, :] != self.own[q][:, None]))
        touched, place = np.unique(at, return_inverse=True)
        if not len(touched):
            return
        t = q[touched]
        row = np.concatenate((place, np.repeat(np.arange(len(t)), self.k)))
        scores = np.concatenate((score[at, col], self.score[t].ravel()))
        found = np.concatenate((a + col, self.at[t].ravel()))
        by = np.lexsort((np.where(found < 0, 0, self.tree.ids[found]), -scores, row))
        row, scores, found = row[by], scores[by], found[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.score[t[row[keep]], rank[keep]], self.at[t[row[keep]], rank[keep]] = scores[keep], found[keep]


def reach(worst: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Distance that a score stands for; without one it is infinite."""
    none = np.isinf(worst)
    return np.where(none, np.inf, np.sqrt(np.maximum(norms - 2 * np.where(none, 0, worst), 0)))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products summed component by component, so equal vectors have equal products wherever they are."""
    return np.einsum("qd,nd->qn", queries, vectors, optimize=False)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of double): finite, not zero, without null, of the commonest length; each row once."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")  # one row
    return fine.join(F.broadcast(sizes), F.size("v") == F.col("n")).select("vec_id", "v").dropDuplicates()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Index:
    """Trees in the shared folder; the driver holds at most PIVOTS pivots with the ball and number of shards of each."""

    def __init__(self, points: DataFrame):
        """points: vec_id, v of one length, on disk."""
        self.count, most = points.agg(F.count("*"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)"))).head()
        self.most = most = most or 0.0
        if not self.count:
            return
        sample = points.orderBy(F.xxhash64("vec_id", "v")).limit(min(PIVOTS, max(1, -(-self.count // SHARD_ROWS)))).select("v").collect()
        self.pivots = pivots = np.array([r.v for r in sample], float).reshape(len(sample), -1)
        lifts = np.sqrt(np.maximum(most - np.einsum("nd,nd->n", pivots, pivots), 0))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column("v"))
                lift = np.sqrt(np.maximum(most - np.einsum("nd,nd->n", v, v), 0))
                pivot = np.argmax(v @ pivots.T + lift[:, None] * lifts, axis=1)
                d = _distances(v - pivots[pivot], lift - lifts[pivot])
                yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(pivot.astype(np.int32)), pa.array(d)], names=["vec_id", "v", "pivot", "d"])

        placed = cut(points.mapInArrow(nearest, "vec_id long, v array<double>, pivot int, d double"), "placed")
        self.near, self.far, self.parts = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
        for r in placed.groupBy("pivot").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.count("*").alias("n")).collect():  # at most PIVOTS rows
            self.near[r.pivot], self.far[r.pivot], self.parts[r.pivot] = r.near, r.far, -(-r.n // SHARD_ROWS)
        self.first = np.concatenate(([0], np.cumsum(self.parts)))
        self.shards = int(self.first[-1])
        firsts = F.array(*map(F.lit, self.first[:-1].tolist()))
        parts = F.array(*map(F.lit, self.parts.tolist()))
        number = (F.get(firsts, F.col("pivot")) + F.pmod(F.xxhash64("vec_id", "v"), F.get(parts, F.col("pivot")))).cast("int")

        def build(shard: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            ids, v, tags = rows.column("vec_id").to_numpy(), np.concatenate([_matrix(c) for c in rows.column("v").chunks]), rows.column("tag").to_numpy()
            by = np.lexsort((tags, ids))
            tree = Tree.build(v[by], ids[by], tags[by], most)
            out = {"shard": [shard[0].as_py()], "ids": [tree.ids.tobytes()], "tags": [tree.tags.tobytes()], "vectors": [tree.vectors.tobytes()], "nodes": [tree.nodes.tobytes()]}
            return pa.table({f.name: pa.array(out[f.name], f.type) for f in pa_schema(INDEX)})

        rows = placed.select(number.alias("shard"), "vec_id", "v", F.xxhash64("v").alias("tag"))
        self.trees = cut(rows.groupBy("shard").applyInArrow(build, INDEX), "trees")

    def search(self, wanted: DataFrame, count: int, k: int, factor: float) -> DataFrame:
        """wanted: shard, query_id, v, least: at most `count` rows for a shard. query_id, vec_id, tag, score of what scores `least` or more."""
        blocks, most = max(1, -(-count // BLOCK_ROWS)), self.most
        none = F.lit(None)
        trees = self.trees.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), none.cast("long").alias("query_id"), none.cast("array<double>").alias("v"), none.cast("double").alias("least"))
        asked = wanted.select("shard", *(none.cast("binary").alias(c) for c in ("ids", "tags", "vectors", "nodes")), F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "query_id", "v", "least")
        both = trees.unionByName(asked).repartition(min(20_000, self.shards * blocks), "shard", "block").sortWithinPartitions("shard", "block", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, here = None, None
            for batch in batches:
                place = list(zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), strict=True))
                kinds = batch.column("kind").to_pylist()
                at = 0
                while at < len(place):
                    if kinds[at] == 0:
                        ids, tags, vectors, nodes = (batch.column(c)[at].as_py() for c in ("ids", "tags", "vectors", "nodes"))
                        ids = np.frombuffer(ids, np.int64)
                        tree, here = Tree(np.frombuffer(vectors).reshape(len(ids), -1), ids, np.frombuffer(tags, np.int64), np.frombuffer(nodes).reshape(-1, 5)), place[at]
                        at += 1
                        continue
                    to = at
                    while to < len(place) and to - at < BATCH and place[to] == place[at] and kinds[to] == 1:
                        to += 1
                    part = batch.slice(at, to - at)
                    at = to
                    assert here == place[to - 1]  # each shard and block begins with its tree
                    ids = part.column("query_id").to_numpy()
                    done = Search(tree, _matrix(part.column("v")), ids, part.column("least").to_numpy(), k, factor, most)
                    hit = done.at >= 0
                    yield pa.record_batch([pa.array(np.repeat(ids, hit.sum(axis=1))), pa.array(tree.ids[done.at[hit]]), pa.array(tree.tags[done.at[hit]]), pa.array(done.score[hit])], schema=pa_schema(FOUND))

        return both.mapInArrow(run, FOUND)

    def routed(self, asking: DataFrame, factor: float) -> DataFrame:
        """asking: query_id, v, and in the second round home and least. Adds the shard that each query starts in, or all others that its ball bounds leave."""
        pivots, near, far, parts, first, most, second = self.pivots, self.near, self.far, self.parts, self.first, self.most, "least" in asking.columns
        filled = parts > 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                v, ids = _matrix(batch.column("v")), batch.column("query_id").to_numpy()
                norms = np.einsum("nd,nd->n", v, v) + most
                d = np.sqrt(np.maximum(norms[:, None] - 2 * (v @ pivots.T), 0))
                if not second:
                    pivot = np.argmin(np.where(filled, d, np.inf), axis=1)
                    shard = first[pivot] + ids % parts[pivot]
                    yield pa.record_batch([batch.column("query_id"), batch.column("v"), pa.array(shard.astype(np.int32)), pa.array(np.full(len(ids), -np.inf))], names=["query_id", "v", "shard", "least"])
                    continue
                least, home = batch.column("least").to_numpy(), batch.column("home").to_numpy()
                gap = np.maximum(d - far, near - d)
                q, pivot = np.nonzero(filled & (gap <= factor * reach(least, norms)[:, None] + 1e-9))
                shard = np.repeat(first[pivot], parts[pivot]) + np.concatenate([np.arange(parts[p]) for p in pivot] or [np.zeros(0, np.int64)])
                q = np.repeat(q, parts[pivot])
                other = shard != home[q]
                for at in range(0, int(other.sum()), 1 << 14):  # what goes out at once is bounded, however many shards there are
                    some = slice(at, at + (1 << 14))
                    yield pa.record_batch([c.take(pa.array(q[other][some])) for c in (batch.column("query_id"), batch.column("v"))] + [pa.array(shard[other][some].astype(np.int32)), pa.array(least[q[other][some]])], names=["query_id", "v", "shard", "least"])

        return asking.mapInArrow(run, "query_id long, v array<double>, shard int, least double")


def search(rows: DataFrame, queries: DataFrame | None = None, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score. queries has vec_id and embedding; without them every EVERY-th vec_id of rows asks."""
    points = cut(usable(rows), "vectors")
    asking = (points.where(F.col("vec_id") % EVERY == 0) if queries is None else usable(queries)).withColumnRenamed("vec_id", "query_id")
    index = Index(points)
    if not index.count or asking.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = asking.count()
    homes = cut(index.routed(asking, factor), "homes")
    near = cut(index.search(homes, count, k, factor), "near")
    bound = near.groupBy("query_id").agg(F.expr("min(score)").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "least")
    # a query id on several vectors is rare; its least score bounds none of them alone
    single = homes.groupBy("query_id").agg(F.count("*").alias("vectors"))
    known = bound.join(single.where("vectors = 1"), "query_id").select("query_id", "least")
    again = homes.select("query_id", "v", F.col("shard").alias("home")).join(known, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    further = index.search(index.routed(again, factor), count, k, factor)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "tag")
    every = near.unionByName(further).repartition("query_id").groupBy("query_id", "vec_id", "tag").agg(F.max("score").alias("score"))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
