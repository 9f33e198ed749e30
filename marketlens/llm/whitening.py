"""Operator 13: whitening of embeddings with a covariance that is exact.

An entry c counts as the integer x = floor(SCALE * c) + SHIFT. With n vectors and the sums S of each dimension, y = n * x - S
is the centred vector times n, an integer too, so the sum of y_i * y_j over all rows is n cubed times the covariance
without any rounding. It is formed by a digit-slice product: each task splits y into limbs of LIMB bits, multiplies the
limbs of up to ROWS rows as float64 matrices (every partial sum stays under 2 to the 53rd, so BLAS is exact), adds the
products of equal weight as integers, and recombines them as big integers; Spark merges these over the tasks in two
decimal columns. The driver gets one number for each pair of dimensions, rounds once and decomposes into eigenvectors.

The embeddings are read four times: sums, products, moments of the whitened values, result. Rows never move.

Defined cases: vectors that are null, empty, of another length than most rows' (ties: the longest) or hold null or
non-finite entries take no part; repeated rows all count; a null vec_id is kept; entries beyond 2**56 count as 2**56
(sign kept); a deviation that passes 64 bits is null as long, `deviation_exact` has its digits; components without variance (under
FLAT of the largest) have no whitened value and are left out, so equal vectors alone give no rows; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, cut, pa_schema, tidy

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FLAT = 1e-12
LIMB, ROWS = 18, 1 << 16
#: Products of ROWS rows are under 2**52, so this many are added as 64-bit integers before they are recombined.
FOLD = 512
#: One task gives a number for each pair of dimensions, so the tasks of that pass are at most so many.
MOST_TASKS = 2048
#: Big integers cross Spark as two decimals in this base.
BASE = 10**30
FIXED = 1 << 62
SUMS, PRODUCTS = "size int, at int, n long, total string", "i int, j int, high string, low string"
MOMENTS, RESULT = "n long, mean array<double>, spread array<double>", "vec_id long, deviation long, deviation_exact string, whitened array<double>"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, of rows whose vector holds finite numbers only."""
    vector = F.col("embedding").cast("array<double>")
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
    return plain.where((F.size("embedding") > 0) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))


def blocks(batch: pa.RecordBatch, size: int | None = None) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Integer vectors of one length, at most ROWS at once, with their ids."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        lists, ids = part.column("embedding"), part.column("vec_id")
        lengths = np.asarray(lists.value_lengths())
        for length in np.unique(lengths) if size is None else [size]:
            mine = pa.array(lengths == length)
            flat = np.asarray(lists.filter(mine).flatten(), dtype=float)
            if len(flat):
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(flat * SCALE), -FIXED, FIXED)
                yield whole.astype(np.int64).reshape(-1, int(length)) + SHIFT, ids.filter(mine)


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns as big integers, by halves that cannot overflow."""
    return ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for x, _ in blocks(batch):
            n, total = found.get(x.shape[1], (0, 0))
            found[x.shape[1]] = [n + len(x), total + column_sums(x)]
    for size, (n, total) in found.items():
        yield as_batch({"size": [size] * size, "at": list(range(size)), "n": [n] * size, "total": [str(t) for t in total]}, pa_schema(SUMS))


@dataclass(frozen=True)
class Centre:
    """n and, for each dimension, the quotient and rest of its sum by n."""

    n: int
    quotients: list[int]
    rests: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as 64-bit integers where they fit, else as big ones."""
        apart = x - np.array(self.quotients, np.int64)
        if self.n * (int(np.abs(apart).max(initial=0)) + 1) < FIXED:
            return self.n * apart - np.array(self.rests, np.int64)
        return (x.astype(object) - np.array(self.quotients, object)) * self.n - np.array(self.rests, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Digits of LIMB bits, least first, as float64; the last one has the sign."""
    out, half = [], 1 << (LIMB - 1)
    while not np.all((y >= -half) & (y < half)):
        out.append((y & ((1 << LIMB) - 1)).astype(float))
        y = y >> LIMB
    return [*out, y.astype(float)]


class Product:
    """The sum of y transposed times y over many blocks, exact."""

    def __init__(self, size: int):
        self.size, self.total, self.open, self.blocks = size, np.zeros((size, size), object), {}, 0

    def add(self, y: np.ndarray) -> None:
        digits = limbs(y)
        for a, left in enumerate(digits):
            for b, right in enumerate(digits):
                product = (left.T @ right).astype(np.int64)
                self.open[a + b, a] = self.open[a + b, a] + product if (a + b, a) in self.open else product
        self.blocks += 1
        if self.blocks == FOLD:
            self.fold()

    def fold(self) -> np.ndarray:
        for (weight, _), product in self.open.items():
            self.total = self.total + (product.astype(object) << (LIMB * weight))
        self.open, self.blocks = {}, 0
        return self.total


def _products(centre: Centre) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(centre.quotients)
        product = Product(size)
        for batch in batches:
            for x, _ in blocks(batch, size):
                product.add(centre.centred(x))
        total = product.fold()
        for i in range(size if total.any() else 0):
            parts = [divmod(int(total[i, j]), BASE) for j in range(i, size)]
            yield as_batch({"i": [i] * (size - i), "j": list(range(i, size)), "high": [str(p[0]) for p in parts], "low": [str(p[1]) for p in parts]}, pa_schema(PRODUCTS))

    return run


@dataclass(frozen=True)
class Whitening:
    """What is fitted: the centre, unit eigenvectors as columns by falling eigenvalue, eigenvalues, and each one's share of the variance."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(float) / self.centre.n) @ self.vectors / np.sqrt(self.values)

    def apply(self, embeddings: DataFrame) -> DataFrame:
        """vec_id, deviation, deviation_exact and the whitened vector of each row that takes part."""
        return usable(embeddings).mapInArrow(tidy(_applied(self), "whitening"), RESULT)

    def identity_error(self, embeddings: DataFrame) -> float:
        """Largest absolute entry of the whitened values' covariance minus the identity. Tasks give their own means and co-moments, which are brought to the common mean."""
        width = len(self.values)
        parts = cut(usable(embeddings).coalesce(MOST_TASKS).mapInArrow(tidy(_moments(self), "whitening"), MOMENTS), "moments")
        means = parts.select("n", F.posexplode("mean").alias("at", "mean")).groupBy("at").agg((F.sum(F.col("n") * F.col("mean")) / self.centre.n).alias("mean")).orderBy("at").collect()
        mean = F.array(*[F.lit(float(r["mean"])) for r in means])
        spread = parts.select("n", "mean", F.posexplode("spread").alias("at", "value"))
        a, b = F.floor(F.col("at") / width).cast("int"), F.pmod("at", F.lit(width))
        off = [F.element_at("mean", side + 1) - F.element_at(mean, side + 1) for side in (a, b)]
        covariance = spread.groupBy("at").agg((F.sum(F.col("value") + F.col("n") * off[0] * off[1]) / self.centre.n).alias("value"))
        one = F.when(F.pmod("at", F.lit(width + 1)) == 0, 1.0).otherwise(0.0)
        return covariance.agg(F.max(F.abs(F.col("value") - one)).alias("most")).first()["most"]


def _moments(fitted: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(fitted.values)
        n, mean, spread = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            for x, _ in blocks(batch, len(fitted.centre.quotients)):
                w = fitted.whitened(fitted.centre.centred(x))
                own, more = w.mean(0), len(w)
                apart = own - mean
                spread += (w - own).T @ (w - own) + np.outer(apart, apart) * (n * more / (n + more))
                mean, n = mean + apart * (more / (n + more)), n + more
        if n:
            yield as_batch({"n": [n], "mean": [mean.tolist()], "spread": [spread.ravel().tolist()]}, pa_schema(MOMENTS))

    return run


def _applied(fitted: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, ids in blocks(batch, len(fitted.centre.quotients)):
                y = fitted.centre.centred(x)
                fits = y.dtype != object and y.shape[1] * int(np.abs(y).max()) ** 2 < FIXED
                far = (y * y if fits else y.astype(object) ** 2).sum(1)
                far = [int(d) for d in far]
                rows = pa.FixedSizeListArray.from_arrays(pa.array(fitted.whitened(y).ravel()), len(fitted.values)).cast(pa.list_(pa.float64()))
                yield pa.record_batch([ids, pa.array([d if d < 1 << 63 else None for d in far], pa.int64()), pa.array([str(d) for d in far]), rows], schema=pa_schema(RESULT))

    return run


def fit(embeddings: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """Fits on all vectors that take part; None where there are none or they do not differ."""
    vectors = usable(embeddings)
    sums = cut(vectors.mapInArrow(tidy(_sums, "whitening"), SUMS).groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")), "sums")
    chosen = sums.where("at = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if chosen is None:
        return None
    n, size = chosen["n"], chosen["size"]
    totals = [int(r["total"]) for r in sums.where(F.col("size") == size).orderBy("at").collect()]
    centre = Centre(n, [t // n for t in totals], [t % n for t in totals])
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    merged = vectors.coalesce(MOST_TASKS).mapInArrow(tidy(_products(centre), "whitening"), PRODUCTS).groupBy("i", "j").agg(*whole)
    covariance, trace = np.zeros((size, size)), 0
    for r in merged.collect():
        product = int(r["high"]) * BASE + int(r["low"])
        covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = product / n**3
        trace += product if r["i"] == r["j"] else 0
    values, found = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > FLAT * max(values.max(), 0)]
    return Whitening(centre, found[:, order], values[order], [float(e) / (trace / n**3) for e in values[order]]) if len(order) else None


def digest(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each vector and component."""
    fitted = fit(embeddings, most)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
    rows = fitted.apply(embeddings).select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(e) for e in fitted.explained])
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.centre.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(fitted.identity_error(embeddings)).alias("identity_error"), "deviation_exact",
    )
