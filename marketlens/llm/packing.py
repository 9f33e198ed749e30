"""Operator 5: hierarchical packing into sequences of several context sizes.

Documents are dealt to shards by a hash. A shard cuts full windows of the longest tier off a document and routes the
rest to the smallest tier that holds it. Tiers are packed from the longest down: gaps in a long window are filled
with pieces of shorter tiers, whole ones first, the last one cut to fit; the shortest tier is filled end to end.
So every window is full but those at the end of a shard, where what is left is cut into windows of ever shorter
powers of two. Windows of a tier are numbered over all shards and form step groups of STEP_TOKENS tokens each, so steps
are balanced: only the last group of each tier may be smaller. What is cut shorter than the tiers belongs to no step.

A shard packs POOL_TOKENS tokens at a time, so a task's memory is bounded; whatever does not fill a window then
stays in the pool for the next round. Shard and order depend on the rows alone, so a task that runs again gives the
same pieces.

Defined cases: null text is empty and gives the end id alone; null doc_id is packed like any other; repeated rows are
packed each; further columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WORD_BPE, encoder, slices
from .common import cut, documents, pa_schema, parts_for, tidy
from .tokens import offsets, with_end

END = 1
LENGTH = 2048
TIERS = (2048, 1024, 512, 256)
#: Windows at the end of a shard; fewer ids than the last are padded.
TAIL = (128, 64, 32, 16, 8, 4, 2, 1)
STEP_TOKENS = 16 * LENGTH
POOL_TOKENS = 4 << 20
SHARD_BYTES = 32 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, shard int, sequence long, offset long, tier int, number long"


class Packer:
    """Pieces are [doc number, start, length]; windows come out as (tier, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.pools, self.held = tiers, {t: deque() for t in tiers}, 0

    def add(self, doc: int, size: int) -> Iterator[tuple[int, list]]:
        longest = self.tiers[0]
        for at in range(0, size - longest + 1, longest):
            yield longest, [(doc, at, longest)]
        if rest := size % longest:
            self.pools[min(t for t in self.tiers if t >= rest)].append((doc, size - rest, rest))
            self.held += rest

    def take(self, room: int, tiers: tuple[int, ...]) -> list:
        """Pieces for a gap: whole ones of the tiers named, then from the shortest pool, the last one cut to fit. Less only where all pools are empty."""
        out, whole = [], room
        for pool in (self.pools[t] for t in tiers):
            tries = 8
            while room and pool and tries:
                if pool[0][2] <= room:
                    out.append(pool.popleft())
                    room -= out[-1][2]
                else:
                    pool.rotate(-1)
                    tries -= 1
        while room and (pool := next((self.pools[t] for t in reversed(self.tiers) if self.pools[t]), None)):
            doc, at, size = pool.popleft()
            used = min(size, room)
            out.append((doc, at, used))
            room -= used
            if rest := size - used:
                self.pools[min(t for t in self.tiers if t >= rest)].append((doc, at + used, rest))
        self.held -= whole - room
        return out

    def full(self) -> Iterator[tuple[int, list]]:
        """All windows that the pools can fill."""
        for i, t in enumerate(self.tiers):
            while self.pools[t] and self.held >= t:
                piece = self.pools[t].popleft()
                self.held -= piece[2]
                yield t, [piece, *self.take(t - piece[2], self.tiers[i + 1 :])]

    def rest(self) -> Iterator[tuple[int, list]]:
        yield from self.full()
        for t in (*self.tiers[1:], *TAIL):
            while self.held >= t:
                yield t, self.take(t, self.tiers)


def pack(docs: DataFrame, tokenizer: str = WORD_BPE, end: int = END) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset, tier, step (null below the tiers). Rows of one doc_id are documents each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, shard, packer, target = encoder(tokenizer), TaskContext.get().partitionId(), Packer(), pa_schema(SCHEMA)
        texts: dict[int, list] = {}  # doc number: [doc_id, ids, ids not yet out]
        count, sequence, numbers = 0, 0, {}

        def rows(windows: Iterator[tuple[int, list]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: dict[str, list] = {name: [] for name in target.names}
            for tier, pieces in windows:
                number, offset = numbers.get(tier, 0), 0
                numbers[tier] = number + 1
                for doc, start, length in pieces:
                    text = texts[doc]
                    for name, value in zip(target.names, (text[0], start, length, len(text[1]), text[1][start : start + length].tobytes(), shard, sequence, offset, tier, number), strict=True):
                        out[name].append(value)
                    offset += length
                    text[2] -= length
                    if not text[2]:
                        del texts[doc]
                sequence += 1
                if len(out["doc_id"]) >= 4096:
                    yield pa.record_batch([pa.array(out[f.name], f.type) for f in target], schema=target)
                    out = {name: [] for name in target.names}
            if out["doc_id"]:
                yield pa.record_batch([pa.array(out[f.name], f.type) for f in target], schema=target)

        def added(part: pa.RecordBatch) -> Iterator[tuple[int, list]]:
            nonlocal count
            ids, places = with_end(*made.flat(part.column("text")), end)
            for doc_id, a, b in zip(part.column("doc_id").to_pylist(), places[:-1].tolist(), places[1:].tolist(), strict=True):
                texts[count] = [doc_id, ids[a:b].astype("<u4"), b - a]
                yield from packer.add(count, b - a)
                count += 1
                if packer.held >= POOL_TOKENS:
                    yield from packer.full()

        for batch in batches:
            for part in slices(batch):
                yield from rows(added(part))
        yield from rows(packer.rest())

    keyed = documents(docs).withColumn("tag", F.xxhash64("text"))
    dealt = keyed.repartition(parts_for(docs, SHARD_BYTES), F.xxhash64("doc_id", "tag")).sortWithinPartitions("doc_id", "tag").select("doc_id", "text")
    packed = cut(dealt.mapInArrow(tidy(run, "bpe"), SCHEMA), "packed")
    # one row for each shard, and one for each shard and tier: as many as tasks, times twelve at most
    shards = offsets(packed.groupBy("shard").agg((F.max("sequence") + 1).alias("size")), "shard", "size", "first").select("shard", "first")
    tiers = packed.groupBy("tier", "shard").agg((F.max("number") + 1).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("tier").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = tiers.select("tier", "shard", before.alias("before")).join(shards, "shard")
    whole = packed.join(F.broadcast(places), ["shard", "tier"])
    step = F.floor((F.col("before") + F.col("number")) / (F.lit(STEP_TOKENS) / F.col("tier"))).cast("long")
    return whole.select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset", "tier", F.when(F.col("tier") >= TIERS[-1], F.concat_ws("-", "tier", step)).alias("step"))


@F.arrow_udf(T.LongType())
def _crc(ids: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64())


def digest(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step: one row for each piece."""
    return pack(docs, tokenizer).select("doc_id", "start", "length", _crc("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")
