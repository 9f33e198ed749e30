"""Operator 6: BPE encoding and decoding with tree concatenation for long unsplit text.

Text is parted into units at white space, where every tokenizer used here parts it anyway, so a text's ids are its
units' ids in a row. A unit's ids come from the tokenizers library; a task remembers units in flat arrays of at most
MEMO_BYTES.

A unit of more than LONG characters is unsplit text. Its normalised form is cut into leaves, rows that Spark deals
to tasks; each leaf is encoded by itself. Neighbours then join in a tree: a window around the join is encoded again
and doubled until it shares AGREE tokens in a row with the left side and AGREE with the right side. Every two
neighbouring tokens of the result stand next to each other in an encoding made by the library, and a BPE encoding is
the one sequence whose neighbours are all compatible; where a window reaches both ends, it is the whole encoding.
A text's joins run in one task, which has to hold that text anyway, as it is one row.

Defined cases: null text is empty and has no ids; repeated rows and null doc_id get a row each; further columns are
ignored; special tokens in a text are matched as the library matches them.
"""

from __future__ import annotations

import array
import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_batch, documents, keeps, own, pa_schema, tidy

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG, LEAF, AGREE = 4096, 2048, 4
MEMO_BYTES = 48 << 20
SLICE_BYTES, SLICE_ROWS = 8 << 20, 4096
#: Characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space between words goes (word_bpe) or, as in the byte-level pattern, its last blank stays with the next word.
DROPPING = re.compile(f"[^{SPACE}]+")
KEEPING = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Texts without these part at single blanks and line ends alone.
ODD = "[\\t\\x0b-\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n]$"


def _odd(texts: pa.Array) -> np.ndarray:
    """Whether some blank or line end of a text does not stand alone between other characters."""
    found = pc.match_substring_regex(texts, ODD)
    for pair in ("  ", "\n\n", " \n", "\n ", "\0"):
        found = pc.or_(found, pc.match_substring(texts, pair))
    return found.to_numpy(zero_copy_only=False)


class Known:
    """Units seen before and their ids, in flat arrays of at most MEMO_BYTES: those met in most slices stay, of these the latest."""

    def __init__(self):
        self.units, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.met, self.latest, self.now = np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def places(self, units: pa.Array) -> np.ndarray:
        """The place of each unit; -1 where it is new."""
        self.now += 1
        at = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy(zero_copy_only=False)
        here = at[at >= 0]
        self.met[here] += 1
        self.latest[here] = self.now
        return at

    def add(self, units: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """units are new; sizes has their number of ids."""
        self.units = pa.concat_arrays([self.units, units])
        self.ids = np.concatenate((self.ids, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        self.met = np.concatenate((self.met, np.ones(len(units), np.int32)))
        self.latest = np.concatenate((self.latest, np.full(len(units), self.now, np.int32)))

    def trim(self) -> None:
        """Halves what is known once it takes more than MEMO_BYTES."""
        weight = pc.binary_length(self.units).to_numpy(zero_copy_only=False) + 4 * np.diff(self.ends) + 20
        if weight.sum() <= MEMO_BYTES:
            return
        order = np.lexsort((-self.latest, -self.met))
        kept = np.sort(order[np.cumsum(weight[order]) <= MEMO_BYTES // 2])
        lists = pa.ListArray.from_arrays(pa.array(self.ends.astype(np.int32)), pa.array(self.ids)).take(pa.array(kept))
        self.units, self.ids, self.ends = self.units.take(pa.array(kept)), lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        self.met, self.latest = (self.met[kept] + 1) // 2, self.latest[kept]


class Encoder:
    """ids of whole texts as the tokenizers library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dropping = self.library.normalizer is not None
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known = Known()

    @functools.cached_property
    def stretches(self) -> re.Pattern:
        """Special tokens, which end what stands before them as the end of a text does."""
        return re.compile("(" + "|".join(map(re.escape, self.special or ["(?!)"])) + ")")

    def units(self, text: str) -> list[str]:
        if self.dropping:
            return DROPPING.findall(text)
        return [u for i, x in enumerate(self.stretches.split(text)) for u in (KEEPING.findall(x) if i % 2 == 0 else [x])]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row and each text's place among them (one more place than texts)."""
        texts = texts.fill_null("")
        odd = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if not self.dropping:
            odd = odd | _odd(texts)
        usual = texts.filter(pa.array(~odd)) if odd.any() else texts
        if self.dropping:
            parts = pc.ascii_split_whitespace(usual)
        else:
            marked = pc.replace_substring(pc.replace_substring(usual, " ", "\0 "), "\n", "\0\n")
            parts = pc.split_pattern(marked, "\0")
        ids, places = self.gathered(parts.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))))
        if not odd.any():
            return ids, places
        own = [self.units(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        odd_ids, odd_places = self.gathered(pa.array([u for row in own for u in row], pa.string()), np.concatenate(([0], np.cumsum([len(row) for row in own]))))
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd], sizes[odd] = np.diff(places), np.diff(odd_places)
        all_places = np.concatenate(([0], np.cumsum(sizes)))
        out, of_odd = np.empty(all_places[-1], "<u4"), np.repeat(odd, sizes)
        out[~of_odd], out[of_odd] = ids, odd_ids
        return out, all_places

    def gathered(self, units: pa.Array, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units' ids in a row; places counts units, what is returned counts ids."""
        coded = units.dictionary_encode()
        lists = self.values(coded.dictionary)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
        return lists.take(coded.indices).values.to_numpy(), np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))[places]

    def values(self, units: pa.Array) -> pa.ListArray:
        """The ids of distinct units.

        A comma or full stop behind a plain Latin letter is a unit of its own, as every tokenizer used here has it, and
        ASCII text is lowered where the library does so (it has no marks that case could tell apart), so more is known.
        """
        ends = pc.and_(pc.match_substring_regex(units, "[A-Za-z\\x{df}-\\x{f6}\\x{f8}-\\x{ff}][.,]$"), pc.invert(pc.match_substring(units, "<|")))
        roots = pc.if_else(ends, pc.utf8_slice_codeunits(units, 0, -1), units)
        if self.dropping:
            roots = pc.if_else(pc.and_(pc.string_is_ascii(roots), pc.invert(pc.match_substring(roots, "<|"))), pc.ascii_lower(roots), roots)
        coded = pa.concat_arrays([roots, pa.array([".", ","], pa.string())]).dictionary_encode()
        lists, codes = self.remembered(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        if not pc.any(ends).as_py():
            return lists.take(pa.array(codes[:-2]))
        stops = pc.ends_with(units, ".").to_numpy(zero_copy_only=False)
        ended = ends.to_numpy(zero_copy_only=False)
        both = np.column_stack((codes[:-2], np.where(stops, codes[-2], codes[-1])))
        wanted = lists.take(pa.array(both[np.column_stack((np.ones(len(ended), bool), ended))]))
        offsets = wanted.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets[np.concatenate(([0], np.cumsum(1 + ended)))]), wanted.values)

    def remembered(self, units: pa.Array) -> pa.ListArray:
        """The ids of distinct units, from what is known or from the library."""
        at = self.known.places(units)
        new = np.flatnonzero(at < 0)
        fresh = units.take(pa.array(new))
        ids, sizes = self.fresh(fresh.to_pylist())
        starts = np.concatenate((self.known.ends[:-1], len(self.known.ids) + np.cumsum(sizes) - sizes))
        lengths = np.concatenate((np.diff(self.known.ends), sizes))
        at = at.astype(np.int64)
        at[new] = len(self.known.units) + np.arange(len(new))
        sizes_out = lengths[at]
        ends = np.concatenate(([0], np.cumsum(sizes_out)))
        picks = np.repeat(starts[at] - ends[:-1], sizes_out) + np.arange(ends[-1])
        out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate((self.known.ids, ids))[picks]))
        short = pc.less_equal(pc.binary_length(fresh), LONG).to_numpy(zero_copy_only=False)
        if short.all():
            self.known.add(fresh, ids, sizes)
        else:
            self.known.add(fresh.filter(pa.array(short)), ids[np.repeat(short, sizes)], sizes[short])
        self.known.trim()
        return out

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each unit)."""
        parts, sizes = array.array("I"), []
        for at in range(0, len(units), 4096):
            some = units[at : at + 4096]
            found = (e.ids for e in self.library.encode_batch_fast([u for u in some if len(u) <= LONG], add_special_tokens=False))
            for x in found if max(map(len, some)) <= LONG else [next(found) if len(u) <= LONG else np.frombuffer(self.long(u), "<u4").tolist() for u in some]:
                parts.extend(x)
                sizes.append(len(x))
        return np.frombuffer(parts.tobytes(), "<u4"), np.array(sizes, np.int64)

    def texts(self, texts: list[str | None]) -> list[bytes]:
        ids, places = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(places)]

    def long(self, unit: str) -> bytes:
        """One unit through leaves and joins in this task."""
        return b"".join(self.whole(part, [self.leaf(x) for x in leaves]) if leaves else self.plain(part) for part, leaves in self.cut(unit))

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, unit: str) -> list[tuple[str, list[str]]]:
        """(normalised text, its leaves) for each stretch of a unit between special tokens; (text, []) for what is short or a special token."""
        out = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", unit) if self.special else [unit]:
            if not part:
                continue
            if part in self.special or len(part) <= LONG:
                out.append((part, []))
                continue
            text = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
            if any(s in text for s in self.special):  # normalising made what looks like a special token; the library does not match it
                out.append((part, []))
            else:
                out.append((text, [text[i : i + LEAF] for i in range(0, len(text), LEAF)]))
        return out

    @functools.cached_property
    def bare(self):
        """The tokenizer without its normaliser, for text that is normalised already."""
        from tokenizers import Tokenizer, normalizers

        out = Tokenizer.from_file(self.path)
        out.normalizer = normalizers.Sequence([])
        return out

    @functools.cached_property
    def tokens(self) -> pa.Array:
        size = self.library.get_vocab_size(with_added_tokens=True)
        return pa.array([self.library.id_to_token(i) for i in range(size)], pa.string())

    def leaf(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids and, for each, the character after its last; -1 where a token ends within a character."""
        e = self.bare.encode(text, add_special_tokens=False)
        ids = np.array(e.ids, np.int64)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2)
        ends = spans[:, 1].copy()
        if len(ends) > 1:
            ends[:-1][spans[1:, 0] < ends[:-1]] = -1
        return ids, ends

    def whole(self, text: str, leaves: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
        """Joins neighbouring encodings level by level."""
        spans = [i * LEAF for i in range(len(leaves))] + [len(text)]
        level = [(spans[i], spans[i + 1], ids, np.where(ends < 0, -1, ends + spans[i])) for i, (ids, ends) in enumerate(leaves)]
        while len(level) > 1:
            level = [self.join(text, level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0][2].astype("<u4").tobytes()

    def join(self, text: str, a: tuple, b: tuple) -> tuple:
        begin, middle, end = a[0], a[1], b[1]
        width = 32
        while True:
            lo, hi = max(begin, middle - width), min(end, middle + width)
            ids, ends = self.leaf(text[lo:hi])
            ends = np.where(ends < 0, -1, ends + lo)
            left = (0, 0) if lo == begin else _agree(a[2], a[3], ids, ends, range(len(ids) - AGREE + 1), middle)
            right = (0, len(ids)) if hi == end else _agree(b[2], b[3], ids, ends, range(len(ids) - AGREE, -1, -1), -middle)
            if left is not None and right is not None and left[1] <= right[1]:
                head = (a[2][: left[0]], a[3][: left[0]]) if lo != begin else (ids[:0], ends[:0])
                tail = (b[2][right[0] :], b[3][right[0] :]) if hi != end else (ids[:0], ends[:0])
                parts = [head, (ids[left[1] : right[1]], ends[left[1] : right[1]]), tail]
                return begin, end, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            width *= 2

    def decode(self, ids: np.ndarray, places: np.ndarray) -> pa.Array:
        """Texts as the library's decode(ids, skip_special_tokens=False) gives them; without a decoder it joins the tokens by blanks."""
        if self.library.decoder is None:
            known = ids[ids < len(self.tokens)]
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), self.tokens.take(pa.array(known.astype(np.int32)))), " ")
        return pa.array(self.library.decode_batch([ids[a:b].tolist() for a, b in itertools.pairwise(places)], skip_special_tokens=False), pa.string())


def _agree(ids: np.ndarray, ends: np.ndarray, window: np.ndarray, window_ends: np.ndarray, places: range, middle: int) -> tuple[int, int] | None:
    """Indexes after AGREE tokens (before them, on the right side: middle < 0) that the side and the window share in a row, on that side of the join."""
    where = {int(e): i for i, e in enumerate(ends) if e >= 0}
    for j in places:
        i = where.get(int(window_ends[j]))
        if i is None or window_ends[j] <= 0:
            continue
        n = min(AGREE, len(ids) - i)
        if n < AGREE or not (np.array_equal(ids[i : i + n], window[j : j + n]) and np.array_equal(ends[i : i + n], window_ends[j : j + n])):
            continue
        if middle >= 0 and window_ends[j + n - 1] > middle or middle < 0 and window_ends[j] <= -middle:
            continue
        return (i + n, j + n) if middle >= 0 else (i, j)
    return None


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    own("bpe")
    return Encoder(path)


keeps("bpe", encoder.cache_clear)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded amount of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        limit = (ends[at - 1] if at else 0) + SLICE_BYTES
        to = min(max(int(np.searchsorted(ends, limit, "right")), at + 1), at + SLICE_ROWS)
        yield batch.slice(at, to - at)
        at = to


def binaries(ids: np.ndarray, places: np.ndarray) -> pa.Array:
    """A binary column of each text's ids."""
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer((places * 4).astype("<i4").tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])


def is_long(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"(?<!\S)\S{{{LONG + 1}}}"), F.lit(False))


def encode(docs: DataFrame, path: str = WORD_BPE) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit): one row for each row of docs."""
    rows = documents(docs)
    return _short(rows.where(~is_long(F.col("text"))), path).unionByName(_long(rows.where(is_long(F.col("text"))), path))


def _short(rows: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, made = pa_schema("doc_id long, ids binary"), encoder(path)
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), binaries(*made.flat(part.column("text")))], schema=target)

    return rows.mapInArrow(tidy(run, "bpe"), "doc_id long, ids binary")


def _long(rows: DataFrame, path: str) -> DataFrame:
    """Leaves of unsplit text are rows of their own, encoded wherever Spark puts them; each text's joins run in one task."""
    texts = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))  # a repeated row is encoded once

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, made = pa_schema("doc_id long, tag long, copies long, part int, leaf int, piece string"), encoder(path)
        for batch in batches:
            for doc_id, tag, copies, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "copies", "text")), strict=True):
                out: list[tuple[int, int, str]] = []
                short: list[str] = []

                def flush(out=out, short=short):
                    blanks = []  # at the end they stay apart: joined, they would part in another way
                    while short and not made.dropping and not short[-1].strip():
                        blanks.insert(0, short.pop())
                    for piece in [("" if not made.dropping else " ").join(short)] * bool(short) + blanks:
                        out.append((out[-1][0] + 1 if out else 0, -1, piece))
                    short.clear()

                for unit in made.units(text):
                    if len(unit) <= LONG:
                        short.append(unit)
                        continue
                    flush()
                    for part, leaves in made.cut(unit):
                        k = out[-1][0] + 1 if out else 0
                        out += [(k, i, leaf) for i, leaf in enumerate(leaves)] if leaves else [(k, -1, part)]
                flush()
                for at in range(0, len(out), 512):
                    some = out[at : at + 512]
                    yield as_batch({"doc_id": [doc_id] * len(some), "tag": [tag] * len(some), "copies": [copies] * len(some), "part": [x[0] for x in some], "leaf": [x[1] for x in some], "piece": [x[2] for x in some]}, target)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        for batch in batches:
            ids, ends = [], []
            for leaf, piece in zip(batch.column("leaf").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                x, y = made.leaf(piece) if leaf >= 0 else (np.frombuffer(made.texts([piece])[0] if len(piece) <= LONG or " " in piece else made.plain(piece), "<u4"), np.zeros(0))
                ids.append(x.astype("<u4").tobytes())
                ends.append(y.astype("<i4").tobytes())
            columns = [batch.column(c) for c in ("doc_id", "tag", "copies", "part", "leaf", "piece")]
            yield pa.record_batch([*columns, pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], names=["doc_id", "tag", "copies", "part", "leaf", "piece", "ids", "ends"])

    @F.arrow_udf(T.BinaryType())
    def joined(rows: pa.Array) -> pa.Array:
        made, out = encoder(path), []
        for row in rows.to_pylist():
            parts: dict[int, list] = {}
            for x in row:
                parts.setdefault(x["part"], []).append(x)
            done = []
            for part in sorted(parts):
                leaves = sorted(parts[part], key=lambda x: x["leaf"])
                if leaves[0]["leaf"] < 0:
                    done.append(leaves[0]["ids"])
                else:
                    spans = [(np.frombuffer(x["ids"], "<u4").astype(np.int64), np.frombuffer(x["ends"], "<i4").astype(np.int64)) for x in leaves]
                    done.append(made.whole("".join(x["piece"] for x in leaves), spans))
            out.append(b"".join(done))
        return pa.array(out, pa.binary())

    cut_up = texts.withColumn("tag", F.xxhash64("text")).mapInArrow(tidy(pieces, "bpe"), "doc_id long, tag long, copies long, part int, leaf int, piece string")
    dealt = cut_up.repartition("doc_id", "tag", "part", "leaf").mapInArrow(tidy(encoded, "bpe"), "doc_id long, tag long, copies long, part int, leaf int, piece string, ids binary, ends binary")
    whole = dealt.groupBy("doc_id", "tag", "copies").agg(F.collect_list(F.struct("part", "leaf", "piece", "ids", "ends")).alias("rows"))
    return whole.select("doc_id", F.explode(F.expr("sequence(1, copies)")), joined("rows").alias("ids")).select("doc_id", "ids")


def digest(docs: DataFrame, path: str = WORD_BPE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, made = pa_schema("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"), encoder(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                ids = part.column("ids").to_pylist()
                places = np.concatenate(([0], np.cumsum([len(b) // 4 for b in ids])))
                text = made.decode(np.frombuffer(b"".join(ids), "<u4"), places).to_pylist()
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(places)), pa.array([hashlib.sha256(b).hexdigest() for b in ids]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text])], schema=target)

    return encode(docs, path).mapInArrow(tidy(run, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
