"""Repeated passages across a corpus: bytes inside a string of `length` bytes that also starts earlier.

1. Anchors. In each text, a gram of GRAM bytes is an anchor if its hash is the least of
   some run of length - GRAM + 1 grams. Every string of `length` bytes holds an anchor,
   and equal strings hold the same ones at the same places. An anchor comes with a hash
   of its surroundings: all bytes of the strings of `length` that hold it.
2. Equal anchors in equal surroundings repeat whole: all but the first lose their
   surroundings. Each task settles this among its own rows at once and sends on the first
   alone, so a passage in every document makes one row a task; the rest is settled after
   one shuffle by anchor.
3. Equal anchors in different surroundings share some strings and not others. The first
   place of each kind is cut into halves keyed by the anchor and its next bytes on
   either side; halves whose key occurs once are done. Of halves with the same bytes all
   but the first are marked whole; where a key has different halves, the first of each
   go to shards, and a shard's suffix array with its permuted common prefixes shows which
   of their strings of `length` bytes are equal; all but the first are marked. A key with
   too many different halves for one shard has each cut in two again, by more bytes on
   either side, until keys are small or have all `length` bytes, and so one string.
4. The marks of a document are merged and its text is cut.

Every place in the corpus is compared with every other through the anchors; nothing
depends on how texts are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpoint, shuffle_partitions, texts
from .suffix_array import common_prefixes, suffix_array

GRAM = 32
#: Bytes of text whose anchors are found at a time; longer texts go in pieces. Each takes some 100 bytes of memory.
_BUFFER = 1 << 19
#: Anchors that a task settles at a time, some 100 bytes of memory each.
_FLUSH = 1_000_000
#: Rows in a batch that goes back to Spark.
_BATCH = 20_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A random word for each byte, and the odd base and its inverse for hashes of strings.
_WORD = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = next(iter(_POWER.values()), None)
    if have is None or len(have[0]) < n:
        n = max(n, 2 * _BUFFER)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWER.clear()
        _POWER[n] = have = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, inverse))
    return have


class StringHash:
    """64-bit hashes of any substrings of a buffer."""

    def __init__(self, b: np.ndarray):
        up, self.down = _powers(len(b) + 1)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_WORD[b] * up[: len(b)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scramble((self.sum[end] - self.sum[start]) * self.down[start] + (end - start).astype(np.uint64) * _B)


def _grams(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place of a buffer that has GRAM more at its end."""
    n = len(b) - GRAM
    words = np.ndarray((n + GRAM - 8,), np.uint64, b.tobytes(), strides=(1,))
    h = words[:n].copy()
    for k in range(8, GRAM, 8):
        h *= _A
        h += words[k : k + n]
    return _scramble(h) | np.uint64(1)  # over 0


def _sliding(x: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best over x[i : i + width] for each i, in blocks: a running best from each block's start and one from its end."""
    n = len(x)
    blocks = -(-(n + width) // width)
    p = np.full(blocks * width, fill, np.uint64)
    p[:n] = x
    p = p.reshape(blocks, width)
    up = best.accumulate(p, axis=1).ravel()
    down = best.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(down[:n], up[width - 1 : width - 1 + n])


def anchors(raws: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, place, gram hash, hash of surroundings, bytes before, bytes after) of the anchors of texts of `length` bytes or more."""
    size = np.array([len(r) for r in raws], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    total = int(size.sum())
    b = np.frombuffer(b"".join(raws) + bytes(GRAM), np.uint8)
    h = _grams(b)
    run = length - GRAM + 1
    least = _sliding(h, run, np.minimum, (1 << 64) - 1)
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + np.maximum(size - length + 1, 0), -1)
    least[np.cumsum(change)[:total] <= 0] = 0  # strings of `length` that would leave the text
    padded = np.concatenate([np.zeros(run - 1, np.uint64), least])
    most = _sliding(padded, run, np.maximum, 0)[:total]
    at = np.flatnonzero(most == h)
    text = np.searchsorted(start, at, side="right") - 1
    place = at - start[text]
    before = np.minimum(place, length - GRAM)
    after = np.minimum(size[text] - place, length)
    return text, place, h[at], StringHash(b).of(at - before, at + after) ^ _scramble(before.astype(np.uint64)), before, after


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document, sorted and joined where they overlap or touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + number * wide)
    new = np.concatenate([[True], (start + number * wide)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return doc[first], start[first], reach[last] - number[last] * wide


_FOUND = pa.schema([("v", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("mark", pa.bool_())])


def _pieces(raw: bytes, length: int) -> Iterator[tuple[bytes, int, int, int]]:
    """A text in pieces (bytes, where they start, which of their places count, from and to) that have `length` bytes more on either side.

    What makes a place an anchor, and its surroundings, are less than that away.
    """
    step = max(_BUFFER, 4 * length)
    for a in range(0, len(raw), step):
        start = max(0, a - length)
        yield (raw if len(raw) <= step else raw[start : a + step + length]), start, a - start, min(a + step, len(raw)) - start


def _find(length: int):
    """A function over batches of texts: the first anchor of each kind among the task's rows, and marks (c: their end) for the others."""

    def settle(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Empties what is held."""
        columns = []
        for x in held:
            columns.append(np.concatenate(x))
            x.clear()
        doc, at, v, c, before, after = columns
        order = np.lexsort((at, doc, c, v))
        again = np.zeros(len(order), bool)
        again[1:] = (v[order[1:]] == v[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
        # a document that occurs twice under one id does not come before itself
        first = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
        again &= (doc[order] != doc[first]) | (at[order] != at[first])
        k, rest = order[again], order[~again]
        del order, first, again
        d, s, e = merge(doc[k], at[k] - before[k], at[k] + after[k])
        for i in range(0, len(d), _BATCH):
            j = slice(i, i + _BATCH)
            none = np.zeros(len(d[j]), np.int32)
            yield _batch(_scramble(d[j].view(np.uint64) * _A + s[j].astype(np.uint64)), e[j], d[j], s[j], none, none, True)
        for i in range(0, len(rest), _BATCH):
            j = rest[i : i + _BATCH]
            yield _batch(v[j], c[j], doc[j], at[j], before[j], after[j], False)

    def _batch(v, c, doc, at, before, after, mark: bool) -> pa.RecordBatch:
        columns = [v.view(np.int64), c.view(np.int64), doc, at, before, after]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(len(v), mark))], schema=_FOUND)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in _FOUND.names[1:]], 0
        pieces, size = [], 0

        def take() -> int:
            ids, raws, start, least, end = zip(*pieces, strict=True)
            pieces.clear()
            ids, start, least, end = (np.array(x, np.int64) for x in (ids, start, least, end))
            text, place, v, c, before, after = anchors(raws, length)
            own = (place >= least[text]) & (place < end[text])
            text, place = text[own], place[own]
            for x, y in zip(held, (ids[text], start[text] + place, v[own], c[own], before[own].astype(np.int32), after[own].astype(np.int32)), strict=True):
                x.append(y)
            return len(text)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = x.as_py().encode()
                if len(raw) < length or i is None:
                    continue
                for p in _pieces(raw, length):
                    pieces.append((i, *p))
                    size += len(p[0])
                    if size >= _BUFFER:
                        n += take()
                        size = 0
                        if n >= _FLUSH:
                            yield from settle(held)
                            n = 0
        if pieces:
            n += take()
        if n:
            yield from settle(held)

    return find


_HALF = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("core", pa.int32()), ("bytes", pa.binary())])
_HALF_COLUMNS = "key long, doc_id long, at long, core int, bytes binary"


def _halves(length: int, width: int, side: int):
    """Of each place asked for, the strings of `length` that hold its `width` bytes and `side` more before, and those that hold `side` more after.

    side is at most half of length - width, rounded up, so that no string is left out.
    core: where in the half the bytes of its key begin. The rows have a text with its
    places, or a half of a step before, whose core is cut.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int, bytes]] = []

        def batch() -> pa.RecordBatch:
            columns = list(map(pa.array, zip(*rows, strict=True), _HALF.types))
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_HALF)

        def texts_and_places(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, list[int]]]:
            if "places" in b.schema.names:
                for i, x, places in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("places").to_pylist(), strict=True):
                    yield i, 0, x.as_py().encode(), places
            else:
                for i, at, core, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "at", "core", "bytes")), strict=True):
                    yield i, at, x, [core]

        for b in batches:
            for i, at, raw, places in texts_and_places(b):
                for p in places:
                    if p >= side:
                        start = max(0, p + width - length)
                        rows.append((_key(b"L" + raw[p - side : p + width]), i, at + start, p - side - start, raw[start : p - side + length]))
                    if p + width + side <= len(raw):
                        start = max(0, p + width + side - length)
                        rows.append((_key(b"R" + raw[p : p + width + side]), i, at + start, p - start, raw[start : p + length]))
                    if len(rows) >= _BATCH:
                        yield batch()
        if rows:
            yield batch()

    return cut


def _key(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


def shard_marks(doc: np.ndarray, at: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked intervals (doc, start, end): the strings of `length` in the pieces that also start earlier, by (doc, place)."""
    size = np.array([len(p) for p in pieces], np.int64)
    t = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + np.int16(2)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    t[start + size] = 1  # between pieces
    t = np.concatenate([t, np.zeros(1, np.int16)])
    sa = suffix_array(t)
    shared = common_prefixes(t, sa, length)
    piece = np.searchsorted(start, sa, side="right") - 1
    whole = sa - start[piece] + length <= size[piece]
    group = np.cumsum(~(shared[sa] >= length))
    sa, piece, group = sa[whole], piece[whole], group[whole]
    where_doc, where_at = doc[piece], at[piece] + sa - start[piece]
    order = np.lexsort((where_at, where_doc, group))
    group, where_doc, where_at = group[order], where_doc[order], where_at[order]
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0)) if len(group) else np.zeros(0, np.int64)
    again = (where_doc != where_doc[first]) | (where_at != where_at[first])
    return merge(where_doc[again], where_at[again], where_at[again] + length)


_MARK = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _sort_shards(length: int, shard_bytes: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a shard ends where a key does."""

        def marks() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(map(pa.array, shard_marks(np.array(doc, np.int64), np.array(at, np.int64), pieces, length))), schema=_MARK)

        doc, at, pieces, size, last = [], [], [], 0, None
        for b in batches:
            for k, d, p, x in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), b.column("at").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                if size >= shard_bytes and k != last:
                    yield marks()
                    doc, at, pieces, size = [], [], [], 0
                last = k
                doc.append(d)
                at.append(p)
                pieces.append(x)
                size += len(x) + 1
        if pieces:
            yield marks()

    return sort


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for x, marks in zip(b.column("text"), b.column("marks").to_pylist(), strict=True):
            raw = x.as_py().encode()
            spans: list[list[int]] = []
            for m in sorted((m["start"], m["end"]) for m in marks or ()):
                if spans and m[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], m[1])
                else:
                    spans.append(list(m))
            kept, at = [], 0
            for s, e in spans:
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            rest = b"".join(kept)
            rows.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, length: int = 100, shard_bytes: int = 1 << 19) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per row of docs (doc_id long, text).

    Removed is each byte inside a string of `length` bytes (UTF-8) that also starts
    earlier: in a document with a smaller doc_id, or before in the same one; overlaps
    count. spans: the maximal removed runs [start, end), in bytes. Null counts as empty;
    texts under `length` bytes lose nothing and take nothing. Rows without a doc_id are
    left whole. Rows with the same doc_id and text are the same place and do not remove
    each other. An empty table gives an empty result. Other columns are ignored.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    t = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = t.mapInArrow(_find(length), "v long, c long, doc_id long, at long, before int, after int, mark boolean")
    of_gram = Window.partitionBy("v")
    place = F.struct("doc_id", "at")
    same = F.min(place).over(Window.partitionBy("v", "c")) != place
    rows = found.repartition("v").withColumns({"same": same, "mixed": F.min("c").over(of_gram) != F.max("c").over(of_gram)})
    rows = checkpoint(
        rows.where("mark or same or mixed").select(
            "doc_id",
            F.when(F.col("mark"), F.col("at")).when(F.col("same"), F.col("at") - F.col("before")).alias("start"),
            F.when(F.col("mark"), F.col("c")).when(F.col("same"), F.col("at") + F.col("after")).alias("end"),
            F.when(~F.col("mark") & ~F.col("same"), F.col("at")).alias("at"),
        )
    )
    asked = rows.where("at is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("places"))
    n = rows.where("at is not null").count()
    shards = max(shuffle_partitions(docs.sparkSession), n * 2 * length // (64 * shard_bytes))
    alike = Window.partitionBy("key", "bytes")
    of_key = Window.partitionBy("key")
    marks = rows.where("start is not null").select("doc_id", "start", "end")
    todo, width, side = t.join(asked, "doc_id"), GRAM, (length - GRAM) // 2
    while True:
        halves = todo.mapInArrow(_halves(length, width, side), _HALF_COLUMNS).repartition(shards, "key")
        halves = (
            halves.withColumns({"first": F.min(place).over(alike), "least": F.min("bytes").over(of_key), "most": F.max("bytes").over(of_key)})
            .withColumns({"again": place != F.col("first"), "mixed": F.col("least") != F.col("most"), "n": F.length("bytes")})
            .withColumn("large", F.sum(F.when(~F.col("again"), F.col("n"))).over(of_key) > 2 * shard_bytes)
        )
        halves = checkpoint(
            halves.where(f"(again and n >= {length}) or (mixed and not again)").select(
                "key", "doc_id", "at", "core", "again", "large", "n", F.when(~F.col("again"), F.col("bytes")).alias("bytes")
            )
        )
        width += side
        twins = halves.where("again").select("doc_id", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"))
        small = F.lit(True) if width >= length else ~F.col("large")
        sorted_ = halves.where(~F.col("again") & small).repartition(shards, "key").sortWithinPartitions("key", "doc_id", "at").select("key", "doc_id", "at", "bytes")
        marks = marks.unionByName(twins).unionByName(sorted_.mapInArrow(_sort_shards(length, shard_bytes), "doc_id long, start long, end long"))
        todo = halves.where(~F.col("again") & ~small).select("doc_id", "at", "core", "bytes")
        if width >= length or todo.isEmpty():
            break
        side = (length - width + 1) // 2
    marks = checkpoint(marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("marks")))
    return t.join(marks, "doc_id", "left").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
