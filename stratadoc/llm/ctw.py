"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a tree of contexts: the bytes
before, 0 to `DEPTH` of them. A node holds how often 0 and 1 followed in training, its
Krichevsky-Trofimov estimate, and the weighted probability

    Pw = 1/2 * Pe + 1/2 * product of the children's Pw        (Pw = Pe at full depth)

so that predicting along a path mixes the estimates of all depths; a context that was
not seen in training gives one half. The sum over a text's bytes and its end is its code
length; 0xFF, which UTF-8 never uses, stands before its beginning and for its end. As
for the words of the base score, A-Z are lower-cased first.

The counts are those of all distinct grams of DEPTH + 1 bytes, so their number follows
the corpus, and they stay distributed: grams are grouped by the two bytes before the
predicted one, which makes whole subtrees; above those, at most 256 * 255 nodes go to
the driver. Texts are dealt into blocks of about `block_bytes`; each block asks once
for each distinct gram and word that it holds and gets that gram's code length and that
word's count back, so no model is broadcast and nothing moves for each occurrence. The
distinct grams of a block move as one packed row for each class of subtrees, and their
code lengths come back in the same order, without the grams; its distinct words move as
one packed row for each hash class, and come back with their counts.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import checkpoint_folder, texts

DEPTH = 6
_END = 0xFF
#: The end of a text among the words, none of which is empty. (bytes.split() cuts at 0x20 and 0x09 to 0x0D alone.)
_STOP = b""
_STEP = 1 << 20
#: Distinct words of a block that a task holds before it sends them on.
_MOST_WORDS = 600_000


def _grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the grams that end at each byte of each text and at its end, and where each text's begin."""
    pad = bytes([_END]) * DEPTH
    b = b"".join(pad + r + bytes([_END]) for r in raws)
    # at each place the eight bytes from there on as one number, of which DEPTH + 1 are the gram
    code = np.ndarray((len(b),), ">u8", b + bytes(8), strides=(1,)).astype(np.uint64)
    code >>= np.uint64(8 * (7 - DEPTH))
    size = np.array([len(r) + 1 + DEPTH for r in raws])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    keep = np.ones(int(size.sum()), bool)
    for k in range(DEPTH):
        keep[start + size - 1 - k] = False
    own = np.concatenate([[0], np.cumsum(size - DEPTH)[:-1]])
    return code[keep], own


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, taken back by the recurrence."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi)


def _weigh(kt: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(kt, below) - math.log(2)


class Level:
    """Nodes of one depth: context bytes and, in the low byte, the bits of the byte so far after a 1."""

    def __init__(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        self.key, self.a, self.b = key, a, b
        self.kt = _log_kt(a, b)
        self.pw = self.kt if below is None else _weigh(self.kt, below)
        self.one = (b + 0.5) / (a + b + 1.0)

    def parents(self, depth: int) -> Level:
        key, at = np.unique(self.key & np.uint64((1 << (8 * depth + 8)) - 1), return_inverse=True)
        add = lambda x: np.bincount(at, weights=x, minlength=len(key))
        out = Level(key, add(self.a), add(self.b), add(self.pw))
        self.parent = at
        return out

    def mix(self, done: np.ndarray, open_: np.ndarray, full: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(1) if the next context was not seen, which the tree gives one half; and what is settled and open for the children. done, open_: the same from above; full: at full depth a node's own estimate is all."""
        own = np.exp(self.kt - math.log(2) - self.pw)
        settled, rest = done + open_ * own * self.one, open_ * (1 - own)
        return (done + open_ * self.one if full else settled + rest / 2), settled, rest


def _bits(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each gram and each of 8 bits: node at full depth, and the bit."""
    y = gram & np.uint64(255)
    ctx = (gram >> np.uint64(8)) << np.uint64(8)
    j = np.arange(8, dtype=np.uint64)
    prefix = (np.uint64(1) << j)[None, :] | (y[:, None] >> (np.uint64(8) - j)[None, :])
    return ctx[:, None] | prefix, ((y[:, None] >> (np.uint64(7) - j)[None, :]) & np.uint64(1)).astype(bool)


def _subtree(gram: np.ndarray, n: np.ndarray, top: int) -> list[Level]:
    """Levels from full depth up to `top`, of the grams with a count."""
    node, bit = _bits(gram)
    key, at = np.unique(node.ravel(), return_inverse=True)
    w, one = np.repeat(n.astype(np.float64), 8), bit.ravel()
    levels = [Level(key, np.bincount(at, weights=w * ~one, minlength=len(key)), np.bincount(at, weights=w * one, minlength=len(key)), None)]
    for depth in range(DEPTH - 1, top - 1, -1):
        levels.append(levels[-1].parents(depth))
    return levels


class Top:
    """The tree above depth 2: at most 255 + 256 * 255 nodes."""

    def __init__(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray):
        order = np.argsort(key)
        one = Level(key[order], a[order], b[order], below[order])
        zero = one.parents(0)
        self.key0, self.key1 = zero.key, one.key
        self.p0, done, open_ = zero.mix(np.zeros(len(zero.key)), np.ones(len(zero.key)))
        self.p1, self.done, self.open = one.mix(done[one.parent], open_[one.parent])


def _find(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(key, of), len(key) - 1)
    return at, key[at] == of


def code_lengths(gram: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 P(last byte | bytes before) of grams that share the two bytes before the last; n: their training counts, 0 for grams not seen there."""
    seen = n > 0
    levels = _subtree(gram[seen], n[seen], 2)[::-1] if seen.any() else []  # depth 2 first
    p: list[np.ndarray] = []
    if levels:
        at, _ = _find(top.key1, levels[0].key & np.uint64(0xFFFF))
        done, open_ = top.done[at], top.open[at]
        for i, level in enumerate(levels):
            own, done, open_ = level.mix(done, open_, i == len(levels) - 1)
            p.append(own)
            if i < len(levels) - 1:
                done, open_ = done[levels[i + 1].parent], open_[levels[i + 1].parent]
    node, bit = _bits(gram)
    flat = node.ravel()
    one = np.full(len(flat), 0.5)
    left = np.ones(len(flat), bool)
    known = [(level.key, q, 2 + i) for i, (level, q) in enumerate(zip(levels, p, strict=True))][::-1] + [(top.key1, top.p1, 1), (top.key0, top.p0, 0)]
    for key, q, depth in known:
        rest = np.flatnonzero(left)
        if not len(rest):
            break
        at, hit = _find(key, flat[rest] & np.uint64((1 << (8 * depth + 8)) - 1))
        one[rest[hit]] = q[at[hit]]
        left[rest[hit]] = False
    one = one.reshape(-1, 8)
    return np.log10(np.where(bit, one, 1 - one)).sum(1)


def _planes(x: np.ndarray) -> bytes:
    """The lowest byte of each number, then the next of each, and so on, which shuffles and files compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack(gram: np.ndarray) -> bytes:
    """Ascending grams as their differences."""
    return _planes(np.diff(gram, prepend=np.uint64(0)))


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(_numbers(raw, np.uint64), dtype=np.uint64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")  # the parts are sorted, which this sort makes use of
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first, dtype=n.dtype)


def _classed(gram: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ascending grams by hash class of the two bytes before the predicted one, and where each class begins in it."""
    two = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(groups)
    cls = two.astype(np.uint16)[(gram >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)]
    return np.argsort(cls, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=groups))])


_ASKED = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("two", pa.int32()), ("key", pa.binary()), ("n", pa.binary())])


def _asked(held: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """For each block, packed rows of a class (two) with counts over its training rows: its distinct grams (kind 0) and its distinct words (kind 1)."""
    grams: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    words: dict[int, Counter] = {}
    waiting: dict[tuple[int, bool], list[bytes]] = {}
    size: Counter = Counter()

    def take(block: int, train: bool) -> None:
        raws = waiting.pop((block, train))
        size[block, train] = 0
        key, n = np.unique(_grams(raws)[0], return_counts=True)
        parts = grams.setdefault(block, [])
        parts.append((key, n.astype(np.uint32) if train else np.zeros(len(key), np.uint32)))
        if len(parts) >= 8:
            grams[block] = [_merged(parts)]
        own = words.setdefault(block, Counter())
        for r in raws:
            found = r.split()
            found.append(_STOP)
            if train:
                own.update(found)
            else:
                for w in found:
                    own.setdefault(w, 0)

    def rows(block: int, kind: int, found: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        k = len(found)
        columns = [pa.array([block] * k, pa.int64()), pa.array([kind] * k, pa.int32()), *map(pa.array, zip(*found, strict=True), (pa.int32(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, schema=_ASKED)

    def told_grams(block: int) -> Iterator[pa.RecordBatch]:
        key, n = _merged(grams.pop(block))
        order, start = _classed(key, groups)
        key, n = key[order], n[order]
        full = np.flatnonzero(np.diff(start))
        for i in range(0, len(full), 32):
            part = [(int(c), slice(start[c], start[c + 1])) for c in full[i : i + 32]]
            yield rows(block, 0, [(c, _pack(key[x]), _planes(n[x])) for c, x in part])

    def told_words(block: int) -> Iterator[pa.RecordBatch]:
        own = words.pop(block)
        word, n = list(own), np.fromiter(own.values(), np.uint32, len(own))
        cls = np.fromiter(map(zlib.crc32, word), np.uint32, len(word)) % np.uint32(groups)
        order = np.argsort(cls, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=groups))])
        full = np.flatnonzero(np.diff(start)).tolist()
        for i in range(0, len(full), 32):
            part = [(c, order[start[c] : start[c + 1]]) for c in full[i : i + 32]]
            yield rows(block, 1, [(c, b" ".join([word[j] for j in x.tolist()]), _planes(n[x])) for c, x in part])

    at = None
    for b in held:
        for block, train, text in zip(b.column("block").to_pylist(), b.column("train").to_pylist(), b.column("text"), strict=True):
            if block != at:  # rows come sorted by block
                for key in list(waiting):
                    take(*key)
                if at in grams:
                    yield from told_grams(at)
                if at in words:
                    yield from told_words(at)
                at = block
            raw = text.as_py().encode().lower()
            waiting.setdefault((block, train), []).append(raw)
            size[block, train] += len(raw) + 1 + DEPTH
            if size[block, train] >= _STEP:
                take(block, train)
                if len(words[block]) > _MOST_WORDS:
                    yield from told_words(block)  # a word that comes again has a second row
    for key in list(waiting):
        take(*key)
    for block in list(grams):
        yield from told_grams(block)
    for block in list(words):
        yield from told_words(block)


def _counted(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of _asked, sorted by class: each class's distinct grams with their counts over all blocks, packed, and its nodes of depth 2."""
    schema = pa.schema([("two", pa.int32()), ("key", pa.binary()), ("n", pa.binary()), ("node", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("pw", pa.float64())])

    def told(two: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        gram, n = _merged(parts)
        for i in range(0, len(gram), _STEP):
            yield pa.RecordBatch.from_arrays([pa.array([two], pa.int32()), pa.array([_pack(gram[i : i + _STEP])], pa.binary()), pa.array([_planes(n[i : i + _STEP])], pa.binary()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64())] * 3], schema=schema)
        seen = n > 0
        if seen.any():
            level = _subtree(gram[seen], n[seen], 2)[-1]
            k = len(level.key)
            yield pa.RecordBatch.from_arrays([pa.array([two] * k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array((level.key & np.uint64(0xFFFF)).view(np.int64)), pa.array(level.a), pa.array(level.b), pa.array(level.pw)], schema=schema)

    at, parts, waiting = None, [], 0
    for b in held:
        for two, gram, n in zip(b.column("two").to_pylist(), b.column("key"), b.column("n"), strict=True):
            if two != at:
                if parts:
                    yield from told(at, parts)
                at, parts, waiting = two, [], 0
            parts.append((_unpack(gram.as_py()), _numbers(n.as_py(), np.uint32).astype(np.int64)))
            waiting += len(parts[-1][0])
            if waiting > max(_STEP, 2 * len(parts[0][0])):
                parts = [_merged(parts)]
                waiting = len(parts[0][0])
    if parts:
        yield from told(at, parts)


def _priced(held: Iterator[pa.RecordBatch], top: Top) -> Iterator[pa.RecordBatch]:
    """(block, two, value): the code lengths of a block's grams of a class, in their order. Rows come sorted by class, those of _counted, which have no block, first."""
    schema = pa.schema([("block", pa.int64()), ("two", pa.int32()), ("value", pa.binary())])
    at, parts, gram, value = None, [], None, None
    for b in held:
        for block, two, packed, n in zip(b.column("block").to_pylist(), b.column("two").to_pylist(), b.column("key"), b.column("n"), strict=True):
            if two != at:
                at, parts, gram = two, [], None
            if block is None:
                parts.append((_unpack(packed.as_py()), _numbers(n.as_py(), np.int64)))
                continue
            if gram is None:
                gram, n_all = _merged(parts)
                value, parts = code_lengths(gram, n_all, top), []
            mine = _unpack(packed.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([two], pa.int32()), pa.array([_planes(value[np.searchsorted(gram, mine)])], pa.binary())], schema=schema)


def _counted_words(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of _asked, sorted by class: each class's distinct words with their counts over all blocks, packed, the sum of these and how many are above 0."""
    schema = pa.schema([("two", pa.int32()), ("key", pa.binary()), ("n", pa.binary()), ("total", pa.int64()), ("seen", pa.int64())])

    def told() -> pa.RecordBatch:
        n = np.fromiter(count.values(), np.int64, len(count))
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([b" ".join(count)], pa.binary()), pa.array([_planes(n)], pa.binary()), pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])], schema=schema)

    at, count = None, {}
    for b in held:
        for two, key, n in zip(b.column("two").to_pylist(), b.column("key"), b.column("n"), strict=True):
            if two != at:
                if count:
                    yield told()
                at, count = two, {}
            for w, c in zip(key.as_py().split(b" "), _numbers(n.as_py(), np.uint32).tolist(), strict=True):
                count[w] = count.get(w, 0) + c
    if count:
        yield told()


def _told_words(held: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, two, key, value): a block's words of a class with their counts over all blocks. Rows come sorted by class, that of _counted_words, which has no block, first."""
    schema = pa.schema([("block", pa.int64()), ("two", pa.int32()), ("key", pa.binary()), ("value", pa.binary())])
    count: dict[bytes, int] = {}
    for b in held:
        for block, two, key, n in zip(b.column("block").to_pylist(), b.column("two").to_pylist(), b.column("key"), b.column("n"), strict=True):
            raw = key.as_py()
            word = raw.split(b" ")
            if block is None:
                count = dict(zip(word, _numbers(n.as_py(), np.int64).tolist(), strict=True))
                continue
            mine = np.fromiter(map(count.__getitem__, word), np.int64, len(word))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([two], pa.int32()), pa.array([raw], pa.binary()), pa.array([_planes(mine)], pa.binary())], schema=schema)


class Slots:
    """Values by gram: an open-addressed table of places, so that a lookup touches one of them or two."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(2 * len(key)).bit_length())
        self.key, self.value = key, value
        self.place = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(key), dtype=np.int32), self._at(key)
        while len(left):
            free = self.place[at] < 0
            self.place[at[free]] = left[free]
            mine = self.place[at] == left
            left, at = left[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _at(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        at = self._at(key)
        place = self.place[at]
        left = np.flatnonzero((place < 0) | (self.key[place] != key))
        while len(left):
            if (place[left] < 0).any():
                raise KeyError("a gram that was not asked for")
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            place[left] = self.place[at[left]]
            left = left[(place[left] < 0) | (self.key[place[left]] != key[left])]
        return self.value[place]


def _steps(raws: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for r in raws:
        some.append(r)
        size += len(r)
        if size >= _STEP:
            yield some
            some, size = [], 0
    if some:
        yield some


def _distinct(raws: list[bytes]) -> np.ndarray:
    def once(key: np.ndarray, how: str | None = None) -> np.ndarray:  # np.unique hashes here, which is slower than a sort
        key = np.sort(key, kind=how)
        return key[np.concatenate([[True], key[1:] != key[:-1]])]

    parts: list[np.ndarray] = []
    for some in _steps(raws):
        parts.append(once(_grams(some)[0]))
        if len(parts) >= 8:
            parts = [once(np.concatenate(parts), "stable")]
    return once(np.concatenate(parts), "stable")


def _scored(held: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Scores of the rows with a text. Rows come sorted by block, those of its classes and words first; its grams are found again, in the order in which their values come."""
    values: dict[int, np.ndarray] = {}
    of_word: dict[bytes, float] = {}
    ids: list[pa.Array] = []
    train: list[bool] = []
    raws: list[bytes] = []
    known = math.log10(1.0)  # log10(c + 0.5) is above it for c > 0 only

    def told() -> pa.RecordBatch:
        key = _distinct(raws)
        order, start = _classed(key, groups)
        if any(len(values.get(c, ())) != start[c + 1] - start[c] for c in range(groups)):
            raise ValueError("the block's grams are not those that were asked for")
        value = np.concatenate([values.pop(c) for c in sorted(values)])
        of_gram = Slots(key[order], value)
        del key, order
        total, n_tokens, n_known, base, n_bytes = [], [], [], [], []
        for some in _steps(raws):
            code, start = _grams(some)
            total.append(np.add.reduceat(of_gram.of(code), start))
            for r in some:
                found = r.split()
                found.append(_STOP)
                v = np.fromiter(map(of_word.__getitem__, found), np.float64, len(found))
                n_bytes.append(len(r) + 1)
                n_tokens.append(len(v))
                n_known.append(int((v > known).sum()))
                base.append(float(v.sum()))
        whole = np.concatenate(total)
        columns = [pa.array(train, pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(whole), pa.array(-whole * math.log2(10) / n_bytes)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], names=["doc_id", "train", "n_tokens", "n_known", "base", "score", "bits_per_byte"])

    at = None
    for b in held:
        block = b.column("block").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for i, j in zip(cut, cut[1:], strict=False):
            if i == j:
                continue
            if block[i] != at:
                if raws:
                    yield told()
                at = block[i]
                for x in (values, of_word, ids, train, raws):
                    x.clear()
            part = b.slice(i, j - i)
            kind = part.column("kind").to_numpy()
            for c, v in zip(part.column("two").filter(pa.array(kind == 0)).to_pylist(), part.column("value").filter(pa.array(kind == 0)), strict=True):
                values[c] = _numbers(v.as_py(), np.float64)
            is_word, is_text = pa.array(kind == 1), pa.array(kind == 2)
            for words, n in zip(part.column("key").filter(is_word), part.column("value").filter(is_word), strict=True):
                of_word.update(zip(words.as_py().split(b" "), np.log10(_numbers(n.as_py(), np.int64) + 0.5).tolist(), strict=True))
            ids.append(part.column("doc_id").filter(is_text))
            train.extend(part.column("train").filter(is_text).to_pylist())
            raws.extend(t.as_py().encode().lower() for t in part.column("text").filter(is_text))
    if raws:
        yield told()


def score(docs: DataFrame, held_out: Column, block_bytes: int = 20 << 20, groups: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row of docs (doc_id, text).

    held_out: true for rows that nothing is learnt from (null: false). score: log10
    probability of the whole text and its end under the tree; bits_per_byte: that code
    length in bits over the bytes of the text, its end counted as one. base_score: the same of
    its words and end, A-Z lower-cased, each with add-half counts over the training
    words. A null or empty text is its end alone. Without training rows each bit has
    probability one half. Repeated rows stay and count each; an empty table gives an
    empty result. Other columns are ignored. groups: tasks' worth of subtrees, at most
    65536, each a hash class of the two bytes before the predicted one.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    groups = groups or min(1 << 16, max(256, 4 * blocks))
    d = texts(docs).withColumns({"train": ~F.coalesce(held_out, F.lit(False)), "block": F.pmod(F.xxhash64("doc_id"), F.lit(blocks))})
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        # small row groups, as a row holds a block's grams of a class
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def by_class(counted: DataFrame, rows: DataFrame) -> DataFrame:
        """A class's counts before the blocks' rows of it."""
        both = counted.select("two", F.lit(None).cast("long").alias("block"), "key", "n").unionByName(rows.select("two", "block", "key", F.lit(None).cast("binary").alias("n")))
        return both.repartition("two").sortWithinPartitions("two", F.col("block").asc_nulls_first())

    asked = d.repartition("block").sortWithinPartitions("block").mapInArrow(lambda held: _asked(held, groups), "block long, kind int, two int, key binary, n binary")
    asked = kept(asked, "asked")
    grams, words = asked.where("kind = 0"), asked.where("kind = 1")
    class_of = lambda rows: rows.select("two", "key", "n").repartition("two").sortWithinPartitions("two")
    word_counts = kept(class_of(words).mapInArrow(_counted_words, "two int, key binary, n binary, total long, seen long"), "words")
    told = word_counts.agg(F.sum("total").alias("n"), F.sum("seen").alias("v")).first()
    n_train, v_train = told["n"] or 0, told["v"] or 0

    counted = kept(class_of(grams).mapInArrow(_counted, "two int, key binary, n binary, node long, a double, b double, pw double"), "counted")
    upper = counted.where("node is not null").groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("pw")).toPandas()  # at most 256 * 255 rows
    top = Top(upper["node"].to_numpy(np.int64).view(np.uint64), *(upper[c].to_numpy(np.float64) for c in ("a", "b", "pw")))
    held = spark.sparkContext.broadcast(top)

    priced = by_class(counted.where("node is null"), grams).mapInArrow(lambda rows: _priced(rows, held.value), "block long, two int, value binary")
    known = by_class(word_counts, words).mapInArrow(_told_words, "block long, two int, key binary, value binary")
    every = priced.withColumn("kind", F.lit(0)).unionByName(known.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(d.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    scored = every.repartition("block").sortWithinPartitions("block", "kind")
    out = scored.mapInArrow(lambda rows: _scored(rows, groups), f"doc_id {kind}, train boolean, n_tokens long, n_known long, base double, score double, bits_per_byte double")
    return out.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(n_train + 0.5 * (v_train + 1))).alias("base_score"),
        "score",
        "bits_per_byte",
    )
