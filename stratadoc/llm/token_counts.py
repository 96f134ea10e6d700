"""Exact token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For each prefix of a piece (what the vocabulary's pattern cuts a text into), the table
holds the last token of the prefix's encoding and its token count. A prefix ends with
token t after the shorter prefix p exactly when the last token of p and t can stand side
by side, that is, when no merge across their border would have come before those inside
them; so count[i] = count[i - len(t)] + 1 for that one t. Counts of whole texts,
truncation to a budget and budget questions are read off the tables: nothing is encoded
a second time. Pieces recur, so their tables are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import texts

#: The pattern of the vocabulary's byte-level pre-tokenizer.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables for the vocabulary of a tokenizers file of byte-level BPE."""

    def __init__(self, path: str, most_pieces: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer") or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: not plain byte-level BPE, for which alone the pattern and the table are right")
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.token = {bytes([b]): b for b in range(256)}  # ids in the order of merging
        self.parts = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for m in spec["model"]["merges"]:
            a, b = map(as_bytes, m if isinstance(m, list) else m.split(" "))
            pair, new = (self.token[a], self.token[b]), len(self.parts)
            self.joined[pair] = self.token[a + b] = new
            self.parts.append(pair)
        self.reach: dict[bytes, int] = {}  # by a token's last three bytes, the length of the longest such token
        for t in self.token:
            self.reach[t[-3:]] = max(self.reach.get(t[-3:], 0), len(t))
        self.special = [x["content"] for x in spec.get("added_tokens", ())]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.piece, self.space = regex.compile(PIECE), regex.compile(r"\s+")
        self.most_pieces, self.tables, self.beside = most_pieces, {}, {}

    def can_stand(self, left: int, right: int) -> bool:
        """Whether left, right is how their bytes are encoded, if each is how its own are.

        Undoes merges from the latest back: at each step the later-made of the two at
        the border is taken apart, and a merge across the border that would have come
        before the last one undone speaks against them.
        """
        key = left << 20 | right
        if (known := self.beside.get(key)) is not None:
            return known
        limit, ok = 1 << 30, True
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < limit:
                ok = False
                break
            if left < 256 and right < 256:
                break
            if left > right:  # what was merged last at the border, on either side
                limit, left = left, self.parts[left][1]
            else:
                limit, right = right + 1, self.parts[right][0]
        if len(self.beside) >= 4 * self.most_pieces:
            self.beside.clear()
        self.beside[key] = ok
        return ok

    def table(self, piece: str) -> tuple[int, ...]:
        """Token count at every byte prefix of a piece, from 0."""
        if (known := self.tables.get(piece)) is not None:
            return known
        b = piece.encode()
        token, can_stand, reach, beside = self.token, self.can_stand, self.reach, self.beside
        count, last = [0], [-1]
        for i in range(1, len(b) + 1):
            for j in range(max(0, i - reach.get(b[i - 3 : i], 2)) if i > 2 else 0, i):
                t = token.get(b[j:i])
                if t is None:
                    continue
                if j and (ok := beside.get(last[j] << 20 | t)) is not True and (ok is False or not can_stand(last[j], t)):
                    continue
                count.append(count[j] + 1)
                last.append(t)
                break
        out = tuple(count)
        if len(b) <= 64:
            if len(self.tables) >= self.most_pieces:
                self.tables.clear()
            self.tables[piece] = out
        return out

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """(piece, special): special strings inside the text are one token each."""
        for i, x in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                yield x, True
            else:
                for p in self.piece.findall(x):
                    yield p, False

    def count(self, text: str) -> int:
        known, table, n = self.tables, self.table, 0
        for i, x in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                n += 1
            else:
                for p in self.piece.findall(x):
                    n += (known.get(p) or table(p))[-1]
        return n

    def prefix_counts(self, text: str) -> list[int]:
        """Token count of the text that ends after i bytes, for every i.

        Inside a piece its own table says so. White space at the end of a prefix is one
        piece, however the whole text goes on, so a run of it has a table of its own. A
        special string that is cut short is ordinary text and may join the piece before.
        """
        out, tail, before = [0], "", 0  # tail: the last piece, before: the count in front of it
        for n, x in enumerate(self.split.split(text) if self.split else [text]):
            now = out[-1]
            if n % 2:
                for k in range(1, len(x)):
                    c = before + sum(self.table(p)[-1] for p in self.piece.findall(tail + x[:k]))
                    out += [c] * len(x[k - 1].encode())
                out += [now + 1] * len(x[-1].encode())
                tail, before = "", now + 1
                continue
            run, start = "", now  # the run of white space that is open, the count in front of it
            for p in self.piece.findall(x):
                t, tail, before = self.table(p), p, now
                blank = p[: len(p) - len(p.lstrip(" "))] if not self.space.fullmatch(p) else p
                if blank:
                    start = start if run else now
                    had, run = len(run.encode()), run + blank
                    out += [start + c for c in self.table(run)[had + 1 :]]
                if blank != p:
                    out += [now + c for c in t[len(blank) + 1 :]]
                    if p in ("'re", "'ve", "'ll"):
                        out[-2] = now + 2  # without its last letter it is two pieces
                    run = ""
                now += t[-1]
        return out

    def cut(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix, at a character's end, that stays within the budget piece by piece."""
        n = size = 0
        for p, special in self.pieces(text):
            t = (0,) if special else self.table(p)
            more = 1 if special else t[-1]
            if n + more > budget:
                if special:
                    return size
                b = p.encode()
                fits = [i for i in range(len(b)) if n + t[i] <= budget and b[i] & 0xC0 != 0x80]
                return size + max(fits, default=0)
            n, size = n + more, size + len(p.encode())
        return size


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut_bytes) per row of docs (doc_id, text).

    vocabulary: path of a tokenizers file of byte-level BPE, on every executor.
    cut_bytes: where to truncate to `limit` tokens; n_bytes if nothing is over. Null
    and empty texts have 0 of all. Repeated rows stay; an empty table gives an empty
    result. Other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            rows = []
            for x in b.column(1):
                text = x.as_py()
                size, n = len(text.encode()), c.count(text)
                rows.append((size, n, n > limit, c.cut(text, limit) if n > limit else size))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns, types)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    return texts(docs).mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")
