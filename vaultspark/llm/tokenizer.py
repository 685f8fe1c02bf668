"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7), by padded numpy matrices.

A text is split by the vocabulary's pattern. Every piece that a worker has not met yet goes into a matrix: a row per
piece, its bytes' ids padded to the width of its length bucket. In each round every row merges its leftmost pair of
least rank: the ranks of neighbouring pairs come from a hashed table of all pairs that the vocabulary joins, and rows are
compacted by one column. Rows without a pair left are finished. Pieces recur, so each worker keeps the ids of the pieces
it has met, up to a fixed number; what is kept never changes a result.

A long piece, such as a run of Chinese or Thai, which have no blanks, is cut first wherever no token of the vocabulary can lie
across: a token over a place holds the two bytes beside it and, unless these are the whole token, three bytes around it, so where
no token has them no merge ever joins the two sides, and each side's merges are the same with and without the other.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int32(2**31 - 1)
#: Parts of more bytes, which no place without a token across ends, are merged by a heap in n log n instead of n squared.
WIDEST = 512
#: Pieces of more bytes are cut where no token can lie across; shorter ones are cheap as they are.
LONG = 32
KEEP = 400_000
_BUCKETS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256, WIDEST)


class PairTable:
    """Open addressing over (left id, right id) -> merged id, looked up by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(merged) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]  # of keys that want the same slot one remains
            won = self.keys[at] == keys[todo]
            self.values[at[won]] = merged[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, _NONE where the pair isn't joined or one side is padding (negative)."""
        keys = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(keys[todo])
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class Encoder:
    """Ids of texts by one rank file; of a vocabulary in which a token's id is its rank."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN, keep: int = KEEP):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = (np.array(c, np.int32) for c in zip(*pairs))
        self.table = PairTable(left, right, merged)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.joins = dict(zip(zip(left.tolist(), right.tolist()), merged.tolist()))
        self._learn_neighbours(list(ranks))
        self.split = regex.compile(pattern).findall
        self.keep = keep
        self._forget()

    def _learn_neighbours(self, tokens: list[bytes]) -> None:
        """Which two bytes are a token, and which three lie side by side in some token."""
        self.pair = np.zeros(1 << 16, bool)
        self.three = np.zeros(1 << 24, bool)
        two = np.frombuffer(b"".join([t for t in tokens if len(t) == 2]), np.uint8).astype(np.int64)
        self.pair[(two[::2] << 8) | two[1::2]] = True
        flat = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
        ends = np.cumsum([len(t) for t in tokens])
        inside = np.ones(len(flat), bool)
        inside[np.concatenate([ends - 1, ends[np.diff(ends, prepend=0) > 1] - 2])] = False  # no three bytes begin at a token's last two
        at = np.flatnonzero(inside[: len(flat) - 2])
        self.three[(flat[at] << 16) | (flat[at + 1] << 8) | flat[at + 2]] = True

    def _cut(self, piece: bytes) -> list[bytes]:
        """A piece in parts between which no token can lie."""
        b = np.frombuffer(piece, np.uint8).astype(np.int64)
        two = (b[:-1] << 8) | b[1:]
        three = self.three[(two[:-1] << 8) | b[2:]]
        across = self.pair[two]
        across[:-1] |= three  # the place between bytes i and i + 1, with the byte after them
        across[1:] |= three  # and with the byte before
        places = np.concatenate(([0], np.flatnonzero(~across) + 1, [len(piece)])).tolist()
        return [piece[i:j] for i, j in zip(places, places[1:])]

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)

    def _merge_matrix(self, m: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of m, whose padding is negative."""
        out: list = [None] * len(m)
        rows = np.arange(len(m))
        rank = self.table.find(m[:, :-1], m[:, 1:])
        while len(rows):
            if m.shape[1] > 1:
                at = rank.argmin(1)
                best = rank[np.arange(len(rows)), at]
                going = best != _NONE
            else:
                going = np.zeros(len(rows), bool)
            for i in np.flatnonzero(~going):
                out[rows[i]] = m[i][m[i] >= 0]
            if not going.any():
                break
            rows, m, rank, at, best = rows[going], m[going], rank[going], at[going], best[going]
            line = np.arange(len(rows))
            m[line, at] = best
            columns = np.arange(m.shape[1] - 1)
            m = np.where(columns <= at[:, None], m[:, :-1], m[:, 1:])
            if m.shape[1] > 1:
                columns = columns[:-1]
                rank = np.where(columns < at[:, None], rank[:, :-1], rank[:, 1:])
                for shift in (-1, 0):  # the pairs that the merge touched
                    c = at + shift
                    ok = (c >= 0) & (c < m.shape[1] - 1)
                    rank[line[ok], c[ok]] = self.table.find(m[line[ok], c[ok]], m[line[ok], c[ok] + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges of one long piece by a heap of pairs: least rank first, then leftmost."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int64).tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.table.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        joins = self.joins.get

        def push(i: int) -> None:
            j = nxt[i] if i >= 0 else n
            if j < n:
                r = joins((ids[i], ids[j]))
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(prv[i])
            push(i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def _merge_all(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of each of several byte strings, by buckets of length."""
        sizes = np.array([len(b) for b in raw])
        done: list = [None] * len(raw)
        low = 0
        for wide in _BUCKETS:
            chosen = np.flatnonzero((sizes > low) & (sizes <= wide))
            step = max(1, 2_000_000 // wide)
            for k in range(0, len(chosen), step):
                part = chosen[k : k + step]
                m = np.full((len(part), wide), -1, np.int32)
                inside = np.arange(wide) < sizes[part][:, None]
                m[inside] = self.byte_ids[np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)]
                for i, ids in zip(part, self._merge_matrix(m)):
                    done[i] = ids
            low = wide
        for i in np.flatnonzero(sizes > WIDEST):
            done[i] = self._merge_long(raw[i])
        return done

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces not met before and keep their ids. Equal parts of long pieces are merged once."""
        if len(self.index) + len(pieces) > self.keep:
            self._forget()
        raw = [p.encode("utf-8", "replace") for p in pieces]
        parts = {i: self._cut(b) for i, b in enumerate(raw) if len(b) > LONG}
        number = {b: k for k, b in enumerate(dict.fromkeys([b for ps in parts.values() for b in ps]))}
        short = [i for i in range(len(raw)) if i not in parts]
        merged = self._merge_all([raw[i] for i in short] + list(number))
        done: list = [None] * len(raw)
        for i, ids in zip(short, merged):
            done[i] = ids
        ids_of = merged[len(short) :]
        for i, ps in parts.items():
            done[i] = np.concatenate([ids_of[number[b]] for b in ps]) if len(ps) > 1 else ids_of[number[ps[0]]]
        known, new = len(self.index), len(pieces)
        lengths = np.array([len(x) for x in done], np.int64)
        flat = np.concatenate(done)
        while known + new > len(self.starts):
            self.starts, self.lengths = np.append(self.starts, np.zeros_like(self.starts)), np.append(self.lengths, np.zeros_like(self.lengths))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.empty_like(self.ids))
        self.starts[known : known + new] = self.used + np.cumsum(lengths) - lengths
        self.lengths[known : known + new] = lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.index.update(zip(pieces, range(known, known + new)))

    def pieces_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each piece in the kept table, offsets of the texts); a null text has no pieces."""
        split = [self.split(t) if t else [] for t in texts]
        flat = [p for ps in split for p in ps]
        fresh = [p for p in dict.fromkeys(flat) if p not in self.index]
        if fresh:
            if len(self.index) + len(fresh) > self.keep:
                self._forget()
                fresh = list(dict.fromkeys(flat))
            self._learn(fresh)
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        return at, np.concatenate(([0], np.cumsum([len(ps) for ps in split]))).astype(np.int64)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        at, offsets = self.pieces_of(texts)
        total = np.concatenate(([0], np.cumsum(self.lengths[at])))
        return total[offsets[1:]] - total[offsets[:-1]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts)."""
        at, offsets = self.pieces_of(texts)
        n = self.lengths[at]
        total = np.concatenate(([0], np.cumsum(n)))
        source = np.repeat(self.starts[at] - total[:-1], n) + np.arange(total[-1])
        return self.ids[source], total[offsets]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """This worker's encoder of a vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


#: Characters encoded at a time, so that the lists of pieces stay small whatever the size of an Arrow batch.
_SLICE = 1_000_000


def _slices(texts: list[str | None]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) if t else 0
        if size >= _SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """array<int>: the text's ids without special tokens; the empty list for a null or empty text."""

    def ids(texts: pa.Array) -> pa.Array:
        values, offsets, total = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for part in _slices(texts.to_pylist()):
            v, o = encoder(vocabulary).encode(part)
            values.append(v)
            offsets.append(o[1:] + total)
            total += len(v)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate(values)))

    return F.arrow_udf(ids, ArrayType(IntegerType()))(text)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """long: the number of token_ids; 0 for a null or empty text."""

    def counts(texts: pa.Array) -> pa.Array:
        parts = [encoder(vocabulary).counts(part) for part in _slices(texts.to_pylist())]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return F.arrow_udf(counts, LongType())(text)


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row of documents. One pass over two columns, no shuffle; rows keep their order and number."""
    return documents.select("doc_id", token_ids(F.col("text"), vocabulary).alias("ids"))
