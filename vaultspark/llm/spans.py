"""Long exact spans shared between records (problem 9), by level-wise doubling.

A window of WIDTH characters is shared if it also occurs in another text. Looking at every window of the corpus at once
would shuffle one hash per character. Instead, lengths are doubled: WIDTH/4, WIDTH/2, WIDTH.

Level WIDTH/4. Of the short windows inside a window of WIDTH characters the one of least hash is its anchor. Equal windows
have equal anchors at equal places, so a shared window always has an anchor that occurs in another text; one in some
75 short windows is an anchor of anything. Level WIDTH/2: anchors that occur in several texts are extended to the left and to
the right; a window of WIDTH characters always holds one of the two extensions whole. Level WIDTH: where an extension still
occurs in several texts, the windows of WIDTH characters around it are hashed and compared; those that occur in several
texts are shared. Between levels everything that is in one text only is dropped, so the last level sees little more than
what is shared in the end.

Every comparison is a groupBy with min and max of the text's key, combined before the shuffle: a passage that a third of all
texts hold costs no more than any other. Copies of a text are handled once. The lower levels compare 64-bit hashes, where a wrong
match only costs work; the last level compares 128 bits, two independent hashes of each window, so at n candidate windows the
expected number of wrongly joined ones is n squared / 2**129 (10**12: 2e-15). Copies are told by 96 bits and their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from vaultspark.operators.prefilter import probably_in
from vaultspark.session import cut

WIDTH = 200
_POS = 31  # bits of a position within a slice: no text has more code points than the JVM's longest string has bytes
_SLICE = 1 << 20
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: The multipliers of the second hash.
_MIX_2 = [np.uint64(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _scramble(x: np.ndarray, mix: list) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * mix[1]
    return x ^ (x >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray, size: int, mix: list) -> np.ndarray:
    """Hashes of windows that begin with a window of a, `size` long, and go on with one of b."""
    n = max(0, min(len(a), len(b) - size))
    return _scramble(a[:n] * mix[0] + b[size : size + n] * mix[2], mix)


def _of_length(codes: np.ndarray, length: int, mix: list) -> np.ndarray:
    """Hashes of all windows of one length, put together from those of powers of two."""
    power, size = _scramble((codes.astype(np.uint64) + np.uint64(1)) * mix[0], mix), 1
    whole, done = None, 0
    while True:
        if length & size:
            whole = power if whole is None else _joined(whole, power, done, mix)
            done += size
        if done == length:
            return whole
        power, size = _joined(power, power, size, mix), size * 2


def window_hashes(codes: np.ndarray, shortest: int, doublings: int, mix: list = _MIX) -> list[np.ndarray]:
    """Hashes of all windows of the shortest length, twice that length and so on; the one at i covers codes[i : i + length]."""
    out = [_of_length(codes, shortest, mix)]
    for level in range(doublings):
        out.append(_joined(out[-1], out[-1], shortest << level, mix))
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i."""
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def slices(texts: list[str | None], limit: int = _SLICE):
    """Numbers of texts, so that a slice has about `limit` characters; a longer text is a slice of its own."""
    part, size = [], 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def anchors(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text number, place, first and last start of the windows it is the anchor of, hash, left and right extension's hash).

    The starts are relative to the place (0 or less). The hash of an extension that would leave the text is 0.
    """
    short, half = width // 4, width // 2
    out = []
    for part in slices([t if t is not None and len(t) >= width else None for t in texts]):
        sizes = np.array([len(texts[i]) for i in part])
        ends = np.cumsum(sizes)
        codes = _codes("".join([texts[i] for i in part]))
        h, h2 = window_hashes(codes, short, 1)
        place = np.arange(len(h), dtype=np.uint64)
        order = ((h >> np.uint64(_POS)) << np.uint64(_POS)) | place  # least hash, then leftmost
        chosen = (_sliding_min(order, width - short + 1) & np.uint64((1 << _POS) - 1)).astype(np.int64)
        text = np.repeat(np.arange(len(part)), sizes)
        start = np.arange(len(chosen))
        inside = start + width <= ends[text[: len(chosen)]]
        start, chosen = start[inside], chosen[inside]
        first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[chosen[1:]] != text[chosen[:-1]])])
        last = np.r_[first[1:], len(chosen)] - 1
        at = chosen[first]
        of = text[at]
        begin = ends[of] - sizes[of]
        left_at, right = at - (half - short), at
        left = np.where(left_at >= begin, h2[np.maximum(left_at, 0)], np.uint64(0))
        right = np.where(right + half <= ends[of], h2[np.minimum(right, len(h2) - 1)], np.uint64(0))
        out.append((np.array(part)[of], at - begin, start[first] - at, start[last] - at, h[at], left, right))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(c) for c in zip(*out))


_ANCHOR = pa.struct([("pos", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16()), ("h", pa.int64()), ("l", pa.int64()), ("r", pa.int64())])


def _lists(count: int, of: np.ndarray, values: pa.Array) -> pa.Array:
    """Values sorted by the number of their row as one list per row."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=count)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def anchor_rows(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, pos, lo, hi, h, l, r): see anchors(); key is the text's hash."""

    def find(texts: pa.Array) -> pa.Array:
        of, *columns = anchors(texts.to_pylist(), width)
        kinds = [np.int32, np.int16, np.int16, np.int64, np.int64, np.int64]
        values = pa.StructArray.from_arrays([pa.array(c.astype(k) if c.dtype != np.uint64 else c.view(np.int64)) for c, k in zip(columns, kinds)], fields=list(_ANCHOR))
        return _lists(len(texts), of.astype(np.int64), values)

    found = F.arrow_udf(find, from_arrow_type(pa.list_(_ANCHOR)))
    return documents.where(F.length("text") >= width).select(F.xxhash64("text").alias("key"), F.inline(found("text")))


def _in_several(rows: DataFrame, *on: str) -> DataFrame:
    """The values of `on` that occur with more than one key."""
    return rows.groupBy(*on).agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select(*on)


def candidate_starts(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, ranges): per text the starts of windows that survive the levels below the full width, as array<struct<lo, hi>>."""
    short, half = width // 4, width // 2
    a = anchor_rows(documents, width)
    repeated = _in_several(a.select("h", "key"), "h")
    once = a.join(repeated, "h").select("key", "pos", "lo", "hi", "l", "r").distinct()
    # The extension to one side lies whole in the windows that start not after it and end not before it.
    sides = once.select(
        "key",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("l").alias("h"), F.greatest(F.col("pos") + F.col("lo"), F.col("pos") + short - width).alias("lo"), F.least(F.col("pos") + F.col("hi"), F.col("pos") + short - half).alias("hi")),
                F.struct(F.lit(1).alias("side"), F.col("r").alias("h"), F.greatest(F.col("pos") + F.col("lo"), F.col("pos") + half - width).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi")),
            )
        ),
    ).where("h <> 0 and lo <= hi")
    again = _in_several(sides.select("side", "h", "key"), "side", "h")
    return sides.join(again, ["side", "h"]).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges (both ends inside) without overlap."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1] + 1]
    return lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(lo) - 1]]


_WINDOW = StructType([StructField("pos", IntegerType()), StructField("h", LongType()), StructField("g", LongType())])
_COPY = ("key", "more", "n")


def _identity(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, more, n): what tells the texts of at least width characters apart, two hashes and the length."""
    return documents.where(F.length("text") >= width).select("doc_id", F.xxhash64("text").alias("key"), F.hash("text").alias("more"), F.length("text").alias("n"))


def window_rows(documents: DataFrame, candidates: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, pos, h, g) of every candidate window, each once; of copies of a text only the one of the least doc_id is read, and
    that doc_id is the key. h and g are the window's two hashes."""
    one = _identity(documents, width).groupBy(*_COPY).agg(F.min("doc_id").alias("doc_id"))
    wanted = cut(candidates.join(one.select("key", "doc_id"), "key").drop("key"))
    texts = probably_in(documents.select("doc_id", "text"), wanted, "doc_id").join(wanted, "doc_id")

    def windows(text: pa.Array, ranges: pa.Array) -> pa.Array:
        t = text.to_pylist()
        ends = ranges.offsets.to_numpy()
        lo, hi = (ranges.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
        ends = ends - ends[0]
        pos, h, g, n = [], [], [], np.zeros(len(t), np.int64)
        for i, whole in enumerate(t):
            # Texts of one 64-bit key have their candidates together; starts beyond a text's own last window aren't its.
            a, b = _merged(lo[ends[i] : ends[i + 1]], np.minimum(hi[ends[i] : ends[i + 1]], len(whole) - width))
            for x, y in zip(a.tolist(), b.tolist()):
                if x > y:
                    continue
                codes = _codes(whole[x : y + width])
                pos.append(np.arange(x, y + 1, dtype=np.int32))
                h.append(window_hashes(codes, width // 4, 2)[2].view(np.int64))
                g.append(window_hashes(codes, width // 4, 2, _MIX_2)[2].view(np.int64))
                n[i] += y + 1 - x
        empty = [np.zeros(0, np.int64)]
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(pos or empty).astype(np.int32)), pa.array(np.concatenate(h or empty)), pa.array(np.concatenate(g or empty))], names=["pos", "h", "g"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), values)

    return texts.select(F.col("doc_id").alias("key"), F.inline(F.arrow_udf(windows, ArrayType(_WINDOW))("text", "ranges")))


_SPAN = StructType([StructField("start_pos", LongType()), StructField("end_pos", LongType())])


def shared_spans(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, start_pos, end_pos): the longest unbroken runs of shared characters of each document.

    A character is shared if it lies in a window of width characters that occurs, without any normalization, in the text of
    another doc_id. Positions count code points from 0, the end is exclusive. Texts that occur under several doc_ids are
    shared from end to end if they have width characters. Null, empty and shorter texts have no spans; doc_id must be
    unique and null doc_ids are left out.
    """
    if width < 8 or width % 4:
        raise ValueError("width must be a multiple of 4, at least 8")
    docs = documents.where("doc_id is not null").select("doc_id", "text")
    w = window_rows(docs, candidate_starts(docs, width), width)
    shared = _in_several(w.select("h", "g", "key"), "h", "g")
    places = w.join(shared, ["h", "g"]).groupBy("key").agg(F.collect_list("pos").alias("places"))

    def runs(lists: pa.Array) -> pa.Array:
        ends = lists.offsets.to_numpy()
        pos = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = ends - ends[0]
        start, stop, n = [], [], []
        for a, b in zip(ends, ends[1:]):
            p = np.sort(pos[a:b])
            x, y = _merged(p, p + width - 1)
            start.append(x)
            stop.append(y + 1)
            n.append(len(x))
        empty = [np.zeros(0, np.int64)]
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(start or empty)), pa.array(np.concatenate(stop or empty))], names=["start_pos", "end_pos"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n or [0]))).astype(np.int32)[: len(lists) + 1]), values)

    spans = places.select(F.col("key").alias("first_doc"), F.arrow_udf(runs, ArrayType(_SPAN))("places").alias("spans"))
    own = _identity(docs, width)
    copies = own.groupBy(*_COPY).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))
    found = copies.join(spans, "first_doc", "left").where("n_docs > 1 or spans is not null")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start_pos"), F.col("n").cast("long").alias("end_pos")))
    out = own.join(found, list(_COPY)).select("doc_id", F.when(F.col("n_docs") > 1, whole).otherwise(F.col("spans")).alias("spans"))
    return out.select("doc_id", F.inline("spans"))
