"""A filter of checked size that spares most rows without a partner the shuffle of a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each wanted key, so that about one row in sixteen without a partner passes; the number of bits is a power of two.
BITS_PER_KEY = 16
#: The least and the most bits: 8 kilobytes and 8 megabytes are what a broadcast may hold.
LEAST, MOST = 1 << 16, 1 << 26


def _bitmap(wanted: DataFrame, keys: tuple[str, ...], bits: int) -> tuple[DataFrame, Column]:
    """(one row with the bitmap, the test of a row's keys against it)."""
    spot = F.pmod(F.xxhash64(*keys), F.lit(bits))
    word, bit = F.shiftright(spot, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))
    set_words = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    all_words = wanted.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word")).join(set_words, "word", "left")
    filled = all_words.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w"))
    return filled.select(F.transform("w", lambda x: x["bits"]).alias("_bitmap")), F.get("_bitmap", word).bitwiseAND(bit) != 0


def bits_for(n: int) -> int | None:
    """How many bits a filter for n keys has; None where so many keys would fill the largest one, so that it spared nothing."""
    if n * 2 > MOST:
        return None
    return min(MOST, max(LEAST, 1 << (n * BITS_PER_KEY - 1).bit_length())) if n else LEAST


def probably_in(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """rows without most of those whose keys wanted lacks; none that it has is left out.

    A bitmap over hashes of the wanted keys goes to all tasks. wanted is counted first and the bitmap sized by the count, within
    MOST bits. Beyond half as many keys rows come back as they are, and the join that follows does the work alone: the result
    is the same. wanted is read twice, so it should be cut off before.
    """
    bits = bits_for(wanted.count())
    if bits is None:
        return rows
    bitmap, test = _bitmap(wanted, keys, bits)
    return rows.join(F.broadcast(bitmap), test, "left_semi")


def split_by(rows: DataFrame, wanted: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys wanted may have, rows whose keys it surely lacks): each row is in one of both. See probably_in."""
    bits = bits_for(wanted.count())
    if bits is None:
        return rows, rows.where("false")
    bitmap, test = _bitmap(wanted, keys, bits)
    return rows.join(F.broadcast(bitmap), test, "left_semi"), rows.join(F.broadcast(bitmap), test, "left_anti")
