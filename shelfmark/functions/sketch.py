"""Bloom filter of a small table as one scalar value, to be probed where rows are made."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.folds import let

#: Bits of the largest filter, 8 MB. With more keys than it suits it lets more through, and the join behind it still decides.
MOST_BITS = 1 << 26


def _places(hashed: Column, bits: int) -> tuple[Column, Column]:
    """Two places of a 64-bit hash in the filter."""
    return tuple(F.pmod(h, F.lit(bits).cast("long")) for h in (hashed, F.shiftrightunsigned(hashed, 29)))


def key_filter(keys: DataFrame, key: str, count: int, per_key: int = 16, most: int = MOST_BITS) -> tuple[Column, Callable[[Column, Column], Column]]:
    """(bits, may_hold): the scalar column of the filter, and may_hold(bits, value).

    Bind bits once outside of lambdas. A value of the table always passes, another one with
    a chance of about 1.4 % while there are `per_key` bits for each of the `count` keys.
    """
    size = 1 << min(max(10, (per_key * max(count, 1) - 1).bit_length()), most.bit_length() - 1)
    spots = keys.select(F.explode(F.array(*_places(F.xxhash64(key), size))).alias("p"))
    marked = spots.select(F.expr("p div 64").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bits"))
    empty = keys.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = marked.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bits = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("all")).scalar()

    def may_hold(own: Column, value: Column) -> Column:
        held = lambda p: F.getbit(F.element_at(own, (F.shiftright(p, 6) + 1).cast("int")), F.pmod(p, F.lit(64).cast("long")).cast("int")) == 1
        return let(F.xxhash64(value), lambda h: reduce(Column.__and__, map(held, _places(h, size))))

    return bits, may_hold
