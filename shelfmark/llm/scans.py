"""Ranks and running totals over groups of any size.

A window over a group is one task, and a group may hold a third of all rows. So rows are
first dealt into ranges of (group, order) and written with the number of their range, the
chunk; a window then runs over (group, chunk), and what the earlier chunks of a group add
up to is carried in. A group that begins in its chunk needs nothing carried, and at most
one group goes on at each border of ranges, so there is at most one carried row for each
range and they can be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise


def chunked(df: DataFrame, name: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table in ranges of (group, order), with `chunk`. It is written, so that every later job and every task that runs again sees the same ranges."""
    return materialise(df.repartitionByRange(*group, *order).withColumn("chunk", F.spark_partition_id()), name)


def running(table: DataFrame, group: Sequence[str], order: Sequence[str], totals: dict[str, Column], fold: str = "sum") -> DataFrame:
    """Adds a column for each of `totals`: its sum (or bit_xor) over the rows of the group up to this one, in `order`.

    table comes from `chunked` with the same group and order; group columns hold no nulls.
    """
    keys = [*group, "chunk"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk of the group
    call = getattr(F, fold)
    parts = table.groupBy(*keys).agg(*[call(c).alias(f"__{n}") for n, c in totals.items()])
    first = Window.partitionBy(*group)
    parts = parts.withColumn("__first", F.min("chunk").over(first)).select(*keys, "__first", *[call(f"__{n}").over(earlier).alias(f"__{n}") for n in totals]).where("chunk > __first").drop("__first")
    out = table.withColumns({n: call(c).over(inside) for n, c in totals.items()}).join(F.broadcast(parts), keys, "left")
    join = (lambda a, b: a + b) if fold == "sum" else (lambda a, b: a.bitwiseXOR(b))
    return out.withColumns({n: F.when(F.col(f"__{n}").isNull(), F.col(n)).otherwise(join(F.col(n), F.col(f"__{n}"))) for n in totals}).drop(*[f"__{n}" for n in totals])


def following(table: DataFrame, group: Sequence[str], value: str, to: str) -> DataFrame:
    """Adds `to`, the next greater row's `value` in the group (null for its last). table comes from `chunked` with this group and the order `value`."""
    keys = [*group, "chunk"]
    heads = table.groupBy(*keys).agg(F.min(value).alias("__next"))
    # the first value of the group's next chunk, for chunks that have one: at most one for each border
    heads = heads.withColumn("__next", F.lead("__next").over(Window.partitionBy(*group).orderBy("chunk"))).where("__next is not null")
    out = table.withColumn(to, F.lead(value).over(Window.partitionBy(*keys).orderBy(value)))
    return out.join(F.broadcast(heads), keys, "left").withColumn(to, F.coalesce(to, "__next")).drop("__next")
