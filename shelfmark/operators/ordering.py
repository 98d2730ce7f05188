"""Order, first rows and set operations on tables of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators.filters import lines


def catalog_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Global order without regard to case, ties by the exact values."""
    return df.orderBy(*[F.lower(c) for c in columns], *columns)


def first_k_per_group(df: DataFrame, group: str, order: Sequence[Column | str], value: str, k: int = 2) -> DataFrame:
    """(group, values): distinct values of the first k rows, in order."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__rank") <= k)
    picked = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__rank", value))).alias("rows"))
    return picked.select(group, F.array_distinct(F.transform("rows", lambda x: x[value])).alias("values"))


def head_lines(docs: DataFrame, key: str, body: str, n: int = 5, end_mark: str = "END_SHOW_METADATA") -> DataFrame:
    """(key, rank, line): the first n non-blank lines, end marks left out."""
    rows = lines(docs, key, body).where((F.trim("line") != "") & (F.trim("line") != end_mark))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.select(key, rank.cast("long").alias("rank"), "line").where(F.col("rank") <= n)


def refresh_catalog(kept: DataFrame, new: DataFrame) -> DataFrame:
    """Kept rows and new rows, repeats included."""
    return kept.unionByName(new)


def sorted_distinct_union(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values of both, without regard to case in the order."""
    both = old.select(F.trim(column).alias(column)).union(new.select(F.trim(column))).where(text.blank_to_null(F.col(column)).isNotNull()).distinct()
    return both.orderBy(F.lower(column), column)


def name_set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(name, side): names only in left, only in right, or in both."""
    a = left.select(F.col(column).alias("name")).distinct().withColumn("l", F.lit(True))
    b = right.select(F.col(column).alias("name")).distinct().withColumn("r", F.lit(True))
    return a.join(b, "name", "full").select("name", F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right").alias("side"))
