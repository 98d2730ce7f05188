"""Audit of how filters act in every order (operator 13).

A document is a mask with a bit for each filter that it fails, so all orders can be told
from the counts of masks: at most 2 ** filters cells for each part. Each cell folds across
the array of orders, which stands in the plan as one literal and so travels to every task:
`transform` goes over the orders, `aggregate` over the filters of one order, and each step
gives a struct that is weighted with the cell's counts. The structs of the cells of a part
(600 for five filters) are added up element by element.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, whole_text
from shelfmark.llm.lines import let

_WORD_BREAKS = "\t\n\u000b\u000c\r"
FILTERS = "ABCDE"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Mask of what a text fails: 1 under 100 words, 2 less than 80 % distinct words, 4 more than 10 % capitals, 8 one of the characters #$%&*|."""
    words = F.filter(F.split(F.translate(text, _WORD_BREAKS, " " * len(_WORD_BREAKS)), " "), lambda w: w != "")
    sizes = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bit = lambda fails, n: F.when(fails, n).otherwise(0)
    of_words = let(sizes, lambda s: bit(s["n"] < 100, 1) + bit(100 * s["distinct"] < 80 * s["n"], 2))
    return of_words + bit(100 * capitals > 10 * F.length(text), 4) + bit(text.rlike("[#$%&*|]"), 8)


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every row: mask as in `text_failures`, and 16 for a text that a smaller doc_id has too.

    A null text is empty, a null part too. Texts are compared by their SHA-256. A null
    doc_id is smaller than none and larger than none. A document is good or toxic if any of
    its rows in labels (doc_id, quality, toxic) says 1. Texts are read once: what is
    counted and joined is a short row for each of them.
    """
    text = whole_text()
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_failures(text).alias("mask"))
    rows = materialise(rows, "masks")
    # the smallest id of each text, counted in part before it is shuffled; the join is by id and text, so a crowd of copies is no group of it
    first = rows.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("f_id")).withColumnRenamed("same", "f_same")
    judged = rows.join(first, (F.col("doc_id") == F.col("f_id")) & (F.col("same") == F.col("f_same")), "left")
    again = F.when(F.col("doc_id").isNotNull() & F.col("f_id").isNull(), 16).otherwise(0)
    judged = judged.select("doc_id", "part", (F.col("mask") + again).alias("mask"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = judged.join(marks, F.col("doc_id") == F.col("l_id"), "left")
    return marked.select("doc_id", "part", "mask", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")])


def _steps(order: Column, filters: int) -> Column:
    """What a cell (mask, n, good, toxic) gives at each step of one order, an array of filter numbers."""
    nothing = F.array().cast("array<struct<" + ", ".join(f"{c}:bigint" for c in _COUNTS) + ">>")
    start = F.struct(F.lit(True).alias("alive"), nothing.alias("out"))

    def step(s: Column, f: Column) -> Column:
        fails = F.col("mask").bitwiseAND(F.element_at(F.lit([1 << i for i in range(filters)]), f + 1)) > 0
        weigh = lambda c, by="n": F.when(c, F.col(by)).otherwise(F.lit(0).cast("bigint"))
        gone = s["alive"] & fails
        only = F.col("mask") == F.element_at(F.lit([1 << i for i in range(filters)]), f + 1)
        values = (weigh(s["alive"] & ~fails), weigh(gone), weigh(~s["alive"] & fails), weigh(only), weigh(gone, "good"), weigh(gone, "toxic"))
        row = F.struct(*[v.alias(c) for v, c in zip(values, _COUNTS, strict=True)])
        return F.struct((s["alive"] & ~fails).alias("alive"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(order, start, step, lambda s: s["out"])


def interactions(failed: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row for each part, order of all filters and step, with the counts of that step; shapley is the filter's removals summed over all orders.

    failed: part, mask, good, toxic, a row for each document; bit i of mask stands for filter i.
    Parts without documents have no rows; the others have all of them, zeros too.
    """
    n = len(filters)
    orders = F.lit([list(o) for o in permutations(range(n))])
    cells = failed.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    folded = cells.select("part", F.flatten(F.transform(orders, lambda o: _steps(o, n))).alias("structs"))
    zero = F.transform(F.sequence(F.lit(1), F.lit(factorial(n) * n)), lambda _: F.struct(*[F.lit(0).cast("bigint").alias(c) for c in _COUNTS]))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in _COUNTS]))
    # at most 2 ** n arrays meet here
    merged = folded.groupBy("part").agg(F.collect_list("structs").alias("all")).select("part", F.aggregate("all", zero, add).alias("structs"))
    turn = F.flatten(orders)
    removed = F.transform(F.lit(list(range(n))), lambda f: F.aggregate(F.zip_with(turn, "structs", lambda g, s: F.when(f == g, s["removed"]).otherwise(0)), F.lit(0).cast("bigint"), lambda a, x: a + x))
    rows = merged.select("part", removed.alias("shares"), F.posexplode("structs").alias("at", "s"))
    order = F.element_at(F.lit(["".join(filters[i] for i in o) for o in permutations(range(n))]), F.expr(f"at div {n} + 1").cast("int"))
    own = F.element_at(turn, F.col("at") + 1)
    return rows.select("part", order.alias("filter_order"), (F.col("at") % n + 1).cast("int").alias("step"), *[F.col(f"s.{c}").alias(c) for c in _COUNTS], F.element_at("shares", own + 1).alias("shapley"))


def op13_filter_interactions(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(failures(docs, labels))


OP13_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM docs),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
  FROM words LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
judged AS (
  SELECT part, o, step, n, good, toxic, fails[o[step]] AS now, len(list_filter(o[1:step - 1], lambda f: fails[f])) > 0 AS before,
         len(list_filter(fails, lambda x: x)) AS n_fails
  FROM cells, steps),
counted AS (
  SELECT part, o, step, sum(CASE WHEN NOT now AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN now AND NOT before THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN now AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN now AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN now AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN now AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda f: chr(CAST(64 + f AS INT))), '') AS filter_order, CAST(step AS INT) AS step,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM counted
"""
