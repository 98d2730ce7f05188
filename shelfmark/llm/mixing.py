"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only (operator 2).

The documents of a source, in the order of the md5 of their id, are cut into blocks of
`block_chars` characters. A source of weight m out of `quantum` (whole numbers) releases
block j at slot floor(j * quantum / m) and must have placed it before slot
ceil((j + 1) * quantum / m). Earliest deadline first among released blocks meets all
deadlines, so while a source lasts, it is never a whole block away from its share. The
schedule repeats after `quantum` slots; one period is computed by a fold over the slots,
whose cost is the number of slots times that of sources. With more than half as many
sources as slots the period is twice their number, so every source has a weight.
A source that has run out leaves its slots idle; `position` counts slots that are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, packed, text_hash, whole_text

_ROWS_PER_GROUP = 5_000


def target_weights(sizes: DataFrame, quantum: int, power: float, given: dict[str, int] | None = None) -> DataFrame:
    """(source, m): whole weights that add up to `quantum`, at least 1 each: the given ones, or in proportion to chars ** power, by largest remainders."""
    if given:
        known = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
        want = F.coalesce(known[F.col("source")].cast("double"), F.lit(0.0))
    else:
        want = F.pow(F.greatest(F.col("chars"), F.lit(1)).cast("double"), F.lit(power))
    every = Window.partitionBy(F.lit(0))  # one row for each source
    shared = sizes.withColumn("want", want).withColumn("exact", (F.lit(quantum) - F.count("*").over(every)) * F.col("want") / F.sum("want").over(every.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    shared = shared.withColumn("whole", F.floor("exact"))
    rank = F.row_number().over(every.orderBy((F.col("whole") - F.col("exact")), "source"))
    spare = F.lit(quantum) - F.count("*").over(every) - F.sum("whole").over(every)
    return shared.withColumn("rank", rank).withColumn("spare", spare).select("source", (1 + F.col("whole") + (F.col("rank") <= F.col("spare")).cast("int")).cast("int").alias("m"))


def _period(quantum: int) -> str:
    """SQL of the fold: which source has which slot of one period, from the array m of weights."""
    open_ = f"IF(a.c[i] < x AND a.c[i] * {quantum}L div x <= t, named_struct('due', ((a.c[i] + 1) * {quantum}L + x - 1) div x, 'i', i), NULL)"
    pick = f"array_min(filter(transform(m, (x, i) -> {open_}), y -> y IS NOT NULL)).i"
    step = f"transform(array({pick}), p -> named_struct('c', transform(a.c, (y, i) -> IF(i = p, y + 1, y)), 'o', concat(a.o, array(p))))[0]"
    return f"aggregate(sequence(0, {quantum} - 1), named_struct('c', transform(m, x -> 0), 'o', cast(array() AS array<int>)), (a, t) -> {step}).o"


def _running(df: DataFrame, number: str, value: str, to: str) -> DataFrame:
    """Adds `to`, the sum of `value` over all lesser numbers (one row each), without a window over all rows."""
    group = df.withColumn("__group", F.expr(f"{number} div {_ROWS_PER_GROUP}"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = before.partitionBy("__group").orderBy(number)
    sums = group.groupBy("__group").agg(F.sum(value).alias("__sum"))
    sums = sums.select("__group", F.coalesce(F.sum("__sum").over(before.partitionBy(F.lit(0)).orderBy("__group")), F.lit(0)).alias("__sum"))  # a row for each group
    return group.join(sums, "__group").withColumn(to, F.col("__sum") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__group", "__sum")


def _scheduled(weighed: DataFrame, quantum: int) -> DataFrame:
    """(source, block, w, slot, position) of all blocks. weighed: source, m, n (number of blocks)."""
    period = weighed.agg(F.sort_array(F.collect_list(F.struct("source", "m"))).alias("s")).select("s.source", "s.m")
    period = period.select("source", F.expr(_period(quantum)).alias("o"))
    slots = period.select("source", F.posexplode("o").alias("at", "i")).select(F.expr("source[i]").alias("source"), "at")
    slots = slots.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1)
    parts = weighed.select("source", "m", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {_ROWS_PER_GROUP})")).alias("part"))
    first, last = f"part * {_ROWS_PER_GROUP}", f"least(n, (part + 1) * {_ROWS_PER_GROUP}) - 1"
    blocks = parts.repartition("source", "part").select("source", F.col("m").alias("w"), F.explode(F.expr(f"sequence({first}, {last})")).alias("block"))
    blocks = blocks.withColumn("k", F.pmod("block", F.col("w")).cast("int")).withColumn("round", F.expr("block div w"))
    placed = blocks.join(slots, ["source", "k"]).select("source", "block", "w", "round", (F.col("round") * quantum + F.col("at")).alias("slot"))
    rounds = _running(placed.groupBy("round").agg(F.count("*").alias("blocks")), "round", "blocks", "earlier").select("round", "earlier")
    own = F.row_number().over(Window.partitionBy("round").orderBy("slot")) - 1  # at most `quantum` rows
    return placed.withColumn("own", own).join(rounds, "round").select("source", "block", "w", "slot", (F.col("earlier") + F.col("own")).alias("position"))


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, block_chars: int = 20_000, quantum: int = 1_000, power: float = 0.5) -> DataFrame:
    """(doc_id, th, source, chars, block, release, deadline, slot, position): every document with its place in the mix.

    Order the rows by position, then by md5 of doc_id for the mix itself. Nothing is left
    out or repeated. A null source is a source of its own; a null text has no characters
    and goes where its neighbours go; documents without an id are the last of their part of
    the md5 order. A document that is longer than a block uses up the blocks after its
    own. Of more than quantum / 2 sources the period has twice their number.
    """
    total = docs.count()
    digits = 1
    while 16**digits * _ROWS_PER_GROUP < total:
        digits += 1
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", text_hash().alias("th"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.length(whole_text()).cast("long").alias("chars"), place.alias("place"))
    # all rows without an id have one md5, so the order of th divides them
    nameless = F.when(F.col("doc_id").isNull(), F.shiftright("th", 52) + 2_048).otherwise(-1)
    rows = rows.withColumn("part", F.struct(F.substring("place", 1, digits).alias("head"), nameless.alias("nameless")))
    inside = Window.partitionBy("source", "part").orderBy("place", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "part").agg(F.sum("chars").alias("size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = parts.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).select("source", "part", "offset")
    begun = rows.withColumn("run", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(offsets, ["source", "part"])
    block = F.floor((F.col("offset") + F.col("run")) / block_chars)
    begun = begun.select("doc_id", "th", "source", "chars", block.alias("block"))

    sizes = materialise(parts.groupBy("source").agg(F.sum("size").alias("chars")), "sources")
    quantum = max(quantum, 2 * sizes.count())
    count = F.greatest(F.ceil(F.col("chars") / block_chars), F.lit(1)).cast("long").alias("n")
    weighed = materialise(sizes.select("source", count).join(target_weights(sizes, quantum, power, weights), "source"), "weights")
    blocks = _scheduled(weighed, quantum)
    # documents without characters at the very end of a source go with its last block
    begun = begun.join(weighed.select("source", "n"), "source").withColumn("block", F.least("block", F.col("n") - 1))
    return begun.join(blocks, ["source", "block"]).select(
        "doc_id", "th", "source", "chars", "block", F.expr(f"block * {quantum}L div w").alias("release"), F.expr(f"((block + 1) * {quantum}L + w - 1) div w").alias("deadline"), "slot", "position",
    )


def _joined(rows: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """(row, id, th, slot, position) of the rows, all of them; the mix is that of docs, which have the same doc_id and text."""
    places = mixed(docs, **options).groupBy(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th")).agg(F.min("slot").alias("slot"), F.min("position").alias("position"))
    return packed(rows).join(places, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th")))


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """The documents, all of them, sorted into the mix."""
    return _joined(docs, docs, **options).orderBy("position", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), "id", "th").select("row.*")


def with_places(rows: DataFrame, docs: DataFrame | None = None, **options) -> DataFrame:
    """The rows, all of them, with their `slot` and `position` in the mix (replaced if there).

    Files keep no order for Spark's readers; the mix is the order by position, then md5 of
    doc_id. docs, if given, are the documents of the rows before columns were added.
    """
    rest = [f"row.`{c}`" for c in rows.columns if c.lower() not in ("slot", "position")]
    return _joined(rows, rows if docs is None else docs, **options).select(*rest, "slot", "position")


def op2_pfair_mix(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("th")


OP2_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS source, length(coalesce(text, '')) AS chars, md5(doc_id::VARCHAR) AS place FROM documents),
begun AS (
  SELECT doc_id, source, chars,
    (coalesce(sum(chars) OVER (PARTITION BY source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20000)::BIGINT AS block
  FROM docs),
sizes AS (SELECT source, sum(chars) AS chars, greatest(ceil(sum(chars) / 20000.0), 1)::BIGINT AS n FROM docs GROUP BY source),
shared AS (
  SELECT *, (1000 - count(*) OVER ()) * pow(greatest(chars, 1)::DOUBLE, 0.5)
    / sum(pow(greatest(chars, 1)::DOUBLE, 0.5)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS exact FROM sizes),
weighed AS (
  SELECT source, n, (1 + floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, source)
    <= 1000 - count(*) OVER () - sum(floor(exact)) OVER () THEN 1 ELSE 0 END)::BIGINT AS m FROM shared),
numbered AS (SELECT *, row_number() OVER (ORDER BY source) AS i FROM weighed),
edf AS (
  SELECT -1 AS t, NULL::BIGINT AS pick, (SELECT list(0::BIGINT ORDER BY i) FROM numbered) AS c, (SELECT list(m ORDER BY i) FROM numbered) AS m
  UNION ALL
  SELECT t + 1, p, list_transform(c, lambda x, k: x + (k = p)::BIGINT), m FROM (
    SELECT t, c, m, list_min(list_filter(list_transform(range(1, len(m) + 1), lambda k:
      CASE WHEN c[k] < m[k] AND c[k] * 1000 // m[k] <= t + 1 THEN {'due': ((c[k] + 1) * 1000 + m[k] - 1) // m[k], 'k': k} END),
      lambda y: y IS NOT NULL)).k AS p
    FROM edf WHERE t < 999)),
slots AS (SELECT t AS at_slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k, c FROM edf WHERE t >= 0),
placed AS (
  SELECT b.*, w.i, w.m AS w, s.at_slot, b.block // w.m AS round, s.c
  FROM begun b JOIN numbered w USING (source) JOIN slots s ON s.i = w.i AND s.k = b.block % w.m),
idle AS (
  SELECT p.doc_id, sum(greatest(p.round * o.m + p.c[o.i] - (o.i = p.i)::BIGINT - o.n, 0)) AS idle
  FROM placed p, numbered o GROUP BY p.doc_id)
SELECT doc_id, source, chars, block, block * 1000 // w AS release, ((block + 1) * 1000 + w - 1) // w AS deadline,
       round * 1000 + at_slot AS slot, (round * 1000 + at_slot - idle)::BIGINT AS position
FROM placed JOIN idle USING (doc_id)
"""
