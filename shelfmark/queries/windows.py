"""Window operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfmark.operators import windows as op
from shelfmark.queries import query
from shelfmark.queries.groups import BUILT, built_docs, numbered

_NUMBERED = "SELECT l_orderkey, l_linenumber, p_partkey, p_name FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = p"


@query("w1_rank_documents", """
WITH d AS (SELECT doc_id, source, source || '/' || CASE WHEN doc_id % 5 = 0 THEN doc_id || '/info.txt' WHEN doc_id % 7 = 0 THEN 'Setlist' || doc_id || '.doc' ELSE 'notes' || doc_id || '.txt' END AS path, doc_id % 13 AS score0 FROM documents),
s AS (SELECT doc_id, source, path, CASE WHEN path LIKE '%.doc' THEN 1 ELSE 2 END AS tier,
  round(CASE WHEN path LIKE '%.doc' THEN 25 - length(split_part(path, '/', 2)) / 100 WHEN path LIKE '%/info.txt' THEN 3 * score0 + 48 - 0.08 ELSE 3 * score0 - length(split_part(path, '/', 2)) / 100 END, 4) AS score FROM d)
SELECT doc_id, tier, row_number() OVER (PARTITION BY source ORDER BY tier, score DESC, lower(path), path) AS rank FROM s""")
def w1(t):
    n = F.col("doc_id")
    name = F.when(n % 5 == 0, F.concat_ws("/", n, F.lit("info.txt"))).when(n % 7 == 0, F.concat_ws("", F.lit("Setlist"), n, F.lit(".doc"))).otherwise(F.concat_ws("", F.lit("notes"), n, F.lit(".txt")))
    docs = t("documents").select("doc_id", "source", F.concat("source", F.lit("/"), name).alias("path"), (n % 13).alias("c"))
    return op.rank_documents(docs, "source", "path", "c").select("doc_id", F.col("tier").cast("int").alias("tier"), "rank")


@query("w2_rank_date_mentions", """
SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS raw, strftime(o_orderdate, '%Y-%m-%d') AS normal, 140 AS score FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def w2(t):
    from shelfmark.operators import dates

    rows = op.lines(built_docs(t), "doc_id", "text", 80)
    found = dates.extract_dates(rows.withColumn("id", F.struct("doc_id", "pos")), "id", "line")
    found = found.select("id.doc_id", F.col("id.pos").alias("line"), "start", "raw", "normal", "kind").join(rows.select("doc_id", F.col("pos").alias("line"), F.col("line").alias("text")), ["doc_id", "line"])
    return op.rank_date_mentions(found, "doc_id").withColumn("score", F.col("score").cast("int"))


@query("w3_assign_alternates", """
WITH f AS (SELECT lang || source AS key, n_chars, min(doc_id) AS first_ FROM documents GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first_) - 1 + CASE WHEN key LIKE 'en%' THEN 3 ELSE 0 END AS alt FROM f)
SELECT doc_id, alt, CASE WHEN alt = 0 THEN key ELSE key || '(alt' || alt || ')' END AS name FROM documents d JOIN n ON n.key = d.lang || d.source AND n.n_chars = d.n_chars""")
def w3(t):
    docs = t("documents").withColumn("key", F.concat("lang", "source"))
    existing = docs.where("lang = 'en'").select("key", F.lit(2).cast("long").alias("alt"))
    return op.assign_alternates(docs, "key", "n_chars", "doc_id", existing).select("doc_id", "alt", "name")


@query("w4_ordered_dedupe", """
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'kept' ELSE 'repeat' END AS part FROM documents""")
def w4(t):
    kept, repeats = op.ordered_dedupe(t("documents"), ["text"], ["doc_id"])
    return kept.select("doc_id", F.lit("kept").alias("part")).union(repeats.select("doc_id", F.lit("repeat")))


@query("w5_sequence_runs", f"""
WITH n AS ({_NUMBERED}), b AS (SELECT *, CASE WHEN l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1 THEN 0 ELSE 1 END AS new_ FROM n),
r AS (SELECT *, sum(new_) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM b)
SELECT l_orderkey, CAST(run AS BIGINT) AS run, min(l_linenumber)::BIGINT AS first, max(l_linenumber)::BIGINT AS last, count(*) AS n, min(l_linenumber)::BIGINT AS starts FROM r GROUP BY l_orderkey, run""")
def w5(t):
    return op.sequence_runs(numbered(t), "l_orderkey", "l_linenumber", "l_linenumber", 1)


@query("w5_best_run", f"""
WITH n AS ({_NUMBERED}), b AS (SELECT *, CASE WHEN l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1 THEN 0 ELSE 1 END AS new_ FROM n),
r AS (SELECT *, sum(new_) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM b),
g AS (SELECT l_orderkey, run, min(l_linenumber) AS starts, count(*) AS n FROM r GROUP BY 1, 2)
SELECT l_orderkey, starts::BIGINT AS starts, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (n <> 2)::INT, n DESC, starts) AS k FROM g) WHERE k = 1""")
def w5_best(t):
    runs = op.sequence_runs(numbered(t), "l_orderkey", "l_linenumber", "l_linenumber", 1)
    expected = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(2).alias("expected"))
    return op.best_run(runs, "l_orderkey", expected).select("l_orderkey", "starts", "n")


@query("w5_sequence_parts", f"""
WITH n AS ({_NUMBERED}), r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM n),
i AS (
  SELECT l_orderkey AS id, l_linenumber AS pos, l_linenumber AS number, false AS head FROM n
  UNION ALL SELECT DISTINCT l_orderkey, 50, 55, false FROM n WHERE l_orderkey % 4 = 0
  UNION ALL SELECT l_orderkey, 100 + l_linenumber, k - CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END, l_orderkey % 3 = 0 AND k = 1 FROM r),
f AS (SELECT *, lag(number) OVER w AS b, lead(number) OVER w AS a FROM i WINDOW w AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT *, (head AND number IN (0, 1)) OR (number = 1 AND coalesce(a = 2, false)) AS begins, coalesce(number - b BETWEEN 1 AND 3, false) AS f1, coalesce(a - b BETWEEN 1 AND 3, false) AS f2 FROM f),
k AS (SELECT *, coalesce(number - lag(number) OVER w BETWEEN 1 AND 3, false) AS goes FROM g WHERE begins OR f1 OR NOT f2 WINDOW w AS (PARTITION BY id ORDER BY pos)),
p AS (SELECT *, sum(begins::INT) OVER (PARTITION BY id ORDER BY pos) AS part FROM k),
q AS (SELECT *, max((NOT begins AND NOT goes)::INT) OVER (PARTITION BY id, part ORDER BY pos) AS broken FROM p)
SELECT id, pos::BIGINT AS pos, number::BIGINT AS number, part::BIGINT AS part FROM q WHERE part > 0 AND broken = 0""")
def w5_parts(t):
    rows = numbered(t).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("pos"))
    k = F.row_number().over(Window.partitionBy("id").orderBy("pos")).cast("long")
    again = rows.withColumn("k", k).select("id", (F.col("pos") + 100).alias("pos"), (F.col("k") - (F.col("id") % 3 == 0).cast("long")).alias("number"), ((F.col("id") % 3 == 0) & (F.col("k") == 1)).alias("head"))
    odd = rows.where("id % 4 = 0").select("id", F.lit(50).cast("long").alias("pos"), F.lit(55).cast("long").alias("number"), F.lit(False).alias("head")).distinct()
    return op.sequence_parts(rows.select("id", "pos", F.col("pos").alias("number"), F.lit(False).alias("head")).union(odd).union(again), "id", "pos", "number", "head")


_COUNTED = "SELECT l_orderkey AS id, count(*) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1 HAVING count(*) >= 2"


@query("w5_numbered_list", f"""
WITH c AS ({_COUNTED}), s AS (SELECT id, k, id % 8 AS v, unnest(range(1, k + 1)) AS i FROM c),
r AS (
  SELECT id, i AS ord, CASE v WHEN 0 THEN 10 + i WHEN 7 THEN 100 + i ELSE i END AS number FROM s
  UNION ALL SELECT id, k + 1, CASE v WHEN 1 THEN 1 WHEN 4 THEN k + 2 WHEN 7 THEN 201 ELSE k + 1 END FROM s WHERE i = 1 AND v IN (1, 2, 3, 4, 7)
  UNION ALL SELECT id, k + 2, CASE v WHEN 1 THEN 2 WHEN 3 THEN k + 2 WHEN 4 THEN k + 3 WHEN 7 THEN 202 END FROM s WHERE i = 1 AND v IN (1, 3, 4, 7)
  UNION ALL SELECT id, k + i, i FROM s WHERE v = 5)
SELECT id, ord::BIGINT AS ord, number::BIGINT AS number FROM r""")
def w5_list(t):
    """One rule for each eighth of the orders: high start, confirmed restart, stray restart, repeated jump, jump, heading, false first line, discs."""
    k = F.count("*").cast("int").alias("k")
    lists = t("lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber").distinct().groupBy("id").agg(k).where("k >= 2")
    run = lambda first: f"transform(sequence(1, k), x -> {first} + x)"
    forms = (f"concat(array(20), {run(10)})", f"concat({run(0)}, array(1, 2))", f"concat({run(0)}, array(1, k + 1))", f"concat({run(0)}, array(k + 2, k + 2))", f"concat({run(0)}, array(k + 2, k + 3))", f"concat({run(0)}, {run(0)})", f"concat(array(1, 7), {run(0)})", f"concat({run(100)}, array(201, 202))")
    numbers = F.expr("CASE id % 8 " + " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(forms)) + " END")
    items = lists.select("id", "k", F.posexplode(numbers).alias("pos", "number"))
    return op.numbered_list(items.withColumn("head", F.expr("(id % 8 = 5 and pos = k) or (id % 8 = 0 and pos = 0)")), "id", "pos", "number", "head").select("id", "ord", "number")


@query("w6_fill_sequence_gaps", f"""
WITH n AS ({_NUMBERED}), e AS (SELECT l_orderkey, max(l_linenumber) + CASE WHEN l_orderkey % 5 = 0 THEN 10 ELSE 0 END AS n FROM n GROUP BY 1),
w AS (SELECT e.l_orderkey, e.n, i AS number FROM e, range(1, 18) t(i) WHERE i <= e.n),
j AS (SELECT w.*, p_name AS title FROM w LEFT JOIN n ON n.l_orderkey = w.l_orderkey AND n.l_linenumber = w.number),
m AS (SELECT *, count(*) FILTER (title IS NULL) OVER (PARTITION BY l_orderkey) AS missing, max(number) FILTER (title IS NOT NULL) OVER (PARTITION BY l_orderkey) AS top FROM j)
SELECT l_orderkey, number, coalesce(title, CASE WHEN number IN (2, 4, 6) THEN 'other ' || number END, 'Unknown') AS title, title IS NULL AS filled FROM m WHERE missing <= greatest(3, n // 5) OR (top = n - missing AND top >= 3)""")
def w6(t):
    items = numbered(t).select("l_orderkey", F.col("l_linenumber").alias("number"), F.col("p_name").alias("title"))
    expected = items.groupBy("l_orderkey").agg(F.max("number").alias("n")).withColumn("n", F.col("n") + F.when(F.col("l_orderkey") % 5 == 0, 10).otherwise(0))
    other = expected.select("l_orderkey", F.explode(F.array(F.lit(2), F.lit(4), F.lit(6))).alias("number")).withColumn("title", F.concat_ws("", F.lit("other "), "number"))
    return op.fill_sequence_gaps(items, expected, "l_orderkey", other)


@query("w7_running_numbers", """
SELECT conv_id, turn AS ord, CASE WHEN conv_id % 2 = 0 THEN turn + 1 ELSE turn + 5 END AS number FROM conversations""")
def w7(t):
    number = F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 1), 5)
    rows = t("conversations").select("conv_id", "turn", number.alias("number"), "role")
    return op.running_numbers(rows, "conv_id", "turn", "number", "role").select("conv_id", "ord", "number")


@query("w8_order_files", f"""
WITH n AS ({_NUMBERED}), f AS (SELECT l_orderkey, l_linenumber, p_name, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS disc FROM n)
SELECT CAST(l_orderkey AS VARCHAR) AS folder, disc::BIGINT AS disc, l_linenumber::BIGINT AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY disc, l_linenumber) AS number, p_name AS title FROM f""")
def w8(t):
    name = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "d2").otherwise("d1"), F.lit("t0"), F.col("l_linenumber").cast("string"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".flac"))
    files = numbered(t).select(F.col("l_orderkey").cast("string").alias("folder"), name.alias("name"))
    return op.order_files(files, "folder", "name").drop("name")


@query("w9_header_section", f"""
WITH {BUILT}
SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))[:3]) AS line, unnest([0, 1, 2]) AS pos FROM built)""")
def w9(t):
    return op.header_section(built_docs(t), "doc_id", "text")


@query("w10_split_blocks", f"""
WITH {BUILT}, c AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM numbered GROUP BY 1)
SELECT doc_id, b AS first_block, b AS last_block FROM (SELECT doc_id, CASE WHEN n = 2 THEN 1 WHEN doc_id % 3 <> 0 THEN 2 END AS b FROM built JOIN c USING (doc_id)) WHERE b IS NOT NULL""")
def w10(t):
    blocks = op.split_blocks(built_docs(t), "doc_id", "text")
    expected = numbered(t).groupBy(F.col("l_orderkey").alias("doc_id")).agg((F.count("*") + 1).alias("expected"))
    return op.blocks_of_total(blocks, expected, "doc_id").select("doc_id", F.col("first_block").cast("int"), F.col("last_block").cast("int"))


@query("w11_select_source", """
WITH c AS (SELECT l_orderkey AS id, 'parts' AS source, 1 AS priority, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'suppliers', 2, count(DISTINCT l_suppkey) FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'flags', 3, count(DISTINCT l_returnflag) FROM lineitem GROUP BY 1)
SELECT id, source, n, n = 3 AS fits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(n - 3), priority, source) AS k FROM c) WHERE k = 1""")
def w11(t):
    items = t("lineitem")
    lists = [items.select(F.col("l_orderkey").alias("id"), F.lit(s).alias("source"), F.lit(p).alias("priority"), F.col(c).cast("string").alias("item")).distinct() for s, p, c in (("parts", 1, "l_partkey"), ("suppliers", 2, "l_suppkey"), ("flags", 3, "l_returnflag"))]
    expected = t("orders").select(F.col("o_orderkey").alias("id"), F.lit(3).alias("expected"))
    return op.select_source(lists[0].unionByName(lists[1]).unionByName(lists[2]), expected, "id")


@query("w12_positional_fill", f"""
WITH n AS ({_NUMBERED})
SELECT l_orderkey AS id, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_linenumber % 4 = 0 THEN 'Unknown' ELSE 'long ' || l_linenumber END ELSE p_name END AS title FROM n""")
def w12(t):
    rows = numbered(t)
    items = rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_linenumber") % 4 == 0, "").when(F.col("l_linenumber") % 2 == 0, "unknown ").otherwise(F.col("p_name")).alias("title"))
    ids = items.select("id").distinct()
    long = ids.select("id", F.lit("b").alias("list"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(5), F.lit(6), F.lit(7))).alias("pos"))
    short = ids.select("id", F.lit("a").alias("list"), F.explode(F.array(F.lit(2), F.lit(4))).alias("pos"))
    lists = long.union(short).withColumn("title", F.concat_ws("", F.when(F.col("list") == "b", "long ").otherwise("short "), "pos"))
    return op.positional_fill(items, lists, "id")


@query("w13_structured_header", """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'entity/venue/location/date' WHEN 1 THEN 'entity/date/venue/location' ELSE 'entity/combined/date' END AS shape, 'Act ' || c_custkey AS entity, strftime(o_orderdate, '%Y-%m-%d') AS date, c_mktsegment AS venue, 'Town, Land' AS location
FROM orders JOIN customer ON c_custkey = o_custkey""")
def w13(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    entity, date, place, n = F.concat_ws(" ", F.lit("Act"), "c_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("Town, Land"), F.col("o_orderkey") % 3
    text = F.when(n == 0, F.concat_ws("\n", entity, "c_mktsegment", place, date)).when(n == 1, F.concat_ws("\n", entity, date, "c_mktsegment", place)).otherwise(F.concat_ws("\n", entity, F.concat_ws(", ", "c_mktsegment", place), date))
    docs = rows.select(F.col("o_orderkey").alias("doc_id"), F.concat(text, F.lit("\n\n1. a\n2. b")).alias("text"))
    return op.structured_header(op.header_section(docs, "doc_id", "text"), "doc_id")
