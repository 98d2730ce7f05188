"""Dates and text extraction."""

from pyspark.sql import functions as F

from shelfmark.operators import dates as op
from shelfmark.queries import query
from shelfmark.queries.groups import BUILT, built_docs, numbered
from shelfmark.queries.keys import titles


@query("d1_extract_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS normal, 5 AS start FROM orders WHERE o_orderkey % 7 < 6""")
def d1(t):
    d, n = F.col("o_orderdate"), F.col("o_orderkey") % 7
    shown = F.when(n == 0, F.date_format(d, "yyyy-MM-dd")).when(n == 1, F.date_format(d, "yyyyMMdd")).when(n == 2, F.date_format(d, "MMM d, yyyy")).when(n == 3, F.date_format(d, "ddMMMyyyy")).when(n == 4, F.date_format(d, "yyyy.MM.dd")).when(n == 5, F.date_format(d, "yyyy MMMM d")).otherwise(F.date_format(d, "yyyy MM-dd"))
    rows = t("orders").select("o_orderkey", F.concat(F.lit("seen "), shown, F.lit(" at 24/96")).alias("text"))
    return op.extract_dates(rows, "o_orderkey", "text").where("kind <> 'range'").select("o_orderkey", "normal", F.col("start").cast("int").alias("start"))


_MASKED = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y-xx-xx') WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-xx') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders"


def masked(t):
    d, n = F.col("o_orderdate"), F.col("o_orderkey")
    return t("orders").select("o_orderkey", "o_custkey", F.when(n % 7 == 0, F.date_format(d, "yyyy-'xx-xx'")).when(n % 3 == 0, F.date_format(d, "yyyy-MM-'xx'")).otherwise(F.date_format(d, "yyyy-MM-dd")).alias("date"))


@query("d2_partial_dates", f"""
WITH m AS ({_MASKED}), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE date END AS normal FROM m)
SELECT o_orderkey, normal, CASE WHEN normal IS NULL THEN 0 ELSE len(list_filter(string_split(normal, '-'), lambda x: NOT contains(x, 'x'))) END AS spec FROM n""")
def d2(t):
    part = F.split("date", "-")
    rows = masked(t).select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.substring(part[0], 3, 2)).otherwise(part[0]).alias("y"), F.when(F.col("o_orderkey") % 11 == 0, "13").otherwise(part[1]).alias("m"), F.regexp_replace(part[2], "^0", "").alias("d"))
    return op.partial_dates(rows, "o_orderkey", "y", "m", "d")


@query("d3_year_ranges", """
WITH y AS (SELECT o_custkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders GROUP BY 1),
r AS (SELECT o_custkey, a, b, CASE WHEN b > a AND (o_custkey % 2 = 0 OR b - a <= 5) THEN a || '-' || b END AS range FROM y)
SELECT o_custkey, range, CASE WHEN range IS NOT NULL THEN a END AS start_year, CASE WHEN range IS NOT NULL THEN b END AS end_year FROM r""")
def d3(t):
    years = t("orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    shown = F.when(F.col("o_custkey") % 2 == 0, F.concat(a, F.lit("_"), b)).otherwise(F.concat(a, F.lit("-"), F.substring(b, 3, 2)))
    return op.year_ranges(years.select("o_custkey", shown.alias("text")), "o_custkey", "text")


@query("d4_match_compatible_dates", f"""
WITH m AS ({_MASKED})
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN CASE WHEN o_orderkey % 5 = 3 THEN m.date ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS date, CASE WHEN o_orderkey % 5 = 4 THEN m.date END AS conflict
FROM m JOIN orders USING (o_orderkey)""")
def d4(t):
    n = F.col("o_orderkey")
    told = t("orders").where("o_orderkey % 5 <> 3").select("o_orderkey", F.when(n % 5 == 4, "1901-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return op.match_compatible_dates(masked(t).select("o_orderkey", "date"), told, "o_orderkey")


@query("d4_ranges_and_parts", f"""
WITH m AS ({_MASKED}), y AS (SELECT o_custkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders GROUP BY 1),
c AS (SELECT DISTINCT o_custkey AS id, date AS c FROM m WHERE o_orderkey % 2 = 0 UNION SELECT o_custkey, a || '-' || b FROM y WHERE b > a AND o_custkey % 3 = 0),
t AS (SELECT DISTINCT o_custkey AS id, date AS m FROM m WHERE o_orderkey % 2 = 1 UNION SELECT o_custkey, '19xx-xx-xx' FROM y WHERE o_custkey % 5 = 0),
p AS (SELECT c.id, c, m, c[5] = '-' AND len(c) = 9 AS rc, contains(c, 'x') AS xc FROM c LEFT JOIN t USING (id)),
k AS (SELECT *, CASE WHEN m IS NULL THEN false WHEN m = '19xx-xx-xx' THEN NOT rc WHEN rc THEN m[1:4] BETWEEN c[1:4] AND c[6:9]
    ELSE c[1:4] = m[1:4] AND (c[6:7] = m[6:7] OR contains(c[6:7], 'x') OR contains(m[6:7], 'x')) AND (c[9:10] = m[9:10] OR contains(c[9:10], 'x') OR contains(m[9:10], 'x')) END AS ok,
  CASE WHEN rc THEN 0 ELSE len(list_filter(string_split(c, '-'), lambda x: NOT contains(x, 'x'))) END AS sc, CASE WHEN m IS NULL THEN 0 ELSE len(list_filter(string_split(m, '-'), lambda x: NOT contains(x, 'x'))) END AS sm FROM p),
g AS (SELECT id, list_sort(list(DISTINCT CASE WHEN ok AND sm > sc THEN m WHEN ok OR m IS NULL THEN c END) FILTER (ok OR m IS NULL)) AS s, list_sort(list(DISTINCT c)) AS every FROM k GROUP BY id)
SELECT id, CASE WHEN len(s) = 1 THEN s[1] END AS date, CASE WHEN s IS NULL OR len(s) <> 1 THEN array_to_string(CASE WHEN len(s) > 1 THEN s ELSE every END, ' | ') END AS conflict FROM g""")
def d4_ranges(t):
    """Dates and year ranges of a customer's even orders against those of the odd ones, some with an unknown year."""
    rows = masked(t).withColumn("id", F.col("o_custkey"))
    years = t("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    spans = years.where("b > a and id % 3 = 0").select("id", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("date"))
    told = rows.where("o_orderkey % 2 = 1").select("id", "date").unionByName(years.where("id % 5 = 0").select("id", F.lit("19xx-xx-xx").alias("date")))
    return op.match_compatible_dates(rows.where("o_orderkey % 2 = 0").select("id", "date").unionByName(spans), told, "id")


@query("d5_prefer_complete_dates", f"""
WITH m AS (SELECT DISTINCT o_custkey % 700 AS id, date FROM ({_MASKED})), c AS (SELECT id, count(DISTINCT date) AS n FROM m WHERE NOT contains(date, 'x') GROUP BY id)
SELECT m.id, date FROM m LEFT JOIN c USING (id) WHERE NOT (coalesce(n, 0) = 1 AND contains(date, 'x'))""")
def d5(t):
    return op.prefer_complete_dates(masked(t).select((F.col("o_custkey") % 700).alias("id"), "date").distinct(), "id")


@query("d6_split_around_date", """
WITH n AS (SELECT o_orderkey, o_orderkey % 4 AS k, c_name, n_name, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y.%m.%d') AS e FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT o_orderkey, 1 AS mention, CASE k WHEN 0 THEN '' WHEN 1 THEN 'ABC' ELSE c_name END AS before, d AS date, n_name AS after, k = 1 AS abbreviation, k <> 0 AS required FROM n WHERE k < 3
UNION ALL SELECT o_orderkey, 1, d || ' ' || n_name, d, c_name, false, true FROM n WHERE k = 3
UNION ALL SELECT o_orderkey, 2, '', d, n_name || ' ' || e || ' ' || c_name, false, false FROM n WHERE k = 3""")
def d6(t):
    n, date = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    both = F.concat_ws(" ", date, "n_name", F.date_format("o_orderdate", "yyyy.MM.dd"), "c_name")
    name = F.when(n == 0, F.concat_ws(" ", date, "n_name")).when(n == 1, F.concat(F.lit("ABC"), date, F.lit(" "), "n_name")).when(n == 2, F.concat_ws(" - ", "c_name", date, "n_name")).otherwise(both)
    return op.split_around_date(titles(t).select("o_orderkey", name.alias("text")), "o_orderkey", "text")


@query("d7_split_on_dash", """
SELECT p_partkey, p_brand AS left, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type || ' - x' END AS right, CASE WHEN p_size % 2 = 0 THEN '1997-11-xx' END AS date FROM part WHERE p_size % 5 <> 0""")
def d7(t):
    shown = F.when(F.col("p_size") % 5 == 0, F.concat_ws("-", "p_brand", "p_type")).when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" - 1997-11-xx"))).otherwise(F.concat_ws(" - ", "p_brand", "p_type", F.lit("x")))
    return op.split_on_dash(t("part").select("p_partkey", shown.alias("text")), "p_partkey", "text")


@query("d8_labelled_fields", f"""
WITH {BUILT}
SELECT doc_id, regexp_extract(text, 'Artist: ([^\n]*)', 1) AS artist, regexp_extract(text, 'Date: ([^\n]*)', 1) AS date, regexp_extract(text, 'Location: ([^\n]*)', 1) AS location, CAST(NULL AS VARCHAR) AS venue FROM built""")
def d8(t):
    # a long opening stands before the labels of every other document
    docs = built_docs(t).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.repeat(F.lit("a line of prose\n"), F.lit(150)), "text")).otherwise(F.col("text")))
    return op.labelled_fields(docs, "doc_id", "text")


@query("d9_numbered_items", "SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS number, p_name AS title FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = p")
def d9(t):
    return op.numbered_items(built_docs(t), "doc_id", "text").drop("pos")


@query("d10_comma_items", """
WITH n AS (SELECT l_orderkey, l_linenumber, p_name FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = p),
c AS (SELECT l_orderkey, count(*) AS n FROM n GROUP BY 1)
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS ord, p_name AS title FROM n JOIN c USING (l_orderkey) WHERE (n >= 5 OR (l_orderkey % 2 = 0 AND n >= 2)) AND l_orderkey % 3 <> 0""")
def d10(t):
    lists = numbered(t).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: x["p_name"]), ", ").alias("list"), F.count("*").alias("n"))
    docs = lists.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.when(F.col("l_orderkey") % 2 == 0, "Set 1:\n").otherwise("notes\n"), "list", F.lit(".")).alias("text"), F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(F.col("n")).alias("expected"))
    return op.comma_items(docs, "doc_id", "text", docs.select("doc_id", "expected"))
