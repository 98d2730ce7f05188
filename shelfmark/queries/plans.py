"""Plans and streams."""

from pyspark.sql import functions as F

from shelfmark.operators.search_index import SearchIndex
from shelfmark.plans import catalog as op
from shelfmark.queries import query
from shelfmark.queries.groups import log_lines, numbered
from shelfmark.queries.keys import titles
from shelfmark.sources.files import scratch
from shelfmark.streaming import arrivals


def folders(t):
    """Orders as folder names: entity, date and place in several layouts."""
    n, date = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.when(n == 0, F.concat_ws(" - ", "c_name", "n_name")).when(n == 1, F.concat_ws(" ", date, "n_name")).when(n == 4, F.concat_ws(" ", "c_name", date)).otherwise(F.concat_ws(" ", "c_name", date, "n_name"))
    tag = F.when(F.col("o_orderkey") % 10 == 1, F.upper("c_name"))
    return titles(t).select(F.col("o_orderkey").alias("id"), name.alias("name"), F.lit("").alias("override"), tag.alias("tag"), "c_name", "n_name", date.alias("d"), "o_custkey")


def known_terms(t):
    return t("customer").select(F.col("c_name").alias("entity"), F.col("c_name").alias("term"))


_E1 = """
WITH r AS (SELECT o_orderkey AS id, c_name, n_name, c_mktsegment, o_orderkey % 5 AS n, o_orderkey % 10 AS m, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT *, CASE WHEN n = 1 AND m <> 1 AND id % 3 <> 0 THEN NULL ELSE c_name END AS entity, CASE WHEN (n = 0 AND id % 2 = 1) OR id % 15 = 2 THEN NULL ELSE d END AS date, id % 15 = 2 AS bad FROM r),
f AS (SELECT *, CASE WHEN n = 4 THEN c_mktsegment ELSE n_name END AS venue, CASE WHEN entity IS NOT NULL AND date IS NOT NULL THEN 'Town of ' || n_name END AS location FROM e)"""


def _resolved(t):
    rows = folders(t).withColumn("path", F.concat(F.lit("/store/"), F.when(F.col("id") % 3 == 0, F.concat("c_name", F.lit("/cd1"))).otherwise("misc")))
    mentions = rows.where("id % 15 = 2").select("id", F.lit("1900-01-01").alias("date")).unionByName(rows.where("id % 20 = 10").select("id", F.col("d").alias("date")))
    files = rows.where("id % 20 = 0").select("id", F.concat(F.lit("t01 "), "d", F.lit(".flac")).alias("name"))
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_name", F.col("c_mktsegment").alias("venue"), F.concat(F.lit("Town of "), "n_name").alias("location"))
    performances = rows.select("c_name", F.col("d").alias("date")).distinct().join(places, "c_name").withColumnRenamed("c_name", "entity")
    return op.resolve_records(rows.select("id", "name", "override", "tag", "path"), known_terms(t), mentions, [("store", performances)], files)


@query("e1_resolve_records", _E1 + """
SELECT id, entity, date, venue, location,
  CASE WHEN entity IS NOT NULL AND NOT bad THEN entity || ' ' || coalesce(date, 'xxxx-xx-xx') || ' ' || venue || coalesce(' ' || location, '') END AS title,
  CASE WHEN entity IS NULL THEN 'blank name; blank entity' WHEN bad THEN 'blank name; in conflict' END AS reason FROM f""")
def e1(t):
    return _resolved(t)[0]


@query("e1_conflicts", _E1 + " SELECT entity, date, 'venue' AS field, n_name AS kept, c_mktsegment AS offered, 'store' AS source FROM f WHERE n <> 4 AND entity IS NOT NULL AND date IS NOT NULL")
def e1_conflicts(t):
    return _resolved(t)[1]


@query("e1_places_tags_collisions", """
WITH r AS (SELECT o_orderkey AS id, o_orderkey % 6 AS n, c_name, n_name, r_name, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
e AS (SELECT id, n, CASE WHEN n <> 3 THEN c_name END AS entity, CASE WHEN n <> 2 THEN d END AS date, CASE WHEN n = 1 THEN NULL ELSE 'Old Hall' END AS venue,
  CASE WHEN n = 0 THEN n_name || ', ' || r_name WHEN n = 4 THEN 'Big Town, ' || n_name || ', ' || r_name END AS location FROM r)
SELECT id, entity, date, venue, location, CASE WHEN n NOT IN (2, 3) THEN entity || ' ' || date || coalesce(' ' || venue, '') || coalesce(' ' || location, '') END AS title,
  CASE n WHEN 2 THEN 'blank name; in conflict' WHEN 3 THEN 'blank name; blank entity; several entities: First Band | Second Band' END AS reason FROM e""")
def e1_places_tags_collisions(t):
    lands = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = folders(t).select("id", "c_name", "n_name", "d").join(F.broadcast(lands.select("n_name", "r_name")), "n_name")
    n = F.col("id") % 6
    # 0 region and country, 1 date in the tag only, 2 another date in the tag, 3 a name of two entities, 4 a partial date and a town, 5 no place
    who = F.when(n == 3, "Shared Name").otherwise(F.col("c_name"))
    when = F.when(n == 4, F.concat(F.substring("d", 1, 7), F.lit("-xx"))).otherwise(F.col("d"))
    where = F.when(n == 0, F.concat_ws(", ", F.lit("Old Hall"), "n_name", "r_name")).when(n == 4, F.concat_ws(", ", F.lit("Old Hall"), F.lit("Big Town"), "n_name", "r_name")).otherwise("Old Hall")
    name = F.when(n == 1, F.lit("cd1")).otherwise(F.concat_ws(" ", who, when, where))
    none = F.lit(None).cast("string")
    places = t("region").select(F.col("r_name").alias("term"), F.lit("country").alias("kind"), F.col("r_name").alias("canonical"), none.alias("region"), none.alias("country"))
    places = places.union(lands.select("n_name", F.lit("region"), "n_name", none, "r_name")).union(t("region").limit(1).select(F.lit("Big Town"), F.lit("city"), F.lit("Big Town"), none, none))
    two = t("region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "First Band").otherwise("Second Band").alias("entity"), F.lit("shared name").alias("term"))
    tags = rows.select("id", F.when(n.isin(1, 4, 5), F.col("d")).when(n == 2, "1901-02-03").alias("value")).where("value is not null")
    store = rows.limit(0).select(F.col("c_name").alias("entity"), F.col("d").alias("date"), F.lit("").alias("venue"), F.lit("").alias("location"))
    listed = rows.select("id", name.alias("name"), F.lit("").alias("override"), F.lit("").alias("tag"), F.concat(F.lit("/store/"), "c_name", F.lit("/cd1")).alias("path"))
    mentions = rows.limit(0).select("id", F.col("d").alias("date"))
    return op.resolve_records(listed, known_terms(t).union(two), mentions, [("store", store)], tags=tags, places=places)[0]


@query("e2_resolve_records_strict", """
WITH r AS (SELECT o_orderkey AS id, c_name, n_name, o_orderkey % 5 AS n, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT id, CASE n WHEN 0 THEN 'entity - tail' WHEN 1 THEN 'name' WHEN 4 THEN 'entity date' ELSE 'entity date tail' END AS pattern, CASE WHEN n <> 1 THEN c_name END AS entity, CASE WHEN n NOT IN (0, 1) THEN d END AS date, CASE WHEN n NOT IN (1, 4) THEN n_name END AS tail,
  CASE n WHEN 0 THEN c_name || ' - ' || n_name WHEN 1 THEN d || ' ' || n_name WHEN 4 THEN c_name || ' ' || d ELSE c_name || ' ' || d || ' ' || n_name END AS title FROM r""")
def e2(t):
    rows = folders(t).select("id", F.regexp_replace("name", "^Customer", "CUSTOMER").alias("name"))
    return op.resolve_records_strict(rows, known_terms(t))


@query("e3_build_catalog", """
WITH r AS (SELECT o_orderkey AS id, c_name || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS title, c_mktsegment AS label, '/' || c_nationkey || '/' || o_orderkey AS path, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT title, label, path FROM r WHERE o_orderdate < TIMESTAMP '1999-01-01' AND NOT (label = 'BUILDING' AND starts_with(path, '/3/'))
UNION ALL SELECT title, label, path FROM r WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND id % 20 <> 0""")
def e3(t):
    return _built(t)["catalog"]


@query("e3_documents", """
WITH l AS (SELECT l_orderkey, string_agg(lpad(l_linenumber::VARCHAR, 2, '0') || '. ' || p_name, chr(10) ORDER BY l_linenumber) AS list FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = p GROUP BY 1),
r AS (SELECT o_orderkey AS id, c_name, strftime(o_orderdate, '%Y-%m-%d') AS d, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderkey % 20 <> 0),
x AS (SELECT id, replace(c_name, '#', '') || d || replace(n_name, '_', '') AS key, CASE WHEN id % 2 = 0 THEN 'told' ELSE 'Artist: ' || c_name || chr(10) || 'Date: ' || d || chr(10) || 'Venue: ' || n_name || CASE WHEN list IS NULL THEN '' ELSE chr(10) || chr(10) || 'TRACKS:' || chr(10) || list END END AS text FROM r LEFT JOIN l ON l_orderkey = id),
f AS (SELECT key, text, min(id) AS first_ FROM x GROUP BY 1, 2), a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first_) - 1 AS alt FROM f)
SELECT id, CASE WHEN alt = 0 THEN key ELSE key || '(alt' || alt || ')' END AS document, md5(text) AS text_md5 FROM x JOIN a USING (key, text)""")
def e3_documents(t):
    return _built(t)["documents"].select("id", "document", F.md5("text").alias("text_md5"))


@query("e3_summary", """
SELECT 1 AS part, o_orderkey AS ord, c_mktsegment || ' /' || c_nationkey || '/' || o_orderkey || ' blank name' AS message FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderkey % 20 = 0
UNION ALL SELECT 0, o_orderkey, 'date of ' || c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_name ORDER BY o_orderkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 7 = 0) WHERE k = 1""")
def e3_summary(t):
    return _built(t)["summary"].select("part", "ord", "message")


def _built(t):
    rows = titles(t).withColumns({"date": F.date_format("o_orderdate", "yyyy-MM-dd"), "label": F.col("c_mktsegment"), "path": F.concat_ws("/", F.lit(""), "c_nationkey", "o_orderkey")})
    rows = rows.withColumn("title", F.concat_ws(" ", "c_name", "date"))
    new = rows.where("o_orderdate >= timestamp '1999-01-01'")
    records = new.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 20 != 0, F.col("title")).alias("title"), F.col("c_name").alias("entity"), "date", F.col("n_name").alias("venue"), F.lit("").alias("location"), "label", "path")
    documents = new.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("ord"), F.lit("told").alias("text"))
    listed = numbered(t).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("number"), F.col("p_name").alias("title"))
    old = rows.where("o_orderdate < timestamp '1999-01-01'").select("title", "label", "path")
    roots = t("region").where("r_regionkey = 0").select(F.lit("building").alias("label"), F.lit("/3").alias("root"))
    conflicts = rows.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("ord"), F.col("label").alias("root"), F.col("path").alias("source"), F.concat(F.lit("date of "), "c_name").alias("message"))
    return op.build_catalog(records, documents, listed, old, roots, conflicts)


@query("e4_search_catalog", """
SELECT p_partkey AS id, doc_id AS document, CASE WHEN doc_id IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS tier, 'row' AS hit FROM part LEFT JOIN documents ON doc_id = p_partkey
WHERE (p_name LIKE '%bolt%' AND p_size > 0 AND p_type = 'PROMO') OR p_brand = 'Brand#7'
UNION ALL SELECT doc_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END, 'document' FROM documents JOIN part ON p_partkey = doc_id WHERE contains(lower(text), 'license')""")
def e4(t):
    rows = t("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("key"), "p_name", "p_type", F.concat(F.lit("<"), "p_brand", F.lit(">")).alias("brand"))
    key = F.concat(F.lit("K"), F.col("doc_id").cast("string"))
    documents = t("documents").select(F.col("doc_id").alias("document"), F.when(F.col("doc_id") % 3 == 0, F.concat(key, F.lit("(alt1)"))).otherwise(key).alias("key"), "text")
    index = SearchIndex(documents.sparkSession, scratch(documents.sparkSession, "index"))
    index.add(documents, "document", "text")
    plain = op.search_catalog(rows, ["p_name", "p_type", "brand"], "bolt |AND| promo |OR| '<Brand#7>'", documents)
    return plain.unionByName(op.search_catalog(rows, ["p_name"], "license", documents, True, index)).withColumn("tier", F.col("tier").cast("int"))


_T1 = """
WITH a AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE c_name || ' ' || strftime(o_orderdate, '%Y-%m') END AS title FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 1 OR o_orderkey % 50 = 0),
k AS (SELECT DISTINCT c_name || ' ' || strftime(o_orderdate, '%Y-%m') AS title FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0),
r AS (SELECT ord, a.title, CASE WHEN a.title = '' THEN 'error' WHEN k.title IS NOT NULL OR row_number() OVER (PARTITION BY a.title ORDER BY ord) > 1 THEN 'duplicate' ELSE 'new' END AS route FROM a LEFT JOIN k USING (title))"""


def arrived(t):
    """Odd orders arrive against a catalog of the even ones; titles have no day, so some meet."""
    rows = titles(t).withColumn("title", F.concat_ws(" ", "c_name", F.date_format("o_orderdate", "yyyy-MM")))
    new = rows.where("o_orderkey % 2 = 1 or o_orderkey % 50 = 0").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 50 == 0, "").otherwise(F.col("title")).alias("title"))
    return new, rows.where("o_orderkey % 2 = 0").select("title", F.concat_ws("/", F.lit(""), "o_orderkey").alias("path"))


@query("t1_ingest_arrivals", _T1 + " SELECT count(*) AS processed, count(*) FILTER (route = 'new') AS staged, count(*) FILTER (route = 'duplicate') AS duplicates, count(*) FILTER (route = 'error') AS errors FROM r")
def t1(t):
    new, known = arrived(t)
    spark, path = new.sparkSession, scratch(new.sparkSession, "arrivals")
    known.write.parquet(f"{path}/catalog")
    new.write.parquet(f"{path}/drop")
    stream = lambda name, df: spark.readStream.schema(df.schema).parquet(f"{path}/{name}")
    arrivals.ingest_arrivals(stream("drop", new), stream("catalog", known), f"{path}/out", f"{path}/state").awaitTermination()
    return arrivals.run_counts(spark.read.parquet(f"{path}/out"))


@query("t1_alias_arrivals", """
WITH o AS (SELECT o_orderkey AS ord, c_name, strftime(o_orderdate, '%Y-%m-%d') AS d, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
k AS (SELECT c_name, d, min(c_name || ' ' || d || ' ' || n_name) AS title FROM o WHERE ord % 2 = 0 GROUP BY 1, 2),
a AS (SELECT *, 'Night of ' || d || ' ' || ord || CASE WHEN ord % 3 = 0 THEN ', ' || upper(c_name) ELSE '' END AS title FROM o WHERE ord % 2 = 1),
n AS (SELECT *, min(ord) FILTER (ord % 3 = 0) OVER (PARTITION BY c_name, d) AS first_named FROM a)
SELECT ord, CASE WHEN k.title IS NOT NULL OR ord > first_named THEN 'duplicate' ELSE 'new' END AS route,
  CASE WHEN k.title IS NOT NULL THEN k.title WHEN ord > first_named THEN (SELECT b.title FROM a b WHERE b.ord = first_named) END AS match
FROM n LEFT JOIN k USING (c_name, d)""")
def t1_alias(t):
    """Titles of arrivals have the date and sometimes the name; they are matched by the names of their entity. They come in two deliveries, the later ones over a restart."""
    rows = titles(t).withColumns({"date": F.date_format("o_orderdate", "yyyy-MM-dd"), "ord": F.col("o_orderkey")})
    known = rows.where("ord % 2 = 0").select(F.concat_ws(" ", "c_name", "date", "n_name").alias("title"))
    title = F.concat(F.lit("Night of "), "date", F.lit(" "), F.col("ord").cast("string"), F.when(F.col("ord") % 3 == 0, F.concat(F.lit(", "), F.upper("c_name"))).otherwise(""))
    new = rows.where("ord % 2 = 1").select(F.col("ord").cast("string").alias("name"), "ord", title.alias("title"), "date", F.array(F.lit("no such name"), "c_name").alias("names"))
    spark, path = new.sparkSession, scratch(new.sparkSession, "arrivals")
    known.write.parquet(f"{path}/catalog")
    # about the middle; an exact median holds all values in one task
    middle = new.agg(F.percentile_approx("ord", 0.5)).scalar()
    for part in (F.col("ord") <= middle, F.col("ord") > middle):
        new.where(part).write.mode("append").parquet(f"{path}/drop")
        stream = lambda name, df: spark.readStream.schema(df.schema).parquet(f"{path}/{name}")
        arrivals.ingest_arrivals(stream("drop", new), stream("catalog", known), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("ord", "route", "match")


@query("t2_resolve_duplicates", _T1 + """,
c AS (SELECT c_name || ' ' || strftime(o_orderdate, '%Y-%m') AS title, '/' || o_orderkey AS path FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0),
acc AS (SELECT DISTINCT title FROM r WHERE route = 'duplicate' AND ord % 4 = 1)
SELECT title, path FROM c WHERE title NOT IN (SELECT title FROM acc) UNION ALL SELECT title, '/new/' || ord FROM r WHERE route = 'duplicate' AND ord % 4 = 1""")
def t2(t):
    new, known = arrived(t)
    work = arrivals.duplicate_work_items(arrivals.route(new, known), known)
    accept = F.col("name").cast("long") % 4 == 1
    decisions = work.select("title", F.concat(F.lit("/new/"), "name").alias("path"), accept.alias("accept"))
    gone = work.where(accept).select(F.explode("matches").alias("m")).select("m.title", "m.path")
    return arrivals.resolve_duplicates(known, decisions, gone)


@query("t3_running_reason_counts", "SELECT code, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN regexp_extract(props, '([0-9]+)', 1) WHEN event_id % 5 = 0 THEN 'WARNING' END AS code FROM events) WHERE code IS NOT NULL GROUP BY code")
def t3(t):
    log = log_lines(t)
    spark, path = log.sparkSession, scratch(log.sparkSession, "log")
    log.select("line").write.text(f"{path}/lines")
    arrivals.running_reason_counts(spark, f"{path}/lines", f"{path}/state", f"{path}/counts").awaitTermination()
    return spark.read.parquet(f"{path}/counts")
