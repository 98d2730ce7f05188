"""Sources and sinks."""

from pyspark.sql import functions as F

from shelfmark.operators import groups
from shelfmark.queries import QUERIES, SQL, query
from shelfmark.queries.keys import titles
from shelfmark.sources import files, tables

_CATALOG = "SELECT c_name || ' ' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 50 = 0 THEN ' ^ \"q\"' ELSE '' END AS show, '[' || c_mktsegment || '] /' || o_orderkey AS volume_path FROM orders JOIN customer ON c_custkey = o_custkey"


def catalog_rows(t):
    show = F.concat_ws("", F.concat_ws(" ", "c_name", F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(F.col("o_orderkey") % 50 == 0, ' ^ "q"'))
    return titles(t).select(show.alias("show"), F.concat_ws("", F.lit("["), "c_mktsegment", F.lit("] /"), "o_orderkey").alias("volume_path"))


@query("s1_read_catalog", "SELECT o_orderkey || ' x' AS show, CASE WHEN o_orderkey % 3 = 0 THEN '[V] /p' || o_orderkey WHEN o_orderkey % 3 = 1 THEN '/p' || o_orderkey ELSE '' END AS volume_path FROM orders")
def s1(t):
    rows = t("orders")
    key, n = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    line = F.concat(key, F.lit(" x"), F.when(n == 0, F.concat(F.lit("^old^V^/p"), key)).when(n == 1, F.concat(F.lit("^/p"), key)).otherwise(""))
    path = files.scratch(rows.sparkSession, "catalog")
    rows.select(F.explode(F.array(F.lit("sep=^"), F.lit("Show^VolumePath"), F.lit(" "), line)).alias("value")).write.text(path)
    return files.read_catalog(rows.sparkSession, path)


@query("s2_write_catalog", _CATALOG)
def s2(t):
    rows = catalog_rows(t)
    path = files.scratch(rows.sparkSession, "catalog")
    files.write_catalog(rows, path)
    return files.read_catalog(rows.sparkSession, path)


@query("s3_scan_files", """
SELECT 'nation' AS place, sum(length(n_name) + 1)::BIGINT AS length, true AS recent FROM nation
UNION ALL SELECT 'deep', sum(length(c_name) + 1)::BIGINT, true FROM customer""")
def s3(t):
    nation, customer = t("nation").select("n_name"), t("customer").select("c_name")
    root = files.scratch(nation.sparkSession, "scan")
    nation.write.text(f"{root}/nation")
    customer.write.text(f"{root}/customer/deep")
    customer.write.text(f"{root}/old-ignoredir/customer")
    found = files.scan_files(nation.sparkSession, [root]).where("name like 'part-%'").withColumn("place", F.regexp_extract("folder", "([^/]*)$", 1))
    return found.groupBy("place").agg(F.sum("length").alias("length"), F.bool_and(F.col("modified") > F.date_sub(F.current_date(), 2)).alias("recent"))


@query("s4_read_documents", "SELECT doc_id, md5(text) AS text_md5, CASE WHEN text IS NULL THEN NULL WHEN text = '' OR doc_id % 3 = 0 THEN 'utf-8' WHEN doc_id % 3 = 1 THEN 'utf-16-le' ELSE 'utf-16-be' END AS encoding FROM documents")
def s4(t):
    n = F.col("doc_id") % 3
    content = F.when(n == 0, F.encode("text", "UTF-8")).when(n == 1, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-16BE"))
    return files.decode_documents(t("documents").select("doc_id", content.alias("content"))).select("doc_id", F.md5("text").alias("text_md5"), "encoding")


@query("s4_read_files", """
SELECT c_nationkey::BIGINT AS nation, 'windows-1252' AS encoding, count(*) AS n_lines, sum(length(c_name || ' café «' || c_mktsegment || '»') + 1)::BIGINT AS n_chars FROM customer GROUP BY 1""")
def s4_files(t):
    rows = t("customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.concat("c_name", F.lit(" café «"), "c_mktsegment", F.lit("»")).alias("line"))
    root = files.scratch(rows.sparkSession, "western")
    rows.repartition("nation").write.partitionBy("nation").option("encoding", "ISO-8859-1").option("quote", "").option("sep", "\t").csv(root)
    read = files.read_documents(rows.sparkSession, root, "*.csv")
    return read.select(F.regexp_extract("path", "nation=([0-9]+)", 1).cast("long").alias("nation"), "encoding", (F.length(F.regexp_replace("text", "[^\n]", ""))).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


@query("s5_read_block_log", "SELECT 'S' || o_orderkey AS show, '/p/' || o_orderkey AS path, o_orderstatus AS artist, o_orderkey % 4 = 0 AS has_conflict FROM orders WHERE o_orderkey % 10 <> 0")
def s5(t):
    rows, key = t("orders"), F.col("o_orderkey").cast("string")
    named = F.when(F.col("o_orderkey") % 10 != 0, F.concat(F.lit("SHOW: S"), key, F.lit("\nPATH: /p/"), key))
    block = F.concat_ws("\n", F.lit("ARTIST: old"), named, F.concat(F.lit("ARTIST: "), "o_orderstatus"), F.lit("OTHER: x"), F.when(F.col("o_orderkey") % 4 == 0, "CONFLICT date"), F.lit(files.END_OF_BLOCK))
    path = files.scratch(rows.sparkSession, "blocks")
    rows.select(block.alias("value")).write.text(path)
    return files.read_block_log(rows.sparkSession, path, ["SHOW", "PATH", "ARTIST"])


@query("s6_write_audit_log", """
SELECT kind, field, count(*) AS n, CAST(sum(confidence) AS BIGINT) AS confidence, CAST(sum(length(value)) AS BIGINT) AS chars FROM (
  SELECT 'evidence' AS kind, 'name' AS field, 80 AS confidence, c_name AS value FROM customer UNION ALL SELECT 'evidence', 'segment', 50, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT 'conflict', 'segment', NULL, c_mktsegment || ' | ' || c_nationkey FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'observation', 'note', NULL, c_name FROM customer WHERE c_custkey % 5 = 0) GROUP BY kind, field""")
def s6(t):
    customer = t("customer")
    fields = {"name": (F.col("c_name"), "customer", F.lit(80)), "segment": (F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), "customer", F.lit(50))}
    evidence = groups.evidence_table(customer, "c_custkey", fields)
    conflicts = customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("record"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("kept"), F.col("c_nationkey").cast("string").alias("offered"), F.lit("nation").alias("source"))
    notes = customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("record"), F.col("c_name").alias("text"))
    path = files.scratch(evidence.sparkSession, "audit")
    files.write_audit_log(evidence, path, conflicts, notes)
    found = evidence.sparkSession.read.parquet(path).groupBy("kind", "field").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"), F.sum(F.length("value")).alias("chars"))
    return found.select(F.col("kind").cast("string").alias("kind"), F.col("field").cast("string").alias("field"), "n", "confidence", "chars")


@query("s7_entity_terms", """
SELECT c_custkey AS entity_id, c_name AS entity, lower(c_name) AS term, 0::BIGINT AS "order" FROM customer
UNION ALL SELECT c_custkey, c_name, 'also ' || c_custkey, 1 FROM customer WHERE c_custkey % 2 = 0""".replace("lower(c_name) AS term", "trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS term"))
def s7_terms(t):
    """Dictionary files with headers, comments and blank lines, read back."""
    customer = t("customer").where("c_name is not null")
    spark, path = customer.sparkSession, files.scratch(customer.sparkSession, "dictionary")
    key = F.col("c_custkey").cast("string")
    names = customer.select(F.explode(F.array(F.concat_ws("^", key, "c_name"), F.lit("# comment"), F.lit("  "))).alias("value"))
    aliases = customer.where("c_custkey % 2 = 0").select(F.explode(F.array(F.concat_ws("^", key, F.concat(F.lit("Also "), key)), F.concat_ws("^", key, F.concat(F.lit("ALSO, "), key)))).alias("value"))
    names.write.text(f"{path}/names")
    aliases.write.text(f"{path}/aliases")
    read = tables.read_dictionary
    return tables.entity_terms(read(spark, f"{path}/names", ["id", "name"]), read(spark, f"{path}/aliases", ["id", "alias"])).withColumn("entity_id", F.col("entity_id").cast("long"))


@query("s7_read_reference_tables", """
WITH a AS (SELECT lower(r_name) AS key, 'country' AS kind, r_name AS canonical, NULL::VARCHAR AS region, NULL::VARCHAR AS country FROM region
  UNION ALL SELECT replace(lower(n_name), '_', ' '), 'region', n_name, NULL, r_name FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT 'n' || n_nationkey, 'region', n_name, NULL, r_name FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT p_name, 'venue', p_name, NULL, NULL FROM (SELECT DISTINCT p_name FROM part)
  UNION ALL SELECT unnest([lower(p_type), 'at ' || lower(p_type)]), 'city', p_type, NULL, NULL FROM (SELECT DISTINCT p_type FROM part))
SELECT *, len(string_split(key, ' ')) AS n_tokens FROM a""")
def s7(t):
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    regions = nations.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("abbrev"), F.col("n_name").alias("name"), F.col("r_name").alias("country"))
    cities = t("part").select(F.col("p_type").alias("city"), none.alias("region"), none.alias("country"), F.concat(F.lit("At "), "p_type", F.lit("|")).alias("aliases")).distinct()
    return tables.place_dimension(t("region").select(F.col("r_name").alias("country"), F.lit("").alias("canonical")), regions, cities, t("part").select(F.col("p_name").alias("venue")))


@query("s8_validate_reference", "SELECT 'customer' AS \"table\", 'missing column c_phone' AS finding UNION ALL SELECT 'gone', 'missing column a' UNION ALL SELECT 'part', 'empty' WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 1000)")
def s8(t):
    wanted = {"customer": ("c_custkey", "c_phone"), "gone": ("a",), "part": ("p_partkey",), "documents": ("doc_id", "text")}
    return tables.validate_reference({"customer": t("customer"), "part": t("part").where("p_size > 1000"), "documents": t("documents")}, wanted)


@query("s9_flatten_performances", """
SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, 'hall' AS venue, o_orderstatus AS city, NULL::VARCHAR AS state, year(o_orderdate)::BIGINT AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE 'a' END AS sets FROM orders WHERE o_orderkey % 9 <> 0""")
def s9(t):
    key = F.when(F.col("o_orderkey") % 9 == 0, "x").otherwise(F.col("o_orderkey").cast("string"))
    node = F.struct(key.alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("hall").alias("venue"), F.col("o_orderstatus").alias("city"), F.lit("a").alias("set1"), F.lit(" ").alias("set2"), F.when(F.col("o_orderkey") % 2 == 0, "b").alias("set3"))
    pages = t("orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(F.struct(node.alias("node"))).alias("edges"))).alias("body"))
    return tables.flatten_performances(pages, "body").withColumn("sets", F.array_join("sets", ","))


@query("s10_flatten_song_sets", """
WITH n AS (SELECT l_orderkey, l_linenumber, p_name FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = p)
SELECT l_orderkey AS id, 'Act' AS artist, CASE WHEN l_orderkey % 2 = 0 THEN 'Town, ST' ELSE 'Town, Land' END AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS number, p_name AS title FROM n""")
def s10(t):
    rows = groups_numbered(t)
    song = lambda x: F.concat(F.lit('{"name":"'), x["p_name"], F.lit('"}'))
    songs = F.array_join(F.transform("x", song), ",")
    one = F.when(F.size("x") == 1, songs).otherwise(F.concat(F.lit('[{"name":"Encore:"},'), songs, F.lit("]")))
    sets = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit('{"song":'), one, F.lit("}"))).otherwise(F.concat(F.lit('[{"name":"none"},{"song":'), one, F.lit("}]")))
    place = F.when(F.col("l_orderkey") % 2 == 0, '{"name":"Town","state":"ST","country":{"name":"USA"}}').otherwise('{"name":"Town","state":"ST","country":{"name":"Land"}}')
    body = F.concat(F.lit('{"artist":{"name":"Act"},"venue":{"city":'), place, F.lit('},"sets":{"set":'), sets, F.lit("}}"))
    return tables.flatten_song_sets(rows.select(F.col("l_orderkey").alias("id"), body.alias("body")), "id", "body")


def groups_numbered(t):
    from shelfmark.queries.groups import numbered

    return numbered(t).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("x"))


