"""Aggregations."""

from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import groups as op
from shelfmark.queries import query


def page_paths(t):
    """Path table: host and path of each page url, without scheme, query and fragment."""
    return t("pages").select("page_id", F.concat(F.lit("/"), paths.url_host(F.col("url")), F.regexp_replace(paths.url_path(F.col("url")), "/+$", "")).alias("path"))


PATHS = r"SELECT page_id, '/' || regexp_extract(url, '://([^/?#]*)', 1) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages"


@query("a1_folder_profile", rf"""
WITH f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM
  (SELECT path FROM ({PATHS}) UNION ALL SELECT regexp_replace(path, '/[^/]*$', '') || '.idx' FROM ({PATHS}) WHERE page_id % 5 = 0)),
p AS (SELECT folder, count(*) AS n_files, min(path) AS first_file, array_to_string(list_sort(list(DISTINCT ext)), ',') AS extensions FROM f GROUP BY folder)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(p.folder, q.folder || '/'))""")
def a1(t):
    files = page_paths(t)
    extra = files.where("page_id % 5 = 0").select(F.concat(F.regexp_replace("path", "/[^/]*$", ""), F.lit(".idx")).alias("path"))
    return op.folder_profile(files.select("path").union(extra), "path")


@query("a2_group_release_parts", """
WITH r AS (SELECT p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' cd' END AS release, p_size FROM part)
SELECT p_brand, replace(release, ' cd', '') AS release, count(*) AS n_folders, CAST(sum(p_size) AS BIGINT) AS n_files FROM r GROUP BY p_brand, replace(release, ' cd', '')""")
def a2(t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" - CD "), (F.col("p_partkey") % 4 + 1).cast("string")))
    return op.group_release_parts(t("part").select("p_brand", name.alias("name"), F.col("p_size").cast("long").alias("n")), "p_brand", "name", "n")


BUILT = """
numbered AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey FROM lineitem GROUP BY 1, 2),
built AS (
  SELECT o_orderkey AS doc_id, 'Artist: ' || c_name || chr(10) || 'Date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'Location: ' || n_name || ', ' || r_name || chr(10) || chr(10) || 'TRACKS:' || chr(10)
    || string_agg(lpad(l_linenumber::VARCHAR, 2, '0') || '. ' || p_name, chr(10) ORDER BY l_linenumber)
    || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || string_agg(lpad(l_linenumber::VARCHAR, 2, '0') || ' ' || p_name || '.flac:' || md5(p_name), chr(10) ORDER BY l_linenumber) ELSE '' END AS text
  FROM numbered JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = partkey
  GROUP BY o_orderkey, c_name, o_orderdate, n_name, r_name)"""


def numbered(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey")).join(t("part").select("p_partkey", "p_name"), "p_partkey")


def built_docs(t):
    """One text per order: labelled header, list of titles and, for every third, checksum lines."""
    n = F.lpad(F.col("l_linenumber").cast("string"), 2, "0")
    rows = numbered(t).select("l_orderkey", F.struct("l_linenumber", F.concat(n, F.lit(". "), "p_name").alias("title"), F.concat(n, F.lit(" "), "p_name", F.lit(".flac:"), F.md5("p_name")).alias("sum")).alias("x"))
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    header = F.concat(F.lit("Artist: "), "c_name", F.lit("\nDate: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nLocation: "), "n_name", F.lit(", "), "r_name", F.lit("\n\nTRACKS:\n"))
    sums = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("\n"), F.array_join(F.transform("x", lambda e: e["sum"]), "\n"))).otherwise("")
    return head.join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("doc_id"), F.concat(header, F.array_join(F.transform("x", lambda e: e["title"]), "\n"), sums).alias("text"))


@query("a3_document_line_profile", f"""
WITH {BUILT}, c AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM numbered GROUP BY 1)
SELECT doc_id, false AS unreadable, CAST(4 + n * (CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_lines, CASE WHEN doc_id % 3 = 0 THEN n ELSE 0 END AS n_checksum, false AS checksum_only
FROM built JOIN c USING (doc_id)""")
def a3(t):
    return op.document_line_profile(built_docs(t), "doc_id", "text").drop("score", "n_info")


@query("a4_consensus", """
WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS v, bool_or(l_quantity > 49) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(v) = 1 AND NOT c THEN v[1] END AS value, CASE WHEN len(v) > 1 OR c THEN array_to_string(v, ' | ') END AS conflict FROM s""")
def a4(t):
    return op.consensus(t("lineitem"), "l_orderkey", "l_returnflag", F.col("l_quantity") > 49)


@query("a5_counts_by_volume", """
SELECT lower(source) AS volume, count(*) AS n_rows, array_to_string(list_sort(list(DISTINCT lang)), ',') AS tokens FROM documents GROUP BY lower(source)""")
def a5(t):
    label = F.concat(F.lit(" ["), F.upper("source"), F.lit("]"))
    return op.counts_by_volume(t("documents").select(label.alias("label"), "lang"), "label", "lang")


def log_lines(t):
    """Events as log lines."""
    kind = F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR reason="), F.regexp_extract("props", "([0-9]+)", 1))).when(F.col("event_id") % 5 == 0, "Warning: slow").when(F.col("event_id") % 7 == 0, "skipped but completed").otherwise(F.col("event_type"))
    return t("events").select("event_id", F.concat(F.date_format("ts", "HH:mm:ss "), kind).alias("line"))


@query("a6_reason_counts", """
SELECT code, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN regexp_extract(props, '([0-9]+)', 1) WHEN event_id % 5 = 0 THEN 'WARNING' END AS code FROM events) WHERE code IS NOT NULL GROUP BY code""")
def a6(t):
    return op.reason_counts(log_lines(t))


@query("a7_merge_stats", """
SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types
FROM (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 20) AS bad FROM events GROUP BY 1, 2) GROUP BY user_id""")
def a7(t):
    parts = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("bad")).withColumn("types", F.array("event_type"))
    return op.merge_stats(parts, ["user_id"], ["n", "bad"], "types").withColumn("types", F.array_join("types", ","))


@query("a8_capacity_rollup", """
SELECT l_suppkey AS destination, sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_quantity END) AS required, count(DISTINCT l_partkey) AS n_sources, 6000.0::DOUBLE AS free_bytes,
  sum(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_quantity END) - 6000.0::DOUBLE AS shortfall FROM lineitem GROUP BY 1 HAVING required > 6000""")
def a8(t):
    moves = t("lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("destination"), F.col("l_quantity").alias("bytes"), (F.col("l_linestatus") == "F").alias("same_device"))
    free = t("supplier").select(F.col("s_suppkey").alias("destination"), F.lit(6000.0).alias("free_bytes"))
    return op.capacity_rollup(moves, free)


@query("a8_shortfall_sources", """
WITH n AS (SELECT l_suppkey AS destination, l_partkey AS source, sum(l_quantity) AS required FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1, 2), s AS (SELECT destination, sum(required) - 6000.0::DOUBLE AS shortfall FROM n GROUP BY 1)
SELECT destination, source, required, shortfall FROM n JOIN s USING (destination) WHERE shortfall > 0""")
def a8_sources(t):
    moves = t("lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("destination"), F.col("l_quantity").alias("bytes"), (F.col("l_linestatus") == "F").alias("same_device"))
    return op.shortfall_sources(moves, t("supplier").select(F.col("s_suppkey").alias("destination"), F.lit(6000.0).alias("free_bytes")))


@query("a9_combine_documents", """
WITH k AS (SELECT conv_id, turn, text, lower(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS key FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) AS rn FROM k WHERE key <> '')
SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM r WHERE rn = 1 GROUP BY conv_id""")
def a9(t):
    return op.combine_documents(t("conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("text_md5"))


@query("a10_generate_documents", """
WITH numbered AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS partkey FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_orderkey, string_agg(lpad(l_linenumber::VARCHAR, 2, '0') || '. ' || p_name, chr(10) ORDER BY l_linenumber) AS list FROM numbered JOIN part ON p_partkey = partkey GROUP BY 1)
SELECT o_orderkey, 'Artist: ' || c_name || chr(10) || 'Date: ' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN list IS NULL THEN '' ELSE chr(10) || chr(10) || 'TRACKS:' || chr(10) || list END AS text
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 0""")
def a10(t):
    orders = t("orders")
    records = orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_name").alias("artist"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("").alias("venue"))
    titles = numbered(t).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("number"), F.col("p_name").alias("title"))
    return op.generate_documents(records, titles, orders.where("o_orderkey % 4 = 0"), "o_orderkey")


@query("a11_sibling_relations", """
SELECT p_brand, count(*) AS n_children, count(DISTINCT p_name) = 1 AND bool_and(p_size > 1) AS related, min(p_name) = max(p_name) AS shared_lead, count(*) = 1 OR (count(DISTINCT p_name) = 1 AND bool_and(p_size > 1)) OR min(p_name) = max(p_name) AS may_share
FROM (SELECT p_brand || p_type || p_size % 9 AS p_brand, p_name, p_size FROM part) GROUP BY p_brand""")
def a11(t):
    part = t("part").withColumn("p_brand", F.concat("p_brand", "p_type", (F.col("p_size") % 9).cast("string")))
    name = F.when(F.col("p_size") > 1, F.concat("p_name", F.lit(" Disc 1"))).otherwise(F.col("p_name"))
    return op.sibling_relations(part.select("p_brand", name.alias("name")), "p_brand", "name")


@query("a12_conflict_summary", """
WITH b AS (
  SELECT 0 AS part, event_id AS ord, CASE WHEN event_id % 10 = 0 THEN 'root' || event_id END AS root, 'u' || user_id AS source, event_type || value::BIGINT AS message FROM events
  UNION ALL SELECT 1, c_custkey, NULL, 'c', 'blank ' || c_mktsegment FROM customer),
r AS (SELECT part, ord, last_value(root IGNORE NULLS) OVER (PARTITION BY source ORDER BY part, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS root, source, message FROM b)
SELECT part, ord, root, source, message FROM (SELECT *, row_number() OVER (PARTITION BY message ORDER BY part, ord, source) AS rn FROM r) WHERE rn = 1""")
def a12(t):
    events = t("events")
    root = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("root"), F.col("event_id").cast("string")))
    conflicts = events.select(F.col("event_id").alias("ord"), root.alias("root"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.concat("event_type", F.rint("value").cast("long").cast("string")).alias("message"))
    blank = t("customer").select(F.col("c_custkey").alias("ord"), F.lit(None).cast("string").alias("root"), F.lit("c").alias("source"), F.concat(F.lit("blank "), "c_mktsegment").alias("message"))
    return op.conflict_summary(conflicts, blank)


@query("a13_evidence_table", """
WITH e AS (
  SELECT doc_id, 'quality' AS field, quality::VARCHAR AS value, doc_id % 7 AS confidence FROM labels UNION ALL SELECT doc_id, 'quality', toxic::VARCHAR, doc_id % 5 FROM labels
  UNION ALL SELECT doc_id, 'lang', lang, 10 FROM documents)
SELECT doc_id, field, count(*) AS n, arg_min(value, {'c': -confidence, 'v': value}) AS best FROM e GROUP BY doc_id, field""")
def a13(t):
    labels = op.evidence_table(t("labels"), "doc_id", {"quality": (F.col("quality"), "labels", F.col("doc_id") % 7)})
    toxic = op.evidence_table(t("labels"), "doc_id", {"quality": (F.col("toxic"), "labels", F.col("doc_id") % 5)})
    langs = op.evidence_table(t("documents"), "doc_id", {"lang": (F.col("lang"), "documents", F.lit(10))})
    return op.evidence_rollup(labels.union(toxic).union(langs), "doc_id")
