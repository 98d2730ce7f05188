"""Keys and projections."""

from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators import projections as op
from shelfmark.queries import query

_ASCII = r"trim(regexp_replace(regexp_replace(strip_accents(replace(replace({0}, 'ß', 'ss'), '`', '''')), '[\r\n\t\f\x0B]', ' ', 'g'), '[^\x20-\x7E]', '', 'g'))"


@query("p1_normalize_columns", rf"""
SELECT doc_id, lang, regexp_replace({_ASCII.format('coalesce(text, chr(32))')}, '\s+', ' ', 'g') AS text FROM documents""")
def p1(t):
    docs = t("documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return op.normalize_columns(docs, ["text"])


_COMPARE = r"trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query("p2_key_variants_report", rf"""
WITH lines AS (SELECT string_split(text, chr(10))[1] AS spelling FROM documents UNION ALL SELECT upper(p_name) FROM part UNION ALL SELECT replace(p_name, ' ', '-') FROM part)
SELECT key, count(*) AS n_rows, count(DISTINCT spelling) AS n_spellings, min(spelling) AS representative
FROM (SELECT spelling, {_COMPARE.format('spelling')} AS key FROM lines) WHERE key <> '' GROUP BY key""")
def p2(t):
    first = t("documents").select(F.split("text", "\n")[0].alias("s"))
    part = t("part")
    lines = first.union(part.select(F.upper("p_name"))).union(part.select(F.replace("p_name", F.lit(" "), F.lit("-"))))
    return op.key_variants_report(lines, "s")


@query("p3_term_variants", r"""
WITH terms AS (
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN p_name || ', The' WHEN 2 THEN replace(p_name, ' ', ', ') ELSE p_name END AS term FROM part),
bare AS (SELECT p_partkey, term, trim(regexp_replace(regexp_replace(term, '(?i)^the ', ''), '(?i),? the$', '')) AS bare FROM terms),
v AS (
  SELECT p_partkey, 0 AS at_, term AS variant FROM bare UNION ALL SELECT p_partkey, 1, bare FROM bare
  UNION ALL SELECT p_partkey, 2, trim(regexp_extract(bare, ',(.*)$', 1)) || ' ' || trim(regexp_extract(bare, '^([^,]*),', 1)) FROM bare WHERE contains(bare, ','))
SELECT p_partkey, arg_min(variant, at_) AS variant FROM v WHERE variant <> '' GROUP BY p_partkey, lower(variant)""")
def p3(t):
    name, n = F.col("p_name"), F.col("p_partkey") % 4
    term = F.when(n == 0, F.concat(F.lit("The "), name)).when(n == 1, F.concat(name, F.lit(", The"))).when(n == 2, F.replace(name, F.lit(" "), F.lit(", "))).otherwise(name)
    return op.term_variants(t("part").select("p_partkey", term.alias("term")), "p_partkey", "term")


@query("p4_path_components", r"""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '://([^?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN '/CD2' ELSE '' END, '/'), lambda x: x <> '') AS parts FROM pages),
r AS (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p),
c AS (SELECT page_id, CAST(len(parts) - i + 1 AS BIGINT) AS depth, regexp_replace(parts[i], '(\.[A-Za-z][A-Za-z0-9]{1,4})+$', '') AS part, '/' || array_to_string(parts[1:i], '/') AS folder FROM r)
SELECT * FROM c WHERE length(part) > 1 AND NOT regexp_matches(part, '^[0-9]+$') AND lower(part) NOT IN ('info', 'cd2')""")
def p4(t):
    return op.path_components(t("pages").select("page_id", F.concat(F.regexp_extract("url", "://([^?#]*)", 1), F.when(F.col("page_id") % 3 == 0, "/CD2").otherwise("")).alias("path")), "page_id", "path", eligible_only=True)


@query("p5_storage_identity", r"""
WITH p AS (
  SELECT CASE WHEN page_id % 9 = 0 THEN '' ELSE regexp_extract(url, '://([^/?#]*)', 1) END AS label, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT label, CASE WHEN path = '/' THEN '/' ELSE regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') END AS path FROM p)
SELECT label, path, count(*) AS n_rows, trim('[' || label || '] ' || path) AS located FROM s GROUP BY label, path""")
def p5(t):
    label = F.when(F.col("page_id") % 9 == 0, "Local Disk").otherwise(paths.url_host(F.col("url")))
    mount = F.when(F.col("page_id") % 2 == 0, "/mnt/e").otherwise("E:")
    located = F.concat(F.lit("["), label, F.lit("] "), mount, paths.url_path(F.col("url")))
    return op.storage_identity(t("pages").select(located.alias("located")), "located")


@query("p6_compose_names", """
SELECT o_orderkey, c_name || ' ' || CASE WHEN o_orderkey % 10 = 0 THEN 'xxxx-xx-xx' ELSE strftime(o_orderdate, '%Y-%m-%d') END || ' ' || n_name
  || CASE WHEN o_orderkey % 3 = 0 THEN ' (' || c_mktsegment || ')' ELSE '' END AS title
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def p6(t):
    return titles(t).select("o_orderkey", "title")


def titles(t):
    """Records of the catalog examples: orders with the names of customer and nation."""
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    date = F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    qualifier = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), F.col("c_mktsegment"), F.lit(")"))).otherwise("")
    return orders.withColumn("title", op.compose_names(F.col("c_name"), date, [F.col("n_name")], qualifier))


@query("p7_document_keys", r"""
WITH k AS (
  SELECT o_custkey, regexp_replace(c_name, '[^A-Za-z0-9()&]', '', 'g') || strftime(o_orderdate, '%Y-%m-%d') || regexp_replace(n_name, '[^A-Za-z0-9()&]', '', 'g')
    || CASE WHEN o_orderkey % 3 = 0 THEN '(' || c_mktsegment || ')' ELSE '' END AS key
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT key, count(*) AS n_records FROM k GROUP BY key""")
def p7(t):
    suffix = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), F.col("c_mktsegment"), F.lit(")"))).otherwise("")
    key = op.document_key(F.col("c_name"), F.date_format("o_orderdate", "yyyyMMdd"), F.col("n_name"), F.lit(""), suffix)
    return titles(t).select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n_records"))


@query("p8_trailing_qualifiers", """
SELECT p_partkey, p_name AS stripped, CASE i WHEN 1 THEN '(' || p_type || ')' ELSE '(' || p_size || ')' END AS qualifier, i AS ord
FROM part, (SELECT unnest([1, 2])::BIGINT AS i)""")
def p8(t):
    name = F.concat_ws("", "p_name", F.lit(" ("), "p_type", F.lit(") ("), "p_size", F.lit(")"))
    return op.trailing_qualifiers(t("part").select("p_partkey", name.alias("name")), "p_partkey", "name")


@query("p9_label_by_rules", """
SELECT label, metal, count(*) AS n FROM (
  SELECT CASE WHEN p_name ILIKE '%small%' THEN 'Small' WHEN p_name ILIKE '%red%' THEN 'Red' WHEN p_type ILIKE '%small%' THEN 'Small' WHEN p_type ILIKE '%promo%' THEN 'Promo' WHEN p_type ILIKE '%econ%' THEN 'Economy' ELSE '' END AS label,
    (p_name ILIKE '%bolt%' OR p_name ILIKE '%gear%') AS metal FROM part) GROUP BY ALL""")
def p9(t):
    rules = [("small", "Small"), ("red", "Red"), ("promo", "Promo"), ("econ", "Economy")]
    # column first, then rule: the name decides before the type
    return op.label_by_rules(t("part"), ["p_name", "p_type"], rules, {"metal": ["bolt", "gear"]}).groupBy("label", "metal").agg(F.count("*").alias("n"))


@query("p10_clean_titles", """
SELECT usable, clean, count(*) AS n FROM (
  SELECT CASE WHEN p_partkey % 7 = 0 THEN 'Unknown' ELSE p_name END AS clean, p_partkey % 7 <> 0 AS usable FROM part) GROUP BY ALL""")
def p10(t):
    n = F.col("p_partkey")
    raw = F.when(n % 7 == 0, F.concat(F.lit("Track "), n.cast("string"))).when(n % 5 == 0, F.concat(F.lit("4 of 28 "), F.col("p_name"))).when(n % 5 == 1, F.concat(F.lit("Encore: "), F.col("p_name"), F.lit(" 4:05"))).when(n % 5 == 2, F.concat(F.col("p_name"), F.lit("** [12:25] tape flip"))).otherwise(F.concat(F.col("p_name"), F.lit(" 11-26")))
    return op.clean_titles(t("part").select(raw.alias("title")), "title").groupBy("usable", "clean").agg(F.count("*").alias("n"))
