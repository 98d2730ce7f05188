"""Joins (J1 to J19)."""

from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.operators import joins as op
from shelfmark.operators.trees import tree_diff
from shelfmark.queries import query
from shelfmark.queries.groups import PATHS, page_paths
from shelfmark.queries.keys import titles
from shelfmark.sources.files import stored

_TERM = "p_name || ' ' || p_size || ' ' || p_type"


def terms(t):
    part = t("part")
    return part.select(F.col("p_brand").alias("entity"), F.concat_ws(" ", "p_name", "p_size", "p_type").alias("term"), "p_partkey")


@query("j1_resolve_aliases", f"""
WITH terms AS (SELECT DISTINCT p_brand AS entity, lower({_TERM}) AS term FROM part),
w AS (SELECT p_partkey AS id, lower({_TERM}) AS term FROM part UNION ALL SELECT c_custkey + 1000000, lower(c_name) FROM customer),
f AS (SELECT id, list_sort(list(DISTINCT entity)) AS c FROM w LEFT JOIN terms USING (term) GROUP BY id)
SELECT id, CASE WHEN c[1] IS NULL THEN 'no_match' WHEN len(c) = 1 THEN 'matched' ELSE 'collision' END AS status, CASE WHEN c[1] IS NULL THEN '' ELSE array_to_string(c, ',') END AS candidates FROM f""")
def j1(t):
    names = terms(t).select(F.col("p_partkey").alias("id"), F.concat(F.lit("The "), F.upper("term")).alias("name"))
    names = names.union(t("customer").select(F.col("c_custkey") + 1_000_000, "c_name"))
    return op.resolve_aliases(names, "id", "name", terms(t)).withColumn("candidates", F.array_join("candidates", ","))


@query("j2_entity_terms", """
WITH terms AS (SELECT c_nationkey AS entity, c_custkey AS id, c_mktsegment AS term FROM customer),
hits AS (SELECT DISTINCT term AS search, entity FROM terms WHERE term IN ('BUILDING', 'MACHINERY'))
SELECT lower(search) AS search, entity, (SELECT string_agg(term, ',' ORDER BY -id) FROM terms t WHERE t.entity = hits.entity) AS terms FROM hits""")
def j2(t):
    rows = t("customer").select(F.col("c_nationkey").alias("entity"), F.col("c_custkey").alias("id"), (-F.col("c_custkey")).alias("order"), F.col("c_mktsegment").alias("term"))
    wanted = t("region").select(F.when(F.col("r_regionkey") == 0, "building").when(F.col("r_regionkey") == 1, "machinery").alias("search")).where("search is not null")
    return op.entity_terms(rows, wanted).withColumn("terms", F.array_join("terms", ","))


_LINE_WORDS = r"string_split(trim(regexp_replace(replace(lower(line), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query("j3_scan_phrases", f"""
WITH l AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_name AS line FROM part), w AS (SELECT id, {_LINE_WORDS} AS w FROM l),
d AS (SELECT DISTINCT p_name AS phrase FROM part WHERE p_partkey % 3 = 0 UNION SELECT DISTINCT lower(p_type) FROM part),
g AS (SELECT id, n AS width, array_to_string(w[i:i + n - 1], ' ') AS gram FROM w, range(1, 5) a(n), range(1, 20) b(i) WHERE i + n - 1 <= len(w)),
h AS (SELECT DISTINCT id, phrase, width FROM g JOIN d ON phrase = gram)
SELECT id, phrase, width FROM h WHERE width = (SELECT max(width) FROM h k WHERE k.id = h.id)""")
def j3(t):
    part = t("part")
    phrases = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("phrase")).union(part.select(F.lower("p_type"))).distinct()
    return op.scan_phrases(part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_name").alias("line")), "id", "line", phrases)


_FREQUENT = """c AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM documents) GROUP BY word),
d AS (SELECT word AS phrase FROM c WHERE length(word) >= 6 AND 100000 * n BETWEEN 5 * (SELECT sum(n) FROM c) AND 20 * (SELECT sum(n) FROM c))"""


@query("j4_best_dictionary_hit", f"""
WITH {_FREQUENT},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
g AS (SELECT DISTINCT doc_id, pos, unnest({_LINE_WORDS}) AS gram FROM l),
f AS (SELECT doc_id, phrase, min(pos) AS line FROM g JOIN d ON phrase = gram GROUP BY 1, 2),
s AS (SELECT *, 72 + least(20.0, length(phrase) / 4) - line / 2 + CASE WHEN line < 10 THEN 15 ELSE 0 END AS score FROM f)
SELECT doc_id, phrase, line, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, phrase) AS rn FROM s) WHERE rn = 1""")
def j4(t):
    docs = t("documents")
    words = stored(docs.select(F.explode(F.split(text.compare_key(F.col("text")), " ")).alias("phrase")).groupBy("phrase").count(), "words")
    total = words.agg(F.sum("count").alias("total")).scalar()
    frequent = words.where(F.length("phrase") >= 6).where((F.col("count") * 100_000).between(5 * total, 20 * total))
    return op.best_dictionary_hit(docs, "doc_id", "text", frequent.select("phrase"), widest=1)


@query("j5_geo_resolve", """
WITH c AS (SELECT c_custkey, c_custkey % 5 AS k, lower(c_mktsegment) AS seg, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey, CASE k WHEN 2 THEN 'hall ' WHEN 4 THEN 'old' ELSE 'club ' END || CASE WHEN k = 4 THEN '' ELSE c_custkey::VARCHAR END AS rest, CASE WHEN k = 4 THEN 'great ' || seg END AS venue,
  CASE WHEN k IN (0, 4) THEN seg || ' town' WHEN k = 3 THEN 'capital of ' || n_name END AS city, CASE WHEN k <> 2 THEN n_name END AS region, r_name AS country FROM c""")
def j5(t):
    nation, region = t("nation"), t("region")
    spots = t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    n = F.col("c_custkey") % 5
    name = F.when(n == 4, F.concat(F.lit("Old, Great "), "c_mktsegment")).otherwise(F.concat(F.when(n == 2, "Hall ").otherwise("Club "), F.col("c_custkey").cast("string")))
    # 0 and 4 with town, 1 region and country, 2 country, 3 a short form that anchors city, region and country
    place = F.when(n.isin(0, 4), F.concat_ws(", ", F.concat("c_mktsegment", F.lit(" Town")), "n_name", "r_name")).when(n == 1, F.concat_ws(", ", "n_name", "r_name")).when(n == 2, F.col("r_name")).otherwise(F.concat(F.lit("CX"), "c_nationkey"))
    none = F.lit(None).cast("string")
    lands = region.select(F.col("r_name").alias("term"), F.lit("country").alias("kind"), F.col("r_name").alias("canonical"), none.alias("region"), none.alias("country"))
    whole = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    parts = whole.select("n_name", F.lit("region"), "n_name", none, "r_name")
    towns = t("customer").select(F.concat(F.col("c_mktsegment"), F.lit(" Town")).alias("a"), F.lit("city"), F.concat(F.lower("c_mktsegment"), F.lit(" town")).alias("b"), none, none).distinct()
    short = whole.select(F.concat(F.lit("CX"), "n_nationkey"), F.lit("city"), F.concat(F.lit("capital of "), "n_name"), "n_name", "r_name")
    halls = t("customer").select(F.concat(F.lit("Great "), "c_mktsegment").alias("a"), F.lit("venue"), F.concat(F.lit("great "), F.lower("c_mktsegment")).alias("b"), none, none).distinct()
    return op.geo_resolve(spots.select("c_custkey", F.concat_ws(", ", name, place).alias("tail")), "c_custkey", "tail", lands.union(parts).union(towns).union(short).union(halls))


@query("j6_enrich_fill_blanks", """
WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS venue, CASE WHEN c_custkey % 5 = 0 THEN 'X' END AS city FROM customer),
s1 AS (SELECT c_custkey, 'first ' || c_mktsegment AS venue, 'C' || c_nationkey AS city FROM customer WHERE c_custkey % 3 = 0),
s2 AS (SELECT c_custkey, 'second' AS venue, 'D' AS city FROM customer)
SELECT c_custkey, coalesce(a.venue, s1.venue, s2.venue) AS venue, coalesce(a.city, s1.city, s2.city) AS city,
  CASE WHEN a.city IS NOT NULL AND s1.city IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN a.city IS NOT NULL OR s1.city IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN a.venue IS NOT NULL OR s1.venue IS NOT NULL THEN 1 ELSE 0 END AS n_differs
FROM a LEFT JOIN s1 USING (c_custkey) LEFT JOIN s2 USING (c_custkey)""")
def j6(t):
    c = t("customer")
    base = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("venue"), F.when(F.col("c_custkey") % 5 == 0, "X").otherwise("").alias("city"))
    one = c.select("c_custkey", F.concat(F.lit("first "), "c_mktsegment").alias("venue"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("C"), F.col("c_nationkey").cast("string"))).alias("city"))
    two = c.select("c_custkey", F.lit("second").alias("venue"), F.lit("D").alias("city"))
    filled, differs = op.enrich_fill_blanks(base, [("one", one), ("two", two)], ["c_custkey"], ["venue", "city"], ["venue", "city"])
    counts = differs.groupBy("c_custkey").agg(F.count("*").alias("n"))
    return filled.join(counts, "c_custkey", "left").select("c_custkey", "venue", "city", F.coalesce("n", F.lit(0)).cast("int").alias("n_differs"))


@query("j7_best_fit_candidate", r"""
WITH c AS (SELECT o_custkey AS id, o_orderkey AS ord, CASE WHEN o_orderpriority LIKE '1%' THEN 60 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 50 ELSE 0 END AS score FROM orders),
b AS (SELECT id, max(score) AS top, min(ord) AS first_ FROM c GROUP BY id),
k AS (SELECT id, CASE WHEN top > 0 AND (SELECT count(*) FROM c WHERE c.id = b.id AND score = top) = 1 THEN (SELECT min(ord) FROM c WHERE c.id = b.id AND score = top) ELSE first_ END AS ord FROM b)
SELECT k.id, k.ord, CAST(score AS BIGINT) AS score FROM k JOIN c ON c.id = k.id AND c.ord = k.ord""")
def j7(t):
    docs = t("customer").select(F.col("c_custkey").alias("id"), F.lit("A note: 1-URGENT, with status F.").alias("text"))
    candidates = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("venue"), F.col("o_orderstatus").alias("city"))
    return op.best_fit_candidate(docs, "id", "text", candidates, {"venue": 60, "city": 50})


@query("j8_lookup_by_entity_date", """
WITH r AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 2 = 0 THEN 'The ' || c_name ELSE c_name END AS wanted, c_name, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey),
f AS (SELECT a.request, b.o_orderkey AS id, lower(a.wanted) = lower(a.c_name) AS exact FROM r a JOIN (SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey) b ON a.c_name = b.c_name AND a.o_orderdate = b.o_orderdate)
SELECT request, id, exact FROM f""")
def j8(t):
    rows = titles(t)
    requests = rows.select(F.col("o_orderkey").alias("request"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("The "), "c_name")).otherwise(F.col("c_name")).alias("entity"), F.col("o_orderdate").alias("date"))
    return op.lookup_by_entity_date(requests, rows.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("entity"), F.col("o_orderdate").alias("date")))


@query("j9_match_potential_duplicates", """
WITH t AS (SELECT o_orderkey, c_name, strftime(o_orderdate, '%Y-%m-%d') AS d, c_name || ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' || n_name AS title FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT DISTINCT a.o_orderkey AS id, b.title FROM t a JOIN t b ON a.d = b.d AND a.c_name = b.c_name WHERE a.o_orderkey % 10 = 0 AND b.o_orderkey % 10 <> 0""")
def j9(t):
    rows = titles(t).withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("title", F.concat_ws(" ", "c_name", "d", "n_name"))
    new = rows.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"), F.col("d").alias("date"), F.col("c_name").alias("name"))
    return op.match_potential_duplicates(new, rows.where("o_orderkey % 10 <> 0").select("title"))


@query("j10_exact_key_duplicates", """
SELECT a.p_partkey AS new_id, b.p_partkey AS old_id FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size WHERE a.p_partkey % 5 = 0 AND b.p_partkey % 5 <> 0""")
def j10(t):
    part = t("part")
    new = part.where("p_partkey % 5 = 0").select("p_partkey", F.upper(F.concat_ws("--", "p_name", "p_size")).alias("title"))
    return op.exact_key_duplicates(new, part.where("p_partkey % 5 <> 0").select("p_partkey", F.concat_ws(" ", "p_name", "p_size").alias("title")), "p_partkey", "title")


_HOSTS = r"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS label, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages"


def hosts(t):
    at = page_paths(t)
    return at.select("page_id", F.regexp_extract("path", "^/([^/]*)", 1).alias("label"), F.regexp_replace("path", "^/[^/]*", "").alias("path"))


@query("j11_replace_scopes", f"""
WITH p AS ({_HOSTS})
SELECT page_id, CASE WHEN label LIKE 'www.%' OR (label LIKE '%.net' AND starts_with(path, '/en/')) THEN 'replaced' ELSE 'kept' END AS part FROM p""")
def j11(t):
    rows = hosts(t)
    roots = rows.where("label like 'www.%'").select(F.upper("label").alias("label"), F.lit("").alias("root")).distinct()
    roots = roots.union(rows.where("label like '%.net'").select("label", F.lit("/en")).distinct())
    kept, replaced = op.replace_scopes(rows, "label", "path", roots)
    return kept.select("page_id", F.lit("kept").alias("part")).union(replaced.select("page_id", F.lit("replaced")))


@query("j12_remove_rows", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 2 = 0)")
def j12(t):
    rows = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return op.remove_rows(rows, rows.where("o_orderstatus = 'F' and o_custkey % 2 = 0"), ["o_orderkey", "o_custkey"])


_ROOTS = rf"SELECT label, CASE WHEN page_id % 3 = 0 THEN regexp_extract(path, '^(/[^/]*)', 1) ELSE path END AS root FROM ({_HOSTS}) WHERE path <> ''"


def roots_of(t):
    return hosts(t).where("path <> ''").select("label", F.when(F.col("page_id") % 3 == 0, F.regexp_extract("path", "^(/[^/]*)", 1)).otherwise(F.col("path")).alias("root"))


@query("j13_overlapping_roots", f"""
WITH r AS ({_ROOTS}), d AS (SELECT DISTINCT label, root FROM r)
SELECT label, root, 'duplicate' AS issue, root AS other FROM r GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT a.label, a.root, 'inside', b.root FROM d a JOIN d b ON a.label = b.label AND starts_with(a.root, b.root || '/')
UNION ALL SELECT a.label, b.root, 'contains', a.root FROM d a JOIN d b ON a.label = b.label AND starts_with(a.root, b.root || '/')""")
def j13(t):
    return op.overlapping_roots(roots_of(t), "label", "root")


@query("j14_classify_root_relation", f"""
WITH n AS (SELECT DISTINCT CASE WHEN label LIKE 'm.%' THEN '' ELSE label END AS label, path AS root FROM ({_HOSTS}) WHERE path <> ''), s AS (SELECT DISTINCT label, root FROM ({_ROOTS})),
r AS (SELECT n.label, n.root, CASE WHEN s.root = n.root THEN 'exact' WHEN starts_with(n.root, s.root || '/') THEN 'child' ELSE 'parent' END AS rel
  FROM n JOIN s ON n.label = s.label AND (s.root = n.root OR starts_with(n.root, s.root || '/') OR starts_with(s.root, n.root || '/'))),
g AS (SELECT label, root, array_to_string(list_sort(list(DISTINCT rel)), ',') AS relation FROM r GROUP BY 1, 2)
SELECT label, root, coalesce(relation, 'unrelated') AS relation, CASE WHEN label = '' THEN 'append_blank' WHEN relation IS NULL THEN 'new' ELSE 'reinventory' END AS action FROM n LEFT JOIN g USING (label, root)""")
def j14(t):
    new = hosts(t).where("path <> ''").select(F.when(F.col("label").startswith("m."), "").otherwise(F.col("label")).alias("label"), F.col("path").alias("root")).distinct()
    return op.classify_root_relation(new, roots_of(t).distinct())


@query("j15_attach_documents", """
SELECT o_orderkey AS id, o_orderkey AS document, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS tier FROM orders WHERE o_orderkey % 2 = 0""")
def j15(t):
    key = F.concat_ws("-", F.lit("Key"), F.col("o_orderkey").cast("string"))
    rows = t("orders").select(F.col("o_orderkey").alias("id"), key.alias("key"))
    documents = t("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("document"), F.when(F.col("o_orderkey") % 4 == 0, F.concat(key, F.lit("(alt2)"))).otherwise(key).alias("key"))
    return op.attach_documents(rows, documents).withColumn("tier", F.col("tier").cast("int"))


@query("j16_orphan_documents", """
SELECT p_name, p_brand FROM (SELECT DISTINCT p_name, p_brand FROM part) WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 30) AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 2)""")
def j16(t):
    part = t("part")
    return op.orphan_documents(part.where("p_size > 30"), part.where("p_size < 2"), part.select("p_name", "p_brand").distinct(), "p_brand")


@query("j17_manifest_diff", """
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'size' WHEN p_partkey % 5 = 0 THEN 'hash' ELSE 'same' END AS status FROM part UNION ALL SELECT 'extra' FROM supplier) GROUP BY status""")
def j17(t):
    part = t("part")
    mine = part.select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").alias("size"), F.sha2("p_name", 256).alias("sha256"))
    changed = part.where("p_partkey % 11 <> 0").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"), F.sha2(F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")), 256).alias("sha256"))
    extra = t("supplier").select(F.col("s_name"), F.lit(1), F.lit("x"))
    return op.manifest_diff(mine, changed.union(extra)).groupBy("status").agg(F.count("*").alias("n"))


_SIDES = f"""
m AS (SELECT page_id, path || '/p' || page_id AS file, path FROM ({PATHS})),
s AS (SELECT file AS path, length(file) AS size, CASE WHEN page_id % 40 = 0 THEN 'old' ELSE 'a' END AS h FROM m),
d AS (SELECT file AS path, length(file) + CASE WHEN page_id % 50 = 0 THEN 1 ELSE 0 END AS size, 'a' AS h FROM m WHERE page_id % 60 <> 0 UNION ALL SELECT path || '/new/p' || page_id, 1, 'a' FROM m WHERE page_id % 70 = 0)"""


def _manifests(t):
    """Pages as files of two stores; the second has some of them changed, some removed and some more."""
    n, file = F.col("page_id"), F.concat(F.col("path"), F.lit("/p"), "page_id")
    rows = page_paths(t).withColumns({"file": file, "size": F.length(file)})
    source = rows.select(F.col("file").alias("path"), "size", F.when(n % 40 == 0, "old").otherwise("a").alias("sha256"))
    target = rows.where("page_id % 60 <> 0").select(F.col("file").alias("path"), (F.col("size") + F.when(n % 50 == 0, 1).otherwise(0)).alias("size"), F.lit("a").alias("sha256"))
    return source, target.union(rows.where("page_id % 70 = 0").select(F.concat(F.col("path"), F.lit("/new/p"), "page_id"), F.lit(1), F.lit("a")))


@query("j17_files", f"""
WITH {_SIDES}
SELECT coalesce(s.path, d.path) AS path, CASE WHEN d.path IS NULL THEN 'missing' WHEN s.path IS NULL THEN 'extra' WHEN s.size <> d.size THEN 'size' WHEN s.h <> d.h THEN 'hash' ELSE 'same' END AS status FROM s FULL JOIN d ON s.path = d.path""")
def j17_files(t):
    return op.manifest_diff(*_manifests(t))


@query("j17_folders", f"""
WITH {_SIDES},
j AS (SELECT coalesce(s.path, d.path) AS path, s.path IS NOT NULL AS l, d.path IS NOT NULL AS r, s.path IS NOT NULL AND d.path IS NOT NULL AND s.size = d.size AND s.h = d.h AS same FROM s FULL JOIN d ON s.path = d.path),
p AS (SELECT string_split(path, '/') AS p, l, r, same FROM j),
f AS (SELECT array_to_string(p[1:n], '/') AS folder, l, r, same FROM p, range(1, 30) a(n) WHERE n < len(p)),
g AS (SELECT folder, count(*) FILTER (l) AS source_files, count(*) FILTER (r) AS target_files, bool_and(same) AS same FROM f GROUP BY 1),
c AS (SELECT folder, CASE WHEN target_files = 0 THEN 'missing' WHEN source_files = 0 THEN 'extra' WHEN same THEN 'same' ELSE 'changed' END AS status, source_files, target_files FROM g)
SELECT * FROM c WHERE folder = '' OR regexp_replace(folder, '/[^/]*$', '') IN (SELECT folder FROM c WHERE status = 'changed')""")
def j17_folders(t):
    return tree_diff(*_manifests(t))


@query("j18_confirm_titles", """
WITH n AS (SELECT l_orderkey AS id, count(DISTINCT p_name) AS n_titles, bool_and(p_name NOT LIKE 'red%') AS clean FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT id, n_titles, clean OR id % 2 = 0 AS confirmed FROM n""")
def j18(t):
    rows = t("lineitem").join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), F.col("p_name").alias("title"))
    told = F.when((F.col("id") % 2 == 1), F.regexp_replace("title", "^red", "rod")).otherwise(F.col("title"))
    docs = rows.groupBy("id").agg(F.concat_ws(". ", F.collect_list(told)).alias("text"))
    red = docs.withColumn("text", F.when(F.col("id") % 2 == 1, F.regexp_replace("text", "\\bred\\b", "")).otherwise(F.col("text")))
    return op.confirm_titles(rows.distinct(), red, "id", "text")


@query("j19_candidate_documents", rf"""
WITH d AS (SELECT DISTINCT path || CASE WHEN length(path) % 3 = 0 THEN '.doc' ELSE '' END AS document, regexp_replace(path, '/[^/]*$', '') AS place FROM ({PATHS})),
f AS (SELECT DISTINCT place AS folder FROM d UNION SELECT DISTINCT regexp_replace(place, '/[^/]*$', '') FROM d WHERE place LIKE '/%/%'),
r AS (SELECT folder, document, CASE WHEN place = folder THEN 1 WHEN place = regexp_replace(folder, '/[^/]*$', '') THEN 2 ELSE 4 END AS tier FROM f JOIN d
  ON place = folder OR place = regexp_replace(folder, '/[^/]*$', '') OR starts_with(place, folder || '/') WHERE folder <> '')
SELECT folder, document, tier, row_number() OVER (PARTITION BY folder ORDER BY CASE tier WHEN 1 THEN 1 WHEN 4 THEN 3 ELSE 2 END, NOT regexp_matches(lower(document), '[.](doc|docx|rtf|pdf)$'), tier, lower(document), document) AS rank FROM r""")
def j19(t):
    docs = page_paths(t).select(F.concat("path", F.when(F.length("path") % 3 == 0, ".doc").otherwise("")).alias("document")).distinct()
    place = F.regexp_replace("document", "/[^/]*$", "")
    folders = docs.select(place.alias("folder")).union(docs.where(place.rlike("^/.*/")).select(F.regexp_replace(place, "/[^/]*$", ""))).distinct().where("folder <> ''")
    return op.candidate_documents(folders, docs).withColumn("tier", F.col("tier").cast("int"))
