"""WARC not-modified revisits: an as-of join to the latest earlier full response (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 answer may bring up to date (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
_SITE = "(?s)^[^:/?#]*://([^/?#]*)([^?#]*)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path without final slashes, sorted query without tracking fields; no scheme, no fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _SITE, 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, _SITE, 2), "/+$", "")
    query = F.regexp_extract(url, "(?s)^[^?#]*[?]([^#]*)", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref)=")))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))


def _lower(headers: Column) -> Column:
    """Field names in lower case; of names that only differ in case the last counts."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    pairs = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def as_of_responses(records: DataFrame, slice_length: int = 4_096) -> DataFrame:
    """Every revisit with `original`, the latest earlier response of its url key as (ts, record_id, full), or null.

    records: record_id, ts (long), key, kind ("response" or "revisit"), full (a struct
    that a response brings with it). Earlier means a lesser (ts, record_id); of responses
    equal in both the one of the greatest `full` counts, so repeated ids stay apart. A
    key's records are dealt into slices of time, so a hot url is no single group; the last
    response of each slice is carried to later slices.
    """
    at = F.struct("ts", "record_id", "full")
    sliced = records.withColumn("slice", F.expr(f"ts div {slice_length}")).withColumn("given", F.when(F.col("kind") == "response", at))
    last = sliced.groupBy("key", "slice").agg(F.max("given").alias("last"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    carried = last.select("key", "slice", F.max("last").over(earlier).alias("carried"))
    # of one (ts, record_id) revisits come before responses, as neither is earlier than the other
    inside = Window.partitionBy("key", "slice").orderBy("ts", "record_id", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    near = sliced.withColumn("near", F.max("given").over(inside)).where("kind = 'revisit'").drop("given", "full")
    found = near.join(carried, ["key", "slice"], "left")
    return found.withColumn("original", F.coalesce("near", "carried")).drop("near", "carried", "slice")


def resolve_revisits(records: DataFrame, slice_length: int = 4_096) -> DataFrame:
    """One row for each revisit: record_id, ts, key, original_id, state, headers, digest.

    records: record_id, ts, url, kind, headers map<string,string>, digest, and whatever
    else a response carries. state is resolved, changed (entity tag, or without one the
    date of last change or the payload digest, differs), unchecked (nothing to compare)
    or missing (no earlier response). headers of resolved revisits are those of the
    response, brought up to date with the fields that a not-modified answer may carry;
    others have their own. A null url has the empty key; null headers count as none;
    records with a null time, id or kind are no revisits and no originals. Repeated ids
    and repeated rows stay separate records: headers and digest travel with their record,
    they are never looked up by id.
    """
    entries = F.array_sort(F.map_entries(_lower(F.col("headers"))))
    keyed = records.select("record_id", F.col("ts").cast("long").alias("ts"), canonical_url(F.col("url")).alias("key"), "kind", F.struct(entries.alias("entries"), "digest").alias("own"))
    keyed = keyed.where("ts is not null and record_id is not null and kind in ('response', 'revisit')").withColumn("full", F.when(F.col("kind") == "response", F.col("own")))
    joined = as_of_responses(keyed, slice_length).select(
        "record_id", "ts", "key", F.col("original.record_id").alias("original_id"), F.map_from_entries("own.entries").alias("headers"), "own.digest",
        F.map_from_entries("original.full.entries").alias("full"), F.col("original.full.digest").alias("full_digest"),
    )
    tag = lambda c: F.regexp_replace(F.col(c)["etag"], "^W/", "")
    same = F.coalesce(tag("headers") == tag("full"), F.col("headers")["last-modified"] == F.col("full")["last-modified"], F.col("digest") == F.col("full_digest"))
    state = F.when(F.col("original_id").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("full", lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    headers = F.when(F.col("state") == "resolved", F.map_concat(kept, fresh)).otherwise(F.col("headers"))
    return joined.withColumn("state", state).select("record_id", "ts", "key", "original_id", "state", headers.alias("headers"), F.when(F.col("state") == "resolved", F.col("full_digest")).otherwise(F.col("digest")).alias("digest"))


def capture_log(pages: DataFrame) -> DataFrame:
    """Captures that stand for the pages: a full response at time 10 * page_id, and a later not-modified answer for the same url.

    Every fifth answer names another entity tag, every eleventh has no validators.
    """
    tag = F.md5(F.coalesce("html", F.lit("")))
    base = pages.select("page_id", "url", tag.alias("tag"))
    full = base.select(
        (F.col("page_id") * 2).alias("record_id"), (F.col("page_id") * 10).alias("ts"), "url", F.lit("response").alias("kind"),
        F.create_map(F.lit("ETag"), F.concat(F.lit('"'), F.col("tag"), F.lit('"')), F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Date"), (F.col("page_id") * 10).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.col("tag").alias("digest"),
    )
    named = F.when(F.col("page_id") % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit('W/"'), F.col("tag"), F.lit('"')))
    later = F.col("page_id") * 10 + 5 + F.col("page_id") % 7 * 1000
    answer = F.create_map(F.lit("etag"), named, F.lit("date"), later.cast("string"), F.lit("expires"), (later + 60).cast("string"), F.lit("Content-Length"), F.lit("0"))
    bare = F.create_map(F.lit("date"), later.cast("string"))
    again = base.select((F.col("page_id") * 2 + 1).alias("record_id"), later.alias("ts"), "url", F.lit("revisit").alias("kind"), F.when(F.col("page_id") % 11 == 0, bare).otherwise(answer).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return full.unionByName(again)


def op5_revisit_resolution(spark, sf_dir: str) -> DataFrame:
    found = resolve_revisits(capture_log(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.withColumn("headers", shown)


OP5_SQL = r"""
WITH parts AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '(?s)^[^:/?#]*://([^/?#]*)([^?#]*)', 1)), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(coalesce(url, ''), '(?s)^[^:/?#]*://([^/?#]*)([^?#]*)', 2), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))) AS q
  FROM pages),
base AS (SELECT page_id, tag, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS key FROM parts),
resp AS (SELECT page_id * 2 AS record_id, page_id * 10 AS ts, key, tag FROM base),
rev AS (SELECT page_id, page_id * 2 + 1 AS record_id, page_id * 10 + 5 + page_id % 7 * 1000 AS ts, key, tag FROM base),
found AS (
  SELECT v.*, (SELECT max({'ts': r.ts, 'record_id': r.record_id}) FROM resp r WHERE r.key = v.key AND (r.ts, r.record_id) < (v.ts, v.record_id)).record_id AS original_id
  FROM rev v),
judged AS (
  SELECT f.*, r.tag AS full_tag, r.ts AS full_ts, CASE WHEN original_id IS NULL THEN 'missing' WHEN page_id % 11 = 0 THEN 'unchecked'
    WHEN page_id % 5 = 0 THEN 'changed' WHEN f.tag = r.tag THEN 'resolved' ELSE 'changed' END AS state
  FROM found f LEFT JOIN resp r ON r.record_id = f.original_id)
SELECT record_id, ts, key, original_id, state,
  CASE WHEN state = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || ts || chr(10) || 'etag: W/"' || tag || '"' || chr(10) || 'expires: ' || (ts + 60)
       WHEN page_id % 11 = 0 THEN 'date: ' || ts
       ELSE 'content-length: 0' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/"' || tag || '"' END || chr(10) || 'expires: ' || (ts + 60) END AS headers,
  CASE WHEN state = 'resolved' THEN full_tag END AS digest
FROM judged
"""
