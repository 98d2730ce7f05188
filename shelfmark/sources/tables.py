"""Dictionaries and performance payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text

# Tables and columns of an entity dictionary.
REQUIRED = {"artists": ("artist_id", "source_row_number", "master_name"), "aliases": ("alias_id", "artist_id", "alias_text", "alias_order"), "terms": ("term_id", "artist_id", "term_text", "term_type", "term_order")}


def read_dictionary(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "^") -> DataFrame:
    """Rows of a dictionary file as text columns; blank lines, comments (#) and missing trailing columns are allowed."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return lines.select(F.from_csv("value", ", ".join(f"`{c}` string" for c in columns), {"sep": sep}).alias("r")).select("r.*")


def entity_terms(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, entity, term, order): comparison keys under which entities are found, the name first; of one entity's equal terms the first stays.

    entities: id, name. aliases: id, alias.
    """
    names = entities.select("id", "name", F.col("name").alias("raw"), F.lit(0).cast("long").alias("order"))
    more = aliases.join(entities, "id").select("id", "name", F.col("alias").alias("raw"), F.lit(1).cast("long").alias("order"))
    keyed = names.unionByName(more).withColumn("term", text.compare_key(F.col("raw"))).where("term <> ''")
    return keyed.groupBy(F.col("id").alias("entity_id"), F.col("name").alias("entity"), "term").agg(F.min("order").alias("order"))


def place_dimension(countries: DataFrame, regions: DataFrame, cities: DataFrame, venues: DataFrame) -> DataFrame:
    """(key, kind, canonical, region, country, n_tokens): one row a key and kind, the first by canonical name.

    countries: country, canonical. regions: abbrev, name, country. cities: city, region,
    country, aliases ("a|b"). venues: venue. Blank names and comments (#) are dropped.
    """
    none = F.lit(None).cast("string")
    parts = [
        countries.select(F.col("country").alias("term"), F.lit("country").alias("kind"), F.coalesce(text.blank_to_null(F.col("canonical")), F.col("country")).alias("canonical"), none.alias("region"), none.alias("country"), F.lit(0).alias("p")),
        regions.select("name", F.lit("region"), "name", none, "country", F.lit(0)),
        regions.select("abbrev", F.lit("region"), "name", none, "country", F.lit(1)),
        cities.select("city", F.lit("city"), "city", "region", "country", F.lit(0)),
        cities.select(F.explode(F.split("aliases", "\\|")), F.lit("city"), "city", "region", "country", F.lit(1)),
        venues.select("venue", F.lit("venue"), "venue", none, none, F.lit(0)),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    keyed = every.where(text.blank_to_null(F.col("term")).isNotNull() & ~F.col("term").startswith("#")).withColumn("key", text.compare_key(F.col("term"), "place")).where("key <> ''")
    first = keyed.groupBy("key", "kind").agg(F.min(F.struct("p", "canonical", "region", "country")).alias("r"))
    return first.select("key", "kind", "r.canonical", "r.region", "r.country", F.size(F.split("key", " ")).cast("long").alias("n_tokens"))


def validate_reference(tables: dict[str, DataFrame], required: dict[str, Sequence[str]] = REQUIRED) -> DataFrame:
    """(table, finding): missing tables, missing columns and empty tables; no rows if all is well."""
    spark = next(iter(tables.values())).sparkSession
    wanted = spark.createDataFrame([(t, c) for t, columns in required.items() for c in columns], "table string, column string")
    there = spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns] or [("", "")], "table string, column string")
    missing = wanted.join(there, ["table", "column"], "left_anti").select("table", F.concat(F.lit("missing column "), "column").alias("finding"))
    for name, df in tables.items():
        if name in required:
            missing = missing.unionByName(df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(name).alias("table"), F.lit("empty").alias("finding")))
    return missing


PAGE = "struct<edges:array<struct<node:struct<id:string,date:string,venue:string,city:string,state:string,set1:string,set2:string,set3:string>>>>"


def flatten_performances(pages: DataFrame, payload: str) -> DataFrame:
    """(id, date, venue, city, state, year, sets) of paged payloads; nodes without a whole-number id are dropped, blank set texts left out."""
    node = pages.select(F.explode(F.from_json(payload, PAGE)["edges"]).alias("e")).select("e.node.*").withColumn("id", F.col("id").try_cast("bigint")).where("id is not null")
    sets = F.filter(F.array("set1", "set2", "set3"), lambda s: text.blank_to_null(s).isNotNull())
    return node.select("id", "date", "venue", "city", "state", F.regexp_extract("date", "([0-9]{4})", 1).try_cast("bigint").alias("year"), sets.alias("sets"))


def flatten_song_sets(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, artist, place, number, title) of nested payloads whose sets and songs may be one object or a list; blank and encore-only names are dropped."""
    v = F.try_parse_json(payload)

    def listed(value: Column, path: str) -> Column:
        many = F.try_variant_get(value, path, "array<variant>")
        one = F.try_variant_get(value, path, "variant")
        return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))

    city, state, country = (F.try_variant_get(v, f"$.venue.city.{p}", "string") for p in ("name", "state", "country.name"))
    place = F.when(country.isin("United States", "USA"), F.concat_ws(", ", city, state)).otherwise(F.concat_ws(", ", city, country))
    sets = rows.select(key, F.try_variant_get(v, "$.artist.name", "string").alias("artist"), place.alias("place"), F.posexplode(listed(v, "$.sets.set")).alias("s", "set"))
    songs = sets.select(key, "artist", "place", "s", F.posexplode(listed(F.col("set"), "$.song")).alias("i", "song"))
    named = songs.withColumn("title", F.trim(F.try_variant_get("song", "$.name", "string"))).where("title is not null and title <> '' and not lower(title) rlike '^encore:?$'")
    order = F.array_sort(F.collect_list(F.struct("s", "i", "title")))
    return named.groupBy(key, "artist", "place").agg(order.alias("t")).select(key, "artist", "place", F.posexplode("t").alias("n", "x")).select(key, "artist", "place", (F.col("n") + 1).cast("long").alias("number"), "x.title")
