"""End-to-end plans (E1 to E4): records from folder names, the catalog from records, and searches over both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import search, text
from shelfmark.operators import dates as date_jobs
from shelfmark.operators import filters, groups, joins, ordering, windows
from shelfmark.operators.projections import compose_names, document_key, path_components
from shelfmark.operators.search_index import SearchIndex
from shelfmark.sources.files import stored


# Where a date of a record comes from, the best first.
_NAME, _PATH, _TAG, _FILE, _DOCUMENT = range(1, 6)


def _placed(tails: DataFrame, places: DataFrame) -> DataFrame:
    """(id, venue, location) of tails (id, venue): known places off the end, and what stands before them as it is written. Equal tails are read once."""
    texts = tails.where("venue is not null").select("venue").distinct()
    found = joins.geo_resolve(texts.select(F.col("venue").alias("tail"), F.col("venue").alias("end")), "tail", "end", places)
    location = F.nullif(F.concat_ws(", ", "city", "region", "country"), F.lit(""))
    found = found.select("tail", "rest", F.col("venue").alias("hall"), location.alias("location"))
    # words of the rest as they stand in the tail; an ampersand is a word there
    count = F.when(F.col("rest") == "", 0).otherwise(F.size(F.split("rest", " ")))
    written = F.regexp_substr("tail", F.concat(F.lit("^(?:[^A-Za-z0-9&]*(?:[A-Za-z0-9]+|&)){"), count.cast("string"), F.lit("}")))
    before = F.when(count > 0, F.coalesce(written, "rest"))
    venue = F.when(F.col("hall").isNull() & F.col("location").isNull(), F.col("tail")).otherwise(F.nullif(F.concat_ws(" ", before, "hall"), F.lit("")))
    read = stored(found.select("tail", venue.alias("place"), "location"), "places")
    return tails.join(read, F.col("venue") == F.col("tail"), "left").select("id", F.col("place").alias("venue"), "location")


def resolve_records(folders: DataFrame, terms: DataFrame, mentions: DataFrame, sources: list[tuple[str, DataFrame]], files: DataFrame | None = None, tags: DataFrame | None = None, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Flexible resolution: records (id, entity, date, venue, location, title, reason), and where sources disagree (entity, date, field, kept, offered, source).

    folders: id, name, override, tag, path. The entity comes from the override, the tag, the
    part before the date, the left side of a spaced dash, path components as "entity date",
    or path components, the deepest first, whichever resolves first (terms: entity, term). A
    name that several entities have ends the search: the record has no entity then, and its
    reason names them all.
    The date comes from the name, else the path, in both cases together with the dates in
    tags (tags: id, value), else tags alone, else names of files (files: id, name), else the
    document (mentions: id, date), and is checked against the document's dates. Partial
    dates give way to complete ones that agree; dates that differ are a conflict.
    With places (term, kind, canonical, region, country) the end of the tail is read as city,
    region and country, which become the location; what stands before them is the venue. A
    tail without a known place is the venue as a whole. sources (entity, date, venue,
    location) fill what is blank. Unresolved records keep a reason in words.
    """
    names = folders.select("id", "name")
    around = date_jobs.split_around_date(names, "id", "name").where("mention = 1").select("id", F.col("before").alias("d_before"), F.col("date").alias("d_date"), F.col("after").alias("d_after"))
    dashed = date_jobs.split_on_dash(names, "id", "name").select("id", "left", "right")
    rows = stored(folders.join(around, "id", "left").join(dashed, "id", "left"), "names")
    parts = path_components(folders, "id", "path", eligible_only=True).select("id", "depth", "part")
    # texts that many records share are read once
    dated_texts = date_jobs.split_around_date(parts.select("part", F.col("part").alias("text")).distinct(), "part", "text").where("mention = 1").select("part", "before", "date")
    dated_parts = stored(parts.join(stored(dated_texts, "dated"), "part").select("id", "depth", "before", "date"), "parts")

    candidates = F.array(*[F.struct(F.lit(i).cast("long").alias("at"), text.blank_to_null(F.col(c)).alias("name")) for i, c in enumerate(("override", "tag", "d_before", "left"))])
    tried = rows.select("id", F.explode(candidates).alias("c")).select("id", "c.at", "c.name")
    tried = tried.unionByName(dated_parts.select("id", (F.col("depth") + 100).alias("at"), F.col("before").alias("name"))).unionByName(parts.select("id", (F.col("depth") + 10_000).alias("at"), F.col("part").alias("name")))
    tried = tried.where("name is not null")
    texts = stored(tried.select("name").distinct(), "texts")
    entities = joins.resolve_aliases(texts.select("name", F.col("name").alias("text")), "name", "text", terms).where("status <> 'no_match'")
    known = tried.join(stored(entities.select("name", "candidates"), "entities"), "name").groupBy("id").agg(F.min_by("candidates", "at").alias("c"))
    one = F.size("c") == 1
    hits = known.select("id", F.when(one, F.col("c")[0]).alias("entity"), F.when(~one, F.array_join("c", " | ")).alias("collision"))

    def dated(df: DataFrame, column: str, rank: int) -> DataFrame:
        found = date_jobs.extract_dates(df.select(F.col(column).alias("told")).distinct(), "told", "told").where("kind <> 'range'")
        return df.join(found.select("told", "normal").distinct(), F.col(column) == F.col("told")).select("id", F.lit(rank).alias("rank"), F.col("normal").alias("date"))

    told = [rows.where("d_date is not null").select("id", F.lit(_NAME).alias("rank"), F.col("d_date").alias("date")), dated_parts.select("id", F.lit(_PATH).alias("rank"), "date"), mentions.select("id", F.lit(_DOCUMENT).alias("rank"), "date")]
    if tags is not None:
        told.append(dated(tags, "value", _TAG))
    if files is not None:
        told.append(dated(files, "name", _FILE))
    ranked = reduce(DataFrame.unionByName, told).groupBy("id", "rank").agg(F.collect_set("date").alias("dates"))
    least = F.min("rank").over(Window.partitionBy("id"))
    first = ranked.withColumn("least", least).where((F.col("rank") == F.col("least")) | ((F.col("rank") == _TAG) & (F.col("least") < _TAG)))
    first = stored(date_jobs.prefer_complete_dates(first.select("id", F.explode("dates").alias("date")).distinct(), "id"), "dates")
    agreed = date_jobs.match_compatible_dates(first, mentions, "id").select("id", "date", F.col("conflict").alias("date_conflict"))

    tails = rows.select("id", text.blank_to_null(F.coalesce("d_after", "right")).alias("venue"))
    tails = tails.withColumn("location", F.lit(None).cast("string")) if places is None else _placed(tails, places)
    out = tails.join(hits, "id", "left").join(agreed, "id", "left")
    filled, conflicts = joins.enrich_fill_blanks(stored(out, "records"), sources, ["entity", "date"], ["venue", "location"], ["venue", "location"])
    title = compose_names(F.col("entity"), F.col("date"), [F.col("venue"), F.col("location")], F.lit(""))
    titled = filled.withColumn("title", F.when(F.col("date_conflict").isNull(), title))
    reason = F.when(F.col("title").isNull(), F.concat_ws("; ", F.lit("blank name"), F.when(F.col("entity").isNull(), "blank entity"), F.concat(F.lit("several entities: "), "collision"), F.when(F.col("date_conflict").isNotNull(), "in conflict")))
    return titled.select("id", "entity", "date", "venue", "location", "title", reason.alias("reason")), conflicts


def resolve_records_strict(folders: DataFrame, terms: DataFrame) -> DataFrame:
    """Strict resolution: (id, pattern, entity, date, tail, title) by the first of "entity date tail", "entity - tail", "entity date", a year, the name itself.

    The tail stays as it is; entities become canonical where exactly one is known.
    """
    name = text.compact(F.col("name"))
    full = "^(.*\\S)\\s+([0-9]{4}-[0-9x]{2}-[0-9x]{2})\\s+(\\S.*)$"
    short = "^(.*\\S)\\s+([0-9]{4}-[0-9x]{2}-[0-9x]{2})$"
    dash = "^(.*?\\S)\\s+-\\s+(\\S.*)$"
    pattern = F.when(name.rlike(full), "entity date tail").when(name.rlike(dash), "entity - tail").when(name.rlike(short), "entity date").when(name.rlike("^(19|20)[0-9]{2}$"), "year").otherwise("name")
    rows = folders.select("id", name.alias("name"), pattern.alias("pattern"))
    by = lambda a, b, c: F.when(F.col("pattern") == "entity date tail", a).when(F.col("pattern") == "entity - tail", b).when(F.col("pattern") == "entity date", c)
    take = lambda p, g: F.regexp_extract("name", p, g)
    parts = rows.select("id", "name", "pattern", by(take(full, 1), take(dash, 1), take(short, 1)).alias("raw"), by(take(full, 2), F.lit(None), take(short, 2)).alias("date"), by(take(full, 3), take(dash, 2), F.lit(None)).alias("tail"))
    known = joins.resolve_aliases(parts.where("raw is not null").select("id", "raw"), "id", "raw", terms).where("status = 'matched'").select("id", F.col("candidates")[0].alias("canonical"))
    out = parts.join(known, "id", "left").withColumn("entity", F.coalesce("canonical", "raw"))
    title = F.when(F.col("pattern") == "entity - tail", compose_names(F.col("entity"), F.lit(""), [F.col("tail")], F.lit(""), "dash")).when(F.col("entity").isNotNull(), compose_names(F.col("entity"), F.col("date"), [F.col("tail")], F.lit(""))).otherwise(F.col("name"))
    return out.select("id", "pattern", "entity", "date", "tail", title.alias("title"))


def build_catalog(records: DataFrame, documents: DataFrame, titles: DataFrame, catalog: DataFrame, roots: DataFrame, conflicts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Catalog, document and report tables of a run.

    conflicts: ord, root, source, message; the summary holds them and the records without
    a title.

    records: id, ord, title, entity, date, venue, location, label, path. documents: id, ord,
    text. titles: id, number, title. catalog: title, label, path. roots: label, root that
    were scanned again. Records without documents get a generated one; documents of one
    key are numbered by their content; catalog rows outside the roots stay.
    """
    named = records.where(text.blank_to_null(F.col("title")).isNotNull())
    key = document_key(F.col("entity"), F.col("date"), F.col("venue"), F.col("location"))
    combined = groups.combine_documents(documents, "id", "ord", "text")
    made = groups.generate_documents(named.select("id", F.col("entity").alias("artist"), "date", "venue", "location"), titles, combined, "id")
    texts = combined.unionByName(made)
    keyed = named.select("id", "ord", key.alias("key")).join(texts, "id").withColumn("size", F.md5("text"))
    placed = windows.assign_alternates(keyed, "key", "size", "ord").select("id", F.col("name").alias("document"), "text")
    kept, replaced = joins.replace_scopes(catalog, "label", "path", roots)
    rows = ordering.refresh_catalog(kept.select("title", "label", "path"), named.select("title", "label", "path"))
    unresolved = filters.unresolved_records(records, F.col("title"), F.col("entity"), F.lit(False)).select("id", "reason")
    blank = records.join(unresolved, "id").select("ord", F.lit(None).cast("string").alias("root"), F.coalesce("path", F.lit("")).alias("source"), F.concat_ws(" ", "label", "path", "reason").alias("message"))
    summary = groups.conflict_summary(blank.limit(0) if conflicts is None else conflicts, blank)
    return {"catalog": rows, "documents": placed, "replaced": replaced, "unresolved": unresolved, "summary": summary}


def search_catalog(rows: DataFrame, columns: list[str], expression: str, documents: DataFrame, deep: bool = False, index: SearchIndex | None = None) -> DataFrame:
    """(id, document, tier, hit): rows that fit the expression, or, with deep, whose documents do, each with its documents.

    rows: id, key and display columns. documents: document, key, text. With an index of
    the documents a deep search reads the texts of candidates only.
    """
    attached = joins.attach_documents(rows.select("id", "key"), documents.select("document", "key"))
    if deep:
        bodies = documents.where(F.col("text").isNotNull() & search.matches(expression, F.col("text"))) if index is None else index.search(expression)
        return attached.join(bodies.select("document"), "document", "left_semi").select("id", "document", "tier", F.lit("document").alias("hit"))
    found = filters.boolean_search(rows, columns, expression).select("id")
    return found.join(attached, "id", "left").select("id", "document", "tier", F.lit("row").alias("hit"))
