"""Aggregating operators (A1 to A13); all of them plan as partial and final aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import rules
from shelfmark.functions import paths, text
from shelfmark.operators.filters import lines
from shelfmark.operators.trees import enclosing, proper


def folder_profile(files: DataFrame, path: str) -> DataFrame:
    """Per folder with files: count, first file, extensions; folders below another such folder are not counted apart."""
    rows = files.select(F.regexp_replace(F.col(path), "/[^/]*$", "").alias("folder"), F.col(path).alias("file"), paths.extension(F.col(path)).alias("ext"))
    profile = rows.groupBy("folder").agg(F.count("*").alias("n_files"), F.min("file").alias("first_file"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("extensions"))
    swept = enclosing(profile, F.lit(""), F.col("folder"))
    return swept.where(F.size(proper()) == 0).select(*profile.columns)


_PART = "(?i)[ _-]*\\(?(cd|disc|disk|vol(ume)?|part)[ ._-]*([0-9]{1,2})\\)?$"


def group_release_parts(folders: DataFrame, parent: str, name: str, count: str) -> DataFrame:
    """(parent, release, n_folders, n_files): folders of one release taken together.

    A part suffix (CD 1, Disc 2) joins folders of one base; bare part names and volume
    suffixes join all of a parent's, volumes only where two or more bases differ.
    """
    word = F.lower(F.regexp_extract(name, _PART, 1))
    base = text.compare_key(F.regexp_replace(name, _PART, ""))
    rows = folders.withColumns({"word": word, "base": base})
    volumes = rows.where("word like 'vol%'").groupBy(parent).agg((F.countDistinct("base") > 1).alias("apart"))
    rows = rows.join(volumes, parent, "left")
    release = F.when((F.col("word") != "") & (F.col("base") == ""), "").when(F.col("word").startswith("vol") & F.coalesce("apart", F.lit(False)), "").when(F.col("word") != "", F.col("base")).otherwise(F.lower(name))
    return rows.withColumn("release", release).groupBy(parent, "release").agg(F.count("*").alias("n_folders"), F.sum(count).alias("n_files"))


def document_line_profile(docs: DataFrame, key: str, body: str, letter: str = "\\p{L}") -> DataFrame:
    """Per document over all its lines: line counts, content score, and whether it is unreadable or checksums only.

    Lines of information have a list mark, a date or enough words and letters. A text is
    unreadable without three characters that fit `letter`, with a tenth of NULs, or with less
    than 60 % printable characters. All counts are made inside the row.
    """
    whole = F.coalesce(F.col(body), F.lit(""))
    size, count = F.length(whole), lambda p: F.regexp_count(whole, F.lit(p))
    letters, nuls, odd = count(letter), count("\\x00"), count("[\\p{Cntrl}\\uFFFD&&[^\\r\\n\\t]]")
    unreadable = (letters < 3) | (10 * nuls >= size) | (10 * (size - odd) < 6 * size)

    def judged(line: Column) -> Column:
        one = text.compact(line)
        checksum = one.rlike("[0-9]") & F.array_max(F.array(*[one.rlike(p) for p in rules.CHECKSUM_LINES]))
        hits = sum((line.rlike(p).cast("int") for p in rules.LIST_LINES), F.lit(0))
        alpha = F.regexp_count(line, F.lit("\\p{L}"))
        dated = line.rlike("[0-9]") & line.rlike("(?<![0-9xX])(?:(?:19|20)?[0-9]{2}[-._ /][0-9xX]{1,2}[-._ /][0-9xX]{1,2}|[0-9xX]{1,2}[-._ /][0-9xX]{1,2}[-._ /](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{6}|(?:19|20)[0-9]{2}[ -][0-9]{4})(?![0-9xX])")
        named = line.rlike("(?i)(?<![a-z])(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ ._,-]*(?:[0-9]{1,2}(?:st|nd|rd|th)?[ ._,-]*)?(?:19|20)?[0-9]{2}(?![a-z0-9])")
        worded = (F.regexp_count(line, F.lit("[A-Za-z]{2,}")) >= 2) & (alpha >= 6)
        marked = (alpha >= 8) & (line.contains(",") | line.contains(" - ") | line.contains("|") | line.contains("@"))
        long = (alpha >= 12) & ~F.lower(line).rlike(rules.HOUSEKEEPING_WORDS)
        file_name = F.lower(F.regexp_extract(line, "\\.([A-Za-z0-9]{2,5})$", 1)).isin(*paths.AUDIO) & ~line.contains("/")
        info = ~checksum & ~file_name & ((hits > 0) | dated | named | worded | marked | long)
        short = F.size(F.split(line, "\\s+")).between(2, 10) & (F.length(line) < 80) & ~F.lower(line).rlike(rules.HOUSEKEEPING_WORDS)
        return F.struct(checksum.alias("checksum"), info.alias("info"), (5 * hits + short.cast("int")).alias("score"))

    trimmed = F.filter(F.transform(F.split(F.regexp_replace(whole, "\r\n?", "\n"), "\n"), F.trim), lambda x: x != "")
    rows = docs.select(key, unreadable.alias("unreadable"), F.transform(trimmed, judged).alias("l"))
    tally = lambda field: F.size(F.filter("l", lambda x: x[field])).cast("long")
    total = F.aggregate("l", F.lit(0), lambda a, x: a + x["score"])
    out = rows.select(key, "unreadable", F.size("l").cast("long").alias("n_lines"), tally("checksum").alias("n_checksum"), tally("info").alias("n_info"), total.alias("score"))
    only = (F.col("n_lines") >= 3) & (F.col("n_info") == 0) & (F.col("n_checksum") >= F.greatest(F.lit(3), F.floor(F.col("n_lines") * 0.6)))
    out = out.withColumn("checksum_only", only & ~F.col("unreadable"))
    return out.withColumn("score", F.when(F.col("unreadable") | F.col("checksum_only"), -1000).otherwise(F.col("score")).cast("long"))


def consensus(df: DataFrame, key: str, value: str, collision: Column | None = None) -> DataFrame:
    """(key, value, conflict): the one value of a record, or the conflict in words; values that lie inside a longer one give way to it."""
    rows = df.where(text.blank_to_null(F.col(value)).isNotNull()).groupBy(key, value).agg(F.bool_or(F.lit(False) if collision is None else collision).alias("collides"))
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"), F.bool_or("collides").alias("collides"))
    inner = lambda v: F.exists("values", lambda w: (w != v) & F.lower(w).contains(F.lower(v)))
    kept = sets.withColumn("values", F.filter("values", lambda v: ~inner(v)))
    single = (F.size("values") == 1) & ~F.col("collides")
    return kept.select(key, F.when(single, F.col("values")[0]).alias("value"), F.when(~single, F.array_join("values", " | ")).alias("conflict"))


def counts_by_volume(df: DataFrame, label: str, token: str) -> DataFrame:
    """Per label, without regard to case: rows and the distinct tokens in order. Repeats are counted away by (label, token) first, so only the list itself meets in one place."""
    key = F.lower(paths.storage_label(F.coalesce(F.col(label), F.lit(""))))
    each = df.groupBy(key.alias("volume"), F.col(token).alias("token")).agg(F.count("*").alias("n"))
    return each.groupBy("volume").agg(F.sum("n").alias("n_rows"), F.array_join(F.array_sort(F.collect_list("token")), ",").alias("tokens"))


def reason_rows(log: DataFrame, line: str = "line") -> DataFrame:
    """(code): reason code of every log line that reports an error, a warning or a skip."""
    low = F.lower(line)
    bad = low.rlike("\\b(error|warning|warn|failed|skip|skipped)\\b") & ~low.rlike("\\b(success|completed|ok)\\b")
    named = F.regexp_extract(line, "(?i)(?:reason|code)\\s*[=:]\\s*([A-Za-z0-9_]+)", 1)
    code = F.coalesce(F.nullif(F.upper(named), F.lit("")), F.upper(F.regexp_extract(low, "\\b(error|warning|warn|failed|skip|skipped)\\b", 1)))
    return log.where(bad).select(code.alias("code"))


def reason_counts(log: DataFrame, line: str = "line") -> DataFrame:
    return reason_rows(log, line).groupBy("code").agg(F.count("*").alias("n"))


def merge_stats(df: DataFrame, keys: Sequence[str], counters: Sequence[str], items: str) -> DataFrame:
    """Counters summed and item lists united without repeats: repeats go by (keys, item) first, so no group holds more than its result."""
    kind = df.schema[items].dataType.elementType.simpleString()
    sums = df.select(*keys, *counters, F.lit(None).cast(f"struct<item:{kind}>").alias("__i"))
    each = df.select(*keys, *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in counters], F.explode(F.transform(items, lambda x: F.struct(x.alias("item")))).alias("__i"))
    once = sums.unionByName(each).groupBy(*keys, "__i").agg(*[F.sum(c).alias(c) for c in counters])
    return once.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters], F.array_sort(F.transform(F.collect_list("__i"), lambda x: x["item"])).alias(items))


def capacity_rollup(moves: DataFrame, free: DataFrame) -> DataFrame:
    """Destinations whose required bytes exceed their free bytes, with the number of sources; moves within a device need none.

    moves: source, destination, bytes, same_device. free: destination, free_bytes.
    """
    need = moves.groupBy("destination").agg(F.sum(F.when(~F.col("same_device"), F.col("bytes")).otherwise(0)).alias("required"), F.countDistinct("source").alias("n_sources"))
    return need.join(free, "destination").where(F.col("required") > F.col("free_bytes")).withColumn("shortfall", F.col("required") - F.col("free_bytes"))


def shortfall_sources(moves: DataFrame, free: DataFrame) -> DataFrame:
    """(destination, source, required, shortfall): a row for each source that needs room at a destination without enough of it."""
    short = capacity_rollup(moves, free).select("destination", "shortfall")
    by_source = moves.where(~F.col("same_device")).groupBy("destination", "source").agg(F.sum("bytes").alias("required"))
    return by_source.join(short, "destination").select("destination", "source", "required", "shortfall")


def combine_documents(docs: DataFrame, record: str, ord_: str, body: str) -> DataFrame:
    """(record, text): bodies in order with a blank line between; bodies that only differ in blanks and case count once."""
    key = F.lower(F.array_join(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n"))
    rank = F.row_number().over(Window.partitionBy(record, "key").orderBy(ord_))
    kept = docs.withColumn("key", key).where("key <> ''").withColumn("rank", rank).where("rank = 1")
    rows = kept.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), F.col(body).alias("b")))).alias("rows"))
    return rows.select(record, F.array_join(F.transform("rows", lambda x: x["b"]), "\n\n").alias("text"))


def generate_documents(records: DataFrame, titles: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, text): a document for each record without one: known header fields (column names as labels), TRACKS: and numbered titles."""
    fields = [c for c in records.columns if c != key]
    header = F.concat_ws("\n", *[F.when(text.blank_to_null(F.col(c).cast("string")).isNotNull(), F.concat(F.lit(f"{c.capitalize()}: "), F.col(c).cast("string"))) for c in fields])
    listed = titles.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", "title"))).alias("rows"))
    listed = listed.select(key, F.array_join(F.transform("rows", lambda x: F.concat(F.lpad(x["number"].cast("string"), 2, "0"), F.lit(". "), x["title"])), "\n").alias("list"))
    missing = records.join(existing.select(key), key, "left_anti").join(listed, key, "left")
    return missing.select(key, F.concat_ws("\n\n", header, F.when(F.col("list").isNotNull(), F.concat(F.lit("TRACKS:\n"), F.col("list")))).alias("text"))


def sibling_relations(folders: DataFrame, parent: str, name: str) -> DataFrame:
    """Per parent: children, whether all are parts of one release, whether all share two leading words, and whether its documents may serve them."""
    key = text.compare_key(F.regexp_replace(name, _PART, ""))
    rows = folders.select(parent, key.alias("key"), F.col(name).rlike(_PART).alias("part")).withColumn("w", F.split("key", " "))
    lead = F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)))
    out = rows.groupBy(parent).agg(F.count("*").alias("n_children"), (F.bool_and("part") & (F.countDistinct("key") == 1)).alias("related"), ((F.min(lead) == F.max(lead)) & (F.min(F.size("w")) > 1)).alias("shared_lead"))
    return out.withColumn("may_share", (F.col("n_children") == 1) | F.col("related") | F.col("shared_lead"))


def conflict_summary(conflicts: DataFrame, blank: DataFrame, block: int = 10_000) -> DataFrame:
    """(ord, source, message): conflicts, then blank-title records; the first of each message, with the last root seen before it.

    Both have ord, root (null where the line names none), source and message. A source's
    rows are dealt into blocks by ord; the last root of each block is carried to later ones.
    """
    both = conflicts.withColumn("part", F.lit(0)).unionByName(blank.withColumn("part", F.lit(1))).withColumn("__block", F.expr(f"ord div {block}"))
    at = F.when(F.col("root").isNotNull(), F.struct("part", "ord", "root"))
    lasts = both.groupBy("source", "part", "__block").agg(F.max(at).alias("__last"))
    w = Window.partitionBy("source").orderBy("part", "__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    carried = lasts.select("source", "part", "__block", F.max("__last").over(w)["root"].alias("__carried"))
    inside = Window.partitionBy("source", "part", "__block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("root", F.last("root", ignorenulls=True).over(inside))
    rooted = near.join(carried, ["source", "part", "__block"]).withColumn("root", F.coalesce("root", "__carried"))
    least = rooted.groupBy("message").agg(F.min(F.struct("part", "ord", "source", "root")).alias("f"))
    return least.select("f.part", "f.ord", "f.root", "f.source", "message")


def evidence_table(df: DataFrame, key: str, fields: dict[str, tuple[Column, str, Column]]) -> DataFrame:
    """(key, field, value, source, confidence) in long form; blank values are left out. fields: name -> (value, source, confidence)."""
    items = [F.struct(F.lit(f).alias("field"), text.blank_to_null(v.cast("string")).alias("value"), F.lit(s).alias("source"), c.cast("long").alias("confidence")) for f, (v, s, c) in fields.items()]
    return df.select(key, F.explode(F.array(*items)).alias("e")).select(key, "e.*").where("value is not null")


def evidence_rollup(evidence: DataFrame, key: str) -> DataFrame:
    """Per record and field: candidates, and the one of most confidence (least value of equals) for the audit."""
    best = F.min_by("value", F.struct(-F.col("confidence"), F.col("value")))
    return evidence.groupBy(key, "field").agg(F.count("*").alias("n"), best.alias("best"))
