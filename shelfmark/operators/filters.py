"""Operators that keep rows: searches, pruning, classes, placeholders, prose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import rules
from shelfmark.functions import paths, search, text


def boolean_search(df: DataFrame, columns: Sequence[str], expression: str) -> DataFrame:
    """Rows whose joined display text fits the expression; a blank expression keeps all."""
    return df.where(search.matches(expression, F.concat_ws(" | ", *columns)))


def deep_search(docs: DataFrame, expression: str, path: str, body: str = "text") -> DataFrame:
    """Documents whose body fits, in order of their path without regard to case; a blank expression is an error and null bodies never fit."""
    if not expression.strip():
        raise search.SearchError("a deep search needs an expression")
    return docs.where(F.col(body).isNotNull() & search.matches(expression, F.col(body))).orderBy(F.lower(path), path)


def prune_paths(df: DataFrame, path: str, suffix: str = "-ignoredir", folders: Sequence[str] = paths.SYSTEM_FOLDERS) -> DataFrame:
    """Rows of which no path component ends in the suffix or is a system folder."""
    return df.where(~F.exists(F.split(F.lower(path), "/"), lambda x: x.endswith(suffix) | x.isin(*folders)))


def extension_classes(spark) -> DataFrame:
    """(ext, media) of known extensions; a fixed handful of rows."""
    rows = [(e, m) for m, group in (("audio", paths.AUDIO), ("video", paths.VIDEO), ("document", paths.DOCUMENT)) for e in group]
    return spark.createDataFrame(rows, "ext string, media string")


def classify_by_extension(df: DataFrame, name: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds ext and media (other for unknown extensions), and keeps the wanted classes."""
    out = df.withColumn("ext", paths.extension(F.col(name))).join(F.broadcast(extension_classes(df.sparkSession)), "ext", "left").withColumn("media", F.coalesce("media", F.lit("other")))
    return out if keep is None else out.where(F.col("media").isin(*keep))


def uniform_groups(df: DataFrame, group: str) -> DataFrame:
    """Per group: rows, whether all have one extension, whether any is media."""
    return df.groupBy(group).agg(F.count("*").alias("n"), (F.countDistinct("ext") == 1).alias("one_extension"), F.bool_or(F.col("media").isin("audio", "video")).alias("has_media"))


def usable_documents(profile: DataFrame, name: str) -> DataFrame:
    """Profiled documents (A3) that are readable, more than checksums, and have no housekeeping name."""
    return profile.where(~F.col("unreadable") & ~F.col("checksum_only") & ~F.lower(name).rlike(rules.HOUSEKEEPING_WORDS))


def blank_placeholder_values(df: DataFrame, key: str, columns: Sequence[str], markers: Sequence[str] = rules.UNKNOWN_MARKERS) -> tuple[DataFrame, DataFrame]:
    """The table with values that hold a marker nulled, and the log (key, field, value) of what was blanked."""
    pattern = "|".join(markers)
    hit = {c: F.lower(text.ascii_text(F.col(c))).rlike(pattern) for c in columns}
    cleaned = df.withColumns({c: F.when(~hit[c], F.col(c)) for c in columns})
    log = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.when(hit[c], F.col(c)).alias("value")) for c in columns])).alias("x"))
    return cleaned, log.select(key, "x.field", "x.value").where("value is not null")


def marker_only_documents(docs: DataFrame, body: str, marker: str = rules.PLACEHOLDER) -> DataFrame:
    """Documents that hold the marker, with `only` true where nothing but punctuation is left without it."""
    low = F.lower(F.regexp_replace(F.col(body), "[‘’]", "'"))
    rest = F.regexp_replace(F.replace(low, F.lit(marker)), "[\\s\\uFEFF.:'\"()\\[\\]{}!?;,-]+", "")
    return docs.where(low.contains(marker)).withColumn("only", rest == "")


def unresolved_records(df: DataFrame, name: Column, entity: Column, conflict: Column) -> DataFrame:
    """Records without a name, with the reasons in words."""
    reason = F.concat_ws("; ", F.lit("blank name"), F.when(text.blank_to_null(entity).isNull(), "blank entity"), F.when(conflict, "in conflict"))
    return df.where(text.blank_to_null(name).isNull()).withColumn("reason", reason)


def lines(docs: DataFrame, key: str, body: str, limit: int | None = None) -> DataFrame:
    """(key, pos, line): lines of each document from position 0; the table that line operators share."""
    split = F.split(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), "\r\n?", "\n"), "\n")
    return docs.select(key, F.posexplode(split if limit is None else F.slice(split, 1, limit)).alias("pos", "line"))


def is_prose(line: Column) -> Column:
    """Sentence-like lines: long, or with sentence marks and mostly lower-case words; blank lines count as prose."""
    bare = F.regexp_replace(line, "^[\\s*_=#~-]+|[\\s*_=#~-]+$", "")
    words = F.regexp_count(bare, F.lit("[A-Za-z]+"))
    lower = F.regexp_count(bare, F.lit("(^|[^A-Za-z])[a-z]")) / F.greatest(words, F.lit(1))
    marks = bare.rlike("[.!?;]")
    label = bare.rlike("^[A-Za-z]+\\s*:")
    # How many words, marks and lower-case words make a sentence.
    prose = (words == 0) | (words >= 10) | ((words >= 7) & (marks | (lower >= 0.45))) | ((words >= 5) & marks & (lower >= 0.3))
    return (bare == "") | (prose & ~label)


def prose_line_filter(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, line, role): header for short lines, prose for sentences, leading for prose before the first header line."""
    rows = lines(docs, key, body).withColumn("prose", is_prose(F.col("line")))
    first = F.min(F.when(~F.col("prose"), F.col("pos"))).over(Window.partitionBy(key))
    role = F.when(~F.col("prose"), "header").when(first.isNull() | (F.col("pos") < first), "leading").otherwise("prose")
    return rows.select(key, "pos", "line", role.alias("role"))
