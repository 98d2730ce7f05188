"""Operators that derive columns: keys, variants, components, names and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths, text


def normalize_columns(df: DataFrame, columns: Sequence[str], fallback: str = "") -> DataFrame:
    """The given columns in printable ASCII; blank results become the fallback."""
    return df.withColumns({c: text.ascii_text(F.col(c), F.lit(fallback)) for c in columns})


def key_variants_report(df: DataFrame, column: str, kind: str = "compare") -> DataFrame:
    """Per comparison key the rows, the number of spellings and the least spelling; rows without a key are left out."""
    keyed = df.select(F.col(column).alias("spelling"), text.compare_key(F.col(column), kind).alias("key")).where("key <> ''")
    return keyed.groupBy("key").agg(F.count("*").alias("n_rows"), F.countDistinct("spelling").alias("n_spellings"), F.min("spelling").alias("representative"))


def term_variants(df: DataFrame, key: str, term: str) -> DataFrame:
    """(key, variant): as given, without article, and "Last, First" turned round; once per key without regard to case."""
    given, bare = text.compact(F.col(term)), text.without_article(F.col(term))
    turned = F.when(bare.contains(","), text.compact(F.concat_ws(" ", F.regexp_extract(bare, ",(.*)$", 1), F.regexp_extract(bare, "^([^,]*),", 1))))
    variants = df.select(key, F.posexplode(F.array(given, bare, turned)).alias("at", "variant")).where("variant <> ''")
    first = variants.groupBy(key, F.lower("variant").alias("folded")).agg(F.min_by("variant", "at").alias("variant"))
    return first.select(key, "variant")


#: Folder names that hold a part or a format of something and name nothing themselves.
WRAPPERS = "^(?:(?:cd|dis[ck]|dvd|set|vol(?:ume)?|part|side|tape|reel)s?[ ._-]*[0-9a-d]{0,2}|music|audio|flac(?:[ ._-]*(?:16|24))?|mp3|wav|shn|artwork|covers?|scans?|info|extras?)$"


def path_components(df: DataFrame, key: str, path: str, eligible_only: bool = False) -> DataFrame:
    """(key, depth, part, folder): components of a path, 1 for the deepest; optionally only those that can name an entity."""
    parts = paths.parts_of(F.col(path))
    # cleaned before they become rows, and by posexplode_outer: filters on the parts then read what is there and do not clean them again
    rows = df.select(key, parts.alias("parts")).select(key, "parts", F.posexplode_outer(F.transform("parts", paths.clean_part)).alias("at", "part"))
    rows = rows.select(key, (F.size("parts") - F.col("at")).cast("long").alias("depth"), "part", F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, F.col("at") + 1), "/")).alias("folder"))
    rows = rows.where("part <> ''")
    return rows.where((F.length("part") > 1) & ~F.col("part").rlike("^[0-9]+$") & ~F.lower("part").rlike(WRAPPERS)) if eligible_only else rows


def storage_identity(df: DataFrame, located: str) -> DataFrame:
    """Distinct (label, path, located, n_rows) of "[label] path" values, free of mounts and drives."""
    value = F.trim(F.col(located))
    marked = value.rlike("^\\[[^\\]]*\\]")
    label = F.when(marked, paths.storage_label(F.regexp_extract(value, "^\\[([^\\]]*)\\]", 1))).otherwise("")
    path = paths.storage_path(F.when(marked, F.regexp_replace(value, "^\\[[^\\]]*\\]\\s*", "")).otherwise(value))
    grouped = df.select(label.alias("label"), path.alias("path")).groupBy("label", "path").agg(F.count("*").alias("n_rows"))
    return grouped.withColumn("located", F.trim(F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("path"))))


def compose_names(entity: Column, date: Column, rest: Sequence[Column], qualifiers: Column, layout: str = "structured") -> Column:
    """Title from non-blank parts; null without entity. Layouts: structured (date, or a placeholder), dash, tail (no date needed)."""
    entity, qualifiers = text.blank_to_null(entity), F.coalesce(text.compact(qualifiers), F.lit(""))
    others = [text.blank_to_null(x) for x in rest]
    if layout == "dash":
        name = F.concat_ws(" - ", entity, F.nullif(F.concat_ws(" ", *others), F.lit("")))
    elif layout == "tail":
        name = F.concat_ws(" ", entity, text.blank_to_null(date), *others)
    else:
        name = F.concat_ws(" ", entity, F.coalesce(text.blank_to_null(date), F.lit("xxxx-xx-xx")), *others)
    name = F.when((qualifiers != "") & ~name.endswith(qualifiers), F.concat_ws(" ", name, qualifiers)).otherwise(name)
    return F.when(entity.isNotNull(), name)


def document_key(entity: Column, date: Column, venue: Column, place: Column, suffix: Column | None = None) -> Column:
    """Key of a record's document, 241 characters at most, then the (...) suffix of its folder unless it is there already."""
    date_key = paths.key_part(F.regexp_replace(F.coalesce(date, F.lit("")), "^((19|20)[0-9]{2})([0-9]{2})([0-9]{2})$", "$1-$3-$4"), dash=True)
    base = F.substring(F.concat(paths.key_part(entity), date_key, paths.key_part(venue), paths.key_part(place)), 1, 241)
    if suffix is None:
        return base
    tail = paths.key_part(suffix)
    return F.when((tail != "") & ~base.endswith(tail), F.concat(base, tail)).otherwise(base)


def trailing_qualifiers(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, stripped, qualifier, ord): trailing (...) groups of a text in order; texts without one give a row without qualifier."""
    value = text.compact(F.col(column))
    groups = F.regexp_extract_all(F.regexp_extract(value, "((\\s*\\([^()]*\\))*)\\s*$", 1), F.lit("\\([^()]*\\)"), 0)
    stripped = F.trim(F.regexp_replace(value, "((\\s*\\([^()]*\\))+)\\s*$", ""))
    rows = df.select(key, stripped.alias("stripped"), F.posexplode_outer(groups).alias("at", "qualifier"))
    return rows.select(key, "stripped", "qualifier", (F.col("at") + 1).cast("long").alias("ord"))


def label_by_rules(df: DataFrame, columns: Sequence[str], rules: Sequence[tuple[str, str]], flags: dict[str, Sequence[str]]) -> DataFrame:
    """Adds `label`, of the first column with a matching rule the first such rule's, and a boolean for each set of alternative patterns."""
    first = [F.when(F.col(c).rlike(f"(?i){pattern}"), label) for c in columns for pattern, label in rules]
    any_of = {name: F.coalesce(F.array_max(F.array(*[F.col(c).rlike(f"(?i){p}") for c in columns for p in patterns])), F.lit(False)) for name, patterns in flags.items()}
    return df.withColumns({"label": F.coalesce(*first, F.lit("")), **any_of})


def clean_titles(df: DataFrame, column: str) -> DataFrame:
    """Adds `clean` and `usable`; generic or empty titles are written Unknown."""
    out = df.withColumn("clean", text.clean_title(F.col(column))).withColumn("usable", text.usable_title(F.col("clean")))
    return out.withColumn("clean", F.when(F.col("usable"), F.col("clean")).otherwise("Unknown"))
