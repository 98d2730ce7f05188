"""Date and text extraction jobs (D1 to D10): one row a text in, one row a finding out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import rules
from shelfmark.functions import dates, text
from shelfmark.functions.folds import let, scan
from shelfmark.operators.filters import lines

# Years and English month names.
_YEAR = "(?:19|20)[0-9]{2}"
_NAME = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
#: No month name does without one of these; one test spares most texts the patterns with names.
_MONTH = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"
_SEP = "[\\s._,-]*"
#: kind, order of the parts, pattern (border guards are look-arounds, so the match is the date), groups by part.
FAMILIES = (
    ("ymd", f"(?<![0-9xX])({_YEAR}|[0-9]{{2}})([._-]|\\s)([0-9xX]{{1,2}})\\2([0-9xX]{{1,2}})(?![0-9xX])", (1, 3, 4)),
    ("mdy", f"(?<![0-9xX])([0-9xX]{{1,2}})([._-]|\\s)([0-9xX]{{1,2}})\\2({_YEAR})(?![0-9xX])", (4, 1, 3)),
    ("slash", f"(?<![0-9xX/])([0-9]{{1,2}})/([0-9]{{1,2}})/({_YEAR}|[0-9]{{2}})(?![0-9xX/])", (3, 1, 2)),
    ("compact", f"(?<![0-9xX])({_YEAR})([0-9]{{2}})([0-9]{{2}})(?![0-9xX])", (1, 2, 3)),
    ("mixed", f"(?<![0-9xX])({_YEAR})[ -]([0-9]{{2}})([0-9]{{2}})(?![0-9xX])", (1, 2, 3)),
    ("month_day", f"(?<![A-Za-z0-9])({_NAME}){_SEP}([0-9]{{1,2}})(?:st|nd|rd|th)?{_SEP}({_YEAR}|[0-9]{{2}})(?![A-Za-z0-9])", (3, 1, 2)),
    ("day_month", f"(?<![A-Za-z0-9])([0-9]{{1,2}})(?:st|nd|rd|th)?{_SEP}({_NAME}){_SEP}({_YEAR}|[0-9]{{2}})(?![A-Za-z0-9])", (3, 2, 1)),
    ("year_month_day", f"(?<![A-Za-z0-9])({_YEAR}){_SEP}({_NAME}){_SEP}([0-9]{{1,2}})(?:st|nd|rd|th)?(?![A-Za-z0-9])", (1, 2, 3)),
    ("month_year", f"(?<![A-Za-z0-9])({_NAME}){_SEP}({_YEAR})(?![A-Za-z0-9])", (2, 1, 0)),
    ("range", f"(?<![0-9xX._-])((?:{_YEAR}|[0-9]{{2}})(?:[-_](?:{_YEAR}|[0-9]{{2}})){{1,3}})(?![0-9xX._-])", ()),
)


# Marks that stand around a match and between its parts while it is taken out of a text.
_BEGIN, _PART = "\u0001", "\u0002"
_FOUND = "struct<start:int,end:int,raw:string,rank:int,y:string,m:string,d:string>"


def _found(value: Column, families: list[tuple]) -> Column:
    """Every match of all families (rank, kind, pattern, groups) with its place and parts.

    Each pattern is evaluated once: it puts marks into the text, which is then cut at them.
    One expression reads the cuts of all families, as driver and Catalyst have to handle it.
    """

    def marked(rank: int, kind: str, pattern: str, groups: tuple[int, ...]) -> Column:
        parts = [f"${g}" if g else "xx" for g in groups or (0, 0, 0)]
        text_ = F.regexp_replace(value, pattern, _BEGIN + _PART.join([*parts, "$0", ""]))
        return F.struct(F.lit(rank).alias("rank"), (F.when(value.rlike(_MONTH), text_) if "month" in kind else text_).alias("text"))

    named = [rank for rank, kind, _, _ in families if "month" in kind]

    def taken(rank: Column, cuts: Column) -> Column:
        def step(at: Column, cut: Column) -> Column:
            def read(x: Column) -> Column:
                end = at + F.length(x[3])
                month = F.when(rank.isin(named), dates.month_number(x[1])).otherwise(x[1])
                one = F.struct(at.alias("start"), end.alias("end"), x[3].alias("raw"), rank.alias("rank"), x[0].alias("y"), month.alias("m"), x[2].alias("d"))
                return F.struct((end + F.length(x[4])).alias("state"), one.alias("out"))

            return let(F.split(cut, _PART), read)

        return scan(F.slice(cuts, 2, F.size(cuts)), F.length(cuts[0]), step, _FOUND)

    some = F.filter(F.array(*[marked(rank, kind, pattern, groups) for rank, kind, pattern, groups in families]), lambda m: m["text"].contains(_BEGIN))
    return F.flatten(F.transform(some, lambda m: let(F.split(m["text"], _BEGIN), lambda cuts: taken(m["rank"], cuts))))


def _clear(every: Column, kind: str, ranks: int) -> Column:
    """Mentions that no mention of an earlier family overlaps; every is sorted by start. One sweep forwards keeps the furthest end of each family and those before it, one backwards the nearest start."""
    ints = lambda n: F.array(*[F.lit(n)] * ranks)
    better = lambda marks, x: F.when(x["rank"] > 0, F.get(marks, x["rank"] - 1))
    marked = f"struct<x:{kind},hit:boolean>"

    def ahead(ends: Column, x: Column) -> Column:
        hit = F.coalesce(better(ends, x) > x["start"], F.lit(False))
        return F.struct(F.transform(ends, lambda e, r: F.when(r >= x["rank"], F.greatest(e, x["end"])).otherwise(e)).alias("state"), F.struct(x.alias("x"), hit.alias("hit")).alias("out"))

    def back(starts: Column, y: Column) -> Column:
        x = y["x"]
        hit = y["hit"] | F.coalesce(better(starts, x) < x["end"], F.lit(False))
        return F.struct(F.transform(starts, lambda s, r: F.when(r >= x["rank"], F.least(s, x["start"])).otherwise(s)).alias("state"), F.struct(x.alias("x"), hit.alias("hit")).alias("out"))

    swept = scan(F.reverse(scan(every, ints(-1), ahead, marked)), ints(2**31 - 1), back, marked)
    return F.reverse(F.transform(F.filter(swept, lambda y: ~y["hit"]), lambda y: y["x"]))


def extract_dates(df: DataFrame, key: str, column: str, allow_slash: bool = False, pivot: int = 35) -> DataFrame:
    """(key, start, raw, normal, kind): date mentions of each text; of overlapping ones the first family in FAMILIES stays.

    Mixed separators are no date. Eight or four joined digits must be a real date.
    Slashed dates count only on request. Every pattern is evaluated once, and the time is
    linear in the number of mentions.
    """
    # the marks are taken out first; what they become is part of no date
    value = F.translate(F.coalesce(F.col(column), F.lit("")), _BEGIN + _PART, "\u0003\u0003")
    used = [(rank, kind, pattern, groups) for rank, (kind, pattern, groups) in enumerate(FAMILIES) if kind != "slash" or allow_slash]
    # no family does without two digits, so most texts need no further test
    spans = let(value, lambda v: F.when(v.rlike("[0-9xX]{2}"), _found(v, used)).otherwise(F.array().cast(f"array<{_FOUND}>")))
    kinds = F.array(*[F.lit(kind) for kind, _, _ in FAMILIES])
    mention = "struct<start:int,rank:int,end:int,raw:string,kind:string,normal:string>"

    def dated(x: Column) -> Column:
        ymd, ydm = dates.partial_date(x["y"], x["m"], x["d"], pivot), dates.partial_date(x["y"], x["d"], x["m"], pivot)
        kind = F.get(kinds, x["rank"])
        normal = F.when(kind == "range", dates.year_range(x["raw"], pivot)).when(kind == "mdy", F.coalesce(ymd, ydm)).otherwise(ymd)
        return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["raw"].alias("raw"), kind.alias("kind"), normal.alias("normal"))

    # overlaps are settled inside the row, so rows that share a key stay apart and nothing is shuffled
    every = F.sort_array(F.filter(F.transform(spans, dated), lambda x: x["normal"].isNotNull()))
    clear = let(every, lambda e: F.when(F.size(e) > 1, _clear(e, mention, len(FAMILIES))).otherwise(e))
    # explode_outer: for explode Spark puts a filter below that evaluates the whole expression again
    return df.select(key, F.explode_outer(clear).alias("d")).where("d is not null").select(key, "d.start", "d.raw", "d.normal", "d.kind")


def partial_dates(df: DataFrame, key: str, year: str, month: str, day: str, pivot: int = 35) -> DataFrame:
    """(key, normal, spec): normal form of three date parts and the number of known parts; impossible dates give null and 0."""
    normal = dates.partial_date(F.col(year), F.col(month), F.col(day), pivot)
    return df.select(key, normal.alias("normal")).withColumn("spec", dates.specificity(F.col("normal")))


def year_ranges(df: DataFrame, key: str, column: str, pivot: int = 35) -> DataFrame:
    """(key, range, start_year, end_year) of texts that are year ranges; others give nulls."""
    out = df.select(key, dates.year_range(F.col(column), pivot).alias("range"))
    return out.withColumns({"start_year": F.substring("range", 1, 4).cast("long"), "end_year": F.substring("range", 6, 4).cast("long")})


def match_compatible_dates(candidates: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """(key, date, conflict): the more specific of compatible candidate and document dates; several distinct results, or none, are a conflict.

    candidates and mentions: key, date. Repeats count once. Dates with a known year, and each
    year of a range, meet by (key, year); those without one, of which a record has few
    different ones, meet all of their record.
    """
    year = F.substring("date", 1, 4).try_cast("int")
    years = F.when(dates.is_range(F.col("date")), F.sequence(year, F.greatest(year, F.substring("date", 6, 4).try_cast("int")))).when(year.isNotNull(), F.array(year))

    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(key, date as name, year) of dates with a year, and (key, name) of those without."""
        known = df.withColumn("years", years)
        return known.select(key, F.col("date").alias(name), F.explode("years").alias("year")), known.where("years is null").select(key, F.col("date").alias(name))

    every, told = candidates.select(key, "date").distinct(), mentions.select(key, "date").distinct()
    (c_known, c_open), (m_known, m_open) = side(every, "c"), side(told.where("date is not null"), "m")
    pairs = c_known.join(m_known, [key, "year"]).drop("year").unionByName(c_known.select(key, "c").distinct().join(m_open, key)).unionByName(c_open.join(told.where("date is not null").select(key, F.col("date").alias("m")), key))
    fits = pairs.where(dates.compatible(F.col("c"), F.col("m")))
    chosen = fits.select(key, F.when(dates.specificity(F.col("m")) > dates.specificity(F.col("c")), F.col("m")).otherwise(F.col("c")).alias("chosen"))
    # without a date in its document a candidate stands
    blank = told.groupBy(key).agg(F.bool_or(F.col("date").isNull()).alias("blank"))
    alone = every.join(blank, key, "left").where("coalesce(blank, true)").select(key, F.col("date").alias("chosen"))
    sets = chosen.unionByName(alone).select(key, "chosen", F.lit(None).cast("string").alias("c")).unionByName(every.select(key, F.lit(None).cast("string").alias("chosen"), F.col("date").alias("c")))
    sets = sets.groupBy(key).agg(F.array_sort(F.collect_set("chosen")).alias("set"), F.array_sort(F.collect_set("c")).alias("all"))
    one = F.size("set") == 1
    return sets.select(key, F.when(one, F.col("set")[0]).alias("date"), F.when(~one, F.array_join(F.when(F.size("set") > 1, F.col("set")).otherwise(F.col("all")), " | ")).alias("conflict"))


def prefer_complete_dates(candidates: DataFrame, key: str) -> DataFrame:
    """Candidates (key, date) without the partial ones of records whose complete dates all agree."""
    w = Window.partitionBy(key)
    complete = F.when(dates.is_complete(F.col("date")), F.col("date"))
    one = F.size(F.collect_set(complete).over(w)) == 1
    return candidates.withColumn("__drop", one & ~dates.is_complete(F.col("date"))).where("not __drop").drop("__drop")


def split_around_date(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, mention, before, date, after, abbreviation, required): the text around each of its complete or partial dates.

    Required mentions have text before them; they come before the others, each by place. A
    short all-caps word glued to the date is an abbreviation.
    """
    rows = df.withColumn("__text", F.coalesce(F.col(column), F.lit(""))).withColumn("__key", F.struct(key, "__text"))
    found = extract_dates(rows, "__key", "__text").where("kind <> 'range'").select(f"__key.{key}", F.col("__key.__text").alias("__t"), "start", "raw", "normal")
    raw_before = F.substring(F.col("__t"), F.lit(1), F.col("start"))
    tidy = lambda c: F.regexp_replace(text.compact(c), "^[ ,;:_-]+|[ ,;:_-]+$", "")
    after = F.substring(F.col("__t"), F.col("start") + F.length("raw") + 1, F.length("__t"))
    parts = found.select(key, "start", tidy(raw_before).alias("before"), F.col("normal").alias("date"), tidy(after).alias("after"), raw_before.rlike("(^|\\s)[A-Z]{2,5}$").alias("abbreviation"), (tidy(raw_before) != "").alias("required"))
    order = Window.partitionBy(key).orderBy(F.desc("required"), "start")
    return parts.withColumn("mention", F.row_number().over(order).cast("long")).select(key, "mention", "before", "date", "after", "abbreviation", "required")


def split_on_dash(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, left, right, date): both sides of the first spaced dash; a right side that is wholly a date becomes the date."""
    left, right = F.trim(F.regexp_extract(column, "^(.*?)\\s+-\\s+(.*)$", 1)), F.trim(F.regexp_extract(column, "^(.*?)\\s+-\\s+(.*)$", 2))
    rows = df.where(F.col(column).rlike("\\s-\\s")).select(key, left.alias("left"), right.alias("right")).where("left <> '' and right <> ''")
    part = F.regexp_extract_all("right", F.lit("^([0-9]{4})-([0-9x]{2})-([0-9x]{2})$"), 0)
    date = F.when(F.size(part) > 0, dates.partial_date(F.substring("right", 1, 4), F.substring("right", 6, 2), F.substring("right", 9, 2)))
    return rows.withColumn("date", date).withColumn("right", F.when(F.col("date").isNull(), F.col("right")).otherwise(""))


def labelled_fields(docs: DataFrame, key: str, body: str, labels: dict[str, str] = rules.FIELD_LABELS, limit: int | None = None) -> DataFrame:
    """(key, one column for each field): the first non-blank value of "Label: value" or "Label - value" lines, of the first `limit` ones if it is given."""
    fields = sorted(set(labels.values()))
    pattern = f"(?i)^\\s*({'|'.join(labels)})\\s*[:=-]\\s*(\\S.*?)\\s*$"
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rows = lines(docs, key, body, limit).where(F.col("line").rlike(pattern))
    rows = rows.select(key, "pos", known[F.lower(F.regexp_extract("line", pattern, 1))].alias("field"), F.regexp_replace(F.regexp_extract("line", pattern, 2), "(?i)\\s*[,(]?\\s*(fm|tv|radio) broadcast\\)?$", "").alias("value"))
    return rows.groupBy(key).agg(*[F.min_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("pos"))).alias(f) for f in fields])


#: A line that can be an item begins like this; one test spares most lines the others.
_ITEM_BEGIN = "^(?:[0-9\\[(]|t|d|cd|s|[a-d][0-9])"
_ITEM = ("^[0-9]-([0-9]{2})\\s*[.):-]?\\s+(\\S.*)$", "^[a-d]([0-9]{1,2})\\s*[.):-]\\s*(\\S.*)$", "^(?:track|trk)\\s*([0-9]{1,3})\\s*[.:)_ -]\\s*(\\S.*)$", "^(?:d|cd|disc|s|set)\\s*[0-9]{1,2}[ -]*t\\s*([0-9]{1,3})[ ._-]*(\\S.*)$", "^[\\[(]([0-9]{1,3})[\\])]\\s*[.:-]?\\s*(\\S.*)$", "^([0-9]{1,3})[a-b]?\\s*[.):]\\s*(\\S.*)$", "^([0-9]{1,3})\\s*-\\s*(\\S.*)$", "^([0-9]{1,3})\\s+([A-Za-z].*)$")


def numbered_items(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, number, title): lines of numbered lists; checksum lines, dates, bare durations and headings are none. Numbers may have a disc ("1-03") or a side ("A1.") before them."""
    rows = lines(docs, key, body).withColumn("line", F.trim("line")).where(F.col("line").rlike(f"(?i){_ITEM_BEGIN}"))
    one = text.compact(F.col("line"))
    checksum = one.rlike("[0-9]") & F.array_max(F.array(*[one.rlike(p) for p in rules.CHECKSUM_LINES]))
    other = one.rlike("^[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}") | one.rlike("^[0-9]{1,2}:[0-9]{2}")
    fits = [F.col("line").rlike(f"(?i){p}") for p in _ITEM]
    pick = lambda g: F.coalesce(*[F.when(ok, F.regexp_extract("line", f"(?i){p}", g)) for ok, p in zip(fits, _ITEM, strict=True)])
    out = rows.where(~checksum & ~other).select(key, "pos", pick(1).try_cast("long").alias("number"), text.clean_title(pick(2)).alias("title"))
    return out.where("number is not null and title <> ''")


def comma_items(docs: DataFrame, key: str, body: str, expected: DataFrame | None = None, least: int = 5) -> DataFrame:
    """(key, ord, title): items of lines with at least `least` comma-separated items (2 after a set heading) of at most eight words; with `expected` only where the total equals it."""
    rows = lines(docs, key, body)
    w = Window.partitionBy(key).orderBy("pos")
    heading = F.lower(F.trim("line")).rlike("^(set|disc|cd|encore)\\s*[0-9]*\\s*:?$")
    items = F.filter(F.transform(F.split(F.regexp_replace("line", "[.;]\\s*$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("inside", F.coalesce(F.max(heading.cast("int")).over(w), F.lit(0)) == 1).withColumn("items", items)
    ok = (F.size("items") >= F.when(F.col("inside"), 2).otherwise(least)) & F.forall("items", lambda x: F.size(F.split(x, "\\s+")) <= 8)
    each = rows.where(ok).select(key, F.posexplode("items").alias("at", "title"), "pos")
    out = each.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("pos", "at")).cast("long")).select(key, "ord", "title")
    if expected is None:
        return out
    totals = out.groupBy(key).agg(F.count("*").alias("n")).join(expected, key).where("n = expected").select(key)
    return out.join(totals, key, "left_semi")
