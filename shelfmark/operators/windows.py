"""Operators that rank, number and section rows inside a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark import rules
from shelfmark.functions import dates, text
from shelfmark.functions.folds import let, scan
from shelfmark.operators.filters import is_prose, lines

RICH = ("doc", "docx", "rtf", "pdf")
# Marks of a document name and what they add to its score.
NAME_SCORES = (("^info\\.[a-z]+$", 40), ("setlist", 25), ("info", 8), ("read[_-]?me", 5))


def name_score(name: Column) -> Column:
    low = F.lower(name)
    return sum((F.when(low.rlike(p), n).otherwise(0) for p, n in NAME_SCORES), F.lit(0)) - F.least(F.length(low), F.lit(80)) / 100


def rank_documents(docs: DataFrame, folder: str, path: str, content_score: str) -> DataFrame:
    """Adds tier, score and rank: rich formats first by name score, then plain texts by three times the content score and the name score; ties by path."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    tier = F.when(F.lower(F.regexp_extract(name, "\\.([^.]*)$", 1)).isin(*RICH), 1).otherwise(2)
    score = F.when(tier == 1, name_score(name)).otherwise(3 * F.col(content_score) + name_score(name))
    scored = docs.withColumn("tier", tier).withColumn("score", F.round(score, 4))
    rank = F.row_number().over(Window.partitionBy(folder).orderBy("tier", F.desc("score"), F.lower(path), path))
    return scored.withColumn("rank", rank.cast("long"))


#: What a date mention scores by the label of its line, and the labels of a place.
LABEL_SCORES = {"date": 110, "venue": 105, "location": 80, "loc": 80, "city": 80, "state": 80, "region": 80, "province": 80, "country": 80, "place": 80}
OTHER_LABEL, HEADER, CLUE, PROSE_CLUE, PROSE = 70, 70, 20, 12, 5
COMPLETE, RANGE, PART, RANGE_LOSS = 30, 5, 8, 8


def rank_date_mentions(mentions: DataFrame, key: str) -> DataFrame:
    """(key, raw, normal, score): best date mention of each document.

    mentions: key, line (position), start, text, raw, normal, kind. A labelled line scores
    by its label (date, venue, places, others), others as prose, as lines with a word such
    as "live", or as header lines. A complete date adds 30, a range 5, another date 8 for
    each known part; a range in prose or beside such a word loses 8.
    """
    label = F.lower(F.regexp_extract("text", "^\\s*([A-Za-z][A-Za-z ]{1,20}?)\\s*[:=]", 1))
    scores = F.create_map(*[F.lit(x) for pair in LABEL_SCORES.items() for x in pair])
    clue = F.lower("text").rlike("\\b(live|recorded|taped|show|concert)\\b")
    prose = is_prose(F.col("text"))
    context = F.when(label != "", F.coalesce(scores[label], F.lit(OTHER_LABEL))).when(prose & clue, PROSE_CLUE).when(prose, PROSE).when(clue, CLUE).otherwise(HEADER)
    ranged = F.col("kind") == "range"
    known = F.when(ranged, RANGE).when(dates.is_complete(F.col("normal")), COMPLETE).otherwise(PART * dates.specificity(F.col("normal")))
    score = context + known - F.when(ranged & (label == "") & (prose | clue), RANGE_LOSS).otherwise(0)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "line", "start"))
    return mentions.withColumn("score", score.cast("long")).withColumn("rank", rank).where("rank = 1").select(key, "raw", "normal", "score")


def assign_alternates(docs: DataFrame, key: str, size: str, ord_: str, existing: DataFrame | None = None) -> DataFrame:
    """Adds alt and name: documents of one key with equal size are one; others are (alt1), (alt2) by first appearance, after the highest that exists.

    existing: key, alt. Pass a hash as `size` to compare contents.
    """
    first = docs.groupBy(key, size).agg(F.min(ord_).alias("first"))
    numbered = first.withColumn("seen", (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("long"))
    if existing is not None:
        numbered = numbered.join(existing.groupBy(key).agg((F.max("alt") + 1).alias("base")), key, "left").withColumn("seen", F.col("seen") + F.coalesce("base", F.lit(0)))
    out = docs.join(numbered.select(key, size, F.col("seen").alias("alt")), [key, size])
    return out.withColumn("name", F.when(F.col("alt") == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("(alt"), F.col("alt").cast("string"), F.lit(")"))))


def ordered_dedupe(df: DataFrame, keys: Sequence[str], ord_: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, repeats): the first row of each key in the given order, and the others."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*ord_)))
    return ranked.where("__rank = 1").drop("__rank"), ranked.where("__rank > 1").drop("__rank")


def sequence_runs(items: DataFrame, key: str, pos: str, number: str, longest_gap: int = 3) -> DataFrame:
    """(key, run, first, last, n, starts): runs of rising numbers in a document's numbered lines.

    A run goes on with the next number, over a forward gap below `longest_gap`, or from
    the last of one disc to the first of the next (104 to 201); anything else, such as a
    restart at 1, begins a new one.
    """
    w = Window.partitionBy(key).orderBy(pos)
    step = F.col(number) - F.lag(number).over(w)
    before = F.lag(number).over(w)
    disc = (F.col(number) > 100) & (F.col(number) % 100 == 1) & (F.expr(f"{number} div 100") == F.floor(before / 100) + 1)
    goes_on = F.coalesce(step.between(1, longest_gap) | disc, F.lit(False))
    flagged = items.withColumn("__new", (~goes_on).cast("int"))
    runs = flagged.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min(number).cast("long").alias("first"), F.max(number).cast("long").alias("last"), F.count("*").alias("n"), F.min(pos).cast("long").alias("starts"))


def sequence_parts(items: DataFrame, key: str, pos: str, number: str, section: str | None = None, longest_gap: int = 3) -> DataFrame:
    """(key, pos, number, part): the lines that belong to a document's numbered list, with its parts counted from 1.

    A line belongs to the list if it goes on from the line before it, or begins a part: with
    0 or 1 where `section` (a boolean column: a heading stands before it) is true, or with
    1 where the next line is 2. A single line that fits neither, between two lines of which
    the second goes on from the first, is left out, and so is what follows the last part
    without going on.
    """
    w = Window.partitionBy(key).orderBy(pos)
    headed = F.lit(False) if section is None else F.coalesce(F.col(section), F.lit(False))
    follows = lambda a, b: F.coalesce((b - a).between(1, longest_gap) | ((b > 100) & (b % 100 == 1) & (F.floor(b / 100) == F.floor(a / 100) + 1)), F.lit(False))
    n, before, after = F.col(number), F.lag(number).over(w), F.lead(number).over(w)
    begins = (headed & n.isin(0, 1)) | ((n == 1) & F.coalesce(after == 2, F.lit(False)))
    stray = ~begins & ~follows(before, n) & follows(before, after)
    rows = items.withColumns({"__begins": begins, "__stray": stray}).where(~F.col("__stray"))
    goes_on = follows(F.lag(number).over(w), n)
    rows = rows.withColumn("__step", F.when(F.col("__begins"), 1).when(goes_on, 0).otherwise(2))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # what follows a break belongs to no part until the next one begins
    rows = rows.withColumn("part", F.sum((F.col("__step") == 1).cast("long")).over(upto))
    broken = F.max((F.col("__step") == 2).cast("int")).over(Window.partitionBy(key, "part").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__broken", broken).where("part > 0 and __broken = 0").select(key, pos, number, "part")


_LIST_STATE = {"n": "int", "prev": "bigint", "boundary": "boolean", "seen": "boolean", "epoch": "int", "held": "int", "number": "bigint", "pos": "bigint", "missing": "bigint"}
_LISTED = "array<struct<epoch:int,pos:bigint,number:bigint>>"
_HIGH, _RESET, _GAP = 1, 2, 3


def _list_step(state: Column, x: Column) -> Column:
    """One numbered line of `numbered_list`: struct(state, out), where out has the lines that are in the list since."""
    num, none = x["number"], F.array().cast(_LISTED)

    def changed(s: Column, **new: Column) -> Column:
        return F.struct(*[(new[f] if f in new else s[f]).cast(kind).alias(f) for f, kind in _LIST_STATE.items()])

    def taken(s: Column, number: Column) -> Column:
        return changed(s, n=s["n"] + 1, prev=number, boundary=F.lit(False), held=F.lit(0))

    def line(s: Column, number: Column, pos: Column, epoch: Column | None = None) -> Column:
        return F.struct((s["epoch"] if epoch is None else epoch).alias("epoch"), pos.alias("pos"), number.alias("number"))

    def result(s: Column, out: Column, done: bool) -> Column:
        return F.struct(s.alias("state"), out.alias("out"), F.lit(done).alias("done"))

    def hold(s: Column, kind: int, missing: Column | None = None, **new: Column) -> Column:
        return changed(s, held=F.lit(kind), number=num, pos=x["pos"], missing=F.lit(None) if missing is None else missing, **new)

    def two(s: Column, first: Column) -> Column:
        return result(taken(taken(s, first), num), F.array(line(s, first, s["pos"]), line(s, num, x["pos"])), True)

    def resolve(s: Column) -> Column:
        """What becomes of a line that is held back, now that the next one is known."""
        again = F.coalesce((num == s["number"]) & (s["number"] == s["missing"] + 1), F.lit(False))
        released = result(taken(s, s["number"]), F.array(line(s, s["number"], s["pos"])), False)
        return (
            F.when((s["held"] == _RESET) & (num == s["number"] + 1), two(s, s["number"])).when((s["held"] == _GAP) & again, two(s, s["missing"]))
            .when(s["held"] == _GAP, released).when(s["held"] == _RESET, result(changed(s, held=F.lit(0)), none, False)).otherwise(result(s, none, False))
        )

    part = lambda c: F.when(c.between(100, 999), c % 100).otherwise(c)
    disc = lambda c: F.when(c.between(100, 999), F.floor(c / 100))
    begins = part(num).isin(0, 1)

    def place(r: Column) -> Column:
        s, own = r["state"], lambda s: F.concat(r["out"], F.array(line(s, num, x["pos"])))
        take, skip = F.struct(taken(s, num).alias("state"), own(s).alias("out")), F.struct(s.alias("state"), r["out"].alias("out"))
        keep = lambda s, out=r["out"]: F.struct(s.alias("state"), out.alias("out"))
        anew = changed(s, n=F.lit(1), prev=num, boundary=F.lit(False), held=F.lit(0), epoch=s["epoch"] + 1)
        restart = keep(anew, F.concat(r["out"], F.array(line(s, num, x["pos"], s["epoch"] + 1))))
        confirmed = keep(taken(taken(s, s["number"]), num), F.concat(r["out"], F.array(line(s, s["number"], s["pos"]), line(s, num, x["pos"]))))
        first = F.when(begins, take).when((s["held"] == _HIGH) & (num == s["number"] + 1), confirmed).otherwise(keep(hold(s, _HIGH)))
        again = F.when((s["n"] == 1) & ~s["boundary"], restart).when(s["boundary"], take).when((part(s["prev"]) >= 1) & (part(num) == 1), keep(hold(s, _RESET))).otherwise(skip)
        ahead = F.when((s["n"] > 1) | s["seen"], keep(hold(s, _GAP, s["prev"] + 1))).otherwise(keep(hold(s, _HIGH, n=F.lit(0), epoch=s["epoch"] + 1)))
        next_disc = F.coalesce((disc(num) > disc(s["prev"])) & begins, F.lit(False))
        main = F.when(s["n"] == 0, first).when((num == s["prev"] + 1) | next_disc, take).when(begins, again).when(num > s["prev"], ahead).otherwise(skip)
        # the end of the document tells which list is the last one, as it may be empty
        return F.when(num.isNull(), keep(s, own(s))).when(r["done"], skip).otherwise(main)

    headed = changed(state, seen=state["seen"] | x["headed"], boundary=state["boundary"] | (x["headed"] & (state["n"] > 0)), held=F.when(x["headed"] & (state["held"] == _HIGH), 0).otherwise(state["held"]))
    return let(headed, lambda s: let(resolve(s), place))


def numbered_list(items: DataFrame, key: str, pos: str, number: str, section: str | None = None) -> DataFrame:
    """(key, ord, pos, number): the numbered list of each document, one line after the other.

    items are its numbered lines; `section` is true where a heading stands before a line. A
    list begins at 0 or 1 (or at 100, 101, 200, ...). Lines that fit neither as the next
    number, nor as the first of a higher disc, nor as a restart after a heading, are held
    back until the next line tells:

    - a higher start counts if the next line goes on from it, and the document has a heading;
    - a restart at 1 without a heading counts if the next line is 2;
    - a jump ahead in a list of two or more lines, or after a heading, counts as it is,
      unless the next line repeats it and one number is missing: then it is that number;
    - a first line alone is dropped for another start, or for a jump that may be a start.

    Lower numbers are left out. The lines of a document are folded inside one row.
    """
    headed = F.lit(False) if section is None else F.coalesce(F.col(section), F.lit(False))
    row = F.struct(F.col(pos).cast("long").alias("pos"), F.col(number).cast("long").alias("number"), headed.alias("headed"))
    lists = items.where(F.col(number).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    nothing = {"n": F.lit(0), "boundary": F.lit(False), "seen": F.lit(False), "epoch": F.lit(0), "held": F.lit(0)}
    start = F.struct(*[nothing.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in _LIST_STATE.items()])
    end = F.struct(F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("number"), F.lit(False).alias("headed"))
    found = lists.select(key, F.exists("rows", lambda x: x["headed"]).alias("headed"), F.flatten(scan(F.concat("rows", F.array(end)), start, _list_step, _LISTED)).alias("found"))
    last = let(F.col("found"), lambda f: F.filter(f, lambda x: x["number"].isNotNull() & (x["epoch"] == F.element_at(f, -1)["epoch"])))
    first = lambda f: F.get(f, 0)["number"]
    begins = lambda n: F.when(n.between(100, 999), n % 100).otherwise(n).isin(0, 1)
    kept = let(last, lambda f: F.when(F.col("headed") | begins(first(f)), f))
    return found.select(key, F.posexplode(kept).alias("ord", "x")).select(key, (F.col("ord") + 1).cast("long").alias("ord"), "x.pos", "x.number")


def best_run(runs: DataFrame, key: str, expected: DataFrame | None = None) -> DataFrame:
    """One run per document: one of the expected length if there is one, else the longest, the earliest of equals. expected: key, expected."""
    rows = runs if expected is None else runs.join(expected, key, "left")
    exact = F.lit(1) if expected is None else F.when(F.col("n") == F.col("expected"), 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(exact, F.desc("n"), "starts"))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def fill_sequence_gaps(items: DataFrame, expected: DataFrame, key: str, other: DataFrame | None = None, least_run: int = 3) -> DataFrame:
    """(key, number, title, filled): numbers 1 to N of each record with at most max(3, N / 5) missing; gaps take the other list's title or Unknown.

    A list of at least `least_run` titles without a gap that ends before N is padded to N,
    however many are missing. items and other: key, number, title. expected: key, n.
    """
    wanted = expected.select(key, "n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("number"))
    joined = wanted.join(items.select(key, "number", "title"), [key, "number"], "left")
    if other is not None:
        joined = joined.join(other.select(key, "number", F.col("title").alias("__other")), [key, "number"], "left")
    whole = Window.partitionBy(key)
    joined = joined.withColumns({"missing": F.count_if(F.col("title").isNull()).over(whole), "__top": F.max(F.when(F.col("title").isNotNull(), F.col("number"))).over(whole)})
    run = F.col("n") - F.col("missing")
    spare = F.col("__other") if other is not None else F.lit(None).cast("string")
    out = joined.where((F.col("missing") <= F.greatest(F.lit(3), F.floor(F.col("n") / 5))) | ((F.col("__top") == run) & (run >= least_run)))
    return out.select(key, F.col("number").cast("long").alias("number"), F.coalesce("title", spare, F.lit("Unknown")).alias("title"), F.col("title").isNull().alias("filled"))


def running_numbers(items: DataFrame, key: str, ord_: str, number: str, title: str) -> DataFrame:
    """(key, ord, number, title): items keep their number or get one more than the highest so far; lines that only say encore are left out."""
    rows = items.where(~F.lower(F.trim(title)).rlike("^(encore|e)\\s*:?$"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), F.col(number).cast("long").alias("n"), F.col(title).alias("t")))).alias("rows"))
    kind = "struct<o:bigint,n:bigint,t:string>"

    def step(top: Column, x: Column) -> Column:
        n = F.coalesce(x["n"], top + 1)
        return F.struct(F.greatest(top, n).alias("state"), F.struct(x["o"].cast("long").alias("o"), n.alias("n"), x["t"].alias("t")).alias("out"))

    folded = lists.select(key, F.explode(scan(F.col("rows"), F.lit(0).cast("long"), step, kind)).alias("r"))
    return folded.select(key, F.col("r.o").alias("ord"), F.col("r.n").alias("number"), F.col("r.t").alias("title"))


def order_files(files: DataFrame, folder: str, name: str) -> DataFrame:
    """(folder, name, disc, track, number, title): files by disc, track and name; the disc comes from the name, else from the folder, else 1."""
    stem = F.regexp_replace(name, "\\.[A-Za-z0-9]+$", "")
    in_name, in_folder = F.regexp_extract(stem, "(?i)^d(?:isc)?\\s*([0-9]{1,2})[ _-]*t?", 1), F.regexp_extract(folder, "(?i)(?:cd|disc|disk)\\s*([0-9]{1,2})\\s*$", 1)
    disc = F.coalesce(F.expr("try_cast(nullif(__a, '') as bigint)"), F.expr("try_cast(nullif(__b, '') as bigint)"), F.lit(1))
    track = F.regexp_extract(F.regexp_replace(stem, "(?i)^d(?:isc)?\\s*[0-9]{1,2}[ _-]*", ""), "(?i)^t?([0-9]{1,3})", 1)
    rows = files.withColumns({"__a": in_name, "__b": in_folder}).withColumn("disc", disc).withColumn("track", F.coalesce(track.try_cast("bigint"), F.lit(0)))
    title = text.clean_title(F.regexp_replace(F.regexp_replace(stem, "(?i)^(d(isc)?\\s*[0-9]{1,2}[ _-]*)?t?[0-9]{1,3}[ ._-]*", ""), "_", " "))
    number = F.row_number().over(Window.partitionBy(folder).orderBy("disc", "track", F.lower(name), name))
    return rows.select(folder, name, "disc", "track", number.cast("long").alias("number"), title.alias("title"))


_DATE_LINE = "^[0-9]{1,4}[-./ ][0-9]{1,2}[-./ ][0-9]{1,4}$"
_FIELD_LINE = f"(?i)^({'|'.join(rules.FIELD_LABELS)})\\s*[:=-]"


def header_section(docs: DataFrame, key: str, body: str, limit: int = 80, ahead: int = 8, evidence: int = 3) -> DataFrame:
    """(key, pos, line): lines before the first boundary, without blank lines and rules.

    Boundaries are section labels, and list or checksum lines that another one follows
    within `ahead` lines, rules aside. In short texts one such line is enough: after
    `evidence` header lines, with at most one line among the next three. Dates and labelled
    fields never end a header.
    """
    rows = lines(docs, key, body, limit).where(F.trim("line").rlike("[A-Za-z0-9]") | ((F.trim("line") != "") & (F.length(F.trim("line")) < 3)))
    one = text.compact(F.col("line"))
    field = one.rlike(_DATE_LINE) | one.rlike(_FIELD_LINE)
    checksum = one.rlike("[0-9]") & F.array_max(F.array(*[one.rlike(p) for p in rules.CHECKSUM_LINES]))
    listed = (F.col("line").rlike(rules.LIST_LINES[0]) | checksum) & ~field
    label = F.lower(F.trim("line")).rlike("^(tracks?|track list|setlist|set list|songs)\\s*:?$|^(set|disc|cd)\\s*[0-9]+\\s*:?$")
    told = ~listed & (field | ~is_prose(F.col("line")))
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumns({"listed": listed, "label": label, "told": told.cast("int")})
    again = F.coalesce(F.lead("listed").over(w) & (F.lead("pos").over(w) < F.col("pos") + ahead), F.lit(False))
    left, before = F.count("*").over(w.rangeBetween(0, 3)), F.coalesce(F.sum("told").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("edge", F.col("label") | (F.col("listed") & (again | ((before >= evidence) & (left <= 2)))))
    cut = F.min(F.when(F.col("edge"), F.col("pos"))).over(Window.partitionBy(key))
    return rows.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("pos") < F.col("cut"))).select(key, "pos", "line")


def split_blocks(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, block, first, last, n): blocks of lines between blank lines or rules."""
    rows = lines(docs, key, body).withColumn("gap", F.trim("line").rlike("^[-=_*~ ]*$"))
    block = F.sum(F.col("gap").cast("int")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    full = rows.withColumn("id", block).where("not gap").groupBy(key, "id").agg(F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last"), F.count("*").alias("n"))
    return full.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("first")).cast("long")).drop("id")


def blocks_of_total(blocks: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, first_block, last_block): the shortest, then earliest run of neighbouring blocks with the expected number of lines. expected: key, expected."""
    total = F.sum("n").over(Window.partitionBy(key).orderBy("block"))
    ends = blocks.withColumn("upto", total)
    starts = ends.select(key, F.col("block").alias("first_block"), (F.col("upto") - F.col("n")).alias("before"))
    wanted = ends.join(expected, key).withColumn("before", F.col("upto") - F.col("expected"))
    runs = wanted.join(starts, [key, "before"]).where("first_block <= block")
    best = runs.groupBy(key).agg(F.min(F.struct((F.col("block") - F.col("first_block")).alias("len"), F.col("first_block").alias("first"), F.col("block").alias("last"))).alias("b"))
    return best.select(key, F.col("b.first").alias("first_block"), F.col("b.last").alias("last_block"))


def select_source(candidates: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, source, n, fits): the first source by priority whose items have the expected number; else the one that comes nearest.

    candidates: key, source, priority, item. expected: key, expected.
    """
    counts = candidates.groupBy(key, "source", "priority").agg(F.count("item").alias("n")).join(expected, key)
    fits = F.col("n") == F.col("expected")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs(F.col("n") - F.col("expected")), "priority", "source"))
    return counts.withColumn("__rank", rank).where("__rank = 1").select(key, "source", "n", fits.alias("fits"))


def positional_fill(items: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """(key, pos, title): unknown titles replaced by those at the same place of the record's longest list (least list name of equals).

    items: key, pos, title. lists: key, list, pos, title.
    """
    sizes = lists.groupBy(key, "list").agg(F.count("*").alias("n"))
    longest = sizes.groupBy(key).agg(F.min(F.struct(-F.col("n"), F.col("list").alias("list"))).alias("b")).select(key, "b.list")
    spare = lists.join(longest, [key, "list"]).select(key, "pos", F.col("title").alias("__spare"))
    known = F.when(F.lower(F.trim("title")) != "unknown", text.blank_to_null(F.col("title")))
    return items.join(spare, [key, "pos"], "left").select(key, "pos", F.coalesce(known, "__spare", F.lit("Unknown")).alias("title"))


def structured_header(header: DataFrame, key: str) -> DataFrame:
    """(key, shape, entity, date, venue, location): the first shape of lines that a location line anchors.

    header: key, pos, line. Shapes: entity/venue/location/date, entity/date/venue/location,
    and entity/combined/date, whose second line is "venue, city, country". A location is
    "a, b".
    """
    w = Window.partitionBy(key).orderBy("pos")
    rows = header.withColumns({f"l{i}": F.lead("line", i).over(w) for i in (1, 2, 3)})
    date, place = lambda c: F.trim(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), lambda c: F.trim(c).rlike("^[^,0-9]+, *[^,0-9]+$")
    joined = "^([^,]+), *([^,0-9]+, *[^,0-9]+)$"
    plain = ~date("line") & ~F.col("line").contains(",")
    shapes = {"entity/venue/location/date": plain & place("l2") & date("l3"), "entity/date/venue/location": plain & date("l1") & place("l3"), "entity/combined/date": plain & F.trim("l1").rlike(joined) & date("l2")}
    shaped = rows.withColumn("shape", F.coalesce(*[F.when(fits, name) for name, fits in shapes.items()])).where("shape is not null")
    first = shaped.withColumn("__rank", F.row_number().over(w)).where("__rank = 1")
    by = lambda *columns: F.trim(F.coalesce(*[F.when(F.col("shape") == name, c) for name, c in zip(shapes, columns, strict=True)]))
    part = lambda i: F.regexp_extract(F.trim("l1"), joined, i)
    return first.select(key, "shape", F.trim("line").alias("entity"), by(F.col("l3"), F.col("l1"), F.col("l2")).alias("date"), by(F.col("l1"), F.col("l2"), part(1)).alias("venue"), by(F.col("l2"), F.col("l3"), part(2)).alias("location"))
