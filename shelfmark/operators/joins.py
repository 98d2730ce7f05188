"""Joins (J1 to J19). Containment and prefixes become equi joins on exploded words, n-grams or ancestors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths, text
from shelfmark.functions.folds import let
from shelfmark.functions.sketch import key_filter
from shelfmark.operators.projections import term_variants
from shelfmark.operators.trees import enclosing, folder_digests, folder_of, proper
from shelfmark.operators.windows import RICH
from shelfmark.sources.files import stored


def resolve_aliases(df: DataFrame, key: str, name: str, terms: DataFrame) -> DataFrame:
    """(key, status, candidates): entities whose term equals a variant of the name without regard to case.

    terms: entity, term. status is matched, collision or no_match; candidates are sorted.
    """
    wanted = term_variants(df, key, name).select(key, F.lower("variant").alias("folded"))
    known = terms.select("entity", F.lower(text.compact(F.col("term"))).alias("folded")).distinct()
    found = wanted.join(known, "folded").groupBy(key).agg(F.array_sort(F.collect_set("entity")).alias("candidates"))
    out = df.select(key).distinct().join(found, key, "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    n = F.size("candidates")
    return out.select(key, F.when(n == 1, "matched").when(n > 1, "collision").otherwise("no_match").alias("status"), "candidates")


def entity_terms(terms: DataFrame, search: DataFrame) -> DataFrame:
    """(search, entity, terms): every entity that has a searched term, with all its terms by (order, id). terms: entity, id, order, term."""
    hits = search.select(F.lower("search").alias("folded"), "search").join(terms.select("entity", F.lower("term").alias("folded")), "folded").select("search", "entity").distinct()
    listed = terms.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("order", "id", "term"))).alias("rows"))
    return hits.join(listed, "entity").select("search", "entity", F.transform("rows", lambda r: r["term"]).alias("terms"))


def _phrases(phrases: DataFrame) -> DataFrame:
    keyed = phrases.select("phrase", text.compare_key(F.col("phrase")).alias("gram")).where("gram <> ''")
    return keyed.groupBy("gram").agg(F.min("phrase").alias("phrase"))


def _dictionary_windows(df: DataFrame, key: str, line_keys: Column, phrases: DataFrame, widest: int) -> tuple[DataFrame, DataFrame]:
    """(key, x) of every text with x, the array of (gram, width, pos) of word windows that the dictionary may hold, and the dictionary (gram, phrase) itself.

    line_keys are the comparison keys of a text's lines. Filters of the first words and of
    the whole grams are probed where the windows are made, so nearly all others never leave
    their row. The time is linear in the number of words.
    """
    known = stored(_phrases(phrases), "dictionary")
    count = known.count()
    begins = known.select(F.substring_index("gram", " ", 1).alias("word")).distinct()
    whole, holds = key_filter(known, "gram", count)
    first, begun = key_filter(begins, "word", count)

    def of_line(words: Column, bits: Column, pos: Column) -> Column:
        gram = lambda i, n: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
        window = lambda c, n: F.struct(c.alias("gram"), F.lit(n).alias("width"), pos.alias("pos"))
        there = lambda x: (x["gram"] != "") & holds(bits["whole"], x["gram"])
        if widest == 1:
            return F.transform(F.filter(words, lambda w: (w != "") & holds(bits["whole"], w)), lambda w: window(w, 1))
        starts = F.filter(F.transform(words, lambda w, i: F.when(begun(bits["first"], w), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(starts, lambda i: F.filter(F.array(*[window(F.when(i + n <= F.size(words), gram(i, n)), n) for n in range(1, widest + 1)]), there)))

    every = lambda bits: F.flatten(F.transform("__lines", lambda line, p: let(F.split(F.trim(line), " "), lambda words: of_line(words, bits, p))))
    rows = df.select(key, line_keys.alias("__lines"), F.struct(whole.alias("whole"), first.alias("first")).alias("__bits"))
    return rows.select(key, let(F.col("__bits"), every).alias("x")), known


def _line_keys(c: Column) -> Column:
    """Comparison keys of the lines of a text, by one pass over the whole of it."""
    low = F.replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")), F.lit("&"), F.lit(" and "))
    return F.split(F.regexp_replace(low, "[^a-z0-9\n]+", " "), "\n")


def scan_phrases(df: DataFrame, key: str, line: str, phrases: DataFrame, widest: int = 4) -> DataFrame:
    """(key, phrase, width): dictionary phrases inside a text, all those of the widest width that has one.

    `widest` is the number of words of the longest phrase.
    """
    rows, known = _dictionary_windows(df, key, F.array(text.compare_key(F.col(line))), phrases, widest)
    found = rows.select(key, F.explode("x").alias("x")).select(key, "x.gram", "x.width").distinct()
    hits = found.join(known, "gram").select(key, "phrase", "width").distinct()
    best = hits.groupBy(key).agg(F.max("width").alias("width"))
    return hits.join(best, [key, "width"]).select(key, "phrase", F.col("width").cast("long").alias("width"))


# Score of a dictionary hit.
HIT, LETTERS, EARLY, FIRST_LINES = 72, 20.0, 15, 10


def best_dictionary_hit(docs: DataFrame, key: str, body: str, phrases: DataFrame, widest: int = 4) -> DataFrame:
    """(key, phrase, line, score): best entry by 72 + min(20, size / 4) - line / 2, and 15 more in the first ten lines; ties by line, then entry.

    Windows that the dictionary may hold are reduced to distinct ones with their first line
    inside the row, so each goes to the dictionary once.
    """
    rows, known = _dictionary_windows(docs, key, _line_keys(F.col(body)), phrases, widest)
    by_gram = F.sort_array(F.transform("x", lambda x: F.struct(x["gram"], x["pos"])))
    first_of = let(by_gram, lambda g: F.filter(g, lambda x, i: (i == 0) | (F.get(g, i - 1)["gram"] != x["gram"])))
    found = rows.select(key, F.explode(first_of).alias("x")).select(key, "x.gram", F.col("x.pos").alias("line"))
    first = found.join(known, "gram").groupBy(key, "phrase").agg(F.min("line").alias("line"))
    score = HIT + F.least(F.lit(LETTERS), F.length("phrase") / 4) - F.col("line") / 2 + F.when(F.col("line") < FIRST_LINES, EARLY).otherwise(0)
    best = first.withColumn("score", score).groupBy(key).agg(F.min(F.struct(-F.col("score"), F.col("line").alias("line"), F.col("phrase").alias("phrase"), F.col("score").alias("score"))).alias("b"))
    return best.select(key, "b.phrase", F.col("b.line").cast("long").alias("line"), "b.score")


def geo_resolve(df: DataFrame, key: str, tail: str, places: DataFrame, widest: int = 4) -> DataFrame:
    """(key, rest, venue, city, region, country) of a free text whose end names places.

    places: term, kind (country, region, city or venue), canonical, region, country. The
    longest country, region, city and venue term are taken off the end in this order; a
    place fills the wider fields that its row knows, so a short form such as "nyc" anchors
    all of them. A region with its country in one term, and a countryless region or city,
    must agree with what is already known.
    """
    both = places.where("kind = 'region' and country is not null").select(F.concat_ws(" ", "term", "country").alias("term"), F.lit("region").alias("kind"), "canonical", "region", "country")
    known = places.select("term", "kind", "canonical", "region", "country").unionByName(both).select(text.compare_key(F.col("term")).alias("term"), "kind", "canonical", "region", "country")
    out = df.select(key, text.compare_key(F.col(tail)).alias("rest")).withColumns({"city": F.lit(None).cast("string"), "region": F.lit(None).cast("string"), "country": F.lit(None).cast("string"), "venue": F.lit(None).cast("string")})
    for kind in ("country", "region", "city", "venue"):
        words = F.split("rest", " ")
        ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(widest), F.size(words))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, F.size(words) - n + 1, n), " ").alias("term")))  # noqa: B023
        own = known.where(F.col("kind") == kind).select("term", "canonical", F.col("region").alias("p_region"), F.col("country").alias("p_country"))
        hit = out.select(key, F.explode(ends).alias("e"), F.col("region").alias("k_region"), F.col("country").alias("k_country")).select(key, "e.n", "e.term", "k_region", "k_country").join(own, "term")
        agrees = (F.col("k_country").isNull() | F.col("p_country").isNull() | (F.col("k_country") == F.col("p_country"))) & (F.col("k_region").isNull() | F.col("p_region").isNull() | (F.col("k_region") == F.col("p_region")))
        best = hit.where(agrees).groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "canonical", "p_region", "p_country")).alias("b"))
        out = out.join(best, key, "left").withColumns({
            "rest": F.when(F.col("b").isNotNull(), F.array_join(F.slice(words, 1, F.greatest(F.size(words) + F.col("b.n"), F.lit(0))), " ")).otherwise(F.col("rest")),
            kind: F.coalesce(F.col("b.canonical"), kind),
            **({} if kind == "country" else {"country": F.coalesce("country", F.col("b.p_country"))}),
            **({"region": F.coalesce("region", F.col("b.p_region"))} if kind in ("city", "venue") else {}),
        }).drop("b")
    return out


def _equivalent(a: Column, b: Column) -> Column:
    return text.padded(a).contains(text.padded(b)) | text.padded(b).contains(text.padded(a))


def enrich_fill_blanks(df: DataFrame, sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str], fields: Sequence[str], required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table with blank fields filled from the sources in their order, and (keys, field, kept, offered, source) where they disagree.

    A source row counts only if its `required` fields are not blank; sources have one row
    for each key at most. region is not filled where country is known, nor the reverse.
    Values of which one lies inside the other at word borders agree.
    """
    out, differs = df.withColumns({f: text.blank_to_null(F.col(f)) for f in fields}), []
    for name, source in sources:
        complete = reduce(Column.__and__, [text.blank_to_null(F.col(f)).isNotNull() for f in required])
        offered = source.where(complete).select(*keys, *[text.blank_to_null(F.col(f)).alias(f"o_{f}") for f in fields])
        joined = out.join(offered, list(keys), "left")
        for f in fields:
            both = F.col(f).isNotNull() & F.col(f"o_{f}").isNotNull() & ~_equivalent(F.col(f), F.col(f"o_{f}"))
            differs.append(joined.where(both).select(*keys, F.lit(f).alias("field"), F.col(f).alias("kept"), F.col(f"o_{f}").alias("offered"), F.lit(name).alias("source")))
        filled = {}
        for f in fields:
            other = {"region": "country", "country": "region"}.get(f)
            free = F.col(other).isNull() if other in fields else F.lit(True)
            filled[f] = F.coalesce(F.col(f), F.when(free, F.col(f"o_{f}")))
        out = joined.withColumns(filled).drop(*[f"o_{f}" for f in fields])
    return out, reduce(DataFrame.unionByName, differs)


def best_fit_candidate(df: DataFrame, key: str, body: str, candidates: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(key, ord, score): of several candidates the one of the single best positive score, else the first; a field scores its weight if the text has it at word borders."""
    joined = candidates.join(df.select(key, text.padded(F.col(body)).alias("__text")), key)
    score = sum((F.when(text.blank_to_null(F.col(f)).isNotNull() & F.col("__text").contains(text.padded(F.col(f))), w).otherwise(0) for f, w in weights.items()), F.lit(0))
    scored = joined.withColumn("score", score.cast("long"))
    best = scored.groupBy(key).agg(F.max("score").alias("top"), F.min("ord").alias("first"))
    tops = scored.join(best, key).groupBy(key, "top", "first").agg(F.count_if(F.col("score") == F.col("top")).alias("n"), F.min(F.when(F.col("score") == F.col("top"), F.col("ord"))).alias("at"))
    chosen = tops.select(key, F.when((F.col("top") > 0) & (F.col("n") == 1), F.col("at")).otherwise(F.col("first")).alias("ord"))
    return chosen.join(scored.select(key, "ord", "score"), [key, "ord"])


def lookup_by_entity_date(requests: DataFrame, performances: DataFrame) -> DataFrame:
    """Performances of (entity, date) by comparison key, those with the exact entity if there are any.

    requests: request, entity, date. performances: id, entity, date.
    """
    r = requests.select("request", F.col("entity").alias("wanted"), text.compare_key(F.col("entity"), "lookup").alias("key"), "date")
    p = performances.select("id", "entity", text.compare_key(F.col("entity"), "lookup").alias("key"), "date")
    found = r.join(p, ["key", "date"]).withColumn("exact", F.lower("entity") == F.lower("wanted"))
    any_exact = F.max("exact").over(Window.partitionBy("request"))
    return found.withColumn("any_exact", any_exact).where("exact or not any_exact").select("request", "id", "exact")


def _pieces(key: Column, width: Column) -> Column:
    """Runs of `width` characters of a key; none where it is shorter."""
    count = F.length(key) - width + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(key, i, width))).otherwise(F.array().cast("array<string>"))


def _held(small: DataFrame, big: DataFrame) -> DataFrame:
    """(date, small, and the columns of big) where the key `big` holds the key `small` of the same date. small: distinct date, small.

    A small key is found by one piece of it, of the widest power of two that it has room for
    and the one that the fewest small keys of its date share. Pieces of big keys are looked
    up in a filter of those where they are made, so hardly any other row leaves its task.
    """
    cut = small.select("date", "small", F.pow(F.lit(2), F.floor(F.log2(F.length("small")))).cast("int").alias("width"))
    cut = cut.select("date", "small", F.explode(F.array_distinct(_pieces(F.col("small"), F.col("width")))).alias("piece"))
    shared = cut.groupBy("date", "piece").agg(F.count("*").alias("rows"))
    least = cut.join(shared, ["date", "piece"]).groupBy("date", "small").agg(F.min(F.struct("rows", "piece"))["piece"].alias("piece"))
    found = stored(least, "pieces")
    marks = found.select(F.concat_ws(" ", "date", "piece").alias("mark")).distinct()
    bits, may_hold = key_filter(marks, "mark", marks.count(), per_key=32)
    widths = F.coalesce(found.agg(F.collect_set(F.length("piece"))).scalar(), F.array().cast("array<int>"))

    def of_filter(own: Column) -> Column:
        known = lambda w: F.filter(_pieces(own["big"], w), lambda x: may_hold(own["bits"], F.concat_ws(" ", own["date"], x)))
        pieces = F.array_distinct(F.flatten(F.transform(own["widths"], known)))
        return F.transform(pieces, lambda x: F.struct(own["date"].alias("date"), own["big"].alias("big"), x.alias("piece")))

    # one struct, used once, so that key and filter are bound in the projection that probes them; explode_outer, as no filter that repeats the probes comes before it
    rest = [c for c in big.columns if c not in ("date", "big")]
    rows = big.select(*rest, F.struct(bits.alias("bits"), widths.alias("widths"), "date", "big").alias("__own"))
    met = rows.select(*rest, let(F.col("__own"), of_filter).alias("__x")).select(*rest, F.explode_outer("__x").alias("__x")).select(*rest, "__x.*")
    return met.join(found, ["date", "piece"]).where(F.col("big").contains(F.col("small"))).select(*big.columns, "small")


def match_potential_duplicates(new: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, title): catalog titles that hold the date of a new record and one of its names, or lie inside such a name.

    new: id, date, name (a row for each alias). Names meet titles by date and a piece of the
    one that lies inside (`_held`), and are compared then; a date with very many rows is not
    compared pair by pair. A title that lies inside a name brings its date along, so only
    names that hold their date as words can hold a title.
    """
    date = F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}"), 0)))
    named = new.select("id", F.col("date").cast("string").alias("date"), text.compare_key(F.col("name")).alias("n"))
    named = stored(named.where("n <> '' and date is not null").distinct(), "names")
    dated = catalog.select("title", date.alias("date"), text.compare_key(F.col("title")).alias("t"))
    holds = _held(named.select("date", F.col("n").alias("small")).distinct(), dated.withColumnRenamed("t", "big"))
    found = holds.select("title", "date", F.col("small").alias("n")).distinct().join(named, ["date", "n"]).select("id", "title")
    over = named.where(F.col("n").contains(F.replace("date", F.lit("-"), F.lit(" "))))
    longest = over.agg(F.max(F.length("n"))).first()[0]
    if longest is not None:
        short = dated.where(F.length("t") <= longest).join(over.groupBy("date").agg(F.max(F.length("n")).alias("most")), "date").where(F.length("t") <= F.col("most"))
        short = stored(short.select("date", "t", "title").distinct(), "titles")
        inside = _held(short.select("date", F.col("t").alias("small")).distinct(), over.select("id", "date", F.col("n").alias("big")))
        found = found.unionByName(inside.join(short.withColumnRenamed("t", "small"), ["date", "small"]).select("id", "title"))
    return found.distinct()


def exact_key_duplicates(new: DataFrame, catalog: DataFrame, id_: str, title: str) -> DataFrame:
    """(new_id, old_id): catalog rows whose comparison key equals that of a new title."""
    a = new.select(F.col(id_).alias("new_id"), text.compare_key(F.col(title)).alias("key")).where("key <> ''")
    b = catalog.select(F.col(id_).alias("old_id"), text.compare_key(F.col(title)).alias("key"))
    return a.join(b, "key").select("new_id", "old_id")


def replace_scopes(catalog: DataFrame, label: str, path: str, roots: DataFrame, replace_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, replaced): catalog rows outside and inside the re-scanned roots (label, root); with replace_all nothing is kept.

    Labels count without regard to case; a blank root stands for the whole label. Both
    parts come out of one sweep of the folder tree.
    """
    if replace_all:
        return catalog.limit(0), catalog
    scopes = roots.select(F.lower("label").alias("label"), "root")
    judged = enclosing(catalog, F.lower(label), F.col(path), scopes).withColumn("__inside", F.size("__above") > 0)
    rest = [F.col(f"`{c}`") for c in catalog.columns]
    return judged.where("not __inside").select(*rest), judged.where("__inside").select(*rest)


def remove_rows(catalog: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return catalog.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def overlapping_roots(roots: DataFrame, label: str, root: str) -> DataFrame:
    """(label, root, issue, other): repeated roots, and pairs of which one lies below the other, seen from both sides."""
    rows = roots.select(F.col(label).alias("label"), F.col(root).alias("root"))
    twice = rows.groupBy("label", "root").count().where("count > 1").select("label", "root", F.lit("duplicate").alias("issue"), F.col("root").alias("other"))
    one = rows.distinct()
    open_ = enclosing(one, F.col("label"), F.col("root"), one.where(F.size(paths.parts_of(F.col("root"))) > 0))
    pairs = open_.select("label", "root", F.explode(proper()).alias("up")).select("label", "root", F.col("up.root").alias("other"))
    return twice.unionByName(pairs.select("label", "root", F.lit("inside").alias("issue"), "other")).unionByName(pairs.select("label", F.col("other").alias("root"), F.lit("contains").alias("issue"), F.col("root").alias("other")))


def classify_root_relation(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(label, root, relation, action): how new roots lie to the stored ones of their label.

    relation joins exact, child (below a stored root) and parent; action is append_blank
    for a blank label, reinventory where there is a relation, else new.
    """
    wanted, known = (df.select("label", "root").distinct() for df in (new, stored))
    named = lambda df: df.where(F.size(paths.parts_of(F.col("root"))) > 0)
    own = F.exists("__above", lambda r: r["key"] == F.col("__key"))
    down = enclosing(wanted, F.col("label"), F.col("root"), named(known))
    down = down.select("label", "root", F.when(F.size(proper()) > 0, "child").alias("child"), F.when(own, "exact").alias("exact"))
    over = enclosing(known, F.col("label"), F.col("root"), named(wanted)).select("label", F.explode(proper()).alias("up"))
    over = over.select("label", F.col("up.root").alias("root"), F.lit("parent").alias("parent")).distinct()
    related = F.concat_ws(",", "child", "exact", "parent")
    out = down.join(over, ["label", "root"], "left").select("label", "root", F.when(related == "", "unrelated").otherwise(related).alias("relation"))
    return out.withColumn("action", F.when(F.col("label") == "", "append_blank").when(F.col("relation") == "unrelated", "new").otherwise("reinventory"))


def attach_documents(catalog: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, document, tier): documents of a catalog row (id, key), tier 1 with its very key, tier 2 for numbered alternates of it. documents: document, key."""
    base = F.regexp_replace("key", "\\(alt[0-9]+\\)$", "")
    exact = catalog.join(documents, "key").select("id", "document", F.lit(1).cast("long").alias("tier"))
    alternates = documents.withColumn("base", base).where("base <> key").select("document", F.col("base").alias("key"))
    return exact.unionByName(catalog.join(alternates, "key").select("id", "document", F.lit(2).cast("long").alias("tier")))


def orphan_documents(replaced: DataFrame, kept: DataFrame, documents: DataFrame, title: str) -> DataFrame:
    """Documents whose title only replaced rows have."""
    return documents.join(replaced.select(title).distinct(), title, "left_semi").join(kept.select(title).distinct(), title, "left_anti")


def manifest_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(path, status) of two manifests (path, size, sha256), which have one row for each path: missing, extra, size, hash or same.

    Folders whose files have the same digest on both sides are the same as wholes; files
    are joined one by one only where the digests of their folder differ.
    """
    folders = folder_digests(source, "s").join(folder_digests(target, "d"), "folder", "full")
    equal = F.coalesce((F.col("s_n") == F.col("d_n")) & (F.col("s_sum") == F.col("d_sum")), F.lit(False))
    # both decisions read one table, so the manifests are digested once
    alike = stored(folders.select("folder", equal.alias("equal")), "folders").where("equal").select("folder")

    def others(df: DataFrame, side: str) -> DataFrame:
        told = df.select("path", F.col("size").alias(f"{side}_size"), F.col("sha256").alias(f"{side}_hash"), F.lit(True).alias(side), folder_of(F.col("path")).alias("folder"))
        return told.join(alike, "folder", "left_anti").drop("folder")

    status = F.when(F.col("d").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("s_size") != F.col("d_size"), "size").when(~F.col("s_hash").eqNullSafe(F.col("d_hash")), "hash").otherwise("same")
    differ = others(source, "s").join(others(target, "d"), "path", "full").select("path", status.alias("status"))
    same = source.select("path", folder_of(F.col("path")).alias("folder")).join(alike, "folder", "left_semi").select("path", F.lit("same").alias("status"))
    return differ.unionByName(same)


def confirm_titles(titles: DataFrame, docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, n_titles, confirmed): a record's titles hold only if every one of their words of two or more letters is in its text; of titles without such a word all words count."""
    words = lambda c: F.filter(F.split(text.compare_key(c), " "), lambda w: w != "")
    every = words(F.col("title"))
    long = F.filter(every, lambda w: F.length(w) > 1)
    wanted = titles.select(key, "title", F.explode_outer(F.array_distinct(F.when(F.size(long) > 0, long).otherwise(every))).alias("word"))
    have = docs.select(key, F.explode(F.array_distinct(words(F.col(body)))).alias("word")).withColumn("there", F.lit(True))
    judged = wanted.join(have, [key, "word"], "left").groupBy(key, "title").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("ok"))
    return judged.groupBy(key).agg(F.count("*").alias("n_titles"), F.bool_and("ok").alias("confirmed"))


def candidate_documents(folders: DataFrame, documents: DataFrame, allowed_parents: DataFrame | None = None) -> DataFrame:
    """(folder, document, tier, rank): 1 own folder, 2 parent (if allowed), 3 info-named siblings, 4 folders below; the least tier of a pair, and the order of candidates.

    folders: folder. documents: document (path).
    """
    docs = documents.select("document", F.regexp_replace("document", "/[^/]*$", "").alias("place"))
    parent = F.regexp_replace("folder", "/[^/]*$", "")
    own = folders.join(docs.withColumnRenamed("place", "folder"), "folder").withColumn("tier", F.lit(1))
    ups = folders.select("folder", parent.alias("place"))
    if allowed_parents is not None:
        ups = ups.join(allowed_parents.select(F.col("parent").alias("place")), "place", "left_semi")
    above = ups.join(docs, "place").select("folder", "document", F.lit(2).alias("tier"))
    info = docs.where(F.lower(F.regexp_extract("place", "([^/]*)$", 1)).rlike("info|text|docs")).withColumn("up", F.regexp_replace("place", "/[^/]*$", ""))
    beside = folders.withColumn("up", parent).join(info, "up").where("place <> folder").select("folder", "document", F.lit(3).alias("tier"))
    tree = folders.where(F.size(paths.parts_of(F.col("folder"))) > 0).select(F.lit("").alias("label"), F.col("folder").alias("root"))
    below = enclosing(docs, F.lit(""), F.col("place"), tree).select("document", F.explode(proper()).alias("f")).select(F.col("f.root").alias("folder"), "document", F.lit(4).alias("tier"))
    every = own.select("folder", "document", "tier").unionByName(above).unionByName(beside).unionByName(below)
    best = every.groupBy("folder", "document").agg(F.min("tier").cast("long").alias("tier"))
    # own folder, parent with its info folders, folders below; rich formats before the others in each
    near = F.when(F.col("tier") == 1, 1).when(F.col("tier") == 4, 3).otherwise(2)
    rich = F.lower(F.regexp_extract("document", "\\.([^./]*)$", 1)).isin(*RICH)
    order = Window.partitionBy("folder").orderBy(near, (~rich).cast("int"), "tier", F.lower("document"), "document")
    return best.withColumn("rank", F.row_number().over(order).cast("long"))
