"""Literal examples of the operators."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import dates, paths, search, text
from shelfmark.operators import dates as date_jobs
from shelfmark.operators import filters, groups, joins, windows
from shelfmark.plans.catalog import build_catalog
from shelfmark.streaming import arrivals


def value(spark, column, **cells):
    """One column over one row of text cells."""
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in cells.items()])
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("parts", "want"),
    [(("34", "1", "2"), "2034-01-02"), (("35", "1", "2"), "1935-01-02"), (("2001", "04", "1x"), "2001-04-1x"), (("20xx", "xx", "xx"), "20xx-xx-xx"), (("2001", "xx", "04"), None), (("2001", "2", "30"), None), (("2001", "13", "1"), None), ((None, "1", "1"), None)],
)
def test_partial_dates(spark, parts, want):
    y, m, d = parts
    assert value(spark, dates.partial_date(F.col("y"), F.col("m"), F.col("d")), y=y, m=m, d=d) == want


@pytest.mark.parametrize(("shown", "want"), [("96-98", "1996-1998"), ("1917-1939", "1917-1939"), ("1998-97", None), ("24-96", None), ("1996_98", "1996-1998"), ("1996-97_98", None), ("1990-99", None), ("", None)])
def test_year_ranges(spark, shown, want):
    assert value(spark, dates.year_range(F.col("s")), s=shown) == want


@pytest.mark.parametrize(("a", "b", "want"), [("1997-11-05", "1997-11-xx", True), ("1997-11-05", "1997-12-xx", False), ("1996-1998", "1997-01-01", True), ("1996-1998", "1999-01-01", False), ("1996-1998", "1996-1998", True), (None, "1997-01-01", False)])
def test_compatible_dates(spark, a, b, want):
    assert value(spark, dates.compatible(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize(("shown", "want"), [("14APR01", ["2001-04-14"]), ("Apr142001", ["2001-04-14"]), ("2001APR14", ["2001-04-14"]), ("44.1/16", []), ("24/96", []), ("2001 04-14", []), ("a 2001-04-14 b 2002.05.01", ["2001-04-14", "2002-05-01"]), ("", [])])
def test_extract_dates(spark, shown, want):
    rows = spark.createDataFrame([(1, shown), (2, None)], "id int, t string")
    found = date_jobs.extract_dates(rows, "id", "t").where("kind <> 'range'").orderBy("start").collect()
    assert [r.normal for r in found] == want
    assert all(shown[r.start : r.start + len(r.raw)] == r.raw for r in found)


def test_ascii_and_keys(spark):
    assert value(spark, text.ascii_text(F.col("s")), s="Mötley  Crüe – “live”… ß œ\t\u4f60") == 'Motley Crue - "live"... ss oe'
    assert value(spark, text.ascii_text(F.col("s"), F.lit("none")), s="\u4f60") == "none"
    assert value(spark, text.compare_key(F.col("s")), s=" Rock & Roll!! ") == "rock and roll"
    assert value(spark, text.compare_key(F.col("s"), "lookup"), s="The  Band") == "band"
    assert value(spark, text.compare_key(F.col("s"), "place"), s="Orléans") == "orleans"


def test_storage_and_parts(spark):
    assert value(spark, paths.storage_path(F.col("s")), s="/mnt/p/Artist//show/") == "/Artist/show"
    assert value(spark, paths.storage_path(F.col("s")), s="D:\\Music\\x") == "/Music/x"
    assert value(spark, paths.storage_label(F.col("s")), s=" [Local Disk] ") == ""
    assert value(spark, F.array_join(paths.ancestors(F.col("s")), " "), s="/a/b/c") == "/a /a/b /a/b/c"


@pytest.mark.parametrize(("expression", "hits"), [("red |OR| blue |AND| big", ["big blue", "red"]), ("(red |or| blue) |and| big", ["big blue"]), ('"big blue"', ["big blue"]), ("", ["big", "big blue", "red"]), ("RED", ["red"])])
def test_search(spark, expression, hits):
    rows = spark.createDataFrame([("big blue",), ("red",), ("big",)], "s string")
    assert sorted(r.s for r in filters.boolean_search(rows, ["s"], expression).collect()) == hits


@pytest.mark.parametrize("expression", ["(a", "a)", "a |AND|", "|OR| a", '"a', "a (b)", '""'])
def test_search_errors(spark, expression):
    with pytest.raises(search.SearchError):
        search.matches(expression, F.lit("x"))


def test_placeholder_documents(spark):
    rows = spark.createDataFrame([(1, "Folder never contained an info file."), (2, "x\nfolder never contained an info file"), (3, "y"), (4, None)], "id int, t string")
    assert sorted((r.id, r.only) for r in filters.marker_only_documents(rows, "t").collect()) == [(1, True), (2, False)]


def test_checksum_lines_are_no_titles(spark):
    body = "Artist: A\n01 Highway Star.flac:81b2a1f0c3d4e5f681b2a1f0c3d4e5f6\n01. Highway Star 4:05\n02) Lazy*\n1999-01-02 x"
    docs = spark.createDataFrame([(1, body), (2, ""), (3, None)], "id int, t string")
    assert [(r.number, r.title) for r in date_jobs.numbered_items(docs, "id", "t").orderBy("pos").collect()] == [(1, "Highway Star"), (2, "Lazy")]
    profile = {r.id: r for r in groups.document_line_profile(docs, "id", "t").collect()}
    assert profile[1].n_checksum == 1 and not profile[1].unreadable and profile[2].unreadable and profile[3].unreadable


def test_profile_reads_past_the_head(spark):
    sums = [f"{i:02d} song.flac:81b2a1f0c3d4e5f681b2a1f0c3d4e5f6" for i in range(130)]
    docs = spark.createDataFrame([(1, "\n".join([*sums, "A short line of prose", "and one more line of prose"])), (2, "\n".join(sums))], "id int, t string")
    profile = {r.id: r for r in groups.document_line_profile(docs, "id", "t").collect()}
    assert (profile[1].n_lines, profile[1].n_checksum, profile[1].n_info) == (132, 130, 2) and profile[1].score > profile[2].score
    assert not profile[1].checksum_only and profile[2].checksum_only and profile[2].n_lines == 130
    assert [r.name for r in filters.usable_documents(groups.document_line_profile(docs, "id", "t").withColumn("name", F.col("id").cast("string")), "name").collect()] == ["1"]


def test_scopes_cover_their_catalog(spark):
    rows = spark.createDataFrame([("A", "/x/1"), ("A", "/x/12"), ("B", "/x/1"), ("", "/y")], "label string, path string")
    kept, replaced = joins.replace_scopes(rows, "label", "path", spark.createDataFrame([("a", "/x/1"), ("b", "")], "label string, root string"))
    assert sorted(map(tuple, replaced.collect())) == [("A", "/x/1"), ("B", "/x/1")]
    assert kept.count() + replaced.count() == rows.count()
    assert joins.replace_scopes(rows, "label", "path", rows.selectExpr("label", "path root"), replace_all=True)[0].count() == 0


def test_alternates_by_size(spark):
    docs = spark.createDataFrame([("k", 10, 1), ("k", 20, 2), ("k", 10, 3), ("m", 5, 4)], "key string, size int, ord int")
    assert sorted((r.ord, r.name) for r in windows.assign_alternates(docs, "key", "size", "ord").collect()) == [(1, "k"), (2, "k(alt1)"), (3, "k"), (4, "m")]


def test_runs_restart_and_disc_jump(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([101, 102, 103, 104, 201, 202, 1, 2, 9])], "id int, pos int, n int")
    runs = [(r["first"], r["last"], r.n) for r in windows.sequence_runs(rows, "id", "pos", "n").orderBy("starts").collect()]
    assert runs == [(101, 202, 6), (1, 2, 2), (9, 9, 1)]


def test_places(spark):
    places = spark.createDataFrame([("France", "country", "France", None, None), ("Reims", "city", "Reims", None, "France"), ("St. Ingbert", "city", "St. Ingbert", None, "Germany")], "term string, kind string, canonical string, region string, country string")
    rows = spark.createDataFrame([(1, "Parc des Expos, Reims, France"), (2, "Hall, St. Ingbert"), (3, "Nowhere"), (4, "St. Ingbert, France"), (5, "")], "id int, t string")
    got = {r.id: (r.rest, r.city, r.country) for r in joins.geo_resolve(rows, "id", "t", places).collect()}
    assert got == {1: ("parc des expos", "Reims", "France"), 2: ("hall", "St. Ingbert", "Germany"), 3: ("nowhere", None, None), 4: ("st ingbert", None, "France"), 5: ("", None, None)}


def test_arrivals_meet_each_other_and_the_catalog(spark):
    batch = spark.createDataFrame([("a", 1, "One 1999"), ("b", 2, "one-1999"), ("c", 3, "Two"), ("d", 4, None)], "name string, ord long, title string")
    routed = arrivals.route(batch, spark.createDataFrame([("TWO!",)], "title string"))
    assert {r.name: r.route for r in routed.collect()} == {"a": "new", "b": "duplicate", "c": "duplicate", "d": "error"}
    assert tuple(arrivals.run_counts(routed).first()) == (4, 1, 2, 1)


def test_built_catalog_counts(spark):
    records = spark.createDataFrame([(1, 1, "A 1999", "A", "1999-01-01", "V", "", "L", "/x/1"), (2, 2, None, "B", "", "", "", "L", "/x/2")], "id long, ord long, title string, entity string, date string, venue string, location string, label string, path string")
    titles = spark.createDataFrame([(1, 1, "Song")], "id long, number int, title string")
    old = spark.createDataFrame([("old", "L", "/x/9"), ("stays", "L", "/y")], "title string, label string, path string")
    out = build_catalog(records, spark.createDataFrame([], "id long, ord int, text string"), titles, old, spark.createDataFrame([("L", "/x")], "label string, root string"))
    assert sorted(r.title for r in out["catalog"].collect()) == ["A 1999", "stays"]
    assert out["documents"].first().text == "Artist: A\nDate: 1999-01-01\nVenue: V\n\nTRACKS:\n01. Song"
    assert out["unresolved"].first().reason == "blank name"


def test_dates_of_rows_that_share_a_key(spark):
    rows = spark.createDataFrame([(1, "2001-04-14"), (1, "ab 2002-05-01"), (1, None)], "id int, t string")
    assert sorted(r.normal for r in date_jobs.extract_dates(rows, "id", "t").collect()) == ["2001-04-14", "2002-05-01"]


def test_every_mention_has_a_row(spark):
    rows = spark.createDataFrame([(1, "1999-01-02 Hall 2000-03-04 Town")], "id int, t string")
    got = [(r.mention, r.before, r.date, r.after, r.required) for r in date_jobs.split_around_date(rows, "id", "t").orderBy("mention").collect()]
    assert got == [(1, "1999-01-02 Hall", "2000-03-04", "Town", True), (2, "", "1999-01-02", "Hall 2000-03-04 Town", False)]


def test_item_forms(spark):
    text_ = "A1. First\nb2) Second\n1-03 Third\n[4] Fourth\ntrack 5 - Fifth\n6. 2001-01-02\n2001-01-02\nplain words"
    got = date_jobs.numbered_items(spark.createDataFrame([(1, text_)], "id int, t string"), "id", "t").orderBy("pos").collect()
    assert [(r.number, r.title) for r in got][:5] == [(1, "First"), (2, "Second"), (3, "Third"), (4, "Fourth"), (5, "Fifth")]


@pytest.mark.parametrize(
    ("shown", "want"),
    [("4 of 28 Song Title", "Song Title"), ("E: Midnight Hour", "Midnight Hour"), ("The Dance/ [12:25] tape flip", "The Dance"), ("Song 12:20 (end cut)", "Song"), ("[3:05] Song**", "Song"), ("Introduction 11-26", "Introduction"), ("-- 4:05 --", ""), ("1999", "1999"), ("...", "")],
)
def test_clean_titles(spark, shown, want):
    assert value(spark, text.clean_title(F.col("s")), s=shown) == want


def test_parts_of_a_list(spark):
    rows = [(1, i, n, h) for i, (n, h) in enumerate([(1, False), (2, False), (77, False), (3, False), (1, False), (2, False), (0, True), (1, False), (9, False), (10, False)])]
    got = windows.sequence_parts(spark.createDataFrame(rows, "id int, pos int, n int, head boolean"), "id", "pos", "n", "head").orderBy("pos").collect()
    assert [(r.n, r.part) for r in got] == [(1, 1), (2, 1), (3, 1), (1, 2), (2, 2), (0, 3), (1, 3)]


def test_headers_of_short_texts_and_rules(spark):
    docs = spark.createDataFrame([(1, "Act\nHall\nTown\n-----\n1. Only"), (2, "Act\n27. Jazz Festival\nTown\nHall\nmore"), (3, "Act\n1. One\n=====\n2. Two\nthree")], "id int, t string")
    got = {}
    for r in windows.header_section(docs, "id", "t").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.line)
    assert got == {1: ["Act", "Hall", "Town"], 2: ["Act", "27. Jazz Festival", "Town", "Hall", "more"], 3: ["Act"]}


def test_unreadable_and_checksum_texts(spark):
    sums = "\n".join(f"{i:032x} *t{i}.flac" for i in range(4))
    docs = spark.createDataFrame([(1, "ab"), (2, "a\x00b\x00c\x00"), (3, sums), (4, "14 May 1999\nLive at the hall\n1. One"), (5, None), (6, "x" * 20 + "\x01" * 30)], "id int, t string")
    got = {r.id: (r.unreadable, r.checksum_only, r.n_info) for r in groups.document_line_profile(docs, "id", "t").collect()}
    assert {i: x[0] for i, x in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}
    assert got[3][1] and got[3][2] == 0 and got[4][2] == 3


def test_titles_of_single_letters(spark):
    titles = spark.createDataFrame([(1, "A"), (2, "B")], "id int, title string")
    docs = spark.createDataFrame([(1, "Side A of it"), (2, "Side A of it")], "id int, text string")
    assert {r.id: r.confirmed for r in joins.confirm_titles(titles, docs, "id", "text").collect()} == {1: True, 2: False}
