"""Inputs on which queries once differed from their SQL or left their limits."""

from datetime import datetime
from pathlib import Path

import duckdb
import pyarrow.parquet as pq

from shelfmark import queries
from shelfmark.operators import dates as date_jobs
from shelfmark.operators import joins
from shelfmark.queries import plans
from shelfmark.streaming import arrivals

FOUND, SQL = queries.load()


def both(spark, path, name, **tables):
    """Sorted rows of a query and of its SQL over small tables (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        pq.write_table(df.toArrow(), f"{path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    got = FOUND[name](spark, str(path))
    cur = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})")
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    return order(got.collect()), order(cur.fetchall())


def written(df):
    """Rows that the exchanges of a plan that was run have written."""
    found, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if kind == "Exchange":
            found[node.id()] = node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return sum(found.values())


def test_usable_documents_of_few_ascii_letters(spark, tmp_path):
    """three letters of which one is not ASCII are not enough; rows that repeat a doc_id stay one each."""
    docs = [(1, "Erö.", "src1"), (2, "Ero.", "src1"), (3, "ÄÖÜ", "src2"), (4, "abc", "src7"), (5, "abc", "src1"), (5, "abc def", "src1"), (6, None, "src1"), (7, "abc", None)]
    got, want = both(spark, tmp_path, "f5_usable_documents", documents=(docs, "doc_id long, text string, source string"))
    assert got == want and len(want) == 3


def test_documents_are_read_as_they_were_written(spark, tmp_path):
    """two Latin letters of windows-1252 for one of UTF-8, characters beyond U+FFFF, texts without a Latin letter."""
    texts = ["Ein. Enener enß denschzuer scher, keitachau.", "Übel. Über, süß!", "well 😀 said 😀", "😀😀", "Привет, мир", "Привет", ".", "--", "...!", "a", "ß", "ÄÖÜß.", "", None, "日本語 1999", "line\nline\r\n\tß " * 20_000, "😀 night, " * 20_000]
    docs = [(3 * i + n, x) for i, x in enumerate(texts) for n in range(3)]
    got, want = both(spark, tmp_path, "s4_read_documents", documents=(docs, "doc_id long, text string"))
    assert got == want


def test_duplicates_leave_no_runs_of_titles(spark, tmp_path):
    """titles go to names by filtered pieces; what is shuffled grows with the names and the matches, not with the characters of all titles."""
    customers = [(i, f"Customer#{i:09d}", i % 3, "BUILDING") for i in range(401)]
    orders = [(i, i % 401, datetime(1996, 1, 1 + i % 5)) for i in range(8_000)]
    nations = [(i, f"NATION_{i}") for i in range(3)]
    tables = {"customer": (customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"), "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"), "nation": (nations, "n_nationkey int, n_name string")}
    got, want = both(spark, tmp_path, "j9_match_potential_duplicates", **tables)
    assert got == want and len(want) > 500
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = FOUND["j9_match_potential_duplicates"](spark, str(tmp_path))
        plan.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written(plan) < 6 * len(orders)


def test_arrivals_of_many_titles_keep_to_the_disk(spark, tmp_path, monkeypatch):
    """no exact median (one task held every value of it), and the states are in RocksDB, not in an executor's heap."""
    customers = [(i, f"Customer#{i:09d}", i % 3, "BUILDING") for i in range(40)]
    orders = [(i, i % 41, datetime(1996, 1, 1 + i % 7)) for i in range(400)]
    nations = [(i, f"NATION_{i}") for i in range(3)]
    tables = {"customer": (customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"), "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"), "nation": (nations, "n_nationkey int, n_name string")}
    monkeypatch.setattr(plans.F, "median", None)
    places, own = [], plans.scratch
    monkeypatch.setattr(plans, "scratch", lambda *a: places.append(own(*a)) or places[-1])
    got, want = both(spark, tmp_path, "t1_alias_arrivals", **tables)
    assert got == want and {r[1] for r in want} == {"new", "duplicate"}
    assert list(Path(places[0], "state", "state", "0", "0").glob("*.zip")) or list(Path(places[0], "state", "state", "0", "0").glob("*.changelog"))
    assert spark.conf.get(arrivals._PROVIDER, None) is None


def test_names_are_not_compared_with_every_title_of_a_date():
    """a name looks into the titles that hold a rare piece of it only."""
    keys = [f"customer {i:09d} 1996 01 01" for i in range(3_000)]
    known, names = arrivals._Titles(list(keys), list(keys)), [f"customer {i:09d}" for i in range(0, 6_000, 2)]
    known.expect(names)
    assert [known.match("x", [n]) for n in names[:1_500]] == keys[::2] and not any(known.match("x", [n]) for n in names[1_500:])
    assert max(len(p) for listed in known.holders.values() for p in listed.values()) <= 200
    known.add("night of customer 000005998", "late")
    assert known.match("x", [names[-1]]) == "late" and known.match("x", ["night of customer 000005998 and more"]) == "late"


def test_texts_of_many_records_are_read_once(spark, tmp_path, monkeypatch):
    """places, names and dates are looked up for distinct texts, and no filter evaluates the search for dates again."""
    customers = [(i, f"Customer#{i:09d}", i % 3, "BUILDING") for i in range(20)]
    orders = [(i, i % 20, datetime(1996, 1, 1 + i % 28)) for i in range(600)]
    nations, regions = [(i, f"NATION_{i}", i % 2) for i in range(3)], [(i, name) for i, name in enumerate(["AFRICA", "ASIA"])]
    tables = {"customer": (customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"), "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"), "nation": (nations, "n_nationkey int, n_name string, n_regionkey int"), "region": (regions, "r_regionkey int, r_name string")}
    counts, geo, aliases, dates = {}, joins.geo_resolve, joins.resolve_aliases, date_jobs.extract_dates

    def counted(name, operator):
        def run(df, *rest, **options):
            counts.setdefault(name, []).append(df.count())
            return operator(df, *rest, **options)

        return run

    monkeypatch.setattr(joins, "geo_resolve", counted("geo", geo))
    monkeypatch.setattr(joins, "resolve_aliases", counted("aliases", aliases))
    monkeypatch.setattr(date_jobs, "extract_dates", counted("dates", dates))
    got, want = both(spark, tmp_path, "e1_places_tags_collisions", **tables)
    assert got == want and len(want) == 600
    assert max(counts["geo"]) <= 10 and max(counts["aliases"]) <= 30
    # of the names, one a folder; the parts of paths; the tags
    assert len(counts["dates"]) == 3 and sum(counts["dates"]) <= len(orders) + 30 + 30
    plan = dates(spark.createDataFrame([(1, "Act 1999-01-02")], "id int, t string"), "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(date_jobs.FAMILIES[0][1]) == 1
