"""The inverted index gives the rows of a scan, reads candidates only, grows by deliveries, and outlives failed ones."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.search import SearchError
from shelfmark.operators import search_index
from shelfmark.operators.filters import deep_search
from shelfmark.sources.files import scratch

WORDS = "the License of granted Öl ÖL straße STRASSE a zz license-free ﬁ 漢字かな rights reserved all x1 x2 x3".split()
SEARCHES = ["license", "LICENSE |AND| granted", "öl", "straße |OR| 漢字か", "(rights reserved |OR| x1) |AND| zz", "zz", "a", "zz |AND| license", "zz |OR| license", "nowhere", "license |AND| nowhere", '"the license"', "needle"]


def documents(spark, seed, n, at=0):
    rng = random.Random(seed)
    rows = [(f"{'Ab'[rng.randrange(2)]}/{at + i}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 25))) + ("\nhay needle" if i % 97 == 5 else ""), i) for i in range(n)]
    return spark.createDataFrame([*rows, (f"z/{at}", None, 1), (f"z/{at}e", "", 1)], "path string, text string, n int")


@pytest.fixture
def index(spark):
    out = search_index.SearchIndex(spark, scratch(spark, "index"))
    out.add(documents(spark, 1, 300), "path", "text", per_range=40)
    return out


def test_rows_of_a_scan_over_deliveries(spark, index):
    every = documents(spark, 1, 300)
    for delivery in range(2):
        for e in SEARCHES:
            assert [tuple(r) for r in index.search(e).collect()] == [tuple(r) for r in deep_search(every, e, "path").collect()], e
        if not delivery:
            more = documents(spark, 2, 150, 1_000)
            index.add(more, "path", "text", per_range=40)
            every = every.unionByName(more)


def test_many_candidates_are_joined(spark, index, monkeypatch):
    monkeypatch.setattr(search_index, "MOST_LISTED", 3)
    for e in SEARCHES[:6]:
        assert index.search(e).count() == deep_search(documents(spark, 1, 300), e, "path").count()


def test_bodies_of_candidates_only(spark, index):
    read = index.bodies("needle")
    assert 0 < read.count() <= 10 * deep_search(documents(spark, 1, 300), "needle", "path").count() < 300
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "__range" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "In(__doc" in plan
    assert index.bodies("nowhere").count() == 0
    assert index.candidates("a") is None and index.candidates("a |OR| license") is None and index.candidates("a |AND| license") is not None


def test_what_a_failed_delivery_left_is_not_read(spark, index):
    """It fails at its last step, the row in deliveries."""
    create = type(spark).createDataFrame
    try:
        type(spark).createDataFrame = lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost"))
        with pytest.raises(RuntimeError):
            index.add(spark.range(50).select(F.concat(F.lit("q/"), "id").alias("path"), F.lit("needle").alias("text"), F.lit(1).alias("n")), "path", "text")
    finally:
        type(spark).createDataFrame = create
    assert index.search("needle").count() == deep_search(documents(spark, 1, 300), "needle", "path").count()


def test_errors(spark, index):
    with pytest.raises(SearchError):
        index.search(" ")
    with pytest.raises(SearchError):
        index.search("(a")
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame([("a", "b")], "path string, body string"), "path", "body")
    with pytest.raises(ValueError):
        search_index.SearchIndex(spark, scratch(spark, "empty")).search("license")
