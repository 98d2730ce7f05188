"""Arrivals against plain Python: dates and names, exact keys, errors, deliveries over restarts; containment joins against all pairs."""

import random
import re

from pyspark.sql import functions as F

from shelfmark.operators import joins
from shelfmark.sources.files import scratch
from shelfmark.streaming import arrivals

ARRIVAL = "name string, ord long, title string, date string, names array<string>"
BANDS = ["The Owls", "Owls", "Red & Blue", "Red and Blue Trio", "N", "Öre", "The Owls of Night"]


def key_of(x):
    return re.sub("[^a-z0-9]+", " ", (x or "").lower().replace("&", " and ")).strip()


def date_of(title, date):
    found = re.search("[0-9]{4}-[0-9]{2}-[0-9]{2}", title or "")
    return date or (found[0] if found else None)


def judged(known, batches):
    """Routes one by one, in the order of arrival."""
    held = [(date_of(t, None), key_of(t), t) for t in sorted(known) if key_of(t)]
    out = {}
    for batch in batches:
        for name, ord_, title, date, names in sorted(batch, key=lambda r: (r[1], r[2] or "", r[0])):
            key, when = key_of(title), date_of(title, date)
            own = [n for n in map(key_of, names or []) if n]
            hits = [t for d, k, t in held if (d == when if when else d is None) and (k == key or (when and any(n in k or k in n for n in own)))]
            out[name] = "error" if not key else "duplicate" if hits else "new"
            if out[name] == "new":
                held.append((when, key, title))
    return out


def arrival(rng, i):
    band, date = rng.choice(BANDS), f"1999-01-{rng.randrange(1, 6):02d}"
    title = rng.choice([f"{band} {date} Hall {rng.randrange(3)}", f"{band} {date}", f"{band} live", "", f"Night {i} {date}", f"{band.upper()}, {date}!", None, "???"])
    return (f"a{i}", rng.randrange(50), title, rng.choice([None, date]) if title else None, rng.choice([None, [], [band], [band, rng.choice(BANDS)], [f"{band} {date} Hall 1 and more", None]]))


def test_routes_over_deliveries_and_restarts(spark):
    rng = random.Random(9)
    known = [f"{rng.choice(BANDS)} 1999-01-{rng.randrange(1, 6):02d} Hall {rng.randrange(3)}" for _ in range(6)] + ["Owls live", ""]
    batches = [[arrival(rng, 100 * b + i) for i in range(60)] for b in range(3)]
    path = scratch(spark, "arrivals")
    spark.createDataFrame([(t,) for t in known], "title string").coalesce(1).write.parquet(f"{path}/catalog")
    for batch in batches:
        spark.createDataFrame(batch, ARRIVAL).repartition(3).write.mode("append").parquet(f"{path}/drop")
        stream = lambda at, kind: spark.readStream.schema(kind).parquet(f"{path}/{at}")
        query = arrivals.ingest_arrivals(stream("drop", ARRIVAL), stream("catalog", "title string"), f"{path}/out", f"{path}/state")
        query.awaitTermination()
        read = sum(p["numInputRows"] for p in query.recentProgress)
        assert read == len(batch) + (len(known) if batch is batches[0] else 0)  # no batch reads the catalog again
    got = {r.name: r.route for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == judged(known, batches) and set(got.values()) == {"new", "duplicate", "error"}


def test_the_earliest_title_is_named(spark):
    titles = arrivals._Titles(["b 1999", "a 1999"], ["B 1999", "A 1999"])
    for i in range(20):
        titles.add(f"n{i} 1999", f"N{i} 1999")
    assert titles.match("a 1999", []) == "A 1999" and titles.match("x", ["1999"]) == "B 1999" and titles.match("x", ["n17"]) == "N17 1999"
    assert titles.match("x", ["see n3 1999 there"]) == "N3 1999" and titles.match("x", ["n", ""]) == "N0 1999" and titles.match("x", []) is None


def test_potential_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["owl", "owls", "red", "a", "x1", "night", "&", "of"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    dates = ["1999-01-01", "1999-01-02", "1999-01-03"]
    catalog = [f"{text(5)} {rng.choice(dates)} {text(3)}" for _ in range(120)] + ["no date", None, dates[0], f"{dates[0]} {dates[1]}"]
    new = [(i, rng.choice([*dates, None]), rng.choice([text(4), f"x {rng.choice(catalog)} y", "", None])) for i in range(150)]
    got = joins.match_potential_duplicates(spark.createDataFrame(new, "id long, date string, name string"), spark.createDataFrame([(t,) for t in catalog], "title string"))
    want = {(i, t) for i, d, n in new for t in catalog if t and d and d in t and key_of(n) and (key_of(n) in key_of(t) or key_of(t) in key_of(n))}
    assert {(r.id, r.title) for r in got.collect()} == want and len(want) > 50


def test_a_hot_date_is_not_compared_pair_by_pair(spark):
    n = 3_000
    names = spark.range(n).select("id", F.lit("1999-01-01").alias("date"), F.concat(F.lit("band"), F.format_string("%05d", "id")).alias("name"))
    titles = spark.range(n).select(F.concat(F.lit("Band"), F.format_string("%05d", "id"), F.lit(" 1999-01-01")).alias("title"))
    found = joins.match_potential_duplicates(names, titles)
    assert found.count() == n
