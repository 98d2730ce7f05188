"""Work inside a row: dictionary windows, date mentions and running states against brute force, and their time on long rows."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.folds import scan
from shelfmark.functions.sketch import key_filter
from shelfmark.operators import dates as date_jobs
from shelfmark.operators import joins

PHRASES = ["red apple", "apple", "Green & Blue", "one two three four", "two three", "zebra"]


def key_of(line):
    return re.sub("[^a-z0-9]+", " ", line.lower().replace("&", " and ")).strip()


def hits_of(line, widest):
    words, known = key_of(line).split(" "), {key_of(p): p for p in PHRASES}
    return {(n, known[g]) for n in range(1, widest + 1) for i in range(len(words) - n + 1) if (g := " ".join(words[i : i + n])) in known}


@pytest.mark.parametrize("widest", [1, 2, 4])
def test_phrases_of_several_words(spark, widest):
    rng = random.Random(2)
    words = ["red", "apple", "green", "&", "blue", "one", "two", "three", "four", "x", "Apple,", "\t"]
    texts = [[" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 15))] for _ in range(60)]
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    docs = spark.createDataFrame([(i, "\r\n".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")], "id long, text string")
    want = {}
    for i, t in enumerate(texts):
        found = {}
        for pos, line in enumerate(t):
            for _, p in hits_of(line, widest):
                found.setdefault(p, pos)
        ranked = sorted((-(72 + min(20.0, len(p) / 4) - pos / 2 + (15 if pos < 10 else 0)), pos, p) for p, pos in found.items())
        if ranked:
            want[i] = (ranked[0][2], ranked[0][1], -ranked[0][0])
    got = joins.best_dictionary_hit(docs, "id", "text", phrases, widest).collect()
    assert {r.id: (r.phrase, r.line, r.score) for r in got} == want
    single = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "id long, line string")
    widths = {i: max((n for n, _ in hits_of(t[0], widest)), default=0) for i, t in enumerate(texts)}
    assert {(r.id, r.phrase, r.width) for r in joins.scan_phrases(single, "id", "line", phrases, widest).collect()} == {(i, p, n) for i, t in enumerate(texts) for n, p in hits_of(t[0], widest) if n == widths[i]}


def test_a_full_filter_lets_more_through_but_nothing_is_lost(spark):
    keys = spark.range(5_000).select(F.concat(F.lit("k"), "id").alias("key"))
    for most, chance in ((1 << 26, 0.05), (1 << 10, 1.0)):
        bits, holds = key_filter(keys, "key", 5_000, most=most)
        rows = spark.range(10_000).select(F.concat(F.lit("k"), "id").alias("v"), "id", bits.alias("b"))
        got = rows.select("id", holds(F.col("b"), F.col("v")).alias("ok")).groupBy(F.col("id") < 5_000).agg(F.count_if("ok").alias("n")).collect()
        found = dict(map(tuple, got))
        assert found[True] == 5_000 and found[False] <= 5_000 * chance


def test_scan_keeps_a_running_state(spark):
    for n in (0, 1, 63, 64, 65, 128, 1_000):
        row = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n + 1)), lambda x: x.cast("long")).alias("x")).select(F.slice("x", 1, n).alias("x"))
        got = row.select(scan(F.col("x"), F.lit(0).cast("long"), lambda s, x: F.struct((s + x).alias("state"), (s + x).alias("out")), "bigint").alias("s")).first().s
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


def mentions(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    return sorted((r.id, r.start, r.raw, r.normal, r.kind) for r in date_jobs.extract_dates(rows, "id", "t").collect())


def test_dates_stand_where_they_are_found(spark):
    rng = random.Random(6)
    parts = ["1999-12-31", "12-31-1999", "19991231", "1999 1231", "Dec 31, 1999", "31st December 99", "1999 Dec 31", "December 1999", "1998-2001", "1997_99", "99.12.3x", "2001-13-45", "x", "-", " ", ".", "Set 1", "\u0001", "\u0002", "é", "16-44"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    got = mentions(spark, texts)
    assert len(got) > 300
    shown = lambda t: re.sub("[\x01\x02]", "\x03", t)
    rank = {kind: i for i, (kind, _, _) in enumerate(date_jobs.FAMILIES)}
    for i, text in enumerate(texts):
        own = [g for g in got if g[0] == i]
        assert all(shown(text)[s : s + len(raw)] == raw for _, s, raw, _, _ in own)
        spans = sorted((s, s + len(raw), rank[kind]) for _, s, raw, _, kind in own)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    # each alone and all in one row, with a gap between them that is part of no date
    whole = mentions(spark, ["\n;;\n".join(texts)])
    assert [g[2:] for g in whole] == [g[2:] for g in got]


def seconds(work):
    best = 1e9
    for _ in range(2):
        began = time.time()
        work()
        best = min(best, time.time() - began)
    return best


def test_time_is_linear_in_the_row(spark):
    """A row of twice the length takes less than three times as long."""
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")

    def hit(n):
        docs = spark.createDataFrame([(1, "some red apple here " * n)], "id long, text string")
        return seconds(lambda: joins.best_dictionary_hit(docs, "id", "text", phrases, 3).collect())

    def found(n):
        docs = spark.createDataFrame([(1, "on 1999-12-31 and Dec 30, 1999; " * n)], "id long, t string")
        return seconds(lambda: date_jobs.extract_dates(docs, "id", "t").count())

    assert hit(40_000) < 3 * hit(20_000)
    assert found(8_000) < 3 * found(4_000) + 1


def test_labels_anywhere_in_a_document(spark):
    docs = spark.createDataFrame([(1, "\n" * 200 + "Artist: Late\nDate: 1999-01-02"), (2, "Artist: Early" + "\n" * 300 + "Artist: Later")], "id long, t string")
    got = {r.id: (r.artist, r.date) for r in date_jobs.labelled_fields(docs, "id", "t").collect()}
    assert got == {1: ("Late", "1999-01-02"), 2: ("Early", None)}
    assert date_jobs.labelled_fields(docs, "id", "t", limit=80).count() == 1
