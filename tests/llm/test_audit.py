"""Operator 13 against plain Python, with the odd cases of data.py."""

import re
from collections import defaultdict
from itertools import permutations

from shelfmark.llm import audit
from tests.llm import data

LABELS = "doc_id long, quality int, toxic int, part string"
MARKS = [(0, 1, 0, "x"), (1, 0, 1, "x"), (1, 1, None, "x"), (4, 1, 1, "x"), (4, 1, 1, "x"), (901, None, None, "x"), (None, 1, 1, "x"), (77_777, 1, 1, "x")]


def by_force(rows, marks):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(r[0], first.get(r[1] or "", r[0]))
    docs = []
    for r in rows:
        text, words = r[1] or "", re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": r[0] is not None and r[0] > first[text],
        }
        own = [m for m in marks if m[0] is not None and m[0] == r[0]]
        docs.append((r[2] or "", fails, any(m[1] == 1 for m in own), any(m[2] == 1 for m in own)))
    out, shares = {}, defaultdict(int)
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                earlier = [d for d in mine if d[1][f] and any(d[1][g] for g in order[: step - 1])]
                left = [d for d in left if not d[1][f]]
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                out[part, order, step] = (len(left), len(gone), len(earlier), only, sum(d[2] for d in gone), sum(d[3] for d in gone))
                shares[part, f] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*audit._COUNTS, "shapley")) for r in df.collect()}


def test_interactions(spark):
    rows = data.rows() + [(905, "A B & C", "en", "a", 1, None, 1, 2, "y"), (905, "A B & C", "", "a", 1, None, 1, 2, "y"), (906, " ".join(f"w{i}" for i in range(150)), "xx", "a", 1, None, 1, 2, "y")]
    got = audit.interactions(audit.failures(data.table(spark, rows), spark.createDataFrame(MARKS, LABELS)))
    found = told(got)
    assert got.count() == len(found) == 600 * len({r[2] or "" for r in rows})
    assert found == by_force(rows, MARKS)
    assert any(v[0] for v in found.values()) and any(v[2] for v in found.values())


def test_crowd_of_copies(spark):
    rows = [(i, "Some text & more", "en" if i % 3 else None, "a", 1, None, 1, 2, "y") for i in range(300)]
    assert told(audit.interactions(audit.failures(data.table(spark, rows), spark.createDataFrame([], LABELS)))) == by_force(rows, [])


def test_no_documents(spark):
    assert audit.interactions(audit.failures(data.table(spark, []), spark.createDataFrame(MARKS, LABELS))).count() == 0
