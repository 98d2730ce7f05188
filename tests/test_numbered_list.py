"""Numbered lists against a plain loop over the rules, and numbers given to items in order."""

import random

from shelfmark.operators import windows


def part(n):
    return n % 100 if 100 <= n <= 999 else n


def disc(n):
    return n // 100 if 100 <= n <= 999 else None


def listed(rows):
    """rows: (pos, number, headed) in order."""
    out, held, seen, section = [], None, False, False

    def take(number, pos):
        nonlocal held, section
        out.append((pos, number))
        held, section = None, False

    for pos, number, headed in rows:
        if headed:
            seen = True
            section = section or bool(out)
            held = None if held and held[0] == "high" else held
        if held and held[0] == "reset":
            _, n, p, _ = held
            held = None
            if number == n + 1:
                take(n, p)
                take(number, pos)
                continue
        if held and held[0] == "gap":
            _, n, p, missing = held
            held = None
            if number == n == missing + 1:
                take(missing, p)
                take(number, pos)
                continue
            take(n, p)
        last = out[-1][1] if out else None
        if not out:
            if part(number) in (0, 1):
                take(number, pos)
            elif held and number == held[1] + 1:
                take(held[1], held[2])
                take(number, pos)
            else:
                held = ("high", number, pos, None)
        elif number == last + 1 or (disc(number) and disc(last) and disc(number) > disc(last) and part(number) in (0, 1)):
            take(number, pos)
        elif part(number) in (0, 1):
            if len(out) == 1 and not section:
                out.clear()
                take(number, pos)
            elif section:
                take(number, pos)
            elif part(last) >= 1 and part(number) == 1:
                held = ("reset", number, pos, None)
        elif number > last:
            if len(out) > 1 or seen:
                held = ("gap", number, pos, last + 1)
            else:
                out.clear()
                held = ("high", number, pos, None)
    if held and held[0] == "gap":
        take(held[1], held[2])
    return out if out and (seen or part(out[0][1]) in (0, 1)) else []


def test_lists_against_the_rules(spark):
    rng, docs = random.Random(14), []
    for d in range(400):
        n, rows = 0, []
        for i in range(rng.randrange(1, 90 if d % 40 == 0 else 14)):
            n = rng.choice([n + 1, n + 1, n + 1, n + 1, n + 2, n, 1, 0, 2, n - 1, 101, 201, 20, 100])
            rows.append((3 * i, max(n, 0), rng.random() < 0.12))
        docs.append(rows)
    items = [(d, p, n, h or None) for d, rows in enumerate(docs) for p, n, h in rows] + [(900, 1, None, True), (901, 5, 1, False)]
    rng.shuffle(items)
    got = windows.numbered_list(spark.createDataFrame(items, "id int, pos int, n int, head boolean"), "id", "pos", "n", "head").orderBy("id", "ord").collect()
    found = {}
    for r in got:
        assert r.ord == len(found.setdefault(r.id, [])) + 1
        found[r.id].append((r.pos, r.number))
    want = {d: x for d, rows in enumerate(docs) if (x := listed(rows))} | {901: [(5, 1)]}
    assert found == want and sum(map(len, want.values())) > 1_000


def test_without_headings(spark):
    items = [(1, i, n) for i, n in enumerate([5, 6, 7])] + [(2, i, n) for i, n in enumerate([1, 2, 3, 3, 4])]
    got = windows.numbered_list(spark.createDataFrame(items, "id int, pos int, n int"), "id", "pos", "n").orderBy("id", "ord").collect()
    assert [(r.id, r.number) for r in got] == [(2, 1), (2, 2), (2, 3), (2, 4)]
