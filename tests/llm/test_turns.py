"""Operator 12 against plain Python: repeated turns, nulls, a long conversation, one opening of very many, lists ranked in rounds."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelfmark.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, depth string, chunk int, c string"


def by_force(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]  # the remainder has the sign of c, as in SQL
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in kids[k])
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k)))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(rng, n=90):
    rows = []
    for c in range(n):
        size = rng.randrange(1, 7)
        for t in range(size):
            text = rng.choice(["Hello there", "a b  c", "", None, "x\ty\nz", "same"]) if t < 3 else f"turn {rng.randrange(4)}"
            rows.append((c, t if t else None, rng.choice(["user", "assistant", None]) if t % 2 else "user", text, "a", 1, "b"))
    rows += [(200, None, None, None, None, None, None), (201, 3, "user", "only", "a", 1, "b"), (201, 3, "user", "only", "a", 1, "b"), (201, 3, "user", "other", "a", 1, "b"), (None, 1, "user", "nobody", "a", 1, "b")]
    rows += [(300 + c, t, "user", f"copy {t}", "a", 1, "b") for c in range(40) for t in range(5)]
    rows += [(-7, t, "user", f"below {t}", "a", 1, "b") for t in range(4)]
    rows += [(1_000_003, t, "user", f"long {t} text", "a", 1, "b") for t in range(400)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def ranges(spark):
    """Ranges stay as small as they are asked for."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
    spark.conf.set("spark.sql.shuffle.partitions", old[1])


@pytest.mark.parametrize("last", [turns.LAST_CHAINS, 3])
def test_trie(spark, ranges, last):
    ranges(7)
    rows = conversations(random.Random(5))
    got = [tuple(r) for r in turns.trie(spark.createDataFrame(rows, SCHEMA).repartition(5), last).collect()]
    assert len(got) == len(set(got)) and set(got) == by_force(rows)


def test_no_conversations(spark):
    assert turns.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert turns.trie(spark.createDataFrame([(None, 1, "user", "x", "a", 1, "b")], SCHEMA)).count() == 0


def test_conversation_without_turns_is_in_the_root(spark):
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(lone, 1, "user", "gone", "a", 1, "b")]
    got = [tuple(r) for r in turns.trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert set(got) == by_force(rows) and [r[1] for r in got] == [0]


def test_chains_ranked_in_rounds(spark):
    """A list in no order at all, ranked by rounds of independent links down to two chains."""
    rng = random.Random(8)
    ids = rng.sample(range(10**6), 60)
    rows = [(c, 0, n, 0 if n is not None else None, rng.randrange(9), rng.randrange(9)) for c, n in zip(ids, [*ids[1:], None], strict=True)]
    chains = spark.createDataFrame(rows, "c long, a long, nc long, na long, leaves long, saved long")
    got = {r.c: (r.leaves, r.saved) for r in turns.rank_chains(chains, 2).collect()}
    assert got == {c: (sum(r[4] for r in rows[i:]), sum(r[5] for r in rows[i:])) for i, c in enumerate(ids)}
