"""Operator 11 against the tokenizer itself, brute force on lengths and whole round trips, with the odd cases of data.py."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import packing, scans
from tests.llm import data

MODEL = Tokenizer.from_file(packing.TOKENIZER)
ODD = ["a\x1cb c\x85d", "ΑΣ ΑΣ. Ⅷ ﬁ é ́x", "it's 'tis I'LL 12345 3.14", "<|endoftext|> x<|startoftext|>y", "漢字 かな 한국어 ไทย", "\x0b\x0c\r\n \t", "a b　c", "İstanbul ǅ ß ẞ", "x" * 3_000, "\x00 \x01", "👩‍👩‍👧 ȩ́"]


def library_ids(text):
    return MODEL.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    ids, counts = packing.Coder(packing.TOKENIZER).encode([text.encode(), b"", (text + " " + text).encode()])
    assert ids.tolist() == library_ids(text) + library_ids(text + " " + text)
    assert counts[1] == 0


def test_ids_of_random_texts():
    rng, coder = random.Random(3), packing.Coder(packing.TOKENIZER)
    letters = "abcAB'sΣß漢é́ \t\n .,!?0129#<|>ǆ‍🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    ids, counts = coder.encode([t.encode() for t in texts])
    want = [library_ids(t) for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_case_of_letters_under_marks():
    """Lower case comes before the tokenizer composes letters with what follows them."""
    texts = [c + chr(m) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in (*range(0x300, 0x370), 0x1DC4, 0x20D0, 0x3099)]
    ids, _ = packing.Coder(packing.TOKENIZER).encode([t.encode() for t in texts])
    assert ids.tolist() == sum(map(library_ids, texts), [])


def test_every_latin_letter():
    texts = [f"{a}{chr(c)}{b}" for c in range(1, 0x260) for a, b in (("", ""), ("x", "Y"))]
    ids, _ = packing.Coder(packing.TOKENIZER).encode([t.encode() for t in texts])
    assert ids.tolist() == sum(map(library_ids, texts), [])


def test_long_texts_go_in_slices(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 50)
    monkeypatch.setattr(packing, "_CACHE_WORDS", 20)
    coder = packing.Coder(packing.TOKENIZER)
    for text in (data.words(random.Random(5), 2_000), "漢字" * 300, ""):
        assert coder.encode_long(text.encode()).tolist() == library_ids(text)


def by_force(rows, capacity):
    out = Counter()
    for r in rows:
        ids = library_ids(r[1]) + [0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            piece = ids[s : s + capacity]
            out[r[0], k, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    return out


@pytest.mark.parametrize("capacity", [2_048, 100, 1])
def test_every_piece_has_its_place(spark, capacity):
    pieces = packing.tokenised(data.table(spark), capacity=capacity).withColumn("crc", F.crc32("ids")).drop("ids")
    got = packing.packed(pieces, ["doc_id", "th", "piece"], capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in got) == by_force(data.rows(), capacity)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():  # gapless from 0, and no longer than a sequence
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(bins) <= -(-sum(r.length for r in got) // capacity) + 1


def test_sequences_give_the_documents_back(spark):
    rows = [r for r in data.rows() if r[0] is not None and r[0] != 3]
    placed = packing.packed(packing.tokenised(data.table(spark, rows), capacity=128), ["doc_id", "th", "piece"], 128).collect()
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(data.table(spark, rows), capacity=128).collect()}
    assert set(whole) == {r.sequence_id for r in placed} and sum(map(len, whole.values())) == sum(r.length for r in placed)
    docs = defaultdict(dict)
    for r in placed:
        docs[r.doc_id][r.piece] = whole[r.sequence_id][r.offset : r.offset + r.length]
    assert {k: sum((v[i] for i in sorted(v)), []) for k, v in docs.items()} == {r[0]: library_ids(r[1]) + [0] for r in rows}


def test_no_documents(spark):
    assert packing.packed(packing.tokenised(data.table(spark, [])), ["doc_id"]).count() == 0


def test_too_long_a_piece_is_an_error(spark):
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame([(1, 5)], "doc_id long, length long"), ["doc_id"], 4)


def test_fullest_against_all_subsets():
    rng = random.Random(11)
    for _ in range(300):
        counts = Counter(rng.randrange(1, 40) for _ in range(rng.randrange(0, 9)))
        room = rng.randrange(1, 90)
        uses = packing.fullest(counts, sorted((x for x in counts if x <= room), reverse=True), room)
        items = list(counts.elements())
        best = max(s for k in range(len(items) + 1) for c in combinations(items, k) if (s := sum(c)) <= room)
        assert sum(k * v for k, v in uses.items()) == best and all(counts[k] >= v for k, v in uses.items())


def test_plan_uses_every_length_once():
    rng = random.Random(12)
    for capacity in (10, 64, 2_048):
        counts = Counter(min(capacity, int(rng.paretovariate(0.7))) for _ in range(5_000))
        counts[1] += 10**9  # the plan is as short for a billion pieces
        found = packing.plan(dict(counts), capacity)
        used = Counter()
        for uses, bins in found:
            assert bins > 0 and sum(k * v for k, v in uses.items()) <= capacity
            used.update({k: v * bins for k, v in uses.items()})
        assert used == counts
        assert len(found) <= capacity + sum(capacity // n + 1 for n in range(1, capacity + 1))
        assert sum(bins for _, bins in found) <= -(-sum(k * v for k, v in counts.items()) // capacity) + 1


def test_running_totals_over_ranges(spark):
    # ranges stay as small as they are asked for
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(4)
    rows = [(rng.randrange(3) if i % 3 else 0, i, rng.randrange(100)) for i in range(2_000)]
    table = scans.chunked(spark.createDataFrame(rows, "g long, o long, v long"), "t", ["g"], ["o"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = scans.running(table, ["g"], ["o"], {"s": F.col("v"), "n": F.lit(1)})
    got = scans.running(got, ["g"], ["o"], {"x": F.col("v")}, "bit_xor")
    got = scans.following(got, ["g"], "o", "next")
    want, at = {}, defaultdict(lambda: [0, 0, 0])
    for g, o, v in sorted(rows):
        s = at[g]
        s[0], s[1], s[2] = s[0] + v, s[1] + 1, s[2] ^ v
        want[g, o] = tuple(s)
    later = {(g, o): min((p for h, p, _ in rows if h == g and p > o), default=None) for g, o, _ in rows[::50]}
    assert {(r.g, r.o): (r.s, r.n, r.x) for r in got.collect()} == want
    assert {k: v for k, v in {(r.g, r.o): r.next for r in got.collect()}.items() if k in later} == later
    assert table.select("chunk").distinct().count() > 1
