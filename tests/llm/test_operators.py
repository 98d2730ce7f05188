"""Operators against brute force, round trips and held-out figures, with the odd cases of data.py."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import brown, common, digest, likeness, lines, mixing, pieces, qda, repeats, simhash, urls, warc
from tests.llm import data

ROWS = data.rows()


def key(i):
    return (i is not None, i if i is not None else 0)


def body(text):
    return (text or "").encode()


# 1: repeats


def cut_by_force(all_rows, width):
    counts = Counter(b[s : s + width] for b in (body(r[1]) for r in all_rows) for s in range(len(b) - width + 1))
    out = []
    for r in all_rows:
        b = body(r[1])
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if counts[b[s : s + width]] > 1:
                gone[s : s + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda x: (key(x[0]), x[1:]))


def test_repeats(spark):
    got = sorted((tuple(r) for r in repeats.removal_digest(data.table(spark)).collect()), key=lambda x: (key(x[0]), x[1:]))
    assert got == cut_by_force(ROWS, 200)


def test_cut_texts_keep_their_rows(spark):
    docs = data.table(spark)
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    got = {r.doc_id: r for r in out.collect() if r.doc_id and r.doc_id >= 900}
    assert got[900].text is None and got[901].text == "" and got[903].text == "x" and got[903].place == 2
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_a_cut_long_text_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 1 << 10)
    monkeypatch.setattr(repeats, "SLICE_BYTES", 1 << 10)
    got = sorted((tuple(r) for r in repeats.removal_digest(data.table(spark)).collect()), key=lambda x: (key(x[0]), x[1:]))
    assert got == cut_by_force(ROWS, 200)


def test_heads_are_found_across_batches_and_ranges():
    """Sorted heads in batches of any size, cut into ranges anywhere: places of heads that another place has."""
    rng = random.Random(1)
    rows = sorted((rng.randrange(2), rng.randrange(2), rng.randrange(3), 0, rng.randrange(3), rng.randrange(4)) for _ in range(60))  # digits, full, who, place
    rows += [(5, 5, 5, 5, 1, 1)] * 3 + [(6, 0, 0, 0, 1, 2), (6, 0, 0, 0, 2, 2)]
    places = defaultdict(set)
    for r in rows:
        places[r[:4]].add(r[4:])
    want = {p for x in places.values() if len(x) > 1 for p in x}
    names = [*repeats._DIGITS, "full", "who", "doc_id", "th", "place"]
    for cut in range(0, len(rows), 7):
        for size in (1, 4, 100):
            sure, border = set(), defaultdict(set)
            for part in (rows[:cut], rows[cut:]):
                batches = [pa.RecordBatch.from_arrays([pa.array([(*r[:5], r[4], r[4], r[5])[k] for r in part[i : i + size]], pa.int64()) for k in range(8)], names) for i in range(0, len(part), size)]
                for out in repeats._equal_heads(iter(batches)):
                    for r in out.to_pylist():
                        if r["full"] is None:
                            sure.add((r["who"], r["place"]))
                        else:
                            border[r["d0"], r["d1"], r["d2"], r["full"]].add((r["who"], r["place"]))
            assert sure | {p for x in border.values() if len(x) > 1 for p in x} == want


# 2: mixing


def test_mix_keeps_all_and_its_bounds(spark):
    docs = data.table(spark)
    got = mixing.mixed(docs, block_chars=200, quantum=100, power=0.5).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    assert all(r.release <= r.slot < r.deadline and r.position <= r.slot for r in got)
    assert {r.source for r in got} == {"", "a", "b", "c"}
    out = mixing.in_mix_order(docs, block_chars=200)
    assert out.columns == docs.columns and out.count() == len(ROWS)


@pytest.mark.parametrize("weights", [(50, 30, 20), (90, 9, 1), (34, 33, 33), (100,), (1,) * 100, (51, 7, 7, 7, 7, 7, 7, 7)])
def test_schedule_is_less_than_a_block_off(spark, weights):
    order = spark.range(1).select(F.array(*[F.lit(m) for m in weights]).alias("m")).select(F.expr(mixing._period(100)).alias("o")).first().o
    counts = [0] * len(weights)
    for t, i in enumerate(order, 1):
        counts[i] += 1
        assert all(abs(n - t * m / 100) < 1 for n, m in zip(counts, weights, strict=True))


def test_more_sources_than_slots(spark):
    rng = random.Random(8)
    docs = [(i, "x" * rng.randrange(1, 400), "en", f"s{i % 1_100}", 0, None, 1, 2, "y") for i in range(3_000)]
    got = mixing.mixed(data.table(spark, docs), block_chars=100).collect()
    assert len(got) == len(docs) and all(r.release <= r.slot < r.deadline and r.position <= r.slot for r in got)
    assert len({(r.source, r.block) for r in got}) == len({r.slot for r in got}) == len({r.position for r in got})
    few = mixing.mixed(data.table(spark, docs[:20]), block_chars=100, quantum=5).collect()
    assert len(few) == 20 and len({r.source for r in few}) == 20


def test_the_mix_reaches_the_last_stage(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ab cd", k=7_000)), "en", "xxxxxxyyyz"[i % 10], 7_000, None, 1, 2, "y") for i in range(200)]
    data.table(spark, rows).drop("position").write.parquet(str(tmp_path / "docs"))
    corpus_pipeline.mix(spark, spark.read.parquet(str(tmp_path / "docs")), "").write.parquet(str(tmp_path / "mix"))
    corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mix")), "").write.parquet(str(tmp_path / "out"))
    out = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.position)
    assert len(out) == len(rows) and {r.doc_id: r.source for r in out} == {r[0]: r[3] for r in rows}
    chars = Counter()
    for r in rows:
        chars[r[3]] += len(r[1])
    sizes = spark.createDataFrame(list(chars.items()), "source string, chars long")
    weights = {r.source: r.m for r in mixing.target_weights(sizes, 1_000, 0.5).collect()}
    order = [source for _, source in sorted({(r.position, r.source) for r in out})]
    ends = min(max(r.slot for r in out if r.source == s) for s in weights)
    counts = Counter()
    assert ends > 10 and len(set(order[:10])) == 3
    for t, source in enumerate(order[: ends + 1], 1):
        counts[source] += 1
        assert all(abs(counts[s] - t * m / 1_000) < 1 for s, m in weights.items())


# 3: class bigrams


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in body(text))) + [None]


def test_base_scores(spark):
    train = [r for r in ROWS if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    counts = Counter(t for r in train for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in ROWS:
        seq = tokens(r[1])
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in seq)
        want.append((key(r[0]), r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1, len(seq), sum(counts[t] > 0 for t in seq), n, round(base, 6)))
    got = [(key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in brown.score(data.table(spark), k=8).collect()]
    assert sorted(got) == sorted(want)


def score_by_force(rows, classes, k):
    """log10 probabilities by the model's formulas, word by word; classes: word -> class."""
    train = [tokens(r[1]) for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    counts = Counter(t for x in train for t in x)
    total, once = sum(counts.values()), sum(n == 1 for n in counts.values())
    mass, grid = Counter(), Counter()
    for w, n in counts.items():
        mass[classes[w]] += n
    for x in train:
        before = classes[None]
        for t in x:
            grid[before, classes[t]] += 1
            before = classes[t]
    unseen = (once + 0.5) / (total + 1)
    weight = {c: n + 0.5 for c, n in mass.items()}
    share = {c: x / sum(weight.values()) for c, x in weight.items()}
    row = Counter()
    for (a, _), n in grid.items():
        row[a] += n

    def step(a, c):
        return unseen if c == k else (1 - unseen) * (grid[a, c] + 20 * share.get(c, 0)) / (row[a] + 20)

    out = []
    for r in rows:
        before, score = classes[None], 0.0
        for t in tokens(r[1]):
            c = classes[t] if t in counts else k
            score += math.log10(step(before, c)) + (math.log10(counts[t] / mass[c]) if c < k else 0.0)
            before = c
        out.append((key(r[0]), len(tokens(r[1])), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("chunk_bytes", [16 << 20, 2_000])
def test_scores_by_force(spark, monkeypatch, chunk_bytes):
    """Whole scores against plain Python, with the classes of the operator; every word of the training texts has one."""
    coded = brown.coded
    monkeypatch.setattr(brown, "coded", lambda docs: coded(docs, chunk_bytes))
    docs = data.table(spark)
    found = {r.h: (r["class"], r.n) for r in brown.word_classes(common.materialise(coded(docs, chunk_bytes), "chunks"), 8, 20).collect()}
    train = Counter(t for r in ROWS if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1 for t in tokens(r[1]))
    hashed = {w: int(np.uint64(xxhash.xxh64_intdigest(b"\n" if w is None else w)).view(np.int64)) for w in train}
    assert {h: n for h, (_, n) in found.items()} == {hashed[w]: n for w, n in train.items()}
    got = brown.score(docs, k=8, core_words=20).collect()
    want = score_by_force(ROWS, {w: found[h][0] for w, h in hashed.items()}, 8)
    assert sorted((key(r.doc_id), r.n_tokens, round(r.score, 6)) for r in got) == want


def test_gain_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    grid = rng.integers(1, 40, (5, 5)).astype(float)
    after = np.array([3, 0, 20, 1, 0])
    codes = np.array([int(n) << 8 | d for d, n in enumerate(after) if n])
    got = brown.gains(np.array([-1]), codes, np.array([len(codes)]), grid)[0]
    want = []
    for c in range(5):
        new = grid.copy()
        new[c] += after
        want.append(brown.likelihood(new) - brown.likelihood(grid))
    assert np.allclose(got - got[0], np.array(want) - want[0])
    grid[2] += after  # the same word, now a member of class 2
    again = brown.gains(np.array([2]), codes, np.array([len(codes)]), grid)[0]
    assert np.isclose(again[2], got[2])


def test_contexts_are_summed_over_batches():
    rng = random.Random(3)
    rows = sorted((rng.randrange(6), [(rng.randrange(1, 9), rng.randrange(20)) for _ in range(rng.randrange(4))]) for _ in range(60))
    want = defaultdict(Counter)
    for h, codes in rows:
        want[h].update()
        for n, c in codes:
            want[h][c] += n
    for size in (1, 7, 100):
        batches = [rows[i : i + size] for i in range(0, len(rows), size)]
        arrow = [brown._batch({"h": np.array([h for h, _ in b]), "class": np.zeros(len(b), np.int32), "codes": brown._lists(np.array([n << 8 | c for _, x in b for n, c in x], np.int64), np.array([len(x) for _, x in b]))}) for b in batches]
        got = {h: Counter({c & 255: c >> 8 for c in codes}) for out in brown._summed(iter(arrow)) for h, codes in zip(out["h"].to_pylist(), out["codes"].to_pylist(), strict=True)}
        assert got == {h: +c for h, c in want.items()}


def test_rounds_raise_the_likelihood(spark):
    """Words that the core lacks are moved by the classes of all their neighbours."""
    rng = random.Random(6)
    sides = [[f"{s}{i}" for i in range(80)] for s in "xy"]
    docs = [(i, " ".join(rng.choice(sides[(i + j) % 2]) for j in range(60)), "", "", 0, "", 0, 0, "") for i in range(200)]
    chunks = common.materialise(brown.coded(data.table(spark, docs)), "chunks")
    found = {r.h: r["class"] for r in brown.word_classes(chunks, k=2, core_words=4, rounds=4, least_gain=0).collect()}
    kinds = [{found[int(np.uint64(xxhash.xxh64_intdigest(w.encode())).view(np.int64))] for w in side} for side in sides]
    assert len(kinds[0]) == len(kinds[1]) == 1 and kinds[0] != kinds[1]


def test_classes_help_on_held_out_texts(spark):
    rng = random.Random(5)
    sides = [[f"{s}{i}" for i in range(60)] for s in "xy"]
    docs = [(i, " ".join(rng.choice(sides[(i + j) % 2]) for j in range(60)), "", "", 0, "", 0, 0, "") for i in range(300)]
    got = [r for r in brown.score(data.table(spark, docs), k=6, core_words=60).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got) + 5 * len(got)
    with pytest.raises(ValueError):
        brown.score(data.table(spark, docs), k=129)


def test_exchange_finds_the_sides():
    rng, pairs = np.random.default_rng(1), np.zeros((20, 20))
    pairs[:10, 10:], pairs[10:, :10] = rng.poisson(5, (2, 10, 10))
    classes = brown.exchange(pairs, 2)
    assert len(set(classes[:10])) == len(set(classes[10:])) == 1 and classes[0] != classes[10]


# 4: fingerprints


def levels_by_force(text, window):
    gain = digest._GAINS[window]
    return [digest.LEVELS - sum(int(gain[c]) for c in Counter(text[i : i + window]).values()) * digest.LEVELS // int(gain[window]) for i in range(len(text) - window + 1)]


def scale_by_force(text):
    return digest.BRIEF if len(text.decode()) < digest.SHORT else digest.LONG


def fingerprints_by_force(corpus):
    """A function from text to fingerprint, with ranks from the whole corpus."""
    counts = {s: Counter(x for t in corpus if scale_by_force(t) is s for x in levels_by_force(t, s.window)) for s in (digest.LONG, digest.BRIEF)}
    ranks = {}
    for s in counts:
        order = sorted(range(digest.LEVELS + 1), key=lambda x: (counts[s][x], x))
        ranks[s] = {x: digest._NEVER if x < digest.LEAST_ENTROPY * digest.LEVELS else i for i, x in enumerate(order)}

    def chain(text):
        s = scale_by_force(text)
        rank = [ranks[s][x] for x in levels_by_force(text, s.window)]
        points = Counter(min(range(i, i + s.run), key=lambda j: (rank[j], j)) for i in range(len(rank) - s.run + 1))
        places = [i for i in sorted(points) if points[i] >= s.points and rank[i] != digest._NEVER]
        one = lambda x: int(repeats.Rolling(np.frombuffer(x, np.uint8), 0).of(np.array([0]), np.array([len(x)]))[0])
        hashes = [one(text[i : i + s.window]) for i in places]
        if not hashes:
            at = min(range(len(rank)), key=lambda j: (rank[j], j)) if rank else 0
            hashes = [int.from_bytes(hashlib.blake2b(text[at : at + s.window] if rank else text, digest_size=8).digest(), "little")]
        hashes = list(dict.fromkeys(hashes)) if text else []
        bits = np.zeros((-(-len(hashes) // digest.PER_FILTER), digest.BITS), bool)
        for k, h in enumerate(hashes):
            for probe in range(digest.PROBES):
                bits[k // digest.PER_FILTER, (h >> 11 * probe + 9) % digest.BITS] = True
        return len(hashes), np.packbits(bits, axis=1)

    return chain


def monotone(rng, n):
    """Texts with long runs of one byte, and short ones, whose features are few."""
    out = []
    for i in range(n):
        parts = [rng.choice("abc é") * rng.choice([3, 70, 300, 900]) if rng.random() < 0.5 else data.words(rng, rng.randrange(1, 80)) for _ in range(rng.randrange(1, 5))]
        out.append((10_000 + i, "".join(parts), "en", "a", 0, None, 1, 2, "y"))
    return out


def test_fingerprints_by_force(spark, monkeypatch):
    monkeypatch.setattr(digest, "_CUT", 1 << 10)
    rows = ROWS + monotone(random.Random(2), 200)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, int(np.uint64(xxhash.xxh64_intdigest(body(r[1]), 42)).view(np.int64))))
    chain = fingerprints_by_force([body(r[1]) for r in rows])
    written = lambda c: f"{c[0]}:{c[1].tobytes().hex()}"
    want = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        q = len(text) // 4
        edit = text[: len(text) - q] + after[:q]
        own, edited = chain(text.encode()), chain(edit.encode())
        near = (round(digest.likeness(own, edited), 9), round(digest.likeness(own, chain(after.encode())), 9))
        want.append((key(r[0]), len(text), hashlib.sha256(edit.encode()).hexdigest(), written(own), written(edited), *near))
    got = digest.edited_fingerprints(data.table(spark, rows)).collect()
    found = [(key(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(found) == sorted(want)
    for low, high in ((64, 400), (400, 10**9)):
        assert np.mean([r.near_edited for r in got if low <= r.n_chars < high and r.doc_id and r.doc_id < 10_000]) > 0.5


def test_ids_of_other_types_and_one_row(spark):
    docs = spark.createDataFrame([("b", "some text of one row"), ("a", "another text")], "doc_id string, text string")
    assert {r.doc_id for r in digest.edited_fingerprints(docs).collect()} == {"a", "b"}
    one = digest.edited_fingerprints(docs.where("doc_id = 'a'")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_a_text_of_20_mib(spark):
    """One row that is cut inside: its fingerprint is that of the text by itself, its copy has the same."""
    rng = np.random.default_rng(4)
    long = rng.choice(np.frombuffer(b"abcdefghij klmnop", np.uint8), 20 << 20).tobytes()
    docs = spark.createDataFrame([(1, long.decode()), (2, long.decode()), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in digest.edited_fingerprints(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint == digest.fingerprint(long, digest.rarity_ranks(docs))
    assert got[1].near_next == 1.0 and 0.6 < got[1].near_edited < 1.0


def test_entropy_levels_by_force():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 110, 500, dtype=np.uint8)
    for scale in (digest.LONG, digest.BRIEF):
        assert digest.entropy_levels(text, scale.window).tolist() == levels_by_force(text.tobytes(), scale.window)


def test_least_of_windows_beyond_24_bits():
    values = np.full((1 << 24) + 500, 7)
    values[(1 << 24) + 100] = 3
    found = common.sliding_argmin(values, 64)
    assert found[(1 << 24) + 100] == found[(1 << 24) + 50] == (1 << 24) + 100 and found[5] == 5


# 5: revisits


def test_revisits_by_force(spark):
    rng = random.Random(9)
    urls_ = [f"http://Ex.org:80/{i % 4}/?utm_a=1&b={i % 2}#f" for i in range(8)] + [None, ""]
    logs = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit", None])
        tag = rng.choice(['"1"', 'W/"1"', '"2"', None])
        headers = {"ETag": tag, "Date": str(i), "Content-Length": "9"} if tag else ({"date": str(i)} if i % 3 else None)
        logs.append((i, rng.randrange(0, 40_000), rng.choice(urls_), kind, headers, None))
    records = spark.createDataFrame(logs, "record_id long, ts long, url string, kind string, headers map<string,string>, digest string")
    canonical = {r.url: r.k for r in records.select("url", warc.canonical_url(F.col("url")).alias("k")).distinct().collect()}
    want = {}
    for r in logs:
        if r[3] == "revisit":
            full = [x for x in logs if x[3] == "response" and canonical[x[2]] == canonical[r[2]] and (x[1], x[0]) < (r[1], r[0])]
            want[r[0]] = max(full, key=lambda x: (x[1], x[0]))[0] if full else None
    got = {r.record_id: r for r in warc.resolve_revisits(records, slice_length=500).collect()}
    assert {i: r.original_id for i, r in got.items()} == want
    for i, r in got.items():
        old, new = (logs[x][4] or {} if x is not None else {} for x in (r.original_id, i))
        a, b = (h.get("ETag", "").removeprefix("W/") for h in (old, new))
        assert r.state == ("missing" if r.original_id is None else "unchecked" if not a or not b else "resolved" if a == b else "changed")
        if r.state == "resolved":
            assert r.headers["date"] == new["Date"] and r.headers["content-length"] == "9"


def test_repeated_record_ids_keep_their_own_headers(spark):
    rows = [
        (1, 10, "http://a/x", "response", {"ETag": "1"}, "d1"), (1, 10, "http://b/y", "response", {"ETag": "2"}, "d2"), (1, 10, "http://b/y", "response", {"ETag": "0"}, "d0"),
        (7, 20, "http://a/x", "revisit", {"ETag": "1", "Date": "a"}, None), (7, 20, "http://b/y", "revisit", {"ETag": "2", "Date": "b"}, None), (7, 20, "http://b/y", "revisit", {"ETag": "2", "Date": "b"}, None),
        (1, 10, "http://a/x", "revisit", {"ETag": "1"}, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, ts long, url string, kind string, headers map<string,string>, digest string")
    got = sorted((r.record_id, r.key, r.original_id or 0, r.state, r.headers.get("date"), r.digest or "") for r in warc.resolve_revisits(records).collect())
    assert got == [(1, "a/x", 0, "missing", None, ""), (7, "a/x", 1, "resolved", "a", "d1"), (7, "b/y", 1, "resolved", "b", "d2"), (7, "b/y", 1, "resolved", "b", "d2")]


# 6: lines


def test_line_rules_by_force(spark):
    got = {(key(r.doc_id), r.n_words): r for r in lines.verdicts(data.table(spark), least_docs=3).collect()}
    for r in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        seen = [x for x in (r[1] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[key(r[0]), len(words)]
        assert (g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(seen) - len(set(seen)), len(covered))
        assert g.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (g.kept and g.base_failed)


def test_common_lines_go(spark):
    docs = [(i, f"own line {i} with a few words of its own here\nshared   LINE", "", "h", 0, "", 0, 0, "") for i in range(30)] + [(99, "Shared line", "", "other", 0, "", 0, 0, "")]
    out = {r.doc_id: r.text for r in lines.cleaned(data.table(spark, docs)).collect()}
    assert out[5] == "own line 5 with a few words of its own here" and out[99] == "Shared line"


# 7: quality


def test_quality_on_held_out_texts(spark):
    rng = random.Random(11)
    good = [data.words(rng, 80) for _ in range(150)]
    bad = [" | ".join(data.words(rng, 60).split()).upper() for _ in range(150)]
    docs = [(i, t, "", "", 0, "", 0, 0, "") for i, t in enumerate(good + bad)] + ROWS[-8:]
    labels = spark.createDataFrame([(i, 1 if i < 150 else 0) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = qda.quality_scores(data.table(spark, docs), labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == (r.doc_id < 150) for r in judged) / len(judged) > 0.97
    none = qda.quality_scores(data.table(spark), labels.where("quality > 5")).collect()
    assert {r.score for r in none} == {0.5}


def test_quality_scores_by_force(spark):
    """Scores against a direct computation from the statistics, with the folds by crc32."""
    rng = random.Random(12)
    docs = [(i, data.words(rng, 60) if i % 2 else " ".join(rng.choice(["BUY", "##", "now!", "9%", "|"]) for _ in range(rng.randrange(5, 60))), "", "", 0, "", 0, 0, "") for i in range(120)]
    quality = {i: i % 2 for i in range(120)}
    labels = spark.createDataFrame([*quality.items(), (4, 1), (4, 0), (77, 9)], "doc_id long, quality int")
    got = {r.doc_id: r for r in qda.quality_scores(data.table(spark, docs), labels).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(120)}
    x = {r[0]: np.array(qda.statistics(body(r[1]))) for r in docs}
    rows = {c: [x[i] for i, y in [*quality.items(), (4, 1), (4, 0)] if y == c and not out[i]] for c in (0, 1)}
    n = {c: len(rows[c]) for c in rows}
    mean = {c: np.mean(rows[c], axis=0) for c in rows}
    cov = {c: np.cov(np.array(rows[c]).T, bias=True) for c in rows}
    pooled = (cov[0] * n[0] + cov[1] * n[1]) / (n[0] + n[1])
    scale = np.sqrt(np.diag(pooled) + 0.25 * (mean[0] - mean[1]) ** 2 + 1e-9)
    for i in range(120):
        density = {}
        for c in (0, 1):
            s = (0.85 * cov[c] + 0.15 * pooled) / np.outer(scale, scale) + 0.02 * np.eye(len(scale))
            z = (x[i] - mean[c]) / scale
            density[c] = -0.5 * z @ np.linalg.solve(s, z) - 0.5 * np.linalg.slogdet(s)[1]
        odds = np.clip(math.log((n[1] + 1) / (n[0] + 1)) + density[1] - density[0], -500, 500)
        assert got[i].held_out == out[i] and math.isclose(got[i].score, 1 / (1 + math.exp(-odds)), abs_tol=1e-6)


# 8: pieces


ODD = ["", " ", "  a  b\n\n c", "\n", "a\x00b \x00", "▁x▁▁y", "你好 世界 日本語", "x" * 900, "aaaa" * 200 + " " + "de" * 300, "\t\ttab", "é\u0301 😀", "<s> <0x0A>", "7.5% 123456"]


def test_pieces_equal_the_library(spark):
    texts = ODD + [r[1] or "" for r in ROWS]
    want = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in pieces.encode(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    back = pieces.decode(pieces.encode(docs.withColumn("text", F.when(F.col("text") != "", F.col("text"))))).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)
    both = pieces.encode(docs.withColumn("decoded", F.lit(1)), decoded="decoded").collect()
    assert all(r.ids == got[r.doc_id] and r.decoded == r.text.replace("▁", " ") for r in both)


# 9: urls


def test_url_contract(spark):
    cases = {
        "http://a.example.net/en/x": "example.net/en/", "http://a.example.net/x": "net/", "http://example.net": None, "HTTP://EXAMPLE.COM/de/?q": "example.com/de/",
        "http://notexample.com/de/": None, "http://x.org/fr/1#f": "org/fr/", "http://org/fr/": "org/fr/", "http://x.org/fr": None, "x/y": None, None: None, "a://b://c.net/": None, "http://c.net?x=/": None, "http://c.net#/": None,
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    listed = spark.createDataFrame([("b:",), ("b:",), (None,), ("nowhere.org",)], "key string")
    got = {r.page_id: r for r in urls.url_verdicts(pages, listed).collect()}
    assert [got[i].rule for i in range(len(cases))] == list(cases.values())
    assert got[10].host == "b:" and got[10].verdict == "block" and got[9].host == got[9].path == ""


@pytest.mark.parametrize(("shard", "scalar"), [(1 << 20, 1 << 26), (256, 1 << 26), (256, 64)])
def test_cascade_is_exact(spark, monkeypatch, shard, scalar):
    monkeypatch.setattr(urls, "SHARD_BITS", shard)
    monkeypatch.setattr(urls, "SCALAR_BITS", scalar)
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("listed")).cache()
    judged = urls.Cascade(universe).listed(universe.withColumnRenamed("key", "name"), "name", "found")
    assert judged.where("listed <> found").count() == 0 and judged.count() == 3000


def test_pages_by_a_large_list(spark, monkeypatch):
    """Many hosts, a third of the pages on one of them, repeated page ids; scalar levels and levels read by their shards agree with the list itself."""
    host = F.when(F.col("id") % 3 == 0, F.lit("hot.example.org")).otherwise(F.concat(F.lit("h"), F.pmod(F.xxhash64("id"), F.lit(20_000)).cast("string"), F.lit(".example.org")))
    pages = spark.range(60_000).select(F.floor(F.col("id") / 2).alias("page_id"), F.concat(F.lit("http://"), host, F.lit("/x")).alias("url"))
    listed = spark.range(20_000).where("id % 4 = 1").select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.org")).alias("key"))
    for scalar in (1 << 26, 1 << 10):
        monkeypatch.setattr(urls, "SCALAR_BITS", scalar)
        monkeypatch.setattr(urls, "SHARD_BITS", 1 << 12)
        judged = urls.url_verdicts(pages, listed)
        truth = judged.join(listed.withColumn("on", F.lit(True)), F.col("host") == F.col("key"), "left")
        assert truth.where("coalesce(on, false) <> listed or listed <> (verdict = 'block')").count() == 0
        assert judged.count() == 60_000


def test_cascade_without_listed_keys(spark):
    universe = spark.createDataFrame([("a", False)], "key string, listed boolean")
    assert not urls.Cascade(universe).listed(universe.select("key"), "key", "found").first().found


# 10: near duplicates


def fingerprint_by_force(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in body(text)))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_force(fps, radius=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def crowd(rng, centres, each, flips):
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            out.add(centre ^ sum(1 << bit for bit in rng.sample(range(64), rng.randrange(flips + 1))))
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 9])
def test_tree_of_a_node_by_force(radius):
    fps = sorted(crowd(random.Random(radius), 20, 25, radius + 3), key=gray_rank)
    got, want = simhash._tree_groups(np.array(fps, np.uint64), radius).tolist(), classes_by_force(fps, radius)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def gray_rank(x):
    for by in (1, 2, 4, 8, 16, 32):
        x ^= x >> by
    return x


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 63])
def test_block_masks_cover(radius):
    masks = simhash.block_masks(radius)
    assert len(masks) == radius + 1 and sum(masks) == (1 << 64) - 1 and all(masks)


@pytest.mark.parametrize("largest", [1 << 15, 2])
def test_near_duplicates_by_force(spark, largest):
    fps = [fingerprint_by_force(r[1]) for r in ROWS]
    least = defaultdict(lambda: None)
    classes = classes_by_force(fps)
    for r, c in zip(ROWS, classes, strict=True):
        if r[0] is not None and (least[c] is None or r[0] < least[c]):
            least[c] = r[0]
    want = sorted((key(r[0]), f, key(least[c])) for r, f, c in zip(ROWS, fps, classes, strict=True))
    got = simhash.near_duplicates(data.table(spark), largest_node=largest).collect()
    assert sorted((key(r.doc_id), r.fp % (1 << 64), key(r.component_id)) for r in got) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_links_in_a_crowd(spark, radius):
    fps = sorted({*crowd(random.Random(radius), 5, 12, 3), 0, 1, 3, 7, (1 << 64) - 1})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    want = classes_by_force(fps, radius)
    for largest in (1 << 15, 20, 2):
        found = simhash.links(spark.createDataFrame(signed, "fp long"), radius, largest)
        roots = {r.node % (1 << 64): r.root for r in simhash.components(found).collect()}
        got = [roots.get(x, x - (1 << 64) if x >> 63 else x) for x in fps]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_one_of_each_class_stays(spark):
    docs = data.table(spark)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert out.count() == len(set(classes_by_force([fingerprint_by_force(r[1]) for r in ROWS])))


def shingles_by_force(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in body(text)))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike_by_force(texts):
    sets = [shingles_by_force(t) for t in texts]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def planted_copies(rng, copies, edits):
    out = []
    for k in range(12):
        words = data.words(rng, rng.randrange(60, 160), 3_000).split()
        out.append(" ".join(words))
        for _ in range(copies):
            copy = words[:]
            for _ in range(rng.randrange(1, edits)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("common", "most", "company"), [(1 << 15, 2, 8), (0, 2, 8), (0, 0, 2)])
def test_alike_by_force(spark, monkeypatch, common, most, company):
    """With 0 pairs for a member all that are apart meet by chance first, in rounds."""
    monkeypatch.setattr(likeness, "_COMMON", common)
    monkeypatch.setattr(likeness, "_PAIRS_PER_MEMBER", most)
    monkeypatch.setattr(likeness, "_COMPANY", company)
    monkeypatch.setattr(likeness, "_CROWD", 1 if most == 0 else 64)
    rng = random.Random(11)
    line = data.words(rng, 30, 3_000)
    texts = [r[1] for r in ROWS] + planted_copies(rng, 6, 6) + [f"{line} {data.words(rng, n, 3_000)}" for n in (2, 5, 9, 14, 20, 30)]
    got = likeness.alike(data.table(spark, [(i, t, "en", "a", 0, None, 1, 2, "y") for i, t in enumerate(texts)])).collect()
    roots = {r.doc_id: r.root for r in got}
    want = alike_by_force(texts)
    assert len(got) == len(texts) and len(set(zip(roots.values(), (want[i] for i in roots), strict=True))) == len(set(roots.values())) == len(set(want))


def test_stage_drops_edited_copies(spark):
    texts = planted_copies(random.Random(5), 5, 4)
    docs = data.table(spark, [(i, t, "en", "a", 0, None, 1, 2, "y") for i, t in enumerate(texts)])
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    want = alike_by_force(texts)
    assert out.columns == docs.columns and len(set(want)) < len(texts) // 2
    assert sorted(r.doc_id for r in out.collect()) == sorted({min(i for i, c in enumerate(want) if c == k) for k in want})


def test_stage_needs_no_fingerprints(spark, monkeypatch):
    """Fingerprints and their index never changed what the exact join finds."""

    def fail(*_):
        raise AssertionError("an index that has no effect")

    monkeypatch.setattr(likeness, "links", fail, raising=False)
    texts = planted_copies(random.Random(6), 3, 4)
    docs = data.table(spark, [(i, t, "en", "a", 0, None, 1, 2, "y") for i, t in enumerate(texts)])
    want = alike_by_force(texts)
    got = {r.doc_id: r.root for r in likeness.alike(docs).collect()}
    assert len(set(zip(got.values(), (want[i] for i in got), strict=True))) == len(set(want)) == len(set(got.values()))
    assert "fp" not in likeness.set_ids(docs, 5).columns


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 40, 200, 3_000):
        for keep in (0.0, 0.5, 0.9, 1.0):
            a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < keep], rng.integers(-(2**63), 2**63 - 1, n // 7)]))
            apart = int(np.bitwise_count((likeness.parities(a) ^ likeness.parities(b)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b)) and likeness.parities(a).shape == (1, 8)
    one = np.array([5], np.int64)
    assert int(np.bitwise_count(likeness.parities(one).view(np.uint64)).sum()) == 1


def test_crowd_of_near_copies_is_not_squared(spark, monkeypatch):
    """Near copies of one text, some alike at 0.8 and many not: few pairs are left to compare on their whole sets."""
    rng = random.Random(8)
    words, texts = data.words(rng, 150, 3_000).split(), []
    for k in range(240):
        copy = words[:]
        for at in rng.sample(range(5, 145), 2 + k % 6):
            copy[at] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs, counts, write = data.table(spark, [(i, t, "en", "a", 0, None, 1, 2, "y") for i, t in enumerate(texts)]), {}, likeness.materialise

    def counted(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(likeness, "materialise", counted)
    got = {r.doc_id: r.root for r in likeness.alike(docs).collect()}
    want = alike_by_force(texts)
    assert len(set(zip(got.values(), (want[i] for i in got), strict=True))) == len(set(want)) == len(set(got.values()))
    assert 10 < len(set(want)) < 200 and counts["left"] < 2 * len(texts)


def test_alike_of_an_empty_table(spark):
    assert likeness.keep_one(spark.createDataFrame([], data.SCHEMA)).count() == 0


# all


EMPTY = {
    "1": lambda s, d: repeats.removal_digest(d), "2": lambda s, d: mixing.mixed(d), "3": lambda s, d: brown.score(d), "4": lambda s, d: digest.edited_fingerprints(d),
    "6": lambda s, d: lines.verdicts(d), "7": lambda s, d: qda.quality_scores(d, s.createDataFrame([], "doc_id long, quality int")), "8": lambda s, d: pieces.encode(d), "10": lambda s, d: simhash.near_duplicates(d),
    "5": lambda s, d: warc.resolve_revisits(warc.capture_log(s.createDataFrame([], "page_id long, url string, html string"))), "9": lambda s, d: urls.url_verdicts(s.createDataFrame([], "page_id long, url string"), s.createDataFrame([("a.org",)], "key string")),
}


@pytest.mark.parametrize("number", sorted(EMPTY))
def test_empty_tables(spark, number):
    assert EMPTY[number](spark, spark.createDataFrame([], data.SCHEMA)).count() == 0


def test_pipeline_by_force(spark, tmp_path):
    """Every stage against plain Python: junk goes, one of each class stays, repeated strings go, ids and places are right."""
    rng = random.Random(21)
    junk = [(2_000 + i, " | ".join(data.words(rng, 60).split()).upper(), "en", "a", 5, None, 1, 2, "y") for i in range(60)]
    good = [(3_000 + i, data.words(rng, 90, 3_000), "en", "b", 5, None, 1, 2, "y") for i in range(60)]
    rows = ROWS + junk + good
    docs = data.table(spark, rows).withColumnsRenamed({"th": "ids", "row": "decoded", "place": "n_tokens"}).drop("position")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], int(r[0] not in range(2_000, 3_000))) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    scores = {(r.doc_id, r.th): r.predicted for r in qda.quality_scores(data.table(spark, rows), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    hashed = [int(np.uint64(xxhash.xxh64_intdigest(body(r[1]), 42)).view(np.int64)) for r in rows]
    accepted = [(r, h) for r, h in zip(rows, hashed, strict=True) if scores[r[0], h]]
    assert len(accepted) < len(rows) - 40
    seen = {}
    for (r, h), c in zip(accepted, alike_by_force([r[1] for r, _ in accepted]), strict=True):
        order = (r[0] is None, r[0] or 0, h)
        if c not in seen or order < seen[c][0]:
            seen[c] = (order, r)
    kept = [r for _, r in seen.values()]
    want = {(x[0], x[1]): x[4] for x in cut_texts_by_force(kept, 200)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(key(r.doc_id) for r in out) == sorted(key(r[0]) for r in kept)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    left = Counter((r.doc_id, r.text) for r in out)
    assert left == Counter((x[0], x[4]) for x in cut_texts_by_force(kept, 200)) and want
    for r in out:
        assert r.ids == model.encode(r.text or "") and r.n_tokens == len(r.ids) and r.round_trip
    assert len({(r.source or "", r.position) for r in out}) == len({r.position for r in out})


def cut_texts_by_force(all_rows, width):
    counts = Counter(b[s : s + width] for b in (body(r[1]) for r in all_rows) for s in range(len(b) - width + 1))
    out = []
    for r in all_rows:
        b = body(r[1])
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if counts[b[s : s + width]] > 1:
                gone[s : s + width] = b"\x01" * width
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append((r[0], len(b), sum(gone), 0, None if r[1] is None else text))
    return out
