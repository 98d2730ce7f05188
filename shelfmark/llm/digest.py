"""Document fingerprints from statistically improbable byte windows (operator 4).

Every window of some bytes has an entropy; entropies that few windows of the whole corpus
have are rare and rank first. In every run of neighbouring windows the rarest one
(leftmost of equals) gains a point, and windows with enough points become features; a
text without such a window has its rarest one as its only feature. Texts of fewer than
`SHORT` code points have windows and runs of their own size, with ranks from such texts.
A document's features fill a chain of Bloom filters of `BITS` bits, at most `PER_FILTER`
features each. The likeness of two chains is the overlap of set bits beyond what chance
explains, normalised by the largest overlap that is possible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import gather, materialise, sliding_argmin, spans, text_hash, utf8, whole_text
from shelfmark.llm.repeats import Rolling


class Scale(NamedTuple):
    """Bytes of a window, windows of a run, points that make a feature."""

    window: int
    run: int
    points: int


LONG, BRIEF = Scale(64, 64, 16), Scale(8, 8, 2)
SHORT, LEVELS = 512, 1000
BITS, PROBES, PER_FILTER = 2048, 5, 160
#: Windows below this part of the largest entropy say too little to be a feature.
LEAST_ENTROPY = 0.1
#: Texts above this many bytes are worked on in overlapping cuts.
_CUT = 1 << 20
_UNIT = 1 << 20
_NEVER = 1 << 30


def _gains(window: int) -> np.ndarray:
    return np.array([0] + [round(c * np.log2(c) * _UNIT) for c in range(1, window + 1)], np.int64)


_GAINS = {scale.window: _gains(scale.window) for scale in (LONG, BRIEF)}


def scale_of(text: bytes) -> Scale:
    return BRIEF if int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)) < SHORT else LONG


def entropy_levels(body: np.ndarray, window: int = LONG.window) -> np.ndarray:
    """Entropy of each window as a level from 0 to LEVELS, in whole-number arithmetic, so equal windows have equal levels."""
    n = len(body)
    if n < window:
        return np.zeros(0, np.int64)
    gain = _GAINS[window]
    change = np.concatenate([[0], np.diff(gain)])
    order = np.argsort(body, kind="stable")
    key = body[order].astype(np.int64) * (n + window) + order
    high = np.searchsorted(key, key + window)
    rank = np.arange(n)
    low = np.cumsum(np.bincount(high, minlength=n + 1))[:n]
    leaving, entering = np.empty(n, np.int64), np.empty(n, np.int64)
    leaving[order] = change[high - rank]  # the byte's count in the window that it begins
    entering[order] = change[rank - low + 1]  # its count in the window that it ends
    total = np.empty(n - window + 1, np.int64)
    total[0] = gain[np.bincount(body[:window], minlength=256)].sum()
    total[1:] = entering[window:] - leaving[: n - window]
    np.cumsum(total, out=total)
    return LEVELS - total * LEVELS // gain[window]


def _cuts(texts: list[bytes], scale: Scale) -> Iterator[tuple[int, int, int]]:
    """(text, first and last start of a window) of every cut; a text of usual size is one cut."""
    for i, text in enumerate(texts):
        for first in range(0, max(len(text) - scale.window + 1, 0), _CUT):
            yield i, first, min(first + _CUT, len(text) - scale.window + 1) - 1


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {LONG: np.zeros(LEVELS + 1, np.int64), BRIEF: np.zeros(LEVELS + 1, np.int64)}
    for batch in batches:
        body, at = utf8(batch.column(0))
        for first, last in spans(at):
            texts = [body[at[i] : at[i + 1]].tobytes() for i in range(first, last)]
            scales = [scale_of(x) for x in texts]
            for scale, total in counts.items():
                own = [x for x, s in zip(texts, scales, strict=True) if s is scale]
                for group in _grouped(own, list(_cuts(own, scale))):
                    parts = [own[i][a : b + scale.window] for i, a, b in group]
                    starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])[:-1]
                    levels = entropy_levels(np.frombuffer(b"".join(parts), np.uint8), scale.window)
                    total += np.bincount(levels[gather(starts, np.array([b - a + 1 for _, a, b in group]))], minlength=LEVELS + 1)
    for scale, total in counts.items():
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), scale.window)), pa.array(there), pa.array(total[there])], ["window", "level", "windows"])


def _grouped(texts: list[bytes], cuts: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The cuts in groups of about _CUT bytes."""
    group, size = [], 0
    for cut in cuts:
        if group and size + cut[2] - cut[1] > _CUT:
            yield group
            group, size = [], 0
        group.append(cut)
        size += cut[2] - cut[1]
    if group:
        yield group


def rarity_ranks(docs: DataFrame) -> dict[int, np.ndarray]:
    """For both sizes of windows the rank of each entropy level by the number of windows that have it in all documents; LEVELS + 1 numbers."""
    counted = docs.select(whole_text().alias("text")).mapInArrow(_histogram, "window long, level long, windows long").groupBy("window", "level").agg(F.sum("windows").alias("windows"))
    counts = {(r.window, r.level): r.windows for r in counted.collect()}
    out = {}
    for scale in (LONG, BRIEF):
        by_rarity = sorted(range(LEVELS + 1), key=lambda level: (counts.get((scale.window, level), 0), level))
        out[scale.window] = np.empty(LEVELS + 1, np.int64)
        out[scale.window][by_rarity] = np.arange(LEVELS + 1)
        out[scale.window][: int(LEAST_ENTROPY * LEVELS)] = _NEVER
    return out


def features(texts: list[bytes], scale: Scale, ranks: dict[int, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text (positions, hashes) of the windows with enough points, in order of position.

    Points of a window come from runs that reach `run - 1` windows to both sides, so a cut
    of a long text has that many more on both sides.
    """
    out = [[] for _ in texts]
    more = scale.run - 1
    for group in _grouped(texts, list(_cuts(texts, scale))):
        lows = [max(a - more, 0) for _, a, _ in group]
        parts = [texts[i][low : b + more + scale.window] for (i, _, b), low in zip(group, lows, strict=True)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        body = np.frombuffer(b"".join(parts), np.uint8)
        windows = np.diff(starts) - scale.window + 1
        rank = ranks[scale.window][entropy_levels(body, scale.window)]
        least = sliding_argmin(rank, scale.run)[gather(starts[:-1], np.maximum(windows - scale.run + 1, 0))]
        points = np.bincount(least, minlength=len(rank))
        points[rank == _NEVER] = 0
        chosen = np.flatnonzero(points >= scale.points)
        hashes = Rolling(body, 0).of(chosen, chosen + scale.window)
        cuts = np.searchsorted(chosen, starts)
        for k, (i, a, b) in enumerate(group):
            place = chosen[cuts[k] : cuts[k + 1]] - starts[k] + lows[k]
            own = (place >= a) & (place <= b)
            out[i].append((place[own], hashes[cuts[k] : cuts[k + 1]][own]))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return [empty if not x else x[0] if len(x) == 1 else tuple(np.concatenate(y) for y in zip(*x, strict=True)) for x in out]


def only_feature(text: bytes, scale: Scale, ranks: dict[int, np.ndarray]) -> np.ndarray:
    """Hash of the rarest window (leftmost of equals) of a text without features; of the whole text where it is shorter than a window."""
    best = None
    for _, a, b in _cuts([text], scale):
        body = np.frombuffer(text[a : b + scale.window], np.uint8)
        rank = ranks[scale.window][entropy_levels(body, scale.window)]
        at = int(np.argmin(rank))
        if best is None or rank[at] < best[0]:
            best = (int(rank[at]), text[a + at : a + at + scale.window])
    return np.frombuffer(hashlib.blake2b(text if best is None else best[1], digest_size=8).digest(), np.uint64)


def _chain(text: bytes, hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of distinct features and the filters, one row of bytes each."""
    if not text:
        return 0, np.zeros((0, BITS // 8), np.uint8)
    _, where = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(where)]
    bits = np.zeros((-(-len(hashes) // PER_FILTER), BITS), bool)
    row = np.arange(len(hashes)) // PER_FILTER
    for probe in range(PROBES):
        bits[row, (hashes >> np.uint64(11 * probe + 9)).astype(np.int64) % BITS] = True
    return len(hashes), np.packbits(bits, axis=1)


def likeness(one: tuple[int, np.ndarray], two: tuple[int, np.ndarray]) -> float:
    """0 to 1: for each filter of the shorter chain its best normalised overlap in the other, weighted by features; two empty texts are alike."""
    if one[0] == two[0] and np.array_equal(one[1], two[1]):
        return 1.0
    if len(one[1]) > len(two[1]) or (len(one[1]) == len(two[1]) and (one[0], one[1].tobytes()) > (two[0], two[1].tobytes())):
        one, two = two, one
    if not one[0]:
        return 0.0
    sizes = [np.minimum(PER_FILTER, n - PER_FILTER * np.arange(len(f))) for n, f in (one, two)]
    full = [np.bitwise_count(f).sum(axis=1, dtype=np.int64) for _, f in (one, two)]
    free = 1 - 1 / BITS
    score = np.empty(len(one[1]))
    for i, row in enumerate(one[1]):
        common = np.bitwise_count(two[1] & row).sum(axis=1, dtype=np.int64)
        chance = BITS * (1 - free ** (PROBES * sizes[0][i]) - free ** (PROBES * sizes[1]) + free ** (PROBES * (sizes[0][i] + sizes[1])))
        most = np.minimum(full[0][i], full[1])
        floor = np.minimum(chance, most - 1e-9)
        score[i] = np.clip((common - floor) / (most - floor), 0, 1).max()
    return float(np.average(score, weights=sizes[0]))


def fingerprint(text: bytes, ranks: dict[int, np.ndarray]) -> str:
    """The fingerprint of one text by itself."""
    return written(*_packed(_whole_chain(text, ranks)))


def _whole_chain(text: bytes, ranks: dict[int, np.ndarray]) -> tuple[int, np.ndarray]:
    scale = scale_of(text)
    hashes = features([text], scale, ranks)[0][1]
    return _chain(text, hashes if len(hashes) else only_feature(text, scale, ranks))


def _packed(chain: tuple[int, np.ndarray]) -> tuple[int, bytes]:
    return chain[0], chain[1].tobytes()


def written(size: int, bits: bytes) -> str:
    return f"{size}:{bits.hex()}"


#: The bytes of a row that waits for its next document, and of what the last of a partition brings with it.
_RESULT = "n_chars long, edited_sha256 string, size long, bits binary, edited_size long, edited_bits binary, near_edited double, near_next double"
_NAMES = ["n_chars", "edited_sha256", "size", "bits", "edited_size", "edited_bits", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.float64(), pa.float64()]


def in_order(docs: DataFrame, bytes_per_part: int = 16 << 20) -> DataFrame:
    """(doc_id, th, text) in ranges by doc_id (null first), then text hash, sorted; ids of any type that sorts."""
    total = docs.agg(F.sum(F.octet_length(whole_text()))).first()[0] or 0
    parts = max(-(-total // bytes_per_part), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", text_hash().alias("th"), whole_text().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("th")]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last quarter is the begin of the next document; likeness to the edit and to the next.

    Order is doc_id (null first), then text hash; rows that repeat an id stay separate;
    after the last document comes the first. Null texts count as empty: no features,
    fingerprint "0:", alike only to empty texts. A text shorter than a window has one
    feature, itself. Texts of any length are worked on whole, in cuts of bounded size.

    Each range of documents is one task, which compares neighbours; the last document of a
    range meets the first of the next in a join by the number of the range.
    """
    ranks = rarity_ranks(docs)
    rows = in_order(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begun, held = TaskContext.get().partitionId(), False, []
        for batch in batches:
            body, at = utf8(batch.column(2))
            for first, last in spans(at):
                texts = [body[at[i] : at[i + 1]].tobytes() for i in range(first, last)]
                ids = batch.column(0).slice(first, last - first).to_pylist()
                if not begun and texts:
                    begun = True
                    yield _loose(part, "first", ids[0], texts[0], batch.schema.field(0).type)
                held += zip(ids, texts, strict=True)
                if len(held) > 1:
                    yield _finished(part, held, ranks, batch.schema.field(0).type)
                    held = held[-1:]
        if held:
            yield _loose(part, "last", *held[0], batch.schema.field(0).type)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, after = (x[i].as_py().encode() for x in (batch.column(1), batch.column(2)))
                done = _finished(0, [(batch.column(0)[i].as_py(), own), (None, after)], ranks, batch.schema.field(0).type)
                yield done.select(["doc_id", *_NAMES])

    done = materialise(rows.mapInArrow(run, f"part int, role string, doc_id {kind}, text string, {_RESULT}"), "digests")
    firsts = done.where("role = 'first'").select("part", F.col("text").alias("after"))
    meet = done.where("role = 'last'").select("part", "doc_id", "text").join(_next_parts(firsts.select("part")), "part")
    ends = meet.join(firsts.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "after").mapInArrow(between, f"doc_id {kind}, {_RESULT}")
    every = done.where("role is null").select("doc_id", *_NAMES).unionByName(ends)
    shown = lambda size, bits: F.concat(F.col(size).cast("string"), F.lit(":"), F.lower(F.hex(bits)))
    return every.select("doc_id", "n_chars", "edited_sha256", shown("size", "bits").alias("fingerprint"), shown("edited_size", "edited_bits").alias("edited_fingerprint"), "near_edited", "near_next")


_PARTS = 1_000


def _next_parts(parts: DataFrame) -> DataFrame:
    """(part, next): the number of the next range that has rows; after the last comes the first. One row for each range."""
    group = parts.withColumn("g", F.expr(f"part div {_PARTS}"))
    inside = F.lead("part").over(Window.partitionBy("g").orderBy("part"))
    groups = group.groupBy("g").agg(F.min("part").alias("least"))  # a row for each thousand ranges
    heads = groups.select("g", F.lead("least").over(Window.partitionBy(F.lit(0)).orderBy("g")).alias("later"), F.min("least").over(Window.partitionBy(F.lit(0))).alias("first"))
    return group.withColumn("near", inside).join(heads, "g").select("part", F.coalesce("near", "later", "first").alias("next"))


def _loose(part: int, role: str, doc_id, text: bytes, kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([role]), pa.array([doc_id], kind), pa.array([text.decode()], pa.string()), *[pa.nulls(1, k) for k in _KINDS]]
    return pa.RecordBatch.from_arrays(columns, ["part", "role", "doc_id", "text", *_NAMES])


#: Features are those of the text itself this many bytes before its edit begins.
_REACH = 2 * (LONG.window + LONG.run)


def _finished(part: int, rows: list[tuple], ranks: dict[int, np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    """Results of the rows with the row after each; the last one only serves as the next."""
    texts = [r[1] for r in rows]
    body = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    begins = np.flatnonzero((body & 0xC0) != 0x80)  # code points
    index = np.searchsorted(begins, at)
    chars = np.diff(index)
    begins = np.append(begins, len(body))
    own = _by_scale(texts, [LONG if n >= SHORT else BRIEF for n in chars.tolist()], ranks)
    edits, pieces, froms, scales = [], [], [], []
    for i in range(len(rows) - 1):
        quarter = int(chars[i]) // 4
        keep = int(begins[index[i] + chars[i] - quarter] - at[i]) if chars[i] else 0
        taken = min(quarter, int(chars[i + 1]))
        more = int(begins[index[i + 1] + taken] - at[i + 1])
        edits.append(texts[i][:keep] + texts[i + 1][:more])
        scales.append(LONG if chars[i] - quarter + taken >= SHORT else BRIEF)
        # far from the edit, features of texts of usual length are those of the text itself
        froms.append(keep - 2 * _REACH if keep > 4 * _REACH and chars[i] >= SHORT and scales[-1] is LONG else 0)
        pieces.append(edits[-1][froms[-1] :])
    tails = _by_scale(pieces, scales, ranks)
    chains = [_chain(x, h if len(h) else only_feature(x, LONG if n >= SHORT else BRIEF, ranks)) for x, (_, h), n in zip(texts, own, chars.tolist(), strict=True)]
    out: list[tuple] = []
    for i, (text, start, scale, (place, hashes)) in enumerate(zip(edits, froms, scales, tails, strict=True)):
        if start:
            border = start + _REACH
            hashes = np.concatenate([own[i][1][own[i][0] < border], hashes[place + start >= border]])
        edited = _chain(text, hashes if len(hashes) else only_feature(text, scale, ranks))
        out.append((int(chars[i]), hashlib.sha256(text).hexdigest(), *_packed(chains[i]), *_packed(edited), likeness(chains[i], edited), likeness(chains[i], chains[i + 1])))
    n = len(out)
    columns = [pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.string()), pa.array([r[0] for r in rows[:n]], kind), pa.nulls(n, pa.string())]
    columns += [pa.array([x[k] for x in out], _KINDS[k]) for k in range(len(_KINDS))]
    return pa.RecordBatch.from_arrays(columns, ["part", "role", "doc_id", "text", *_NAMES])


def _by_scale(texts: list[bytes], scales: list[Scale], ranks: dict[int, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    out: list = [None] * len(texts)
    for scale in (LONG, BRIEF):
        own = [i for i, s in enumerate(scales) if s is scale]
        for i, found in zip(own, features([texts[i] for i in own], scale, ranks), strict=True):
            out[i] = found
    return out


def op4_rare_window_digest(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
