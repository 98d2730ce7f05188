"""Exact substring dedup: suffixes sorted only through `width` bytes, by most-significant-digit passes (operator 1).

A string of `width` bytes that starts in two places makes two equal suffix heads, so
equal groups of heads are exactly the repeats. Suffixes are not shuffled one by one:
two passes over units, runs of consecutive suffixes of one document, thin them out first.

1. Suffixes whose head has its least `gram`-byte hash at the same place (the anchor) form
   a unit; its key is the anchor's gram, which all of their heads contain.
2. Units of `step` suffixes, aligned with the anchor; the key is the part that all of
   their heads contain.
3. What is left are single suffixes. Their heads are dealt by ranges of their digits (those
   of `DIGITS` byte ranges, the most significant first) and sorted by them; runs of equal
   heads are the repeats. A head that many share may fill several ranges, so the first and
   the last head of each range are compared once more.

In the first two passes a group with one member is done: nothing in it repeats. Members
that agree with another on all bytes that their heads cover are done too: everything in
them repeats. Of groups with several kinds of members, one of each kind goes on to the
next pass, with the bytes around it, so whole texts move once for this and once to be cut.
Groups are counted by partial aggregation and joined back, so a key that a third of all
units share needs no task of its own.

Byte ranges are compared by 64-bit hashes, and whole heads (or units) by a second,
independent one. Different heads are taken for equal only if both hashes agree: among n
heads with chance n * n / 2**129 at most, 2e-11 for the 10**14 heads of 100 TB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import SLICE_BYTES, gather, materialise, sliding_argmin, spans, text_hash, utf8, whole_text

_CHUNK = 1 << 20
#: Byte ranges of a head by which pass 3 sorts.
DIGITS = 3
#: Bytes around a unit that its context keeps: the longest run of pass 2.
_MARGIN = 16
_RANDOM = np.random.default_rng(20240229)
_BYTE_CODES = _RANDOM.integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASES = [int(x) | 5 for x in _RANDOM.integers(2**40, 2**62, 2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        base, size = _BASES[which] | 1, max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _POWERS[which]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any substrings of one byte array."""

    def __init__(self, body: np.ndarray, which: int):
        self.up, self.down = _powers(which, len(body) + 1)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[which][body] * self.up[: len(body)], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def _pieces(body: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes to work on at once, with the first start, the number of starts and the document of each part, and the offset of a cut document."""
    for first, last in spans(at, SLICE_BYTES):
        if last - first > 1 or at[last] - at[first] <= _CHUNK:
            count = np.maximum(np.diff(at[first : last + 1]) - width + 1, 0)
            yield body[at[first] : at[last]], at[first:last] - at[first], count, np.arange(first, last), 0
        else:
            for cut in range(0, int(at[last] - at[first]) - width + 1, _CHUNK):
                part = body[at[first] + cut : min(at[first] + cut + _CHUNK + width - 1, at[last])]
                yield part, np.zeros(1, np.int64), np.array([len(part) - width + 1]), np.array([first]), cut


def _anchored(width: int, gram: int) -> Callable:
    """Units of pass 1. place: start << 16 | (suffixes - 1) << 8 | (anchor - start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = utf8(batch.column(2))
            for part, starts, count, docs, cut in _pieces(body, at, width):
                suffix = gather(starts, count)
                if not len(suffix):
                    continue
                one, two = Rolling(part, 0), Rolling(part, 1)
                grams = one.all(gram)
                anchor = sliding_argmin(grams >> np.uint64(24), width - gram + 1)[suffix]
                new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (suffix[1:] != suffix[:-1] + 1)]))
                end = np.concatenate([new[1:], [len(suffix)]]) - 1
                low, high, anchor = suffix[new], suffix[end], anchor[new]
                doc = np.repeat(np.arange(len(docs)), count)[new]
                span = (high - low) << 8 | (anchor - low)
                full = two.of(low, high + width) ^ _mixed(span.astype(np.uint64) + np.uint64(1))
                row = docs[doc]
                yield _rows(batch, row, grams[anchor], full, (low - starts[doc] + cut) << 16 | span)

    return run


def _context_table(width: int) -> Callable:
    """(doc_id, th, base, place, body) of (doc_id, th, text, places): the bytes that a pass 1 unit's heads and their neighbours cover; base is the offset of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = utf8(batch.column(2))
            lists = batch.column(3)
            place, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            start, size = place >> 16, (place >> 8 & 255) + 1
            low, high = np.maximum(start - _MARGIN, 0), np.minimum(start + size - 1 + width + _MARGIN, at[row + 1] - at[row])
            raw = body.tobytes()
            part = pa.array([raw[a:b] for a, b in zip((at[row] + low).tolist(), (at[row] + high).tolist(), strict=True)], pa.binary())
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(low), pa.array(place), part], ["doc_id", "th", "base", "place", "body"])

    return run


def _runs(width: int, step: int) -> Callable:
    """Units of pass 2 from the contexts: runs of `step` suffixes counted from the anchor, as far as the context has whole heads for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = utf8(batch.column(4))
            base, place = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            start = (place >> 16) - base
            anchor, size = start + (place & 255), (place >> 8 & 255) + 1
            first, last = (start - anchor) // step, (start + size - 1 - anchor) // step
            row = np.repeat(np.arange(len(place)), last - first + 1)
            begin = np.repeat(anchor, last - first + 1) + gather(first, last - first + 1) * step
            yield from _hashed(batch, body, at, row, begin, base, width, step)

    return run


def _singles(width: int, step: int) -> Callable:
    """Heads of pass 3: every suffix of a run, from the contexts with their runs; its digits, the second hash and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = utf8(batch.column(4))
            base, size = batch.column(2).to_numpy(), np.diff(at)
            lists = batch.column(3)
            runs, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes * step)
            begin = gather(runs, np.full(len(runs), step)) - base[row]
            good = (begin >= 0) & (begin <= size[row] - width)
            row, begin = row[good], begin[good]
            if not len(row):
                continue
            one, two = Rolling(body, 0), Rolling(body, 1)
            first = at[row] + begin
            digits = [one.of(first + width * i // DIGITS, first + width * (i + 1) // DIGITS) for i in range(DIGITS)]
            keys = [pa.array(x.view(np.int64)) for x in (*digits, two.of(first, first + width))]
            whose = pa.array(row)
            yield pa.RecordBatch.from_arrays([*keys, batch.column(0).take(whose), batch.column(1).take(whose), pa.array(begin + base[row])], [*_DIGITS, "full", "doc_id", "th", "place"])

    return run


_DIGITS = [f"d{i}" for i in range(DIGITS)]


def _equal_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of heads in sorted order, each place (once) of those that two places of this range have; also the first and the last head, with their digits.

    columns: digits, full, who, doc_id, th, place. No more than a batch and one row are held.
    """
    kept, known = None, False  # the row before, and whether it is among those given already
    for batch in batches:
        if not batch.num_rows:
            continue
        if kept is None:
            yield _named(batch.slice(0, 1).columns)
        rows = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        place, who = rows.column(rows.num_columns - 1).to_numpy(), rows.column(DIGITS + 1).to_numpy()
        new = np.zeros(rows.num_rows, bool)
        for i in range(DIGITS + 1):
            digit = rows.column(i).to_numpy()
            new[1:] |= digit[1:] != digit[:-1]
        group = np.cumsum(new)
        once = new | np.append(True, (place[1:] != place[:-1]) | (who[1:] != who[:-1]))
        several = np.bincount(group[once]) > 1
        several[0] |= known
        given = once & several[group]
        given[0] &= not known
        out = rows.take(pa.array(np.flatnonzero(given)))
        yield _named([*[pa.nulls(out.num_rows, pa.int64())] * (DIGITS + 1), *out.columns[DIGITS + 1 :]])
        kept, known = rows.slice(rows.num_rows - 1), bool(several[-1])
    if kept is not None:
        yield _named(kept.columns)


def _named(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [*_DIGITS, "full", "who", "doc_id", "th", "place"])


def _hashed(batch: pa.RecordBatch, body: np.ndarray, at: np.ndarray, row: np.ndarray, begin: np.ndarray, base: np.ndarray, width: int, step: int) -> Iterator[pa.RecordBatch]:
    """Digit (what all heads of a unit contain) and hash of all that they cover; units without a whole head in their text are left out."""
    size = np.diff(at)
    good = (begin + step - 1 >= 0) & (begin <= size[row] - width)
    row, begin = row[good], begin[good]
    if not len(row):
        return
    one, two = Rolling(body, 0), Rolling(body, 1)
    low, high = np.maximum(begin, 0), np.minimum(begin + width + step - 1, size[row])
    full = two.of(at[row] + low, at[row] + high)
    if step > 1:
        full ^= _mixed(((low - begin) << 16 | (high - begin)).astype(np.uint64))
    core = one.of(at[row] + begin + step - 1, at[row] + begin + width)
    yield _rows(batch, row, core, full, begin + base[row])


def _rows(batch: pa.RecordBatch, row: np.ndarray, digit: np.ndarray, full: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    row = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(digit.view(np.int64)), pa.array(full.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(place.astype(np.int64))], ["digit", "full", "doc_id", "th", "place"])


def _several(overlapping: bool) -> Column:
    """True for groups of more than one unit. Units of passes 2 and 3 can come from two contexts of one document; they count once there."""
    if not overlapping:
        return F.count("*") > 1
    where = F.xxhash64("doc_id", "th", "place")
    return F.min(where) != F.max(where)


def _classified(units: DataFrame, name: str, overlapping: bool = False) -> tuple[DataFrame, DataFrame]:
    """(whole, onward): units that repeat as they are, and one unit of each kind found in groups of several kinds."""
    digits = units.groupBy("digit").agg(_several(overlapping).alias("several"), F.min("full").alias("least"), F.max("full").alias("most"))
    # a table of its own, so that a digit that many units share can be split in the join
    digits = materialise(digits.where("several").select("digit", (F.col("least") == F.col("most")).alias("pure")), f"{name}-digits")
    joined = materialise(units.join(digits, "digit"), name)
    mixed = joined.where(~F.col("pure"))
    kinds = materialise(mixed.groupBy("digit", "full").agg(_several(overlapping).alias("several"), F.min(F.struct("doc_id", "th", "place")).alias("one")), f"{name}-kinds")
    # all but the kinds of one member; a unit meets one row of those at most
    whole = joined.join(kinds.where(~F.col("several")).select("digit", "full"), ["digit", "full"], "left_anti")
    return whole.select("doc_id", "th", "place"), kinds.select("one.*")


def _joined(texts: DataFrame, places: DataFrame, how: str = "inner") -> DataFrame:
    """texts (doc_id, th, text) with what `places` has for them."""
    right = places.withColumnsRenamed({"doc_id": "p_id", "th": "p_th"})
    return texts.join(right, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th")), how).drop("p_id", "p_th")


def repeated_spans(docs: DataFrame, width: int = 200, gram: int = 32, step: int = 16) -> DataFrame:
    """(doc_id, th, runs): per document with repeats, runs (start, suffixes) of suffixes whose `width`-byte head starts elsewhere too.

    Texts are judged as whole UTF-8 strings, null as empty; th is the hash that tells
    rows of one doc_id apart. Runs may touch or overlap.
    """
    texts = keyed(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    unit = f"digit long, full long, doc_id {kind}, th long, place long"
    whole, onward = _classified(texts.mapInArrow(_anchored(width, gram), unit), "anchors")
    wanted = onward.groupBy("doc_id", "th").agg(F.collect_list("place").alias("places"))
    contexts = materialise(_joined(texts, wanted).mapInArrow(_context_table(width), f"doc_id {kind}, th long, base long, place long, body binary"), "contexts")
    whole_runs, onward_runs = _classified(contexts.mapInArrow(_runs(width, step), unit), "runs", overlapping=True)
    held = contexts.select("doc_id", "th", "base", "place", "body")
    lists = onward_runs.select("doc_id", "th", "place").groupBy("doc_id", "th").agg(F.collect_list("place").alias("runs"))
    near = F.filter("runs", lambda x: (x >= F.shiftright("place", 16) - step + 1) & (x <= F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(F.lit(255))))
    last = _joined(held, lists).withColumn("runs", near).where(F.size("runs") > 0).select("doc_id", "th", "base", "runs", "body")
    columns = f"{', '.join(f'{d} long' for d in _DIGITS)}, full long, doc_id {kind}, th long, place long"
    heads = materialise(last.mapInArrow(_singles(width, step), columns), "suffixes").select(*_DIGITS, "full", F.xxhash64("doc_id", "th").alias("who"), "doc_id", "th", "place")
    order = [*_DIGITS, "full", "who", "place"]
    ranged = heads.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_equal_heads, f"{', '.join(f'{d} long' for d in _DIGITS)}, full long, who long, doc_id {kind}, th long, place long")
    ranged = materialise(ranged, "heads")
    borders = ranged.where("full is not null")  # two rows for each range
    open_ = borders.groupBy(*_DIGITS, "full").agg(_several(True).alias("several")).where("several").drop("several")
    repeated = ranged.where("full is null").select("doc_id", "th", "place").unionByName(borders.join(open_, [*_DIGITS, "full"], "left_semi").select("doc_id", "th", "place"))
    size = F.shiftright("place", 8).bitwiseAND(F.lit(255)) + 1
    parts = [
        whole.select("doc_id", "th", F.shiftright("place", 16).alias("start"), size.cast("long").alias("suffixes")),
        whole_runs.select("doc_id", "th", F.col("place").alias("start"), F.lit(step).cast("long").alias("suffixes")),
        repeated.select("doc_id", "th", F.col("place").alias("start"), F.lit(1).cast("long").alias("suffixes")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "suffixes")).alias("runs"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_hash().alias("th"), whole_text().alias("text"))


def removed_mask(n: int, runs: np.ndarray, suffixes: np.ndarray, width: int) -> np.ndarray:
    """True for each of n bytes that a repeated head covers."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.clip(runs, 0, n), 1)
    np.add.at(change, np.clip(runs + suffixes - 1 + width, 0, n), -1)
    return np.cumsum(change[:n]) > 0


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, bytes]]]]:
    for batch in batches:
        body, at = utf8(batch.column(2))
        lists = batch.column(3)
        flat = lists.flatten()
        start, size = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
        lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        out = []
        for i in range(len(at) - 1):
            text, n = body[at[i] : at[i + 1]], int(at[i + 1] - at[i])
            if cuts[i] == cuts[i + 1]:
                out.append((n, 0, 0, text.tobytes()))
                continue
            gone = removed_mask(n, start[cuts[i] : cuts[i + 1]], size[cuts[i] : cuts[i + 1]], width)
            begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((n, int(gone.sum()), begins, text[~gone].tobytes()))
        yield batch, out


def removal_digest(docs: DataFrame, width: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document row; an empty text has no bytes and no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in _cut(batches, width):
            columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)] + [pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts = _joined(keyed(docs), repeated_spans(docs, width), "left").select("doc_id", "th", "text", "runs")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """The documents with repeated bytes taken out of `text` (all occurrences) and n_chars, if there, counted anew.

    Bytes of a character that a cut divides go with the cut. A text that repeats as a
    whole becomes empty; its row stays. Other columns pass through; null texts stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in _cut(batches, width):
            texts = pa.array([x[3].decode("utf-8", "ignore") for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == 2 else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = F.struct(F.lit(0).alias("doc_id"), *[F.col(f"`{c}`") for c in rest])  # never an empty struct
    texts = docs.select("doc_id", text_hash().alias("th"), whole_text().alias("text"), F.col("text").isNull().alias("was_null"), whole.alias("rest"))
    joined = _joined(texts, repeated_spans(docs, width), "left").select("doc_id", "th", "text", "runs", "was_null", "rest")
    done = joined.mapInArrow(run, joined.schema)
    text = F.when(~F.col("was_null"), F.col("text"))
    fields = {c: F.col(f"rest.`{c}`") for c in rest} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in rest:
        fields["n_chars"] = F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return done.select(*[fields[c].alias(c) for c in docs.columns])


def op1_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    return removal_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
