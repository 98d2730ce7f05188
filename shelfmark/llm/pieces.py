"""SentencePiece encoding and decoding by suffix-array matching (operator 8).

Texts of a batch are cut where no piece can cross (before a run of spaces, around line
ends); distinct parts that are new are concatenated, and their suffixes are sorted by as
many bytes as a key holds. Every piece of the vocabulary is looked up in that array by
binary search; its range of suffixes gives its occurrences, which are the edges (start,
end, piece). Edges are sorted by position. The model at hand is BPE, whose path is not
the one of best total score, so edges are relaxed in BPE's order: in each part the edge
of best score that spans two neighbouring symbols joins them, leftmost first, until no
edge spans two neighbours. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import gather, spans, utf8, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_PART = re.compile(" +[^ \n\x00]*|[^ \n\x00]+|[\n\x00]")
_KEY = 16
_LONG = 256
_NONE = np.iinfo(np.int32).max
_CACHE_PARTS = 200_000


class Vocabulary:
    """Pieces of a model as bytes (space for the mark of a space), the ranks of their scores and the byte pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.surface = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        plain = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.surface[i] = piece.replace("\u2581", " ").encode()
                plain.append(i)
                if "\n" in piece or " " in self.surface[i].decode().lstrip(" "):
                    raise ValueError(f"piece {piece!r} crosses a place where texts are cut")
        order = sorted(plain, key=lambda i: self.surface[i])
        scores = np.array([model.get_score(i) for i in order])
        self.ids = np.array(order, np.int32)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.bytes = [self.surface[i] for i in order]
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.low = np.array([x[:_KEY] for x in self.bytes], f"S{_KEY}")
        self.high = np.array([x[:_KEY].ljust(_KEY, b"\xff") for x in self.bytes], f"S{_KEY}")


def _edges(body: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of all pieces: sorted start << 8 | bytes, and the piece's number; body holds parts with a zero byte after each."""
    n = len(body)
    padded = np.concatenate([body, np.zeros(_KEY, np.uint8)])
    heads = np.flatnonzero(((body & 0xC0) != 0x80) & (body != 0))
    rows = np.lib.stride_tricks.sliding_window_view(padded, _KEY)[heads]
    keep = np.cumsum(rows == 0, axis=1, dtype=np.uint8) == 0  # what lies behind the end of a part doesn't count
    rows = np.where(keep, rows, 0).astype(np.uint8)
    halves = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    suffixes = np.ascontiguousarray(rows[order]).view(f"S{_KEY}").ravel()
    first, last = np.searchsorted(suffixes, words.low), np.searchsorted(suffixes, words.high, side="right")
    count = last - first
    piece = np.repeat(np.arange(len(count)), count)
    start = heads[order[gather(first, count)]]
    size = words.size[piece]
    long = np.flatnonzero(size > _KEY)
    if len(long):
        ok = np.array([start[i] + size[i] <= n and body[start[i] : start[i] + size[i]].tobytes() == words.bytes[piece[i]] for i in long.tolist()])
        drop = long[~ok]
        piece, start, size = np.delete(piece, drop), np.delete(start, drop), np.delete(size, drop)
    key = start << 8 | size
    by_place = np.argsort(key, kind="stable")
    return key[by_place], piece[by_place]


def _found(keys: np.ndarray, pieces: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of the piece that spans start to end, or -1."""
    if not len(keys):
        return np.full(len(start), -1)
    want = start << 8 | np.minimum(end - start, 255)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where((keys[at] == want) & (end - start < 255), pieces[at], -1)


def encode_parts(parts: list[bytes], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts, one after the other, and how many each has."""
    body = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8)
    keys, pieces = _edges(body, words)
    starts = np.flatnonzero(((body & 0xC0) != 0x80))
    lengths = np.array([len(x) for x in parts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    is_end = np.zeros(len(body) + 1, bool)
    is_end[begin + lengths] = True
    symbols = starts[~is_end[starts]]
    part = np.searchsorted(begin, symbols, side="right") - 1
    stop = np.append(symbols[1:], 0)
    final = np.append(part[1:] != part[:-1], True)
    stop[final] = (begin + lengths)[part[final]]
    slow = lengths > _LONG
    start, stop, part = _joined(symbols, stop, part, keys, pieces, words, slow)
    found = _found(keys, pieces, start, stop)
    ids = np.where(found >= 0, words.ids[np.maximum(found, 0)], -1)
    size = np.where(found >= 0, 1, stop - start)  # unknown: a piece for each byte
    at = np.repeat(np.arange(len(ids)), size)
    out = ids[at]
    raw = gather(start, size)
    out = np.where(out >= 0, out, words.byte_id[body[raw]])
    counts = np.bincount(part[at], minlength=len(parts))
    return out.astype(np.int32), counts


def _joined(start: np.ndarray, stop: np.ndarray, part: np.ndarray, keys: np.ndarray, pieces: np.ndarray, words: Vocabulary, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after all joins, sorted by start; in every round each part makes its best join."""
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    late = slow[part]
    for p in np.unique(part[late]).tolist():
        own = part == p
        a, b = _by_heap(start[own].tolist(), stop[own].tolist(), keys, pieces, words)
        done.append((a, b, np.full(len(a), p)))
    start, stop, part = start[~late], stop[~late], part[~late]

    def ranks(i: np.ndarray) -> np.ndarray:
        """Rank of the join of symbol i with the next one."""
        out = np.full(len(i), _NONE, np.int32)
        ok = np.flatnonzero(i + 1 < len(start))
        ok = ok[part[i[ok]] == part[i[ok] + 1]]
        found = _found(keys, pieces, start[i[ok]], stop[i[ok] + 1])
        out[ok] = np.where(found >= 0, words.rank[np.maximum(found, 0)], _NONE)
        return out

    rank = ranks(np.arange(len(start)))
    while len(start):
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        least = np.minimum.reduceat(rank, cuts)
        sizes = np.diff(np.append(cuts, len(part)))
        idle = np.repeat(least == _NONE, sizes)
        if idle.any():
            done.append((start[idle], stop[idle], part[idle]))
            start, stop, part, rank = start[~idle], stop[~idle], part[~idle], rank[~idle]
            if not len(start):
                break
            live = least != _NONE
            least, sizes = least[live], sizes[live]
            cuts = np.cumsum(sizes) - sizes
        hits = np.flatnonzero(rank == np.repeat(least, sizes))
        hits = hits[np.concatenate([[True], part[hits][1:] != part[hits][:-1]])]
        stop[hits] = stop[hits + 1]
        gone = np.ones(len(start), bool)
        gone[hits + 1] = False
        place = np.cumsum(gone) - 1
        start, stop, part, rank = start[gone], stop[gone], part[gone], rank[gone]
        hits = place[hits]
        rank[hits] = ranks(hits)
        before = hits[hits > 0] - 1
        rank[before] = ranks(before)
    if not done:
        return start, stop, part
    start, stop, part = (np.concatenate([x[k] for x in done]) for k in range(3))
    order = np.argsort(start, kind="stable")
    return start[order], stop[order], part[order]


def _by_heap(start: list[int], stop: list[int], keys: np.ndarray, pieces: np.ndarray, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The joins of one very long part, by a queue of candidate edges."""
    n = len(start)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(left: list[int]) -> None:
        left = [i for i in left if 0 <= i and after[i] < n]
        if left:
            found = _found(keys, pieces, np.array([start[i] for i in left]), np.array([stop[after[i]] for i in left]))
            for i, piece in zip(left, found.tolist(), strict=True):
                if piece >= 0:
                    heapq.heappush(heap, (int(words.rank[piece]), i, stop[after[i]]))

    offer(list(range(n)))
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or stop[after[i]] != end:
            continue
        j = after[i]
        alive[j], stop[i], after[i] = False, end, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer([before[i], i])
    left = [i for i in range(n) if alive[i]]
    return np.array([start[i] for i in left]), np.array([stop[i] for i in left])


class Encoder:
    """Ids of texts; parts seen lately are kept with their ids."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has; an empty text has none."""
        if len(self.known) > _CACHE_PARTS:
            self._forget()
        split = [_PART.findall(" " + x.replace("\u2581", " ")) if x else [] for x in texts]
        fresh = list({p for parts in split for p in parts} - self.known.keys())
        if fresh:
            ids, counts = encode_parts([p.encode() if p != "\x00" else b"" for p in fresh], self.words)
            if "\x00" in fresh:  # the index uses zero as its mark, so this one is set here
                at = fresh.index("\x00")
                ids, counts = np.insert(ids, counts[:at].sum(), self.words.byte_id[0]), counts + (np.arange(len(counts)) == at)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, counts])
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        sizes = np.array([len(x) for x in split], np.int64)
        at = np.fromiter((self.known[p] for parts in split for p in parts), np.int64, int(sizes.sum()))
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(sizes)
        return self.ids[gather(self.begin[at], count)], total[ends] - total[ends - sizes]


def _texts(flat: np.ndarray, sizes: np.ndarray, surface: list[bytes]) -> pa.Array:
    """Texts of ids: surfaces joined, without the space that encoding puts first."""
    ends = np.cumsum(sizes).tolist()
    texts = [b"".join(map(surface.__getitem__, flat[e - s : e].tolist())) for e, s in zip(ends, sizes.tolist(), strict=True)]
    return pa.array([x[x[:1] == b" " :].decode("utf-8", "replace") for x in texts], pa.string())


def encode(docs: DataFrame, path: str = MODEL, text: str = "text", to: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids of `text` as an array column `to` (replaced if there); null and empty texts have no ids.

    With `decoded`, the text that `decode` gives for these ids is added under that name, in
    the same tasks.
    """
    words = Vocabulary(path)
    rest = [c for c in docs.columns if c not in (to, decoded)]
    names = ["row", to] + [decoded] * (decoded is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(words)
        for batch in batches:
            _, at = utf8(batch.column(0))
            for first, last in spans(at, 1 << 20):
                ids, counts = encoder.encode(batch.column(0).slice(first, last - first).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
                back = [_texts(ids, counts, words.surface)] if decoded is not None else []
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, last - first), lists, *back], names)

    rows = docs.select(whole_text(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, {to} array<int>"
    done = rows.mapInArrow(run, kind if decoded is None else f"{kind}, {decoded} string")
    return done.select(*[F.col(f"row.`{c}`") for c in rest], *names[1:])


def decode(encoded: DataFrame, path: str = MODEL, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of the ids as `to`: surfaces joined, without the space that encoding puts first; bytes that are no UTF-8 become U+FFFD, ids without a surface nothing."""
    words = Vocabulary(path)
    rest = [c for c in encoded.columns if c != to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(1), _texts(flat, sizes, words.surface)], ["row", to])

    rows = encoded.select(F.col(ids).alias("ids"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {to} string")
    return done.select(*[F.col(f"row.`{c}`") for c in rest], to)


def ids_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the ids as little-endian 32-bit numbers."""
    for batch in batches:
        lists = batch.column(1)
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes).tolist()
        out = [hashlib.sha256(flat[e - s : e].astype("<i4").tobytes()).hexdigest() for e, s in zip(ends, sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "ids_sha256"])


def op8_sentencepiece_suffix_array(spark, sf_dir: str, path: str = MODEL) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", whole_text().alias("text"))
    coded = encode(docs, path)
    # the text goes no further than its digest
    coded = coded.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), "ids")
    back = decode(coded, path)
    row = F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_chars", "text_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
    out = back.select(row.alias("row"), "ids")
    kind = out.schema["row"].dataType.simpleString()
    done = out.mapInArrow(ids_digest, f"row {kind}, ids_sha256 string").select("row.*", "ids_sha256")
    return done.withColumn("round_trip", F.col("text_sha256") == F.col("decoded_sha256"))
