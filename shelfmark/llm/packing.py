"""Best-fit packing of token pieces by minimum bin slack (operator 11).

Every document becomes its token ids and an end mark; those longer than a sequence are cut
into whole ones and a rest. Only lengths matter for packing, and there are at most
`capacity` different ones, so their histogram is all that the planning sees, however many
documents there are. The plan is made bin by bin: the longest length that is left opens
the bin, and a subset-sum over the others, whose reachable fillings are the bits of one
integer, finds the fullest combination with it. That combination is taken out as often as
all its lengths last, which is what the next bins would choose too, so the plan has a
bounded number of rows. Pieces get their rank within their length by a distributed scan
and find their sequence and offset by binary search in the plan.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import SLICE_BYTES, gather, materialise, spans, text_hash, utf8, whole_text
from shelfmark.llm.scans import chunked, running

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
_CACHE_WORDS = 1 << 19
_LONG_WORD = 256
_SPACES = b" \t\n\r\x0b\x0c"
_ENDS = re.compile(rb"[.,;:!?](?<=[A-Za-z0-9].)(?=[ \t\n\r])")
#: Letters below are composed already, and their lower case is that of every Unicode version.
_LATIN_END = "\u0250"


class _Words(dict):
    """Word -> its number; a new one gets the next and is noted in `fresh`."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        found = self[word] = len(self)
        return found


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE uses for each byte: visible Latin-1 for itself, the others in order from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)}


class Coder:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never joins over it: words are coded once and kept.

    A single point or comma at the end of a word is a part of its own for such a tokenizer,
    so it is cut off; that and lower case (of ASCII) leave fewer different words. Words of
    Latin letters alone need no more than the tokenizer's BPE itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merges, self.letters = self.model.model, _byte_letters()
        self.marks = [x.content.encode() for x in self.model.get_added_tokens_decoder().values()]
        self.plain = True
        self.plain = all(self._code([w]) == [self.model.encode(w.decode(), add_special_tokens=False).ids] for w in (b"a", b"tokenizers", "Étude".encode(), "ĳßǆ".encode()))
        self.lower = self.plain and self.model.encode("ABC d").ids == self.model.encode("abc D").ids
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.begin, self.count = _Words(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _split(self, text: bytes) -> list[bytes]:
        """Words at ASCII white space. Letters keep their case where a mark may follow them, as marks are composed first, and where lower case could make a special token."""
        low = text.lower() if self.lower and b"\xcc" not in text and b"\xcd" not in text else text
        if low is not text and any(m in low for m in self.marks):
            low = text
        return (_ENDS.sub(rb" \g<0>", low) if self.plain else low).split()

    def _code(self, words: list[bytes]) -> list[list[int]]:
        texts, out, rest = [w.decode() for w in words], [], []
        for text in texts:
            if self.plain and text.isalpha() and max(text) < _LATIN_END and "\u0130" not in text:  # whose lower case has a mark
                out.append([t.id for t in self.merges.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))])
            else:
                rest.append(text)
                out.append(None)
        coded = iter(self.model.encode_batch_fast(rest, add_special_tokens=False) if rest else ())
        return [next(coded).ids if x is None else x for x in out]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.known) > _CACHE_WORDS:
            self._forget()
        split = [self._split(x) for x in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        fresh, self.known.fresh = self.known.fresh, []
        if fresh:
            coded = self._code(fresh)
            each = np.fromiter(map(len, coded), np.int64, len(coded))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(each) - each])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(coded), np.uint32, int(each.sum()))])
            self.count = np.concatenate([self.count, each])
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(sizes)
        out = self.ids[gather(self.begin[at], count)], total[ends] - total[ends - sizes]
        if any(len(w) > _LONG_WORD for w in fresh):  # what is too long to be met again isn't kept
            self._forget()
        return out

    def encode_long(self, text: bytes) -> np.ndarray:
        """Ids of one text of any length, in slices that end at white space."""
        out, start = [], 0
        while start < len(text):
            end = min(start + SLICE_BYTES, len(text))
            while end < len(text) and text[end] not in _SPACES:
                end += 1
            out.append(self.encode([text[start:end]])[0])
            start = end
        return np.concatenate([np.zeros(0, np.uint32), *out])


def tokenised(docs: DataFrame, path: str = TOKENIZER, capacity: int = 2_048, end: int = 0, text: str = "text") -> DataFrame:
    """(doc_id, th, piece, start, length, ids) of every document's pieces; ids are unsigned 32-bit numbers, little-endian, one after the other.

    A document is its ids and the end mark; a null or empty text is the end mark alone.
    Whole texts are coded, in slices of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            body, at = utf8(batch.column(2))
            raw = body.tobytes()
            for first, last in spans(at):
                if last - first == 1 and at[last] - at[first] > SLICE_BYTES:
                    flat = coder.encode_long(raw[at[first] : at[last]])
                    counts = np.array([len(flat)], np.int64)
                else:
                    flat, counts = coder.encode([raw[a:b] for a, b in zip(at[first:last].tolist(), at[first + 1 : last + 1].tolist(), strict=True)])
                sizes = counts + 1
                ids = np.full(int(sizes.sum()), end, "<u4")
                ids[gather(np.cumsum(sizes) - sizes, counts)] = flat
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                piece = gather(np.zeros(len(sizes), np.int64), pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                for a in range(0, len(owner), 4_096):
                    b = min(a + 4_096, len(owner))
                    begin = int(length[:a].sum())
                    ends = np.concatenate([[0], np.cumsum(length[a:b])]) * 4
                    data = ids[begin : begin + int(ends[-1]) // 4].tobytes()
                    column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                    who = pa.array(owner[a:b] + first)
                    columns = [batch.column(0).take(who), batch.column(1).take(who), pa.array(piece[a:b].astype(np.int32)), pa.array(start[a:b]), pa.array(length[a:b]), column]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "piece", "start", "length", "ids"])

    rows = docs.select("doc_id", text_hash(text).alias("th"), whole_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, piece int, start long, length long, ids binary")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How often each length is used in the fullest combination of at most `room`. lengths are in descending order; the longest that can be part of it are preferred.

    Bit t of `reach` is set if some of the lengths looked at so far add up to t.
    """
    reach, steps, within = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if reach >> room & 1:
            break
        left, take = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4, ... of them at once stand for any number of them
            n = min(take, left)
            wider = (reach | reach << length * n) & within
            if wider != reach:
                steps.append((length, n, reach))
                reach = wider
            left, take = left - n, take * 2
    target, uses = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> target & 1:
            uses[length] = uses.get(length, 0) + n
            target -= length * n
    return uses


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, and for how many bins each is used, until no length is left."""
    counts, out = {k: v for k, v in histogram.items() if v > 0}, []
    lengths = sorted(counts, reverse=True)
    while lengths:
        opens = lengths[0]
        counts[opens] -= 1
        room = capacity - opens
        uses = fullest(counts, [x for x in lengths if x <= room], room) if room else {}
        counts[opens] += 1
        uses[opens] = uses.get(opens, 0) + 1
        bins = min(counts[x] // n for x, n in uses.items())
        for x, n in uses.items():
            counts[x] -= bins * n
        lengths = [x for x in lengths if counts[x]]
        out.append((uses, bins))
    return out


def _places(found: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, uses in a bin, first sequence, offset) of a plan, by length and rank."""
    rows, used, sequence = [], {}, 0
    for uses, bins in found:
        offset = 0
        for length in sorted(uses, reverse=True):
            rows.append((length, used.get(length, 0), uses[length], sequence, offset))
            used[length] = used.get(length, 0) + bins * uses[length]
            offset += length * uses[length]
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(pieces: DataFrame, order: list[str], capacity: int = 2_048) -> DataFrame:
    """The pieces with sequence_id and offset. pieces: length (1 to capacity) and any other columns.

    order names columns that tell rows apart as far as they differ; pieces of one length
    are dealt out in it. The driver sees the histogram of lengths, at most `capacity` rows.
    """
    table = chunked(pieces, "pieces", ["length"], order)
    histogram = {r.length: r["count"] for r in table.groupBy("length").count().collect()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError("a piece is longer than a sequence, or empty")
    rows = _places(plan(histogram, capacity))
    keys = rows[:, 0] << 48 | rows[:, 1]
    ranked = running(table, ["length"], order, {"__rank": F.lit(1).cast("long")})
    rest = [c for c in pieces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (1, 2))
            own = rows[np.searchsorted(keys, length << 48 | (rank - 1), side="right") - 1]
            nth = rank - 1 - own[:, 1]
            sequence, offset = own[:, 3] + nth // own[:, 2], own[:, 4] + nth % own[:, 2] * length
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    given = ranked.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col("length").cast("long").alias("length"), F.col("__rank").cast("long").alias("rank"))
    done = given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return done.select("row.*", "sequence_id", "offset")


def sequences(docs: DataFrame, path: str = TOKENIZER, capacity: int = 2_048) -> DataFrame:
    """(sequence_id, ids, docs): the packed sequences themselves, ids as in `tokenised`, and the doc_ids in their order."""
    placed = packed(tokenised(docs, path, capacity), ["doc_id", "th", "piece"], capacity)
    listed = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))  # at most `capacity` ids
    return listed.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("docs"))


def op11_bin_slack_packing(spark, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # ids go no further than their checksum
    pieces = tokenised(docs, path).select("doc_id", "th", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(materialise(pieces, "coded"), ["doc_id", "th", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
