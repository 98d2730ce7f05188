"""Language-model scoring with class-based bigrams (operator 3).

Words are put into classes by exchange: a word goes to the class that raises the
likelihood of the class bigram model most. First the most frequent words (a bounded
core) are exchanged one after the other until nothing moves. Then come rounds in which
all words of the training texts take part in parallel: each is judged by the classes of
all words before and after it, over all training texts, as they were before the round,
and by the class bigram counts of all training texts. Rounds go on until the likelihood
gains less than `least_gain` a token, or `rounds` of them are done; of two successive
states the likelier one stays. The model is P(word | word before) =
P(class | class before) * P(word | class); a word that the training texts lack has a
class of its own, with the weight of words seen once.

Words travel as 64-bit hashes. Texts are read once: they are coded in chunks of bounded
size, each with the numbers of its own words, and no task holds the vocabulary.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import discard, materialise, utf8, whole_text

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_END = b"\n"  # no word holds white space
_END_HASH = int(np.uint64(xxhash.xxh64_intdigest(_END)).view(np.int64))
#: Contexts of a word: the class of the word after it, or the class before it and this.
_BEFORE = 128
_SMALL = 16


def held_out(column: str = "doc_id") -> Column:
    """Rows of the evaluation fold; a null id is in the training fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 1, F.lit(False))


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


# texts to chunks


def _coded_chunk(number: int, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """One row for the texts of a chunk: documents of the training fold first, so their words have the first numbers."""
    rows = sorted(rows, key=lambda r: r[1])
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    ids[_END]  # noqa: B018
    parts, sizes, types = [np.zeros(1, np.int32)], [], None
    for _, out, text in rows:
        if out and types is None:
            types = len(ids)
        words = text.split()
        parts += [np.fromiter(map(ids.__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
        sizes.append(len(words) + 1)
    sequence = np.concatenate(parts)
    training = sum(n for n, r in zip(sizes, rows, strict=True) if not r[1])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids)).view(np.int64)
    small = pa.compress(sequence.tobytes(), codec="zstd", asbytes=True)
    columns = {
        "chunk": pa.array([number], pa.int64()), "hashes": _lists(hashes, np.array([len(hashes)])), "types": pa.array([len(ids) if types is None else types], pa.int32()), "sequence": pa.array([small], pa.binary()),
        "tokens": pa.array([len(sequence)], pa.int64()), "training": pa.array([training], pa.int64()), "ids": pa.array([[r[0] for r in rows]], pa.list_(kind)),
        "held_out": pa.array([[r[1] for r in rows]], pa.list_(pa.bool_())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
    }
    return _batch(columns)


def coded(docs: DataFrame, chunk_bytes: int = 16 << 20) -> DataFrame:
    """Chunks of about `chunk_bytes` (a longer text is a chunk of its own): hashes of their distinct words, of which `types` are in training texts, and the sequence of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, kind = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            body, at = utf8(batch.column(2))
            for i, (key, out) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                held.append((key, out, body[at[i] : at[i + 1]].tobytes().translate(_LOWER)))
                size += len(held[-1][2]) + 1
                if size > chunk_bytes:
                    yield _coded_chunk(number, held, kind)
                    number, held, size = number + 1, [], 0
        if held:
            yield _coded_chunk(number, held, kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text"))
    schema = f"chunk long, hashes array<long>, types int, sequence binary, tokens long, training long, ids array<{kind}>, held_out array<boolean>, sizes array<long>"
    return rows.mapInArrow(run, schema)


def _sequence(row: dict) -> np.ndarray:
    return np.frombuffer(pa.decompress(row["sequence"], decompressed_size=4 * row["tokens"], codec="zstd"), np.int32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """Chunks with their hashes, one at a time."""
    for batch in batches:
        at = batch.schema.get_field_index("hashes")
        for i in range(batch.num_rows):
            yield {f.name: batch.column(k)[i].as_py() for k, f in enumerate(batch.schema) if f.name != "hashes"}, batch.column(at)[i].values.to_numpy()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n) of the training texts of each chunk."""
    for row, hashes in _rows(batches):
        counts = np.bincount(_sequence(row)[1 : row["training"] + 1], minlength=row["types"])
        yield _batch({"h": hashes[: row["types"]], "n": counts[: row["types"]]})


def _places(trained: bool) -> Callable:
    """(h, chunk, at) of the distinct words of each chunk, or of those in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, hashes in _rows(batches):
            n = row["types"] if trained else len(hashes)
            if not trained or row["training"]:
                yield _batch({"h": hashes[:n], "chunk": np.full(n, row["chunk"]), "at": np.arange(n, dtype=np.int32)})

    return run


# the start: exchange in the core


def _located(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def _core_pairs(core: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(core) ** 2, np.int64)
        for row, hashes in _rows(batches):
            at = _located(hashes, core)[_sequence(row)[: row["training"] + 1]]
            both = (at[1:] >= 0) & (at[:-1] >= 0)
            total += np.bincount(at[:-1][both] * len(core) + at[1:][both], minlength=len(total))
        there = np.flatnonzero(total)
        yield _batch({"pair": there, "n": total[there]})

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Classes of the words of a count matrix (before, after), most frequent word first; each round moves every word to its best class, until none moves (or after `rounds`)."""
    n = len(pairs)
    classes = np.arange(n) % k
    one = np.zeros((n, k))
    one[np.arange(n), classes] = 1
    grid = one.T @ pairs @ one
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            own, self_n = classes[w], pairs[w, w]
            one[w, own] = 0
            after, before = pairs[w] @ one, pairs[:, w] @ one
            grid[own] -= after
            grid[:, own] -= before
            grid[own, own] -= self_n
            rows = _f(grid + after) - _f(grid)
            cols = _f(grid + before[:, None]) - _f(grid)
            both = _f(np.diag(grid) + after + before + self_n) - _f(np.diag(grid))
            gain = rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols) + both
            left, right = grid.sum(axis=1) + before, grid.sum(axis=0) + after  # with what the word takes to and from them
            gain -= _f(left + pairs[w].sum()) - _f(left)
            gain -= _f(right + pairs[:, w].sum()) - _f(right)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            classes[w] = best
            one[w, best] = 1
            grid[best] += after
            grid[:, best] += before
            grid[best, best] += self_n
        if not moved:
            break
    return classes


# rounds over all words


def _contexts(row: dict, hashes: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
    """(h, class, codes) of the words of a chunk's training texts; codes are n << 8 | context. Neighbours without a class don't count."""
    sequence = _sequence(row)[: row["training"] + 1]
    of = classes[sequence].astype(np.int64)
    words = sequence.astype(np.int64) << 8
    after, before = of[1:] >= 0, of[:-1] >= 0
    codes, n = np.unique(np.concatenate([(words[:-1] | of[1:])[after], (words[1:] | _BEFORE | of[:-1])[before]]), return_counts=True)
    sizes = np.bincount(codes >> 8, minlength=row["types"])
    return _batch({"h": hashes[: row["types"]], "class": classes[: row["types"]].astype(np.int32), "codes": _lists(n << 8 | (codes & 255), sizes)})


def _start_contexts(core: np.ndarray, classes: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, hashes in _rows(batches):
            if row["training"]:
                at = _located(hashes, core)
                yield _contexts(row, hashes, np.where(at >= 0, classes[at], -1) if len(core) else at)

    return run


def _round_contexts(key: tuple, chunks: pa.Table, placed: pa.Table) -> pa.Table:
    """The same from a chunk and the (at, class) of its words."""
    batches = chunks.combine_chunks().to_batches()
    out = []
    for row, hashes in _rows(iter(batches)):
        classes = np.full(len(hashes), -1)
        classes[placed["at"].to_numpy()] = placed["class"].to_numpy()
        out.append(_contexts(row, hashes, classes))
    return pa.Table.from_batches(out, pa.schema(_CONTEXTS))


_CONTEXTS = [("h", pa.int64()), ("class", pa.int32()), ("codes", pa.list_(pa.int64()))]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each word, of rows that come in the order of h; no more than a batch and one word are held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, kind, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        if held is not None:
            h, kind = np.concatenate([held[0], h]), np.concatenate([held[1], kind])
            flat, sizes = np.concatenate([held[2], flat]), np.concatenate([[len(held[2])], sizes])
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        group = np.repeat(np.cumsum(np.append(False, h[1:] != h[:-1])), sizes)
        codes, back = np.unique(group << 8 | (flat & 255), return_inverse=True)
        n = np.bincount(back, weights=flat >> 8, minlength=len(codes)).astype(np.int64)
        merged, sizes = n << 8 | (codes & 255), np.bincount(codes >> 8, minlength=len(first))
        cut = len(merged) - sizes[-1]
        if len(first) > 1:
            yield _batch({"h": h[first[:-1]], "class": kind[first[:-1]], "codes": _lists(merged[:cut], sizes[:-1])})
        held = (h[first[-1:]], kind[first[-1:]], merged[cut:])
    if held is not None:
        yield _batch({"h": held[0], "class": held[1], "codes": _lists(held[2], np.array([len(held[2])]))})


def _class_pairs(k: int) -> Callable:
    """(pair, n): how often class a stands before class b, from the words of class a and what follows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy()
            own = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
            there = (flat & 255 < _BEFORE) & (own >= 0)
            total += np.bincount(own[there] * k + (flat[there] & 255), weights=flat[there] >> 8, minlength=k * k)
        there = np.flatnonzero(total)
        yield _batch({"pair": there, "n": total[there].astype(np.int64)})

    return run


def likelihood(grid: np.ndarray) -> float:
    """What classes add to the logarithm of the likelihood of the training texts."""
    return float(_f(grid).sum() - _f(grid.sum(axis=1)).sum() - _f(grid.sum(axis=0)).sum())


def gains(own: np.ndarray, codes: np.ndarray, sizes: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For each word and class, what the word adds to the likelihood there, all others staying. own is -1 without a class."""
    k = len(grid)
    tables = np.concatenate([grid.T, np.zeros((_BEFORE - k, k)), grid, np.zeros((_BEFORE - k, k))])  # by context, then class
    context, n = codes & 255, codes >> 8
    word = np.repeat(np.arange(len(own)), sizes)
    steps = np.stack([_f(tables + i) - _f(tables) for i in range(_SMALL)])
    rows = steps[np.minimum(n, _SMALL - 1), context]
    large = np.flatnonzero(n >= _SMALL)
    rows[large] = _f(tables[context[large]] + n[large, None]) - _f(tables[context[large]])
    mine = np.flatnonzero(own[word] >= 0)
    kept = tables[context[mine], own[word[mine]]]
    rows[mine, own[word[mine]]] = _f(kept) - _f(np.maximum(kept - n[mine], 0))
    out = np.zeros((len(own), k))
    has = np.flatnonzero(sizes)
    if len(has):
        out[has] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[has], axis=0)
    for side, total in ((context < _BEFORE, grid.sum(axis=1)), (context >= _BEFORE, grid.sum(axis=0))):
        mass = np.bincount(word[side], weights=n[side], minlength=len(own))
        margin = _f(total + mass[:, None]) - _f(total)
        known = np.flatnonzero(own >= 0)
        at = total[own[known]]
        margin[known, own[known]] = _f(at) - _f(np.maximum(at - mass[known], 0))
        out -= margin
    return out


def _moved(grid: np.ndarray) -> Callable:
    """(h, class): every word in its best class; its own one where none is better."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lists = batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            best, first = own.copy(), 0
            while first < len(own):  # as many words as have some thousand codes
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + (1 << 15), side="right")))
                gain = gains(own[first:last], flat[ends[first] - sizes[first] : ends[last - 1]], sizes[first:last], grid)
                there = gain[np.arange(last - first), np.maximum(own[first:last], 0)]
                better = (own[first:last] < 0) | (gain.max(axis=1) > there + 1e-9)
                best[first:last] = np.where(better, gain.argmax(axis=1), own[first:last])
                first = last
            yield _batch({"h": batch.column(0), "class": best.astype(np.int32)})

    return run


def word_classes(chunks: DataFrame, k: int = 64, core_words: int = 512, rounds: int = 3, least_gain: float = 0.002) -> DataFrame:
    """(h, n, class) for every distinct word of the training texts and the end.

    `core_words` bounds what the driver sees for the start. `rounds` is how often all
    words are counted by the classes of all their neighbours.
    """
    lean = chunks.select("chunk", "hashes", "types", "sequence", "tokens", "training")
    unigrams = materialise(lean.mapInArrow(_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 0"), "unigrams")
    core, classes = _start(lean, unigrams, k, core_words)
    kind = "h long, class int, codes array<long>"

    def counted(contexts: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """Contexts of every word, and the class bigrams of all training texts."""
        words = materialise(contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_summed, kind), "words")
        found = words.select("class", "codes").mapInArrow(_class_pairs(k), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        grid = np.zeros(k * k)
        grid[found["pair"].to_numpy()] = found["n"].to_numpy()
        return words, grid.reshape(k, k)

    def moved(words: DataFrame, grid: np.ndarray) -> DataFrame:
        out = materialise(words.mapInArrow(_moved(grid), "h long, class int"), "classes")
        discard(words)
        return out

    best = moved(*counted(lean.mapInArrow(_start_contexts(core, classes), kind)))
    bound = least_gain * (unigrams.agg(F.sum("n")).first()[0] or 0)
    now, reached = best, -np.inf
    for left in range(rounds, 0, -1):
        # a table of its own, so that what its join has shuffled is gone before the rest is
        placed = materialise(lean.mapInArrow(_places(True), "h long, chunk long, at int").join(now, "h").select("chunk", "at", "class"), "placed")
        words, grid = counted(lean.groupBy("chunk").cogroup(placed.groupBy("chunk")).applyInArrow(_round_contexts, kind))
        discard(placed)
        gain = likelihood(grid) - reached
        if gain < 0:
            discard(words, now)
            break
        if now is not best:
            discard(best)
        best, reached = now, reached + gain if np.isfinite(reached) else likelihood(grid)
        if left == 1 or gain < bound:
            discard(words)
            break
        now = moved(words, grid)
    out = materialise(unigrams.join(best, "h").select("h", "n", "class"), "classes")
    discard(unigrams, best)
    return out


def _start(lean: DataFrame, unigrams: DataFrame, k: int, core_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words, sorted, and their classes by exchange among each other."""
    top = unigrams.orderBy(F.desc("n"), "h").limit(core_words).collect()
    by_hash = np.argsort(np.array([r.h for r in top], np.int64), kind="stable")
    core = np.array([r.h for r in top], np.int64)[by_hash]
    found = lean.mapInArrow(_core_pairs(core), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(len(core) ** 2)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    pairs = pairs.reshape(len(core), len(core))
    by_count = np.argsort(by_hash, kind="stable")
    classes = np.empty(len(core), np.int64)
    classes[by_count] = exchange(pairs[np.ix_(by_count, by_count)], k)
    return core, classes


# scores


def encoded(chunks: DataFrame, classes: DataFrame, facts: dict, k: int, kind: str) -> DataFrame:
    """Per document the counts and sums of the scores that need single words, and its sequence of classes (one byte a token; k: unknown)."""
    placed = chunks.select("chunk", "hashes", "types", "training").mapInArrow(_places(False), "h long, chunk long, at int").join(classes, "h").select("chunk", "at", "n", "class")
    base = np.log10(facts["tokens"] + 0.5 * (facts["types"] + 1))
    plain = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("share", pa.float64()), ("classes", pa.binary())]

    def run(key: tuple, chunks: pa.Table, placed: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", chunks.schema.field("ids").type.value_type), ("held_out", pa.bool_()), *plain])
        out = []
        for row, hashes in _rows(iter(chunks.combine_chunks().to_batches())):
            n, kinds = np.zeros(len(hashes), np.int64), np.full(len(hashes), k)
            at = placed["at"].to_numpy()
            n[at], kinds[at] = placed["n"].to_numpy(), placed["class"].to_numpy()
            share = np.where(n > 0, np.log10(np.maximum(n, 1)) - facts["class_log"][kinds], 0.0)
            sequence, sizes = _sequence(row)[1:], np.array(row["sizes"], np.int64)
            cuts = np.cumsum(sizes) - sizes
            raw = kinds.astype(np.uint8)[sequence].tobytes()
            columns = [pa.array(row["ids"], schema.field(0).type), pa.array(row["held_out"], pa.bool_()), pa.array(sizes)]
            columns += [pa.array(np.add.reduceat(x[sequence], cuts)) for x in ((n > 0).astype(np.int64), np.log10(n + 0.5) - base, share)]
            columns.append(pa.array([raw[a : a + s] for a, s in zip(cuts.tolist(), sizes.tolist(), strict=True)], pa.binary()))
            out.append(pa.RecordBatch.from_arrays(columns, schema.names))
        return pa.Table.from_batches(out, schema)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, share double, classes binary"
    return chunks.groupBy("chunk").cogroup(placed.groupBy("chunk")).applyInArrow(run, schema)


def _transitions(end: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) ** 2, np.int64)
        for batch in batches:
            seq = np.frombuffer(bytes([end]) + b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(seq[:-1] * (k + 1) + seq[1:], minlength=len(total))
        there = np.flatnonzero(total)
        yield _batch({"pair": there, "n": total[there]})

    return run


def score(docs: DataFrame, k: int = 64, core_words: int = 512, rounds: int = 3, least_gain: float = 0.002) -> DataFrame:
    """Class bigram score of every document beside the unigram base score.

    The model learns from all rows outside the held-out fold. Null and empty texts are
    one token, the end. Without training rows every word is unknown and known counts are
    zero. Rows that repeat an id are scored one by one. `k` is from 1 to 128.
    """
    if not 1 <= k <= _BEFORE:
        raise ValueError("k must be from 1 to 128")
    chunks = materialise(coded(docs), "chunks")
    classes = word_classes(chunks, k, core_words, rounds, least_gain)
    sums = classes.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once")).collect()
    mass = np.zeros(k + 1)
    for r in sums:
        mass[r["class"]] = r.n
    facts = {"tokens": int(mass.sum()), "types": sum(r.types for r in sums), "class_log": np.log10(np.maximum(mass, 1))}
    unseen = (sum(r.once for r in sums) + 0.5) / (facts["tokens"] + 1)
    ends = classes.where(F.col("h") == _END_HASH).select("class").first()
    end = ends[0] if ends else k
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialise(encoded(chunks, classes, facts, k, kind), "encoded")
    discard(chunks, classes)
    counted = rows.where(~F.col("held_out")).select("classes").mapInArrow(_transitions(end, k), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros((k + 1) ** 2)
    grid[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    grid = grid.reshape(k + 1, k + 1)
    grid[:, k] = 0
    overall = (mass + 0.5 * (mass > 0)) / max((mass + 0.5 * (mass > 0)).sum(), 1)
    step = (1 - unseen) * (grid + 20 * overall) / (grid.sum(axis=1, keepdims=True) + 20)
    step[:, k] = unseen
    step = np.log10(np.maximum(step, 1e-300))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = batch.column(1).to_numpy()
            values = []
            for seq, own in zip(batch.column(0).to_pylist(), share, strict=True):
                c = np.frombuffer(bytes([end]) + seq, np.uint8).astype(np.int64)
                values.append(own + step[c[:-1], c[1:]].sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(values, pa.float64())], [*batch.schema.names[2:], "score"])

    kept = rows.select("classes", "share", "doc_id", "held_out", "n_tokens", "n_known", F.lit(facts["tokens"]).cast("long").alias("train_tokens"), "base_score")
    scored = kept.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op3_brown_class_bigrams(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
