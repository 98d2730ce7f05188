"""Incremental arrivals and running counts with Structured Streaming."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.functions import text
from shelfmark.operators.groups import reason_rows
from shelfmark.operators.joins import remove_rows


def route(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds route: duplicate where the title's comparison key is in the catalog or came earlier in the batch (by ord, name), error without a key, else new.

    batch: name, ord, title. catalog: title, or key.
    """
    keyed = batch.withColumn("key", text.compare_key(F.coalesce("title", F.lit(""))))
    keys = catalog.select("key" if "key" in catalog.columns else text.compare_key(F.col("title")).alias("key"))
    known = keys.distinct().withColumn("known", F.lit(True))
    # rows without a key are errors, each by itself
    first = F.row_number().over(Window.partitionBy("key", F.when(F.col("key") == "", F.col("name"))).orderBy("ord", "name"))
    out = keyed.withColumn("nth", first).join(known, "key", "left")
    return out.withColumn("route", F.when(F.col("key") == "", "error").when(F.col("known") | (F.col("nth") > 1), "duplicate").otherwise("new")).drop("nth", "known")


_ROUTED = "name string, ord long, title string, key string, route string, match string"
_KNOWN = "keys array<string>, titles array<string>"


def _pieces(name: str) -> list[str]:
    """Runs of the widest power of two characters that a name has room for."""
    width = 1 << (len(name).bit_length() - 1)
    return [name[a : a + width] for a in range(len(name) - width + 1)]


class _Titles:
    """Titles of one date by their keys, in the order they came.

    A name is looked up by one piece of it, the rarest among the names that are expected; the
    keys that hold such a piece are listed by one pass over all keys, so the work does not grow
    with names times keys.
    """

    def __init__(self, keys: list[str], titles: list[str]):
        self.keys, self.titles, self.place, self.sizes = keys, titles, {}, set()
        self.piece, self.holders, self.tried, self.first = {}, {}, {}, {}
        for i, k in enumerate(keys):
            self.place.setdefault(k, i)
            self.sizes.add(len(k))

    def add(self, key: str, title: str) -> None:
        for width, listed in self.holders.items():
            self._list(listed, width, len(self.keys), key)
        self.place.setdefault(key, len(self.keys))
        self.sizes.add(len(key))
        self.keys.append(key)
        self.titles.append(title)

    @staticmethod
    def _list(listed: dict[str, list[int]], width: int, at: int, key: str) -> None:
        for a in range(len(key) - width + 1):
            places = listed.get(key[a : a + width])
            if places is not None and (not places or places[-1] != at):
                places.append(at)

    def expect(self, names: Iterable[str]) -> None:
        """List the keys that may hold these names."""
        new = {n for n in names if n and n not in self.piece}
        shared = Counter(p for n in new for p in set(_pieces(n)))
        fresh = {}
        for n in new:
            self.piece[n] = p = min(_pieces(n), key=lambda x: (shared[x], x))
            if p not in self.holders.get(len(p), {}):
                fresh.setdefault(len(p), {})[p] = []
        for width, listed in fresh.items():
            for i, k in enumerate(self.keys):
                self._list(listed, width, i, k)
            self.holders.setdefault(width, {}).update(listed)

    def _holding(self, name: str) -> list[int]:
        """The first title whose key holds the name."""
        if name not in self.piece:
            self.expect([name])
        if name not in self.first:
            piece = self.piece[name]
            places = self.holders[len(piece)][piece]
            found = next((i for i in places[self.tried.get(name, 0) :] if name in self.keys[i]), None)
            if found is None:
                self.tried[name] = len(places)
                return []
            self.first[name] = found
        return [self.first[name]]

    def match(self, key: str, names: list[str]) -> str | None:
        """The earliest title with this key, or that holds one of the names or lies inside of one."""
        found = [self.place[key]] if key in self.place else []
        for name in filter(None, names):
            found += self._holding(name)
            found += [self.place[part] for size in self.sizes for a in range(len(name) - size + 1) if (part := name[a : a + size]) in self.place]
        return self.titles[min(found)] if found else None


def _judge(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Routes of the arrivals of one date, or of some keys without a date; the state holds the titles that are in the catalog by then."""
    dated = not group[0].startswith("=")
    columns = ("arrival", "ord", "title", "name", "key", "names")
    rows = [row for frame in frames for row in zip(*(frame[c].tolist() for c in columns), strict=True)]
    rows.sort(key=lambda r: (r[0], r[1], r[2] or "", r[3] or ""))
    known = _Titles(*map(list, state.get)) if state.exists else _Titles([], [])
    if dated:
        known.expect(n for r in rows if r[0] for n in r[5])
    before, out = len(known.keys), []
    for arrival, ord_, title, name, key, names in rows:
        if not arrival:
            known.add(key, title)
            continue
        match = known.match(key, list(names) if dated else []) if key else None
        route = "error" if not key else "duplicate" if match is not None else "new"
        if route == "new":
            known.add(key, title)
        out.append((name, ord_, title, key, route, match))
    if len(known.keys) > before:
        state.update((known.keys, known.titles))
    if out:
        yield pd.DataFrame(out, columns=["name", "ord", "title", "key", "route", "match"])


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: RocksDB, and the memory that all its stores of an executor share.
_STORE = {
    _PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def _store_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query that starts inside keeps its states in RocksDB, unless the session names a store; the session stays as it was."""
    # a query copies the settings of its session when it starts
    own = _STORE if spark.conf.get(_PROVIDER, None) is None else {}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def ingest_arrivals(arrivals: DataFrame, catalog: DataFrame, sink: str, checkpoint: str, undated: int = 4_096) -> StreamingQuery:
    """Route each arrival: duplicate, error (no key), or new, and write the batches to `sink`.

    arrivals: a stream of name, ord, title and, where known, date and names (the names of its
    entity, an array). catalog: a stream of title and, where known, date; its rows of a
    batch count before the arrivals. An arrival is a duplicate of a title with the same
    comparison key, or of one of its date that holds one of its names or lies inside one;
    titles are those of the catalog and of arrivals that were new, in the order (ord, title,
    name). Dates default to the first yyyy-mm-dd of the title. `match` is the earliest title
    that it meets.

    The keys are in the state store by date, those without a date by their hash in `undated`
    groups (more of them for a longer catalog), so a batch reads only what is new and the
    states it meets. A date's titles are one state. The store is RocksDB, which keeps states
    on disk and takes a bounded part of an executor's memory, unless the session names another
    one. A batch that runs again after a failure starts from the state before it and overwrites
    its own output, so each arrival counts once.
    """
    first = F.nullif(F.regexp_extract(F.coalesce("title", F.lit("")), "[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit(""))

    def keyed(df: DataFrame, arrival: bool) -> DataFrame:
        names = F.transform("names", lambda n: text.compare_key(n)) if "names" in df.columns else F.array().cast("array<string>")
        given = {"arrival": F.lit(arrival), "name": F.col("name") if arrival else F.lit(None).cast("string"), "ord": F.col("ord").cast("long") if arrival else F.lit(0).cast("long")}
        date = F.coalesce(F.col("date").cast("string"), first) if "date" in df.columns else first
        rows = df.select(*[c.alias(n) for n, c in given.items()], "title", text.compare_key(F.coalesce("title", F.lit(""))).alias("key"), F.coalesce(F.filter(names, lambda n: n.isNotNull()), F.array().cast("array<string>")).alias("names"), date.alias("date"))
        # errors are spread, they meet no state
        spread = F.concat(F.lit("!"), F.pmod(F.xxhash64("name"), F.lit(64)).cast("string"))
        return rows.select("*", F.when(F.col("key") == "", spread).otherwise(F.coalesce("date", F.concat(F.lit("="), F.pmod(F.xxhash64("key"), F.lit(undated)).cast("string")))).alias("group")).drop("date")

    rows = keyed(catalog, False).where("key <> ''").unionByName(keyed(arrivals, True))
    routed = rows.groupBy("group").applyInPandasWithState(_judge, _ROUTED, _KNOWN, "append", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    with _store_on_disk(catalog.sparkSession):
        return routed.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counts(routed: DataFrame) -> DataFrame:
    """Counts of a run: one row with processed, staged, duplicates and errors."""
    n = lambda r: F.count_if(F.col("route") == r)
    return routed.agg(F.count("*").alias("processed"), n("new").alias("staged"), n("duplicate").alias("duplicates"), n("error").alias("errors"))


def duplicate_work_items(routed: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, title, matches): duplicates with the catalog rows (title, path) that share their key, in order."""
    keyed = catalog.select(text.compare_key(F.col("title")).alias("key"), F.struct("title", "path").alias("row"))
    listed = keyed.groupBy("key").agg(F.array_sort(F.collect_set("row")).alias("matches"))
    return routed.where("route = 'duplicate'").join(listed, "key", "left").select("name", "title", "matches")


def resolve_duplicates(catalog: DataFrame, decisions: DataFrame, gone: DataFrame) -> DataFrame:
    """The catalog (title, path) after review: chosen rows removed, accepted new rows added.

    decisions: title, path, accept. gone: title, path of the rows to replace.
    """
    return remove_rows(catalog, gone, ["title", "path"]).unionByName(decisions.where("accept").select("title", "path"))


def running_reason_counts(spark: SparkSession, path: str, checkpoint: str, sink: str) -> StreamingQuery:
    """Counts of reason codes over log lines that arrive as text files, as a Parquet table at `sink` that every batch replaces."""
    log = spark.readStream.format("text").load(path).withColumnRenamed("value", "line")
    counts = reason_rows(log).groupBy("code").agg(F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
