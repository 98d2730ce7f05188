"""Inverted index for deep searches: trigram postings by range of documents.

    index = SearchIndex(spark, path)
    index.add(docs, "path", "text")          # again for every later delivery
    index.search('license |AND| "all rights"')

Documents are numbered inside ranges of their path. `bodies` holds them by range;
`postings` has, for each trigram of the lower-case bodies and each range, the numbers of
the documents that hold it, so no list is longer than a range. Postings are laid out by a
hash of the trigram and sorted by it, so a search reads the few row groups of its own
trigrams. A term occurs only where all its trigrams do; the expression is worked out on
the lists of each range by itself, and the bodies that are left are read and compared, so
the rows are those of a scan. A delivery counts once its row in `deliveries` is written;
what a failed one has left is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelfmark.functions import search

#: Up to so many candidates are looked for by number, so that Parquet can skip row groups; more are joined.
MOST_LISTED = 2_000
_SHARDS = 64


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), 1))


def _shard(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(_SHARDS)).cast("int")


class SearchIndex:
    """An index at `path`; several may add to it one after the other, and any number may search."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _deliveries(self) -> list[tuple[str, str]]:
        """(id, schema) of whole deliveries; a row for each call of `add`."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deliveries")
        if not root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(root):
            return []
        rows = self.spark.read.schema("delivery string, kind string, key string, body string").parquet(f"{self.path}/deliveries").collect()
        return sorted(map(tuple, rows))

    def add(self, docs: DataFrame, key: str, body: str, per_range: int = 20_000) -> None:
        """Index more documents, all their columns kept. Null bodies are kept and never found. Every delivery has the columns of the first."""
        known = self._deliveries()
        kind = StructType([StructField(f.name, f.dataType) for f in docs.schema]).json()
        if known and known[0][1:] != (kind, key, body):
            raise ValueError(f"the index holds other columns, or is by {known[0][2]}")
        delivery = f"d{uuid.uuid4().hex}"
        at, ranges = f"{self.path}/bodies/delivery={delivery}", max(1, -(-docs.count() // per_range))
        # ranges of the path: neighbours share their words, and so their lists
        placed = docs.repartitionByRange(ranges, F.col(key)).sortWithinPartitions(key)
        place = F.monotonically_increasing_id()
        placed = placed.withColumns({"__range": F.shiftright(place, 33).cast("int"), "__doc": place.bitwiseAND(F.lit((1 << 33) - 1)).cast("int")})
        placed.write.option("parquet.block.size", 1 << 20).partitionBy("__range").parquet(at)
        numbered = self.spark.read.schema(placed.schema).parquet(at).select("__range", "__doc", F.explode(trigrams(F.col(body))).alias("gram"))
        lists = numbered.groupBy("gram", "__range").agg(F.sort_array(F.collect_list("__doc")).alias("docs")).withColumn("shard", _shard(F.col("gram")))
        lists.repartition("shard").sortWithinPartitions("shard", "gram", "__range").write.option("parquet.block.size", 4 << 20).partitionBy("shard").parquet(f"{self.path}/postings/delivery={delivery}")
        self.spark.createDataFrame([(delivery, kind, key, body)], "delivery string, kind string, key string, body string").coalesce(1).write.mode("append").parquet(f"{self.path}/deliveries")

    def _table(self, name: str, kind: StructType, known: list) -> DataFrame:
        """bodies or postings of whole deliveries."""
        return self.spark.read.schema(kind.add("delivery", "string")).parquet(f"{self.path}/{name}").where(F.col("delivery").isin([d for d, *_ in known]))

    def candidates(self, expression: str) -> DataFrame | None:
        """(delivery, __range, __doc) of all documents that may fit; None if every one may, as where a term is shorter than a trigram."""
        known = self._deliveries()
        terms: list[str] = []
        search.fold(expression, terms.append, lambda a, b: None, lambda a, b: None)
        row = self.spark.range(1).select(*[trigrams(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]).first()  # one row, no table
        grams = sorted({g for found in row for g in found})
        name = {g: f"g{i}" for i, g in enumerate(grams)}
        of = {t: list(found) for t, found in zip(terms, row, strict=True)}

        def leaf(term: str) -> Column | None:
            out = None
            for g in of[term]:
                out = F.col(name[g]) if out is None else F.array_intersect(out, F.col(name[g]))
            return out

        both = lambda a, b: b if a is None else a if b is None else F.array_intersect(a, b)
        either = lambda a, b: None if a is None or b is None else F.array_union(a, b)
        fits = search.fold(expression, leaf, both, either)
        if fits is None or not known:
            return None
        shards = {r.s for r in self.spark.range(1).select(F.explode(F.array(*[_shard(F.lit(g)) for g in grams])).alias("s")).collect()}
        read = self._table("postings", StructType.fromDDL("gram string, __range int, docs array<int>, shard int"), known).where(F.col("shard").isin(sorted(shards)) & F.col("gram").isin(grams))
        lists = read.groupBy("delivery", "__range").agg(*[F.coalesce(F.any_value(F.when(F.col("gram") == g, F.col("docs")), F.lit(True)), F.array().cast("array<int>")).alias(n) for g, n in name.items()])
        return lists.select("delivery", "__range", F.explode(fits).alias("__doc"))

    def bodies(self, expression: str) -> DataFrame:
        """Documents that may fit, with their columns; only ranges and row groups that hold candidates are read."""
        known = self._deliveries()
        if not known:
            raise ValueError("the index is empty")
        _, kind, _, _ = known[0]
        rows = self._table("bodies", StructType.fromJson(json.loads(kind)).add("__range", "integer").add("__doc", "integer"), known)
        found = self.candidates(expression)
        if found is None:
            return rows
        listed = found.limit(MOST_LISTED + 1).collect()
        if len(listed) > MOST_LISTED:
            return rows.join(found, ["delivery", "__range", "__doc"], "left_semi")
        some = lambda c: F.col(c).isin(sorted({r[c] for r in listed}))
        return rows.where(some("delivery") & some("__range") & some("__doc")) if listed else rows.where(F.lit(False))

    def search(self, expression: str) -> DataFrame:
        """Documents whose body fits, in order of their key without regard to case, with the columns they were added with."""
        if not expression.strip():
            raise search.SearchError("a deep search needs an expression")
        _, _, key, body = (self._deliveries() or [(None, None, None, None)])[0]
        rows = self.bodies(expression).drop("delivery", "__range", "__doc")
        return rows.where(F.col(body).isNotNull() & search.matches(expression, F.col(body))).orderBy(F.lower(key), key)
