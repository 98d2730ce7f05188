"""Quality rules: base counts and cross-document line frequency, in DataFrame functions only (operator 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise, text_hash, whole_text

_SPACES = " \t\n\u000b\u000c\r"
_SYMBOLS = "#*$%&|<>"
_GRAM = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def worded_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES, "") != "")


def _repeated(words: Column) -> Column:
    """Words that lie in a window of five which occurs twice or more in the text."""

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(_GRAM), F.coalesce(F.get(places, i + 1) - p, F.lit(_GRAM)))), F.lit(0), lambda a, x: a + x)

    def repeats(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["g"] == e["g"]) | (F.get(s, i + 1)["g"] == e["g"]), e["i"])), lambda x: x.isNotNull()))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(F.sort_array(twice), covered))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    grams = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - _GRAM), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(_GRAM)])))
    return F.when(F.size(words) <= _GRAM, F.lit(0)).otherwise(let(grams, repeats))


def base_counts(docs: DataFrame) -> DataFrame:
    """One row per document: key, host column kept, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.col("text")
    counted = docs.withColumn(
        "c",
        F.struct(
            let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"))).alias("w"),
            F.length(F.translate(text, _SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    out = counted.select(*[c for c in docs.columns if c != "text"], "c.w.n_words", "c.word_chars", "c.n_symbols", "c.n_dup_lines", "c.w.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")))


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    return docs.select("doc_id", text_hash().alias("th"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), whole_text().alias("text"))


def frequent_lines(docs: DataFrame, host: str = "source", least_docs: int = 10, share: float = 0.001) -> DataFrame:
    """(doc_id, th, removed, removed_words): hashes of a document's lines that more than `least_docs` documents and more than `share` of all document rows of its host hold."""
    rows = _keyed(docs, host)
    line = F.explode(F.transform(worded_lines(F.col("text")), lambda x: F.struct(F.xxhash64(_normal(x)).alias("h"), F.size(words_of(x)).alias("n"))))
    # counted and joined below, so written once: a few numbers for each line
    lines = materialise(rows.select("doc_id", "th", "host", line.alias("l")).groupBy("doc_id", "th", "host", F.col("l.h").alias("h")).agg(F.sum("l.n").alias("n")), "lines")
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    counted = lines.groupBy("host", "h").agg(F.count("*").alias("in_docs")).where(F.col("in_docs") > least_docs)
    common = counted.join(hosts, "host").where(F.col("in_docs") > share * F.col("docs")).select("host", "h")
    return lines.join(common, ["host", "h"]).groupBy("doc_id", "th").agg(F.collect_list("h").alias("removed"), F.sum("n").alias("removed_words"))


def _beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    right = found.withColumnsRenamed({"doc_id": "f_id", "th": "f_th"})
    return rows.join(right, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left").drop("f_id", "f_th")


def verdicts(docs: DataFrame, host: str = "source", least_docs: int = 10, share: float = 0.001, depleted: float = 0.3) -> DataFrame:
    """Base counts with removed_words and kept: no base rule failed and at least `depleted` of the words outlast the removal of common lines.

    Null texts have no words and fail the base rules; a null host is a host of its own.
    Rows that are equal in doc_id and text count as one document and get the same verdict.
    """
    counts = base_counts(_keyed(docs, host))
    joined = _beside(counts, frequent_lines(docs, host, least_docs, share)).withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    return joined.withColumn("kept", ~F.col("base_failed") & (left >= depleted * F.col("n_words"))).drop("th", "host", "removed")


def cleaned(docs: DataFrame, host: str = "source", least_docs: int = 10, share: float = 0.001) -> DataFrame:
    """(doc_id, th, text): every document without the lines that are too common in its host."""
    joined = _beside(_keyed(docs, host), frequent_lines(docs, host, least_docs, share))
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("removed", F.xxhash64(_normal(x))))
    return joined.select("doc_id", "th", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")).alias("text"))


def op6_line_frequency(spark, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM docs),
worded AS (
  SELECT doc_id, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
per AS (SELECT doc_id, host, norm, sum(n) AS n FROM worded GROUP BY ALL),
hosts AS (SELECT host, count(*) AS docs FROM docs GROUP BY host),
common AS (
  SELECT host, norm FROM (SELECT host, norm, count(*) AS in_docs FROM per GROUP BY ALL) JOIN hosts USING (host)
  WHERE in_docs > 10 AND in_docs > 0.001 * docs),
gone AS (SELECT doc_id, sum(n) AS removed_words FROM per JOIN common USING (host, norm) GROUP BY doc_id),
words AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 5) t(k) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed_words, 0) AS removed_words
  FROM words LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       CAST(removed_words AS BIGINT) AS removed_words,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= 0.3 * n_words AS kept
FROM base
"""
