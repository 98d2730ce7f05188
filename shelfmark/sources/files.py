"""Sources and sinks (S1 to S6): catalog text, file listings, documents, block logs and the audit log."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.operators.filters import prune_paths

# Fixed value: the line that ends a block.
END_OF_BLOCK = "END_SHOW_METADATA"


def scratch(spark: SparkSession, name: str) -> str:
    """New path in the shared folder of the cluster (`spark.checkpoint.dir`); a temporary one is set only where none is and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of a step that several others read, written once to the shared folder: nothing above is computed again, by a plan or after a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_catalog(spark: SparkSession, path: str, sep: str = "^") -> DataFrame:
    """(show, volume_path) of catalog text files.

    A `sep=` line, the header and blank rows are dropped, short rows padded; old rows of
    four columns (show, path, volume, path) become "[volume] path".
    """
    text = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("sep=") & ~F.lower("value").startswith(f"show{sep}"))
    row = F.from_csv("value", "show string, a string, volume string, path string", {"sep": sep})
    rows = text.select(row.alias("r"), F.size(F.split("value", f"\\{sep}")).alias("n"))
    old = F.concat_ws(" ", F.concat(F.lit("["), F.coalesce("r.volume", F.lit("")), F.lit("]")), F.coalesce("r.path", F.lit("")))
    out = rows.select(F.coalesce("r.show", F.lit("")).alias("show"), F.when(F.col("n") >= 4, old).otherwise(F.coalesce("r.a", F.lit(""))).alias("volume_path"))
    return out.where("show <> '' or volume_path <> ''")


def write_catalog(catalog: DataFrame, path: str, sep: str = "^") -> None:
    """Catalog text in global order without regard to case, each file with the `sep=` line and the header; nulls are written as blanks."""
    order = [F.lower("show"), F.lower("volume_path"), "show", "volume_path"]
    quoted = lambda c: F.when(F.col(c).contains(sep) | F.col(c).contains('"'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    parts = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = catalog.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    (rows.select(F.concat(quoted("show"), F.lit(sep), quoted("volume_path")).alias(f"Show{sep}VolumePath")).write.option("quote", "\u0000").option("escapeQuotes", "false").option("sep", "\u0001").option("header", True).csv(path))


def scan_files(spark: SparkSession, roots: Sequence[str], ignored: str = "-ignoredir") -> DataFrame:
    """Manifest (path, folder, name, ext, length, modified) of all files below the roots; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots)).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rows = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"), paths.extension(name).alias("ext"), "length", "modified")
    return prune_paths(rows, "path", ignored)


#: Characters that windows-1252 has where ISO-8859-1 has controls.
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def _paired(c: Column, unit: str) -> Column:
    """Whether the surrogates of UTF-16 bytes stand in pairs; unit is the hex pattern of a code unit, with H for its high byte."""
    high, low, some = (unit.replace("H", h) for h in ("D[89AB]", "D[C-F]", "D[89A-F]"))
    rest = F.regexp_replace(F.hex(c), f"\\G((?:....)*?){high}{low}", "$1")
    return ~F.hex(c).rlike(f"^(?:....)*?{some}") | ~rest.rlike(f"^(?:....)*?{some}")


def decode_documents(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds text, encoding and quality: the best of the readings as UTF-8, UTF-16 with or without mark, and windows-1252.

    Windows-1252 is read only where the bytes are no UTF-8: any bytes are some text in it, and
    two letters for an accented one would count as more. A reading scores by its share of
    letters (Latin, Greek to Arabic, characters beyond U+FFFF), digits and blanks, less that of NULs and
    of characters that no text has; of equals the one with more ASCII wins, then the first
    named. Empty contents are empty UTF-8 texts.
    """
    c = F.col(content)
    even, marked = F.length(c) % 2 == 0, F.substring(c, 1, 2)
    safe16 = even & (F.length(c) > 1)
    utf8 = F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))
    le = F.when(safe16 & _paired(c, "..H"), F.decode(c, "UTF-16LE"))
    be = F.when(safe16 & _paired(c, "H.."), F.decode(c, "UTF-16BE"))
    western = F.when(utf8.isNull(), F.translate(F.decode(c, "ISO-8859-1"), _CONTROLS, _WINDOWS))

    def score(t: Column) -> Column:
        n = F.greatest(F.length(t), F.lit(1))
        letters, nuls = F.regexp_count(t, F.lit("[\\p{IsLatin}\\p{IsDigit}\\s\\u0370-\\u07FF\\x{10000}-\\x{3FFFF}]")), F.regexp_count(t, F.lit("\\x00"))
        odd = F.regexp_count(t, F.lit("[\\x01-\\x08\\x0E-\\x1F\\x7F-\\x9F\\uFFFD\\p{Co}\\p{Cn}]|[ÃÂ][\\x80-\\xBF]"))
        return (letters - 4 * nuls - 4 * odd) / n

    plain = lambda t: F.regexp_count(t, F.lit("[\\x20-\\x7E]"))
    readings = [F.struct(score(t).alias("quality"), plain(t).alias("plain"), F.lit(-i).alias("at"), F.lit(e).alias("encoding"), F.regexp_replace(t, "^\\uFEFF", "").alias("text")) for i, (e, t) in enumerate((("utf-8", utf8), ("utf-16-le", le), ("utf-16-be", be), ("windows-1252", western)))]
    best = F.array_max(F.filter(F.array(*readings), lambda r: r["text"].isNotNull()))
    return files.withColumn("__b", best).withColumns({"text": F.col("__b.text"), "encoding": F.col("__b.encoding"), "quality": F.col("__b.quality")}).drop("__b")


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text, encoding, quality) of whole text files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return decode_documents(files.select("path", "content")).drop("content")


def read_block_log(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """One row for each block of `KEY: value` lines up to the end mark: a lower-case column for each key, and has_conflict.

    The last value of a key counts, unknown keys are skipped, and blocks without show and path are dropped.
    """
    blocks = spark.read.option("lineSep", f"{END_OF_BLOCK}\n").text(path)
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike("^[A-Z_]+: ") | x.startswith("CONFLICT"))

    def last(key: str) -> Column:
        found = F.filter(lines, lambda x: x.startswith(f"{key}: "))
        return F.when(F.size(found) > 0, F.substring(F.element_at(found, -1), len(key) + 3, 1 << 20))

    columns = [last(k).alias(k.lower()) for k in keys]
    rows = blocks.select(*columns, F.exists(lines, lambda x: x.startswith("CONFLICT")).alias("has_conflict"))
    return rows.where(F.coalesce("show", F.lit("")).cast("string").rlike("\\S") | F.coalesce("path", F.lit("")).rlike("\\S"))


def write_audit_log(evidence: DataFrame, path: str, conflicts: DataFrame | None = None, observations: DataFrame | None = None) -> None:
    """Audit rows (record, kind, field, value, source, confidence) as Parquet, by kind and field.

    evidence: record, field, value, source, confidence. conflicts: record, field, kept,
    offered, source. observations: record, text.
    """
    rows = evidence.toDF("record", "field", "value", "source", "confidence").withColumn("kind", F.lit("evidence"))
    none = F.lit(None)
    if conflicts is not None:
        told = F.concat_ws(" | ", "kept", "offered")
        rows = rows.unionByName(conflicts.select("record", "field", told.alias("value"), "source", none.cast("long").alias("confidence"), F.lit("conflict").alias("kind")))
    if observations is not None:
        rows = rows.unionByName(observations.select("record", F.lit("note").alias("field"), F.col("text").alias("value"), none.cast("string").alias("source"), none.cast("long").alias("confidence"), F.lit("observation").alias("kind")))
    rows.write.partitionBy("kind", "field").parquet(path)
