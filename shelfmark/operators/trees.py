"""Folder trees by one sort: what lies at or below what, without a row for every ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths
from shelfmark.sources.files import stored

# The end of a component sorts before all characters; a component that holds the mark itself has it replaced.
_END, _ESCAPE = "\u0001", "\u0002"


def tree_key(label: Column, path: Column) -> Column:
    """Text whose order is that of the tree of a label: a folder comes first, then all that is below it, which begins with the folder's own key. Null for a null label."""
    plain = lambda c: F.replace(F.replace(c, F.lit(_ESCAPE), F.lit(_ESCAPE + "\u0004")), F.lit(_END), F.lit(_ESCAPE + "\u0003"))
    parts = F.transform(paths.parts_of(F.coalesce(path, F.lit(""))), plain)
    return F.concat(plain(label), F.lit(_END), F.concat_ws("", F.transform(parts, lambda p: F.concat(p, F.lit(_END)))))


def _depth(key: Column) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit(_END), F.lit(""))) - 1


def enclosing(rows: DataFrame, label: Column, path: Column, roots: DataFrame | None = None) -> DataFrame:
    """The rows, all of them, with `__key` and `__above`, the array of (key, root) of the roots at or above each, outermost first.

    roots: label, root; without them every row that has a component is a root by itself,
    named by its components. A root without components stands for its whole label. Of
    several spellings of one root the least is named. Rows and roots without a label have no roots, or are none.

    Rows and roots are sorted together by `tree_key`, dealt into ranges and written once
    with the number of their range. All roots above a row are open when the sweep reaches
    it, and the last root of a depth is the only one of that depth that can be open. So the
    stack is a running last value for each depth that roots have (their number is bounded
    by the length of a path), and what is open at the border of a range is one row a range.
    """
    key = tree_key(label, path)
    if roots is None:
        plain = F.concat(F.lit("/"), F.array_join(paths.parts_of(path), "/"))
        marked = rows.select(F.struct(*rows.columns).alias("row"), key.alias("key"), F.when(_depth(key) > 0, plain).alias("root"))
        both = marked.withColumn("kind", F.lit(1))
    else:
        known = roots.select(tree_key(F.col("label"), F.col("root")).alias("key"), F.coalesce("root", F.lit("")).alias("root")).where("key is not null")
        known = known.groupBy("key").agg(F.min("root").alias("root"))
        marked = rows.select(F.struct(*rows.columns).alias("row"), key.alias("key"), F.lit(None).cast("string").alias("root"), F.lit(1).alias("kind"))
        both = marked.unionByName(known.withColumn("row", F.lit(None).cast(marked.schema["row"].dataType)).withColumn("kind", F.lit(0)))
    both = both.withColumn("depth", F.when(F.col("root").isNotNull(), _depth(F.col("key"))))
    plain = [F.col(f"row.`{f.name}`") for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    spread = F.xxhash64(*plain) if plain else F.lit(0)  # rows of one path need not stay in one range
    dealt = stored(both.repartitionByRange("key", "kind", spread).withColumn("range", F.spark_partition_id()), "tree")

    depths = sorted(r[0] for r in dealt.where("depth is not null").select("depth").distinct().collect())
    if not depths:
        none = F.array().cast("array<struct<key:string,root:string>>")
        return dealt.where("kind = 1").select("row.*", F.col("key").alias("__key"), none.alias("__above"))
    here = F.struct("key", "root")
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.select("*", *[F.last(F.when(F.col("depth") == d, here), ignorenulls=True).over(sweep).alias(f"d{d}") for d in depths])
    ends = dealt.groupBy("range").agg(*[F.max(F.when(F.col("depth") == d, here)).alias(f"e{d}") for d in depths])
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = ends.select("range", *[F.last(f"e{d}", ignorenulls=True).over(before).alias(f"c{d}") for d in depths])
    open_ = F.array(*[F.coalesce(f"d{d}", f"c{d}") for d in depths])
    above = F.filter(open_, lambda r: F.startswith(F.col("key"), r["key"]))
    out = swept.join(F.broadcast(carried), "range").where("kind = 1")
    return out.select("row.*", F.col("key").alias("__key"), above.alias("__above"))


def proper() -> Column:
    """Of `__above` the roots that are not the row's own folder."""
    return F.filter(F.col("__above"), lambda r: r["key"] != F.col("__key"))


def folder_digests(manifest: DataFrame, side: str) -> DataFrame:
    """(folder, side_n, side_sum): number of the files that stand directly in each folder and their digest, which does not depend on their order.

    manifest: path, size, sha256. A digest has two sums of 64-bit hashes in halves, so that
    two different folders have the same one with a chance of 2**-128.
    """
    told = ["path", "size", "sha256"]
    hashes = [F.xxhash64(*told, F.lit(salt)) for salt in (0, 1)]
    halves = [part for h in hashes for part in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    return manifest.groupBy(folder_of(F.col("path")).alias("folder")).agg(F.count("*").alias(f"{side}_n"), F.array(*[F.sum(h) for h in halves]).alias(f"{side}_sum"))


def folder_of(path: Column) -> Column:
    """Folder of a relative or absolute path; blank for a path without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def rolled_up(digests: DataFrame, side: str) -> DataFrame:
    """The digests of whole subtrees, from those of folders; folders that hold only folders get a row too. A digest is a sum, so it adds up along the ancestors."""
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    every = digests.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ups))).alias("folder"), f"{side}_n", *[F.get(f"{side}_sum", i).alias(f"s{i}") for i in range(4)])
    return every.groupBy("folder").agg(F.sum(f"{side}_n").alias(f"{side}_n"), F.array(*[F.sum(f"s{i}") for i in range(4)]).alias(f"{side}_sum"))


def tree_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """(folder, status, source_files, target_files) of two manifests (path, size, sha256) by whole subtrees: same, changed, missing or extra.

    What is the same, missing or extra as a whole has one row, its topmost folder; what is
    changed has a row of each folder on the way down. Files are read once and reduced to
    their folders; only folders meet. A blank folder is the whole manifest.
    """
    s, d = rolled_up(folder_digests(source, "s"), "s"), rolled_up(folder_digests(target, "d"), "d")
    status = F.when(F.col("d_n").isNull(), "missing").when(F.col("s_n").isNull(), "extra").when(F.col("s_sum") == F.col("d_sum"), "same").otherwise("changed")
    each = s.join(d, "folder", "full").select("folder", status.alias("status"), F.coalesce("s_n", F.lit(0)).alias("source_files"), F.coalesce("d_n", F.lit(0)).alias("target_files"))
    up = each.withColumn("up", F.when(F.col("folder") != "", folder_of(F.col("folder"))))
    whole = each.where("status = 'changed'").select(F.col("folder").alias("up"))
    return up.join(whole, "up", "left_semi").unionByName(up.where("up is null")).drop("up")
