"""Folder trees and manifests against plain Python."""

import random

from pyspark.sql import functions as F

from shelfmark.operators import groups, joins, trees

PARTS = ["a", "b", "a b", "a!", "é", "\U0001f600", "a\u0001b", "b\u0002"]


def some_paths(rng, n, deep=5):
    return ["/" + "/".join(rng.choice(PARTS) for _ in range(rng.randint(1, deep))) for _ in range(n)]


def below(path, root):
    return path == root or path.startswith(root + "/")


def test_enclosing_roots(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["v", "w", None]), p) for i, p in enumerate(some_paths(rng, 300))] + [(1000, "v", None), (1001, "v", ""), (1002, "w", "/a")] * 2
    roots = [(rng.choice(["v", "w"]), p) for p in some_paths(rng, 40, 4)] + [("w", ""), (None, "/a")]
    df, tree = spark.createDataFrame(rows, "id int, label string, path string"), spark.createDataFrame(roots, "label string, root string")
    got = trees.enclosing(df.repartition(5), F.col("label"), F.col("path"), tree).select("id", "label", "path", F.transform("__above", lambda r: r["root"]).alias("above")).collect()
    want = []
    for i, label, path in rows:
        own = {r for n, r in roots if n is not None and n == label and (r == "" or below(path or "", r))}
        want.append((i, label or "", path or "", sorted(own, key=lambda r: (r.count("/"), r))))
    assert sorted((r.id, r.label or "", r.path or "", r.above) for r in got) == sorted(want)
    none = trees.enclosing(df, F.col("label"), F.col("path"), tree.limit(0))
    assert none.count() == len(rows) and none.where(F.size("__above") > 0).count() == 0


def test_replaced_and_kept_are_all_rows(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["V", "v", "w", None]), p, "x") for i, p in enumerate(some_paths(rng, 200) + [None, ""])]
    df = spark.createDataFrame(rows, "id int, label string, path string, row string")
    roots = spark.createDataFrame([("v", "/a"), ("W", "/b/a"), ("V", "/a/b")], "label string, root string")
    kept, replaced = joins.replace_scopes(df, "label", "path", roots)
    inside = {i for i, n, p, _ in rows if n and any(n.lower() == m and below(p or "", r) for m, r in [("v", "/a"), ("w", "/b/a")])}
    assert {r.id for r in replaced.collect()} == inside and inside
    assert {r.id for r in kept.collect()} == {r[0] for r in rows} - inside
    assert kept.columns == df.columns


def test_roots_and_folders(spark):
    rng = random.Random(7)
    every = sorted(set(some_paths(rng, 120, 4)))
    new, stored = every[::2], every[::3] + ["/b"]
    frame = lambda ps: spark.createDataFrame([("v", p) for p in ps], "label string, root string")
    got = {r.root: r.relation for r in joins.classify_root_relation(frame(new), frame(stored)).collect()}
    for p in new:
        found = {"exact" if p == s else "child" if below(p, s) else "parent" for s in stored if below(p, s) or below(s, p)}
        assert got[p] == (",".join(sorted(found)) or "unrelated")
    pairs = {(r.root, r.issue, r.other) for r in joins.overlapping_roots(frame(every), "label", "root").collect()}
    inside = {(p, "inside", s) for p in every for s in every if p != s and below(p, s)}
    assert pairs == inside | {(s, "contains", p) for p, _, s in inside}
    files = [p + "/f.wav" for p in every] + ["/top.wav"]
    tops = {r.folder for r in groups.folder_profile(spark.createDataFrame([(f,) for f in files], "path string"), "path").collect()}
    assert tops == {p for p in every if not any(p != s and below(p, s) for s in every)} | {""}


def manifests(spark, a, b):
    return (spark.createDataFrame([(p, *v) for p, v in m.items()], "path string, size long, sha256 string") for m in (a, b))


def test_manifests(spark):
    rng = random.Random(8)
    a = {f"{p}/{i % 3}": (i, rng.choice(["x", None])) for i, p in enumerate(some_paths(rng, 300, 3))} | {"plain": (1, "x"), "none": (None, None)}
    b = dict(a)
    for p in list(a):
        if p.startswith("/a/"):
            kind = rng.randint(0, 4)
            if kind == 0:
                del b[p]
            elif kind == 1:
                b[p] = (a[p][0] + 1, a[p][1])
            elif kind == 2:
                b[p] = (a[p][0], "other")
    b |= {"/b/more/1": (1, "x"), "/b/more/2": (1, "x")}
    source, target = manifests(spark, a, b)
    got = {r.path: r.status for r in joins.manifest_diff(source, target).collect()}
    want = {p: "missing" if p not in b else "extra" if p not in a else "size" if a[p][0] != b[p][0] else "hash" if a[p][1] != b[p][1] else "same" for p in a | b}
    assert got == want and len(set(got.values())) == 5
    folders = {r.folder: (r.status, r.source_files, r.target_files) for r in trees.tree_diff(source, target).collect()}
    assert folders[""] == ("changed", len(a), len(b))
    assert folders["/b/more"] == ("extra", 0, 2)
    for folder, (status, n, m) in folders.items():
        under = [p for p in want if folder == "" or p.startswith(folder + "/")]
        assert n == sum(p in a for p in under) and m == sum(p in b for p in under)
        assert (status == "same") == all(want[p] == "same" for p in under)
    empty = source.limit(0)
    assert joins.manifest_diff(empty, empty).count() == 0 and trees.tree_diff(empty, target).count() > 0
