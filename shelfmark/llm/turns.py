"""Trie of conversation prefixes with subtree sums by an Euler tour (operator 12).

Conversations share prefixes; each distinct sequence of first turns is a node. A prefix is
named by 128 bits, the running xor of hashes of (depth, turn): two prefixes of 10**12 are
confused with a chance of about 2e-15. Running values inside a conversation come from
scans over ranges, so a conversation of any length is no group of one task.

The tour enters and leaves every node, two arcs each, children in the order of conv_id. An
arc knows only its successor. The list is ranked by contraction: arcs are dealt by ranges
of (conv_id, depth), each task joins what is linked inside its range into chains with
running sums, and the chains, one for each link that leaves a range, are the next list.
While that is longer than a task should hold, rounds of independent links halve it: a
chain whose coin is heads takes in its successor whose coin is tails. What is left is
ranked in one task, and the rounds are undone backwards. A subtree's sums are what lies
between a node's two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.common import materialise
from shelfmark.llm.scans import chunked, following, running

#: Chains that one task ranks at the end.
LAST_CHAINS = 100_000
_IDS_PER_PIECE = 4_096
_GROUP, _MOST = 20, 3


def _turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, hash, words): null role and text are empty; rows without conv_id are no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.size(F.filter(F.split(F.translate(text, "\t\n\u000b\u000c\r", " " * 5), " "), lambda w: w != ""))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.unhex(hashed).alias("hash"), words.cast("long").alias("words"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(c, depth, chunk, hash, words): the turns of every rebuilt conversation from depth 1, and a row of depth 0 for each.

    c keeps its own turns after its first h = crc32(c) % 4, behind the first h of
    conversation c - c % 20 (the remainder has the sign of c, as in SQL). Turns are ordered by turn, null first; of equal turns by the
    MD5 of role and text; repeated rows all count.
    """
    turns = materialise(_turns(conversations), "turns")
    # at most three rows of a conversation leave a task before the shuffle
    nth = F.row_number().over(Window.partitionBy("c").orderBy("turn", "hash"))
    heads = turns.where(F.col("c") % _GROUP == 0).withColumn("pos", nth).where(F.col("pos") <= _MOST)
    heads = heads.groupBy(F.col("c").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "words"))).alias("heads"))
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(_MOST + 1)).cast("int")
    every = turns.select("c").distinct()
    lent = every.withColumn("base", F.col("c") - F.col("c") % _GROUP).join(heads, "base").select("c", F.explode(F.slice("heads", F.lit(1), h)).alias("x")).select("c", F.lit(1).alias("tag"), F.col("x.pos").cast("long").alias("turn"), "x.hash", "x.words")
    root = every.select("c", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"))
    rows = lent.unionByName(turns.withColumn("tag", F.lit(2))).union(root)
    order = ["tag", "turn", "hash"]
    table = running(chunked(rows, "rows", ["c"], order), ["c"], order, {"lent": (F.col("tag") == 1).cast("long"), "own": (F.col("tag") == 2).cast("long")})
    depth = F.when(F.col("tag") == 2, F.col("lent") + F.col("own") - h).when(F.col("tag") == 1, F.col("lent")).otherwise(0)
    return materialise(table.where((F.col("tag") < 2) | (F.col("own") > h)).select("c", depth.cast("long").alias("depth"), "chunk", "hash", "words"), "rebuilt")


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, depth, p1, p2, q1, q2, words): the name of each prefix and of the one before it."""
    at = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "hash")).otherwise(F.lit(0).cast("long"))
    named = running(turns.withColumns({"x1": at(1), "x2": at(2)}), ["c"], ["depth"], {"p1": F.col("x1"), "p2": F.col("x2")}, "bit_xor")
    return materialise(named.select("c", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "words"), "prefixes")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): SHA-256 of the ascending decimal ids c of each node, joined by commas.

    Ids are joined in pieces by ranges of (node, c); the pieces of a node then pass through
    one task as a stream, for a SHA-256 can't be put together from parts. Nothing is held but its state.
    """
    names = ["depth", "p1", "p2"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            keys = list(zip(*[rows[n] for n in names], strict=True))
            out: list[tuple] = []
            for key, c in zip(keys, rows["c"], strict=True):
                if not out or out[-1][0] != key or len(out[-1][2]) >= _IDS_PER_PIECE:
                    out.append((key, c, []))
                out[-1][2].append(str(c))
            columns = [pa.array([k[i] for k, _, _ in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c for _, c, _ in out], pa.int64()), pa.array([",".join(x) for _, _, x in out], pa.string())], [*names, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            done, rows = [], batch.to_pydict()
            for *own, ids in zip(*[rows[n] for n in names], rows["ids"], strict=True):
                if own == key:
                    state.update(b",")
                else:
                    done += [(key, state.hexdigest())] if key else []
                    key, state = own, hashlib.sha256()
                state.update(ids.encode())
            yield digest(done)
        if key:
            yield digest([(key, state.hexdigest())])

    def digest(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k, _ in done], pa.int64()) for i in range(3)], pa.array([x for _, x in done], pa.string())], [*names, "ends_sha256"])

    ranged = ends.select(*names, "c").repartitionByRange(*names, "c").sortWithinPartitions(*names, "c")
    joined = ranged.mapInArrow(pieces, "depth long, p1 long, p2 long, first long, ids string")
    return joined.repartition(*names).sortWithinPartitions(*names, "first").mapInArrow(digests, "depth long, p1 long, p2 long, ends_sha256 string")


def _along(before: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """First element and running sums up to each element of lists that are given by predecessors (-1: none), by doubling."""
    head, before, sums = np.arange(len(before)), before.copy(), [w.copy() for w in weights]
    while len(live := np.flatnonzero(before >= 0)):
        via = before[live]
        for s in sums:
            s[live] += s[via]
        head[live], before[live] = head[via], before[via]
    return head, sums


_CHAIN = "struct<c:bigint,a:bigint,nc:bigint,na:bigint,leaves:bigint,saved:bigint>"
_NODE = "struct<conv_id:bigint,depth:bigint,ec:bigint,ea:bigint,xc:bigint,xa:bigint,leaves:bigint,saved:bigint>"


def _structs(columns: dict[str, np.ndarray]) -> pa.StructArray:
    return pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns.values()], list(columns))


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the arcs of one range of nodes.

    Arc 2 * depth of conv_id enters a node, the one after it leaves it. A node gets the
    first arcs (c, a) of the chains of its two arcs and the sums between both, as if both
    chains began at one place. Batches: conv_id, depth, first_child, next_sibling, parent, leaf, saved.
    """
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    given = {n: table[n].fill_null(0).to_numpy() for n in table.column_names}
    has = {n: table[n].is_valid().to_numpy() for n in ("first_child", "next_sibling", "parent")}
    order = np.lexsort((given["depth"], given["conv_id"]))
    given, has = {n: x[order] for n, x in given.items()}, {n: x[order] for n, x in has.items()}
    conv, depth, n = given["conv_id"], given["depth"], len(order)
    known, number = np.unique(conv, return_inverse=True)
    width = int(depth.max()) + 2
    keys = number * width + depth

    def find(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Number of the node (c, d) in this range, or -1."""
        at = np.minimum(np.searchsorted(known, c), len(known) - 1)
        key = at * width + d
        found = np.minimum(np.searchsorted(keys, key), n - 1)
        return np.where((known[at] == c) & (d < width) & (keys[found] == key), found, -1)

    # successors as (conv_id, arc)
    own = np.arange(n)
    enter_c = np.where(has["first_child"], given["first_child"], conv)
    enter_a = np.where(has["first_child"], 2 * (depth + 1), 2 * depth + 1)
    exit_c = np.where(has["next_sibling"], given["next_sibling"], given["parent"])
    exit_a = np.where(has["next_sibling"], 2 * depth, 2 * (depth - 1) + 1)
    next_c, next_a = np.stack([enter_c, exit_c], 1).ravel(), np.stack([enter_a, exit_a], 1).ravel()
    last = np.stack([np.zeros(n, bool), ~has["next_sibling"] & ~has["parent"]], 1).ravel()
    node = np.where(last, -1, find(next_c, next_a >> 1))
    linked = np.flatnonzero(node >= 0)
    to = 2 * node[linked] + (next_a[linked] & 1)
    before = np.full(2 * n, -1, np.int64)
    before[to] = linked
    weights = []
    for name in ("leaf", "saved"):
        w = np.zeros(2 * n, np.int64)
        w[::2] = given[name]
        weights.append(w)
    head, (leaves, saved) = _along(before, weights)
    arc_c, arc_a = np.repeat(conv, 2), np.stack([2 * depth, 2 * depth + 1], 1).ravel()
    e, x = head[2 * own], head[2 * own + 1]
    nodes = {"conv_id": conv, "depth": depth, "ec": arc_c[e], "ea": arc_a[e], "xc": arc_c[x], "xa": arc_a[x], "leaves": leaves[1::2] - leaves[::2] + given["leaf"], "saved": saved[1::2] - saved[::2] + given["saved"]}
    tails = np.flatnonzero(node < 0)
    h = head[tails]
    chains = {"c": arc_c[h], "a": arc_a[h], "nc": pa.array(next_c[tails], pa.int64(), mask=last[tails]), "na": pa.array(next_a[tails], pa.int64(), mask=last[tails]), "leaves": leaves[tails], "saved": saved[tails]}
    for struct, name in ((_structs(nodes), "node"), (_structs(chains), "chain")):
        other = "chain" if name == "node" else "node"
        none = pa.nulls(len(struct), _structs(chains if other == "chain" else nodes).type)
        yield pa.RecordBatch.from_arrays([struct, none] if name == "node" else [none, struct], ["node", "chain"])


def _rank_all(key: tuple, table: pa.Table) -> pa.Table:
    """Sums from each chain to the end of the list, for a whole list of chains."""
    given = {n: table[n].fill_null(0).to_numpy() for n in table.column_names if n != "k"}
    order = np.lexsort((given["a"], given["c"]))
    ids = np.stack([given["c"][order], given["a"][order]], 1)
    packed = np.ascontiguousarray(ids.astype(">i8")).view("S16").ravel() if len(ids) else np.zeros(0, "S16")
    by_bytes = np.argsort(packed, kind="stable")
    want = np.ascontiguousarray(np.stack([given["nc"], given["na"]], 1).astype(">i8")).view("S16").ravel()
    place = order[by_bytes[np.searchsorted(packed[by_bytes], want).clip(max=len(order) - 1)]]
    after = np.where(table["nc"].is_valid().to_numpy(), place, -1)  # sums to the end run along successors
    _, (leaves, saved) = _along(after, [given["leaves"], given["saved"]])
    return pa.table({"c": given["c"], "a": given["a"], "leaves": leaves, "saved": saved})


def rank_chains(chains: DataFrame, last: int = LAST_CHAINS) -> DataFrame:
    """(c, a, leaves, saved): the sums from each chain to the end of the list. chains: c, a, its successor's nc and na (null: none), leaves, saved."""
    table, n, undo = chains, chains.count(), []
    while n > last:
        coin = lambda c, a: F.pmod(F.xxhash64(F.lit(len(undo)), c, a), F.lit(2))  # noqa: B023, E731
        heads = table.where(coin("c", "a") == 0)
        tails = table.where(coin("c", "a") == 1).select(*[F.col(c).alias(f"t_{c}") for c in table.columns])
        both = heads.join(tails, (F.col("nc") == F.col("t_c")) & (F.col("na") == F.col("t_a")), "full")
        both = materialise(both, "links")
        taken = F.col("c").isNotNull() & F.col("t_c").isNotNull()
        undo.append(both.where(taken).select(F.col("t_c").alias("c"), F.col("t_a").alias("a"), F.col("c").alias("by_c"), F.col("a").alias("by_a"), F.col("leaves").alias("own_leaves"), F.col("saved").alias("own_saved")))
        alone = F.col("c").isNull()
        pick = lambda name: F.when(alone, F.col(f"t_{name}")).otherwise(F.col(name)).alias(name)  # noqa: B023, E731
        link = lambda name: F.when(F.col("t_c").isNotNull(), F.col(f"t_{name}")).otherwise(F.col(name)).alias(name)
        total = lambda name: (F.coalesce(name, F.lit(0)) + F.coalesce(f"t_{name}", F.lit(0))).alias(name)
        table = both.select(pick("c"), pick("a"), link("nc"), link("na"), total("leaves"), total("saved"))
        n = table.count()
    done = table.withColumn("k", F.lit(0)).groupBy("k").applyInArrow(_rank_all, "c long, a long, leaves long, saved long")  # at most `last` rows
    for gone in reversed(undo):
        known = done.select(F.col("c").alias("by_c"), F.col("a").alias("by_a"), F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
        back = gone.join(known, ["by_c", "by_a"]).select("c", "a", (F.col("all_leaves") - F.col("own_leaves")).alias("leaves"), (F.col("all_saved") - F.col("own_saved")).alias("saved"))
        done = materialise(done.unionByName(back), "ranks")
    return done


def subtree_sums(nodes: DataFrame, last: int = LAST_CHAINS) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of every subtree. nodes: conv_id, depth, first_child, next_sibling, parent, leaf, saved."""
    arcs = nodes.repartitionByRange("conv_id", "depth").mapInArrow(contract, f"node {_NODE}, chain {_CHAIN}")
    arcs = materialise(arcs, "arcs")
    parts = arcs.where("node is not null").select("node.*")
    inside = (F.col("ec") == F.col("xc")) & (F.col("ea") == F.col("xa"))
    sums = parts.where(inside).select("conv_id", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ranks = materialise(rank_chains(arcs.where("chain is not null").select("chain.*"), last), "chains")
    to = lambda p: ranks.select(F.col("c").alias(f"{p}c"), F.col("a").alias(f"{p}a"), F.col("leaves").alias(f"{p}_leaves"), F.col("saved").alias(f"{p}_saved"))
    over = parts.where(~inside).join(to("e"), ["ec", "ea"]).join(to("x"), ["xc", "xa"])
    return sums.unionByName(over.select("conv_id", "depth", (F.col("leaves") + F.col("e_leaves") - F.col("x_leaves")).alias("n_leaves"), (F.col("saved") + F.col("e_saved") - F.col("x_saved")).alias("saved_tokens")))


def trie(conversations: DataFrame, last: int = LAST_CHAINS) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. The root has every conversation that has a
    row, even if nothing is left of it; without rows there are no nodes.
    """
    steps = prefixes(rebuilt(conversations))
    nodes = steps.groupBy("depth", "p1", "p2").agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"))
    nodes = materialise(nodes, "nodes")
    # tables on both sides, so a parent of very many children can be split
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    hung = nodes.join(up, ["depth", "q1", "q2"], "left").select("conv_id", "depth", "parent", "n_convs", "words", "p1", "p2")
    group = ["parent", "depth"]
    hung = following(chunked(hung, "siblings", group, ["conv_id"]), group, "conv_id", "next_sibling").drop("chunk")
    children = hung.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    linked = hung.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    linked = materialise(linked.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "links")
    sums = subtree_sums(linked.select("conv_id", "depth", "first_child", "next_sibling", "parent", "leaf", "saved"), last)
    ends = steps.groupBy("c").agg(F.max(F.struct("depth", "p1", "p2")).alias("e")).select("c", "e.*")
    out = linked.join(sums, ["conv_id", "depth"]).join(ends_digest(ends), ["depth", "p1", "p2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = r"""
WITH own AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS hash
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, hash) AS pos FROM own),
every AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM own)),
parts AS (
  SELECT e.c, 0 AS part, p.pos, p.hash, p.text FROM every e JOIN placed p ON p.c = e.base AND p.pos <= e.h
  UNION ALL SELECT e.c, 1, p.pos, p.hash, p.text FROM every e JOIN placed p ON p.c = e.c AND p.pos > e.h),
turns AS (SELECT c, hash, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth FROM parts),
steps AS (
  SELECT c, depth, words, string_agg(hash, '') OVER (PARTITION BY c ORDER BY depth) AS key FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM every),
nodes AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM steps GROUP BY key, depth),
up AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, (n.depth - 1) * 32)),
kids AS (SELECT left(key, (depth - 1) * 32) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT u.*, coalesce(k.n, 0) AS n_children FROM up u LEFT JOIN kids k USING (key)),
above AS (SELECT left(key, d * 32) AS key, (n_children = 0)::INT AS leaf, saved FROM known, range(0, 10000) t(d) WHERE d <= depth),
sums AS (SELECT key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY key),
ends AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, max(key) AS key FROM steps GROUP BY c) GROUP BY key)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256
FROM known JOIN sums USING (key) LEFT JOIN ends USING (key)
"""
