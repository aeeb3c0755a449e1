"""Prefix trie of conversations: what a prompt cache could share, node by node.

Every conversation is first rebuilt (the opening turns of another one stand before its own), then each distinct
sequence of its first d turns is a node of depth d. Only digests of turns move; texts never leave the scan.

1. Turns are numbered and get rolling prefix hashes of 128 bits, in blocks of 64 turns whose totals are carried
   over, so that a conversation with a third of all rows is many tasks' work. A prefix hash names a node.
2. Equal conversations are collapsed to one sequence with a count and the smallest conv_id, so a conversation that
   is logged a million times enters a trie once.
3. Sequences are partitioned by the digest of their first turn. Where a first turn's sequences have more rows than a
   trie may hold, they are partitioned anew by their next turns, and again, until each subtrie fits (the step grows
   with the depth, so that a long shared opening takes few rounds). Subtries are dealt to buckets by hash.
4. applyInPandas builds the pointer dictionaries of a bucket's subtries and sums them up by an iterative postorder.
5. Nodes above the subtries (at least the root) come from counts by prefix hash. What lies below them is placed on the
   row above, of the sequence that the subtrie belongs to, and summed from the end of each sequence to its beginning.
6. Ids of conversations that end at a node are joined to texts within ranges of 4096 ids, and these are digested as
   a sorted stream: a digest is sequential by nature, but no list of ids is ever held.

Defined results: rows with null conv_id are left out. Turns are ordered by number (null first), then by role and
the text's digest; repeated rows are turns of their own. Null role and text are empty. A conversation left without a
turn is a member of the root only. An empty table gives no rows. Other columns are ignored. Rows of one conversation
that share a turn number (or null) are numbered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.storage import discard, load, materialise

BLOCK, IDS = 64, 4096
#: The block of turns without a number.
FIRST = -(1 << 62)
#: A subtrie is built in one task if it has so many rows at most; a bucket has about as many of them as ROWS.
MOST, ROWS = 5_000, 50_000
NODE = "conv_id long, depth long, parent_conv_id long, a long, b long, pa long, pb long, top boolean, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _carried(rows: DataFrame, key: list[str], totals: dict[str, Column], running: dict[str, Column]) -> DataFrame:
    """(conv_id, part, before_<name>...): each column of totals summed up over a conversation's blocks before."""
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*key).agg(*[e.alias(k) for k, e in totals.items()])
    return blocks.select(*key, *totals, *[F.coalesce(e.over(earlier), F.lit(0).cast("long")).alias(f"before_{k}") for k, e in running.items()])


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, rank, role, digest, chars) of every turn within its block, and (conv_id, part, n, before_n)."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")])
    c = c.where(F.col("conv_id").isNotNull()).select("conv_id", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(FIRST)).alias("part"), "turn", "role", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("chars"))
    order = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    ranked = c.withColumn("rank", F.row_number().over(order)).drop("turn")
    return ranked, _carried(c, ["conv_id", "part"], {"n": F.count("*")}, {"n": F.sum("n")})


def rebuilt(conversations: DataFrame, seed_every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n, pos, role, digest, chars) of every rebuilt turn, and (conv_id, n) of every conversation; n is its length.

    The first h turns are those of conversation c - c % seed_every, with h = crc32(c) % most.
    """
    ranked, blocks = numbered_turns(conversations)
    base = F.col("conv_id") - F.col("conv_id") % seed_every
    convs = blocks.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    sizes = convs.where(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    convs = convs.join(sizes, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = convs.withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialise(convs.select("conv_id", "base", "h", "k", "total"), "conversations")
    rows = ranked.join(blocks.select("conv_id", "part", "before_n").join(convs, "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("rank") + F.col("before_n"))
    what = ["role", "digest", "chars"]
    own = rows.where(F.col("pos") > F.col("h")).select("conv_id", F.col("total").alias("n"), (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), *what)
    opening = rows.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < most)).select("base", "pos", *what)
    given = convs.where(F.col("k") > 0).join(opening, "base").where(F.col("pos") <= F.col("h")).select("conv_id", F.col("total").alias("n"), "pos", *what)
    return own.unionByName(given), convs.select("conv_id", F.col("total").alias("n"))


def prefix_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, n, pos, a, b, pa, pb, chars): the hash of the turns up to pos, and of those before it."""
    h = [F.xxhash64(F.lit(i), "pos", "role", "digest").alias(f"h{i}") for i in (1, 2)]
    rows = turns.select("conv_id", "n", F.floor((F.col("pos") - 1) / BLOCK).alias("part"), "pos", *h, "chars")
    inner = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = rows.select("conv_id", "n", "part", "pos", "h1", "h2", "chars", *[F.bit_xor(x).over(inner).alias(f"r{x}") for x in ("h1", "h2")])
    xor = {x: F.bit_xor(x) for x in ("h1", "h2")}
    rolled = rolled.join(_carried(rows, ["conv_id", "part"], xor, xor).drop("h1", "h2"), ["conv_id", "part"])
    a, b = (F.col(f"r{x}").bitwiseXOR(F.col(f"before_{x}")) for x in ("h1", "h2"))
    return rolled.select("conv_id", "n", "pos", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("h1")).alias("pa"), b.bitwiseXOR(F.col("h2")).alias("pb"), "chars")


def cuts(rows: DataFrame, most: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """(rep, cut): the depth at which each sequence enters a subtrie of most rows at most; None if that is 1 for all.

    rows: (rep, n, pos, a, b). A sequence that ends above gets n + 1. One round looks at one depth, and only at
    sequences whose subtries are still too large.
    """
    cut, pending, done, tables = 1, rows, [], []
    at = lambda: F.lit(cut).cast("long").alias("cut")
    while True:
        here = pending.where(F.col("pos") == cut)
        sizes = here.groupBy("a", "b").agg(F.sum(F.col("n") - cut + 1).alias("size"))
        large = materialise(sizes.where(F.col("size") > most).select("a", "b"), "large")
        tables.append(large)
        if large.isEmpty():
            done.append(here.select("rep", at()))
            return (None if cut == 1 else reduce(DataFrame.unionByName, done)), tables
        done.append(here.join(large, ["a", "b"], "left_anti").select("rep", at()))
        left, cut = here.join(large, ["a", "b"], "left_semi").select("rep", "n"), cut + max(1, cut // 2)
        done.append(left.where(F.col("n") < cut).select("rep", (F.col("n") + 1).alias("cut")))
        pending = materialise(rows.where(F.col("pos") >= cut).join(left.select("rep"), "rep", "left_semi"), "pending")
        tables.append(pending)


def build_subtries(part: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a bucket's subtries, with the sums over their subtrees.

    part: (rep, copies, pos, cut, a, b, pa, pb, chars), a sequence's rows from its cut on. A node is a dictionary of
    its children, by the key of their prefix; parents are made before their children.
    """
    part = part.sort_values(["rep", "pos"], kind="stable")
    conv, depth, parent, n_convs, chars, key, above, children = [], [], [], [], [], [], [], []
    tops: dict[tuple, int] = {}
    at = -1
    for rep, copies, pos, cut, a, b, pa_, pb_, size in zip(*(part[c].tolist() for c in ("rep", "copies", "pos", "cut", "a", "b", "pa", "pb", "chars")), strict=True):
        up = -1 if pos == cut else at
        level = tops if pos == cut else children[at]
        found = level.get((a, b))
        if found is None:  # sequences come by id: the first to pass is the smallest
            found = level[a, b] = len(conv)
            for column, value in zip((conv, depth, parent, n_convs, chars, key, above, children), (rep, pos, up, 0, size, (a, b), (pa_, pb_), {}), strict=True):
                column.append(value)
        n_convs[found] += copies
        at = found
    leaves, saved = [0] * len(conv), [0] * len(conv)
    stack = [(node, False) for node in tops.values()]
    while stack:  # postorder: a node is summed up after all its children
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack += [(child, False) for child in children[node].values()]
            continue
        leaves[node] = sum(leaves[c] for c in children[node].values()) or 1
        saved[node] = (n_convs[node] - 1) * chars[node] + sum(saved[c] for c in children[node].values())
    return pd.DataFrame(
        {
            "conv_id": pd.array(conv, "int64"), "depth": pd.array(depth, "int64"), "parent_conv_id": pd.array([conv[p] if p >= 0 else None for p in parent], "Int64"),
            "a": pd.array([k[0] for k in key], "int64"), "b": pd.array([k[1] for k in key], "int64"), "pa": pd.array([k[0] for k in above], "int64"), "pb": pd.array([k[1] for k in above], "int64"),
            "top": [p < 0 for p in parent], "n_convs": pd.array(n_convs, "int64"), "n_children": pd.array([len(c) for c in children], "int64"), "n_leaves": pd.array(leaves, "int64"), "saved_tokens": pd.array(saved, "int64"),
        }
    )


def upper_nodes(rows: DataFrame, whole: DataFrame, entered: DataFrame | None, tops: DataFrame) -> DataFrame:
    """The nodes above all subtries, the root included, in the columns of NODE (parent_conv_id still null).

    rows: (rep, copies, pos, a, b, pa, pb, chars); whole: (rep, copies) of every sequence; entered: (rep, cut) or None.
    """
    zero = F.lit(0).cast("long")
    spine = whole.select("rep", "copies", *[zero.alias(c) for c in ("pos", "a", "b", "pa", "pb", "chars")])
    if entered is not None:
        spine = spine.unionByName(rows.join(entered, "rep").where(F.col("pos") < F.col("cut")).select(*spine.columns))
        spine = materialise(spine, "spine")
    own = spine.groupBy("pos", "a", "b").agg(F.min("rep").alias("conv_id"), F.sum("copies").alias("n_convs"), F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    below = tops.select((F.col("depth") - 1).alias("pos"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    below = below.unionByName(own.where("pos > 0").select((F.col("pos") - 1).alias("pos"), F.col("pa").alias("a"), F.col("pb").alias("b")))
    own = own.join(below.groupBy("pos", "a", "b").agg(F.count("*").alias("n_children")), ["pos", "a", "b"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    own = materialise(own, "upper")
    # what each sequence brings, on the row where it joins the upper nodes; then summed towards the root
    brought = tops.select(F.col("conv_id").alias("rep"), (F.col("depth") - 1).alias("pos"), "n_leaves", "saved_tokens")
    brought = brought.unionByName(own.select(F.col("conv_id").alias("rep"), "pos", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")))
    brought = brought.groupBy("rep", "pos").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")])
    if entered is None:
        totals = brought.agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]).select(*[zero.alias(c) for c in ("pos", "a", "b")], "n_leaves", "saved_tokens")
    else:
        towards = Window.partitionBy("rep").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
        passed = spine.join(brought, ["rep", "pos"], "left").select("pos", "a", "b", *[F.sum(F.coalesce(c, zero)).over(towards).alias(c) for c in ("n_leaves", "saved_tokens")])
        totals = passed.groupBy("pos", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")])
    return own.join(totals, ["pos", "a", "b"]).select("conv_id", F.col("pos").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "a", "b", "pa", "pb", (F.col("pos") > 0).alias("top"), "n_convs", "n_children", "n_leaves", "saved_tokens")


def ends_digests(last: DataFrame) -> DataFrame:
    """(n, a, b, ends_sha256): the digest of the ascending, comma-joined ids of the conversations (conv_id, n, a, b) that end there."""
    kinds = "n long, a long, b long, ends_sha256 string"
    ranges = last.groupBy("n", "a", "b", F.floor(F.col("conv_id") / IDS).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, running = None, None

        def finished(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.string(),), strict=True)], ["n", "a", "b", "ends_sha256"])

        for batch in batches:
            rows = []
            for n, a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("n", "a", "b", "ids")), strict=True):
                if (n, a, b) != of:
                    if of is not None:
                        rows.append((*of, running.hexdigest()))
                    of, running = (n, a, b), hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
            yield finished(rows)
        if of is not None:
            yield finished([(*of, running.hexdigest())])

    return ranges.repartition("n", "a", "b").sortWithinPartitions("n", "a", "b", "range").mapInArrow(digest, kinds)


def conversation_trie(conversations: DataFrame, most: int = MOST, bucket_rows: int = ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    turns, sizes = rebuilt(conversations)
    prefixes = materialise(prefix_rows(turns), "prefixes")
    zero = F.lit(0).cast("long")
    last = prefixes.where(F.col("pos") == F.col("n")).select("conv_id", "n", "a", "b")
    last = materialise(last.unionByName(sizes.where("n = 0").select("conv_id", "n", zero.alias("a"), zero.alias("b"))), "last")
    whole = materialise(last.groupBy("n", "a", "b").agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")), "sequences")
    rows = prefixes.withColumnRenamed("conv_id", "rep").join(whole.select("rep", "copies"), "rep")
    rows = materialise(rows.select("rep", "copies", "n", "pos", "a", "b", "pa", "pb", "chars"), "rows")
    discard(prefixes)
    entered, tables = cuts(rows, most)
    if entered is None:
        inside = rows.withColumn("cut", F.lit(1).cast("long"))
    else:
        entered = materialise(entered, "cuts")
        inside = rows.join(entered, "rep").where(F.col("pos") >= F.col("cut"))
    tops = inside.where(F.col("pos") == F.col("cut")).select("rep", F.col("a").alias("ta"), F.col("b").alias("tb"))
    buckets = max(1, rows.count() // bucket_rows)
    dealt = inside.join(tops.select("rep", F.pmod(F.xxhash64("ta", "tb"), F.lit(buckets)).alias("bucket")), "rep")
    nodes = dealt.groupBy("bucket").applyInPandas(build_subtries, NODE)
    nodes = materialise(nodes, "nodes")
    upper = materialise(upper_nodes(rows, whole.select("rep", "copies"), entered, nodes.where("top")), "upper_nodes")
    discard(rows, *tables)
    hung = nodes.where("top").drop("parent_conv_id").unionByName(upper.where("top").drop("parent_conv_id"))
    named = upper.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    hung = hung.join(named, ["depth", "pa", "pb"])
    every = nodes.where("not top").unionByName(upper.where("not top")).unionByName(hung)
    ends = ends_digests(last).withColumnRenamed("n", "depth")
    sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return every.join(ends, ["depth", "a", "b"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(load(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, n, CAST(conv_id AS VARCHAR) AS s FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY 1)),
     h AS (SELECT c.conv_id, c.base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(range(8 * length(c.s)) AS BIGINT[])),
             lambda x, i: xor(xor(x, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(c.s, i // 8 + 1, 1)) AS BIGINT) ELSE 0 END) >> 1, (xor(x, CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(c.s, i // 8 + 1, 1)) AS BIGINT) ELSE 0 END) & 1) * 3988292384)), 4294967295) % 6 AS h,
             coalesce(b.n, 0) AS n_base FROM c LEFT JOIN c b ON b.conv_id = c.base),
     r AS (SELECT h.conv_id, o.pos, o.role, o.text FROM h JOIN o ON o.conv_id = h.base AND o.pos <= h.h
       UNION ALL SELECT h.conv_id, o.pos - h.h + least(h.h, n_base), o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id AND o.pos > h.h),
     p AS (SELECT conv_id, pos AS d, length(text) AS chars, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS k FROM r
       UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
     l AS (SELECT conv_id, max(d) AS n FROM p GROUP BY 1),
     e AS (SELECT k, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN l ON l.conv_id = p.conv_id AND l.n = p.d GROUP BY 1),
     m AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY 1, 2),
     q AS (SELECT m.*, up.k AS pk FROM m LEFT JOIN p up ON up.conv_id = m.conv_id AND up.d = m.d - 1),
     w AS (SELECT q.*, coalesce(x.n_children, 0) AS n_children FROM q LEFT JOIN (SELECT pk, count(*) AS n_children FROM q GROUP BY 1) x ON x.pk = q.k),
     s AS (SELECT a.k, count(*) FILTER (w.n_children = 0) AS n_leaves, CAST(sum((w.n_convs - 1) * w.chars) AS BIGINT) AS saved_tokens FROM w JOIN p a ON a.conv_id = w.conv_id AND a.d <= w.d GROUP BY 1)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, v.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM w JOIN s ON s.k = w.k LEFT JOIN w v ON v.k = w.pk LEFT JOIN e ON e.k = w.k
"""
