"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation again and again, each time some turns longer. Every turn gets two rolling hashes of
all turns up to it (exclusive or of hashes that include the position, 128 bits together), so a conversation is a
prefix of another if its last hashes are those of an inner turn there. An anti-join keeps conversations that are no
proper prefix of another one, equal ones once (smallest conv_id), and only they are rendered. Turns are handled in
blocks of 64 turn numbers: running values are made within a block and carried over by the blocks' totals, and a
rendering is split into parts of a block each, so no conversation, however long, meets in one task or string.

DataFrame functions only. Texts are shuffled once, for rendering; all else moves hashes.

Defined results: rows with null conv_id are left out; a null turn comes first (its block is that of turn -1); null
roles render as "unknown", null texts as empty. Equal rows count once; rows that share a turn number are ordered by
role, then text. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.storage import load, materialise

BLOCK = 64
#: The marks around a rendered turn.
START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return c.where(F.col("conv_id").isNotNull()).withColumn("part", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).cast("int"))


def _carried(rows: DataFrame, totals: dict[str, Column], running: dict[str, Column]) -> DataFrame:
    """rows with each column of totals summed up over the blocks before (as before_<name>)."""
    blocks = rows.groupBy("conv_id", "part").agg(*[e.alias(k) for k, e in totals.items()])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "part", *[F.coalesce(running[k].over(earlier), F.lit(0).cast("long")).alias(f"before_{k}") for k in totals])
    return rows.join(blocks, ["conv_id", "part"])


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b): the rolling hashes at each turn, pos counting from 1."""
    light = _turns(conversations).select("conv_id", "part", "turn", "role", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).distinct()
    order = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "t1", "t2")
    ranked = light.withColumn("rank", F.row_number().over(order))
    ranked = _carried(ranked, {"n": F.count("*")}, {"n": F.sum("n")})
    placed = ranked.select("conv_id", "part", (F.col("before_n") + F.col("rank")).alias("pos"), "role", "t1", "t2")
    hashed = placed.select("conv_id", "part", "pos", F.xxhash64(F.lit(2), "pos", "role", "t1", "t2").alias("h1"), F.xxhash64(F.lit(3), "pos", "role", "t1", "t2").alias("h2"))
    inner = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.select("conv_id", "part", "pos", "h1", "h2", F.bit_xor("h1").over(inner).alias("r1"), F.bit_xor("h2").over(inner).alias("r2"))
    rolled = _carried(rolled, {"h1": F.bit_xor("h1"), "h2": F.bit_xor("h2")}, {"h1": F.bit_xor("h1"), "h2": F.bit_xor("h2")})
    return rolled.select("conv_id", "pos", F.col("r1").bitwiseXOR(F.col("before_h1")).alias("a"), F.col("r2").bitwiseXOR(F.col("before_h2")).alias("b"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id of conversations that are no proper prefix of another; of equal ones the smallest."""
    hashes = materialise(prefix_hashes(conversations), "prefixes")
    last = hashes.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b")).alias("last")).select("conv_id", "last.*")
    whole = last.groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    longest = last.select("conv_id", F.col("pos").alias("n"))
    inner = hashes.join(longest, "conv_id").where(F.col("pos") < F.col("n")).select("pos", "a", "b").distinct()
    return whole.join(inner, ["pos", "a", "b"], "left_anti").select("conv_id")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text): each conversation's turns between marks, in parts of a block each."""
    grouped = _turns(conversations).groupBy("conv_id", "part").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    turns = F.concat(F.filter("turns", lambda t: t["turn"].isNull()), F.filter("turns", lambda t: t["turn"].isNotNull()))
    text = F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(BREAK), t["text"], F.lit(END))), "")
    return grouped.select("conv_id", "part", F.size("turns").cast("long").alias("n_turns"), text.alias("text"))


def chat_formatting(conversations: DataFrame) -> DataFrame:
    kept = materialise(maximal_conversations(conversations), "conversations")
    return render(conversations.withColumn("conv_id", F.col("conv_id").cast("long")).join(kept, "conv_id", "left_semi"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting(load(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     p AS (SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                  md5(string_agg(role || chr(30) || text, chr(31)) OVER w) AS h
           FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
     k AS (SELECT min(f.conv_id) AS conv_id FROM p f WHERE f.pos = f.n
             AND NOT EXISTS (SELECT 1 FROM p q WHERE q.pos = f.n AND q.pos < q.n AND q.h = f.h) GROUP BY f.n, f.h)
SELECT t.conv_id, CAST(floor(coalesce(turn, -1) / 64.0) AS INTEGER) AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
FROM t JOIN k USING (conv_id) GROUP BY t.conv_id, part
"""
