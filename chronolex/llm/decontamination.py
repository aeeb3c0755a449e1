"""Benchmark decontamination by size-partitioned MinHash containment search.

Every benchmark item keeps a bottom-k MinHash sketch of its word shingles, with k chosen so that a text holding at
least the given share of the item's shingles must hold one of the k: of n shingles, at most n - ceil(share n) may
be missing. Items are partitioned by size; each partition has one threshold, its largest sketched hash. A
document's sketch holds its shingle hashes up to the threshold of the partitions it is long enough for, so it
grows with the document and finds short items in long texts. Documents and items that meet in a sketched hash are
candidates, and are verified by the exact containment of the item's shingles in the text.

A bitmap of fixed size drops hashes that no sketch holds before anything is shuffled; it never drops a true one.
Texts are keyed by 128 bits of hashes, so copies are verified once. DataFrame functions only.

Defined results: null or empty text contains nothing; an item without words is contained in nothing. An item of
fewer words than a shingle is one shingle of all its words. Repeated items are separate; rows with one id and the
same text yield one row each item, as do rows with one id and several texts (the largest containment).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.storage import load, materialise

WORDS, SHARE = 5, 0.8
#: log2 of the bits of the bitmap.
BITMAP = 20
LONGS = 1 << (BITMAP - 6)
#: Up to so many keys (16 bytes each) are broadcast; a shuffled join takes more.
BROADCAST_KEYS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingles(words: Column, size: int, of: str) -> Column:
    """Array of the hashes (of="hash") or texts of the shingles. words must be a plain column."""
    make = (lambda w: F.xxhash64(w)) if of == "hash" else (lambda w: F.array_join(w, " "))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
    return F.when(F.size(words) >= size, F.transform(starts, lambda i: make(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>" if of == "hash" else "array<string>"))


def text_key(text: Column) -> Column:
    """128 bits of a text; null for a null text."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.when(text.isNotNull(), F.unhex(F.concat(digits(F.xxhash64(text)), digits(F.xxhash64(F.lit(1), text)))))


def light(keys: DataFrame) -> DataFrame:
    """Keys of a written table, to be broadcast while they are few, so that texts needn't move to be told apart."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def item_sketches(items: DataFrame) -> DataFrame:
    """(item_id, size, part, n, need, texts, sketch): one row per item with a word."""
    worded = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    worded = worded.withColumn("size", F.least(F.size("words"), F.lit(WORDS)))
    by_size = F.coalesce(*[F.when(F.col("size") == s, shingles(F.col("words"), s, "text")) for s in range(1, WORDS + 1)])
    hashed = F.coalesce(*[F.when(F.col("size") == s, shingles(F.col("words"), s, "hash")) for s in range(1, WORDS + 1)])
    rows = worded.select("item_id", "size", F.array_distinct(by_size).alias("texts"), F.array_sort(F.array_distinct(hashed)).alias("hashes"))
    rows = rows.withColumn("n", F.size("texts")).withColumn("need", F.ceil(F.col("n") * F.lit(SHARE)).cast("int"))
    sketch = F.slice("hashes", F.lit(1), F.size("hashes") - F.col("need") + 1)
    return rows.select("item_id", "size", F.floor(F.log2("n")).cast("int").alias("part"), "n", "need", "texts", sketch.alias("sketch"))


def bitmap(items: DataFrame) -> Column:
    """An array literal of LONGS longs with a bit for every sketched hash."""
    h = items.select(F.explode("sketch").alias("h"))
    slot = F.shiftright("h", 6).bitwiseAND(F.lit(LONGS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    rows = h.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect()
    longs = [0] * LONGS
    for r in rows:
        longs[r.slot] = r.bits
    return F.lit(np.array(longs, dtype=np.int64))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(text_key, item_id, n_shared, n_item) of every text and item it contains to the share at least."""
    sketched = materialise(item_sketches(items), "items")
    parts = sketched.groupBy("size", "part").agg(F.max(F.element_at("sketch", -1)).alias("top"), F.min("need").alias("need")).collect()
    bits = bitmap(sketched)
    held = lambda h: F.call_function("bit_get", F.element_at(bits, F.shiftright(h, 6).bitwiseAND(F.lit(LONGS - 1)).cast("int") + 1), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    rows = texts.select(text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words"))
    sketches = F.array().cast("array<bigint>")
    for size in sorted({p["size"] for p in parts}):
        top = F.lit(None).cast("bigint")
        best = None
        for p in sorted((p for p in parts if p["size"] == size), key=lambda p: p.need):
            best = p.top if best is None else max(best, p.top)
            top = F.when(F.size("words") - size + 1 >= p.need, F.lit(best)).otherwise(top)
        rows = rows.withColumn(f"top{size}", top)
        ceiling = F.col(f"top{size}")
        own = F.filter(shingles(F.col("words"), size, "hash"), lambda h: (h <= ceiling) & held(h))
        sketches = own if size == min(p["size"] for p in parts) else F.concat(sketches, own)
    hits = rows.select("text_key", F.explode(F.array_distinct(sketches)).alias("h"))
    met = hits.join(sketched.select("item_id", F.explode("sketch").alias("h")), "h").select("text_key", "item_id").distinct()
    met = materialise(met, "candidates")
    keyed = texts.select(text_key(F.col("text")).alias("text_key"), "text")
    found = keyed.join(light(met.select("text_key").distinct()), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    worded = found.select("text_key", words_of(F.col("text")).alias("words"))
    worded = worded.select("text_key", *[F.array_distinct(shingles(F.col("words"), s, "text")).alias(f"s{s}") for s in sorted({p["size"] for p in parts}) or [WORDS]])
    pairs = worded.join(met, "text_key").join(sketched.select("item_id", "size", "n", "need", "texts"), "item_id")
    shared = F.coalesce(*[F.when(F.col("size") == p, F.size(F.array_intersect("texts", f"s{p}"))) for p in sorted({p["size"] for p in parts}) or [WORDS]])
    return pairs.select("text_key", "item_id", shared.cast("long").alias("n_shared"), F.col("n").cast("long").alias("n_item"), "need").where(F.col("n_shared") >= F.col("need")).drop("need")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): documents and the items they contain to 80 % at least."""
    found = materialise(matches(docs, items), "matches")
    keyed = docs.select("doc_id", text_key(F.col("text").cast("string")).alias("text_key"))
    return keyed.join(found, "text_key").groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that contain an item; their columns as they are."""
    found = materialise(matches(docs, items).select("text_key").distinct(), "matches")
    key = "text_key_of_decontamination"
    return docs.withColumn(key, text_key(F.col("text").cast("string"))).join(light(found.withColumnRenamed("text_key", key)), key, "left_anti").select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, z.size, array_to_string(w[i.i : i.i + z.size - 1], ' ') AS s
            FROM d, (SELECT DISTINCT least(5, len(w)) AS size FROM b WHERE len(w) > 0) z, LATERAL (SELECT unnest(range(1, len(w) - z.size + 2)) AS i) i),
     bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS size, array_to_string(w[i.i : i.i + least(5, len(w)) - 1], ' ') AS s
            FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i) i WHERE len(w) > 0),
     n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
     m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (size, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(0.8 * n_item)
"""
