"""A stored inverted file of trigrams: literal and similarity searches that read the query's posting lists only.

An index is a folder of three tables, and a fourth with its settings, written last, so that an index without it is
not there yet:

- units: the rows to search, with a number each (uid). Rows written by one task are one shelf, a partition.
- postings: (gram, block, n, deltas) by bucket of grams. A block is 16,384 consecutive uids; within it the ids that
  hold a gram are differences of one or two bytes each. A frequent gram has many blocks, never one long list, and its
  bucket is written by several tasks.
- grams: how many units hold each gram, by bucket.

A gram is one number: three code points of 21 bits. Of the kind "literal" are all windows of three characters of the
normalised text; if a text contains a query it has all of the query's windows. Of the kind "words" are the padded
trigrams of words that the similarity is made of.

A literal search looks up its grams' counts, takes the rarest, intersects their lists block by block, rarest first,
and verifies what is left on the shelves that hold it. A similarity search counts, block by block, how many of the
query's grams each unit has; with the number of grams of the unit that is the similarity, and no text is read. A query of
fewer than three characters has no window and scans the units instead.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolex.functions.text import trigrams
from chronolex.operators import search
from chronolex.storage import materialise, small_batches

BLOCK_BITS, SHELF_BITS = 14, 33
#: A task encodes its postings whenever it holds so many.
HELD = 4_000_000
#: Of a literal query's grams so many are intersected, the rarest; the rest is left to verification.
RAREST = 12
POSTINGS = "gram long, bucket int, block long, n int, deltas binary"


def codes_of(points: np.ndarray) -> np.ndarray:
    """The grams of a sequence of code points, one for each window."""
    p = points.astype(np.int64)
    return (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]


def buckets_of(grams: np.ndarray, bits: int) -> np.ndarray:
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4"), np.array([len(t) for t in texts], dtype=np.int64)


def literal_pairs(uids: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, uid) of every window that lies within one text."""
    points, sizes = _points(texts)
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    inside = of[2:] == of[:-2]
    return codes_of(points)[inside], uids[of[:-2][inside]]


def word_pairs(uids: np.ndarray, grams: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, uid) of lists of trigrams."""
    points, _ = _points([g for one in grams for g in one])
    return codes_of(points)[::3] if len(points) else np.empty(0, np.int64), np.repeat(uids, [len(one) for one in grams])


def encoded(grams: np.ndarray, uids: np.ndarray, bits: int) -> pa.RecordBatch:
    """Posting rows of (gram, uid) pairs: ids within a block as differences, of one byte where all of a list fit."""
    order = np.lexsort((uids, grams))
    grams, uids = grams[order], uids[order]
    if len(grams):
        new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (uids[1:] != uids[:-1])))
        grams, uids = grams[new], uids[new]
    blocks, local = uids >> BLOCK_BITS, uids & ((1 << BLOCK_BITS) - 1)
    starts = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]) | (blocks[1:] != blocks[:-1])))) if len(grams) else np.empty(0, np.int64)
    n = np.diff(np.append(starts, len(grams)))
    deltas = np.diff(local, prepend=0)
    deltas[starts] = local[starts]
    width = np.where(np.maximum.reduceat(deltas, starts) < 256, 1, 2) if len(starts) else np.empty(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(n * width)))
    wide = np.repeat(width, n)
    at = np.repeat(offsets[:-1], n) + (np.arange(len(grams)) - np.repeat(starts, n)) * wide
    data = np.zeros(offsets[-1], dtype=np.uint8)
    data[at] = deltas & 255
    data[at[wide == 2] + 1] = deltas[wide == 2] >> 8
    lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    columns = [pa.array(grams[starts], pa.int64()), pa.array(buckets_of(grams[starts], bits), pa.int32()), pa.array(blocks[starts], pa.int64()), pa.array(n, pa.int32()), lists]
    return pa.RecordBatch.from_arrays(columns, ["gram", "bucket", "block", "n", "deltas"])


def decoded(n: int, deltas: bytes) -> np.ndarray:
    """The ids within the block."""
    return np.cumsum(np.frombuffer(deltas, dtype=np.uint8 if len(deltas) == n else "<u2"), dtype=np.int64)


def build_index(units: DataFrame, path: str, text: Column | str, kind: str = "literal", bits: int = 6, held: int = HELD) -> TrigramIndex:
    """Writes an index of the column text of units into the folder; null texts have no grams.

    There are 2 ** bits buckets. A task encodes its postings whenever it holds so many.
    """
    if kind not in ("literal", "words"):
        raise ValueError("an index is of the kind literal or words")
    spark = units.sparkSession
    small_batches(spark)
    body = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    grams = trigrams(body) if kind == "words" else body
    n_grams = F.size(grams) if kind == "words" else F.lit(None)
    placed = units.withColumn("n_grams", n_grams.cast("int")).withColumn("uid", F.monotonically_increasing_id())
    placed = placed.withColumn("shelf", F.shiftright("uid", SHELF_BITS).cast("int"))
    placed.write.partitionBy("shelf").parquet(f"{path}/units")

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = [], 0

        def emptied() -> pa.RecordBatch:
            whole = [np.concatenate(x) for x in zip(*pairs, strict=True)]
            pairs.clear()
            return encoded(*whole, bits)

        for b in batches:
            uids, values = b.column(0).to_numpy(), b.column(1).to_pylist()
            at = 0
            while at < len(values):  # a few long texts may fill what is held
                end = at + 1
                most = len(values[at])
                while end < len(values) and most + len(values[end]) <= held // 4:
                    most += len(values[end])
                    end += 1
                pairs.append((word_pairs if kind == "words" else literal_pairs)(uids[at:end], values[at:end]))
                size += len(pairs[-1][0])
                at = end
                if size >= held:
                    size = 0
                    yield emptied()
        if pairs:
            yield emptied()

    source = spark.read.schema(placed.schema).parquet(f"{path}/units").select("uid", grams)
    postings = source.mapInArrow(invert, POSTINGS)
    postings.repartition("bucket", F.shiftright("block", 6)).sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.sum("n").alias("n_units"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/grams")
    spark.createDataFrame([(kind, bits, placed.schema.json())], "kind string, bits int, columns string").write.parquet(f"{path}/settings")
    return TrigramIndex(spark, path)


class TrigramIndex:
    """An index in a folder, as build_index wrote it."""

    def __init__(self, spark: SparkSession, path: str):
        self.kind, self.bits, columns = spark.read.parquet(f"{path}/settings").first()
        self.units = spark.read.schema(StructType.fromJson(json.loads(columns))).parquet(f"{path}/units")
        self.postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
        self.grams = spark.read.schema("gram long, bucket int, n_units long").parquet(f"{path}/grams")

    def of(self, table: DataFrame, grams: list[int]) -> DataFrame:
        """Rows of postings or grams for these grams: their buckets' partitions only."""
        buckets = sorted(set(buckets_of(np.array(grams, dtype=np.int64), self.bits).tolist()))
        return table.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))

    def rarest(self, grams: list[int], most: int = RAREST) -> list[int] | None:
        """The grams that fewest units hold; None if one is in none at all. Reads a row for each gram of the query."""
        found = sorted((r["n_units"], r["gram"]) for r in self.of(self.grams, grams).collect())
        return [g for _, g in found[:most]] if len(found) == len(grams) else None

    def _per_block(self, grams: list[int], least: int, counts: bool) -> DataFrame:
        """(uid, shared): units that have at least least of the grams, by streams of whole blocks."""

        def meet(lists: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            merged = sorted((np.concatenate(x) if len(x) > 1 else x[0] for x in lists.values()), key=len)
            if counts:
                shared = np.bincount(np.concatenate(merged), minlength=1)
                found = np.flatnonzero(shared >= least)
                return found, shared[found]
            if len(merged) < least:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            found = merged[0]
            for other in merged[1:]:  # rarest first
                found = np.intersect1d(found, other, assume_unique=True)
                if not len(found):
                    break
            return found, np.full(len(found), least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, lists = None, {}

            def finished() -> pa.RecordBatch:
                found, shared = meet(lists)
                return pa.RecordBatch.from_arrays([pa.array((at << BLOCK_BITS) + found, pa.int64()), pa.array(shared, pa.int32())], ["uid", "shared"])

            for b in batches:
                for block, gram, n, deltas in zip(*(b.column(c).to_pylist() for c in ("block", "gram", "n", "deltas")), strict=True):
                    if block != at:
                        if lists:
                            yield finished()
                        at, lists = block, {}
                    lists.setdefault(gram, []).append(decoded(n, deltas))
            if lists:
                yield finished()

        lists = self.of(self.postings, grams).select("block", "gram", "n", "deltas")
        return lists.repartition("block").sortWithinPartitions("block").mapInArrow(run, "uid long, shared int")

    def fetched(self, candidates: DataFrame) -> DataFrame:
        """The units of candidates (uid, ...), from the shelves that hold one; there are as many shelves as tasks wrote units."""
        candidates = materialise(candidates, "candidates")
        shelves = [r[0] for r in candidates.select(F.shiftright("uid", SHELF_BITS).cast("int").alias("s")).distinct().collect()]
        return self.units.where(F.col("shelf").isin(shelves)).join(candidates, "uid")

    def holding(self, query: str) -> DataFrame:
        """Units that may contain the query: all that do, and few others."""
        if self.kind != "literal":
            raise ValueError("a literal search needs an index of literal windows")
        if len(query) < 3:
            return self.units
        grams = sorted(set(codes_of(_points([query])[0]).tolist()))
        chosen = self.rarest(grams)
        if chosen is None:
            return self.units.limit(0)
        return self.fetched(self._per_block(chosen, len(chosen), counts=False))

    def lexical_search(self, query: str, keys: list[str], limit: int | None = None) -> DataFrame:
        """What search.lexical_search finds in the units' column text."""
        q = " ".join(query.split())
        return search.lexical_search(self.holding(q) if q else self.units, q, keys, limit)

    def chunk_lexical_search(self, query: str, keys: list[str], scope: DataFrame, scope_keys: list[str], limit: int | None = None) -> DataFrame:
        """What search.chunk_lexical_search finds among the chunks of the scope; the index is of prefix and text."""
        q = " ".join(query.split())
        return search.chunk_lexical_search(search.in_scope(self.holding(q) if q else self.units, scope, scope_keys), q, keys, limit)

    def similar(self, question: str, least: float) -> DataFrame:
        """Units whose words' trigrams have a similarity of least or more with those of the question, with it as score."""
        if self.kind != "words":
            raise ValueError("a similarity search needs an index of words")
        spark = self.units.sparkSession
        asked = spark.range(1).select(trigrams(F.lit(question)).alias("g")).first()["g"]
        if least <= 0:
            raise ValueError("a similarity search needs a least score above 0")
        if not asked:
            return self.units.limit(0).withColumn("score", F.lit(0.0))
        grams = word_pairs(np.zeros(1, np.int64), [asked])[0].tolist()
        # the shared part is at most the smaller set: score >= least needs least * n_asked shared ones (rounding allowed for)
        enough = max(1, int(np.ceil((least - 1e-6) * len(asked))))
        units = self.fetched(self._per_block(grams, enough, counts=True))
        score = F.round(F.col("shared") / (F.lit(len(asked)) + F.col("n_grams") - F.col("shared")), 6)
        return units.withColumn("score", score).where(F.col("score") >= least)

    def suggest(self, question: str, group: str, name: str, least: float = 0.12, limit: int = 5) -> DataFrame:
        """What search.suggest finds among the units."""
        return search.best_names(self.similar(question, least), group, name, limit)
