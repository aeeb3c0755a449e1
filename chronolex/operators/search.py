"""Literal, structural and vector search, weighted reciprocal-rank fusion, context budgets and phrase resolution."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.text import clamp, cosine, normalise, similarity, trigrams
from chronolex.operators.linkage import contained_mentions

#: The fusion constant and the channels' weights.
RRF_K = 60
WEIGHTS = {"lexical": 1.0, "structural": 0.75, "vector": 1.0}
#: Vectors are compared in blocks of so many queries and of so many rows at most.
QUERY_BLOCK, ROW_BLOCK = 256, 1024


def lexical_search(units: DataFrame, query: str, keys: list[str], limit: int | None = None) -> DataFrame:
    """Units that hold the query literally, by trigram similarity. The filter runs before any trigram is made."""
    q = " ".join(query.split())
    if not q:
        return units.limit(0).select(*keys, F.lit(0.0).alias("score"))
    found = units.withColumn("body", normalise("text")).where(F.col("body").contains(q))
    scored = found.select(*keys, F.round(similarity(trigrams("body"), trigrams(F.lit(q))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), *keys).limit(clamp(limit, 20, 200))


def structural_search(units: DataFrame, filters: dict[str, object], contains: dict[str, str], keys: list[str], limit: int | None = None) -> DataFrame:
    """Units by exact and substring filters, in document order; filters that are None are left out of the plan."""
    out = reduce(lambda d, f: d.where(F.col(f[0]) == F.lit(f[1])), ((k, v) for k, v in filters.items() if v is not None), units)
    out = reduce(lambda d, f: d.where(F.col(f[0]).contains(f[1])), ((k, v) for k, v in contains.items() if v), out)
    return out.orderBy(*keys).select(*keys).limit(clamp(limit, 100, 500))


def best_names(scored: DataFrame, group: str, name: str, limit: int) -> DataFrame:
    """The best name of each group (the last in order among equals), best groups first; scored has a column score."""
    best = scored.groupBy(group).agg(F.max_by(F.struct(name, "score"), F.struct("score", F.col(name))).alias("b")).select(group, F.col(f"b.{name}").alias(name), F.col("b.score").alias("score"))
    return best.orderBy(F.desc("score"), group).limit(limit)


def suggest(names: DataFrame, question: str, group: str, name: str, least: float = 0.12, limit: int = 5) -> DataFrame:
    """The most similar name of each group, best groups first."""
    scored = names.select(group, name, F.round(similarity(trigrams(name), trigrams(F.lit(question))), 6).alias("score")).where(F.col("score") >= least)
    return best_names(scored, group, name, limit)


def phrase_resolution(names: DataFrame, questions: DataFrame, phrase: str, question: str) -> DataFrame:
    """For each question the longest of its highest-priority phrases; phrases inside a longer one don't count.

    names: (entity, phrase, priority). Phrases are found by contained_mentions, so no pair of a question and a
    phrase is formed that doesn't match.
    """
    key = lambda c: F.xxhash64(c)
    met = contained_mentions(questions.select(key(question).alias("q"), F.col(question).alias("text")), names.select(key(phrase).alias("p"), F.col(phrase).alias("text")).distinct(), "q", "p", least=1, squeeze=False)
    met = met.join(questions.select(question).distinct().withColumn("q", key(question)), "q").join(names.withColumn("p", key(phrase)), "p")
    best = met.groupBy(question).agg(F.max(F.struct("priority", F.length(phrase).alias("size"))).alias("top"))
    top = met.join(best, question).where((F.col("priority") == F.col("top.priority")) & (F.length(phrase) == F.col("top.size")))
    n = F.count_distinct("entity")
    return top.groupBy(question).agg(n.alias("n"), F.min("entity").alias("entity"), F.min(phrase).alias("phrase")).select(question, F.when(F.col("n") == 1, "resolved").otherwise("candidates").alias("status"), F.when(F.col("n") == 1, F.col("entity")).alias("entity"), F.col("n").alias("n_candidates"))


def vector_topk(vectors: DataFrame, query: list[float], key: str, column: str, limit: int | None = None) -> DataFrame:
    """Exact top-k by cosine over all vectors in scope; zero vectors are skipped."""
    scored = vectors.select(key, F.round(cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score")).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), key).limit(clamp(limit, 20, 200))


def _blocks(vectors: DataFrame, key: str, column: str, most: int) -> DataFrame:
    """(dims, ids, data): unit vectors of one length packed as rows; null, zero and non-finite ones are skipped."""
    schema = "dims int, ids array<long>, data binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(n: int) -> pa.RecordBatch:
            rows = held.pop(n)
            m = np.array([v for _, v in rows], dtype=np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                norms = np.sqrt((m * m).sum(axis=1))
            good = np.isfinite(norms) & (norms > 0)
            ids = [i for (i, _), g in zip(rows, good, strict=True) if g]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([(m[good] / norms[good, None]).tobytes()], pa.binary())], names=["dims", "ids", "data"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == most:
                    yield packed(len(v))
        for n in list(held):
            yield packed(n)

    return vectors.select(F.col(key).cast("long"), F.col(column).cast("array<double>")).mapInArrow(pack, schema)


def vector_topk_batch(queries: DataFrame, vectors: DataFrame, key: str, column: str, limit: int | None = None) -> DataFrame:
    """(query_id, key, score): exact top-k by cosine of every query over all vectors of its length.

    Blocks of queries meet blocks of vectors; each pair of blocks keeps its own top-k of every query, and these
    are merged for each query.
    """
    k = clamp(limit, 20, 200)
    schema = f"query_id long, {key} long, score double"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, qi, q, vi, v in zip(*(b.column(c).to_pylist() for c in ("dims", "q_ids", "q_data", "ids", "data")), strict=True):
                if not qi or not vi:
                    continue
                ids, qs = np.array(vi), np.frombuffer(q).reshape(-1, dims)
                scores = np.round(np.clip(qs @ np.frombuffer(v).reshape(-1, dims).T, -1, 1), 6) + 0.0
                top = [np.lexsort((ids, -s))[:k] for s in scores]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, [len(t) for t in top]), pa.int64()), pa.array(np.concatenate([ids[t] for t in top]), pa.int64()), pa.array(np.concatenate([s[t] for s, t in zip(scores, top, strict=True)]), pa.float64())], names=["query_id", key, "score"])

    asked = _blocks(queries, key, column, QUERY_BLOCK).select(F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    met = _blocks(vectors, key, column, ROW_BLOCK).crossJoin(asked).where("dims = q_dims").select("dims", "q_ids", "q_data", "ids", "data")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return met.mapInArrow(best, schema).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def ranked(hits: DataFrame, channel: str, key: str, order: list[Column], per: list[str] | None = None) -> DataFrame:
    """Hits of one channel with their rank: hits are a limited list, or limited per query."""
    w = Window.partitionBy(*(per or [])).orderBy(*order)
    return hits.select(*(per or []), key, F.lit(channel).alias("channel"), F.row_number().over(w).alias("rank"))


def fuse(hits: DataFrame, key: str, per: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion: the sum over channels of weight / (60 + best rank)."""
    used = {c: w for c, w in (weights or WEIGHTS).items() if w > 0}
    table = F.create_map(*[F.lit(x) for c, w in used.items() for x in (c, w)])
    best = hits.where(F.col("channel").isin(list(used))).groupBy(*(per or []), key, "channel").agg(F.min("rank").alias("rank"))
    return best.groupBy(*(per or []), key).agg(F.round(F.sum(table[F.col("channel")] / (F.lit(RRF_K) + F.col("rank"))), 9).alias("score"), F.count("*").alias("n_channels"))


def guarded(hits: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """Hits with the columns of the scope; a hit outside of it fails the query."""
    joined = hits.join(scope.withColumn("in_scope", F.lit(True)), key, "left")
    return joined.where(F.when(F.col("in_scope"), True).otherwise(F.raise_error(F.lit("retrieval hit outside the resolved scope")).cast("boolean"))).drop("in_scope")


def in_scope(rows: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the resolved scope only; filtered before anything is ranked or limited."""
    return rows.join(scope.select(*keys).distinct(), keys, "left_semi")


def chunk_matches(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks whose text or prefix holds the query literally."""
    q = " ".join(query.split())
    if not q:
        return chunks.limit(0)
    return chunks.where(normalise("text").contains(q) | normalise("prefix").contains(q))


def chunk_lexical_search(chunks: DataFrame, query: str, keys: list[str], limit: int | None = None) -> DataFrame:
    """Matching chunks by trigram similarity of their text, then by keys. chunks are those of the scope."""
    scored = chunk_matches(chunks, query).select(*keys, F.round(similarity(trigrams("text"), trigrams(F.lit(" ".join(query.split())))), 6).alias("score"))
    return scored.orderBy(F.desc("score"), *keys).limit(clamp(limit, 50, 200))


def chunk_structural_search(chunks: DataFrame, filters: dict[str, object], keys: list[str], limit: int | None = None) -> DataFrame:
    """Chunks by their anchor's fields, all with score 1, in document order; without any filter there is nothing to search."""
    used = {k: v for k, v in filters.items() if v is not None}
    if not used:
        raise ValueError("a structural search needs a filter")
    found = reduce(lambda d, f: d.where(F.col(f[0]) == F.lit(f[1])), used.items(), chunks)
    return found.orderBy(*keys).select(*keys, F.lit(1.0).alias("score")).limit(clamp(limit, 100, 500))


def scope_supplement(chunks: DataFrame, members: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc, chunk_id, channel, score): chunks below each hit (doc, anchor, slots, room) that fit what is left of slots and room.

    members: (doc, anchor, ord), the nodes below. Of each hit the first 3 * slots chunks are candidates.
    """
    wanted = hits.join(members, ["doc", "anchor"]).select("doc", "anchor", "slots", "room", F.col("ord").alias("first_ord"))
    found = chunks.drop("anchor").join(wanted, ["doc", "first_ord"])
    w = Window.partitionBy("doc", "anchor").orderBy("first_ord", "chunk_id")
    candidates = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= 3 * F.col("slots"))
    lists = candidates.groupBy("doc", "anchor", "slots", "room").agg(F.array_sort(F.collect_list(F.struct("place", "n_chars", "chunk_id"))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["taken"]) < F.col("slots")) & (acc["used"] + x["n_chars"] <= F.col("room"))
        return F.when(fits, F.struct((acc["used"] + x["n_chars"]).alias("used"), F.array_append(acc["taken"], x["chunk_id"]).alias("taken"))).otherwise(acc)

    taken = lists.select("doc", F.explode(F.aggregate("items", start, step)["taken"]).alias("chunk_id"))
    return taken.select("doc", "chunk_id", F.lit("structural-scope").alias("channel"), F.lit(0.0).alias("score"))


def _in_reach(rows: DataFrame, most: int, salts: int) -> DataFrame:
    """Rows (g, o, n, k) that budgeted may choose; groups are dealt to salts, so none is one task's work.

    When a row is chosen, all rows before it that are no longer have been chosen too, so there are fewer than most of
    them, among any part of the rows. A part read in order needs the lengths of the most shortest rows so far only.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shortest = None, []
        for b in batches:
            kept = []
            for g, salt, n in zip(*(b.column(c).to_pylist() for c in ("g", "salt", "n")), strict=True):
                if (g, salt) != of:
                    of, shortest = (g, salt), []
                kept.append(n is not None and bisect.bisect_right(shortest, n) < most)
                if kept[-1]:
                    bisect.insort(shortest, n)
                    del shortest[most:]
            yield b.filter(pa.array(kept, pa.bool_()))

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("k", "o"), F.lit(salts)).cast("int"))
    return salted.repartition("g", "salt").sortWithinPartitions("g", "salt", "o").mapInArrow(keep, salted.schema).drop("salt")


def budgeted(ranked_rows: DataFrame, group: str, order: str, length: str, key: str, most: int = 8, budget: int = 6000, salts: int = 32) -> DataFrame:
    """(group, position, key, used): contexts chosen in rank order; one that would exceed the budget is skipped, later ones may still fit.

    The first may be larger than the budget by itself. used is the length of all that is chosen. Rows without a length
    aren't chosen. A running sum would count skipped ones, so lists are read in order as streams: first by parts of
    each group, which leave the few rows that can be chosen at all, then these.
    """
    names = ["g", "o", "n", "k"]
    rows = _in_reach(ranked_rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(length).cast("long").alias("n"), F.col(key).alias("k")), most, salts)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, taken, used = None, [], 0

        def chosen() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of] * len(taken), kinds[0]), pa.array(range(1, len(taken) + 1), pa.int64()), pa.array(taken, kinds[1]), pa.array([used] * len(taken), pa.int64())], ["g", "position", "k", "used"])

        for b in batches:
            kinds = (b.schema.field("g").type, b.schema.field("k").type)
            for g, _, n, k in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if g != of and taken:
                    yield chosen()
                if g != of:
                    of, taken, used = g, [], 0
                if len(taken) < most and (not taken or used + n <= budget):
                    taken.append(k)
                    used += n
        if taken:
            yield chosen()

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("g", "k")}
    stream = rows.repartition("g").sortWithinPartitions("g", "o").mapInArrow(choose, f"g {kind['g']}, position long, k {kind['k']}, used long")
    return stream.select(F.col("g").alias(group), "position", F.col("k").alias(key), "used")
