"""N-gram Jaccard join by grouped prefixes.

A document's set is that of its distinct word shingles, as 64-bit hashes. Documents with one set form a class.
Hashes have a global order, rare ones first, and sets of n hashes with a Jaccard similarity of t or more must share
one of the first n - ceil(t n) + 1: the prefix. t is an exact fraction p / q, from which all filters follow. Classes with the same prefix and size form a group; the index over prefix
hashes holds groups. Group pairs are filtered by size and by where in their prefixes they first meet, then expanded
to members, filtered by a 256-bit parity bitmap (each differing bit is a differing hash at least) and verified on
the whole sets.

Large families of near copies would make pairs in the square of their size. So each indexed hash first links its
groups to one pivot, the one with fewest hashes of its own; linked classes get components, and later only pairs of
different components count, as links inside one change nothing. A pair is made only where a run of common hashes
begins, and of the pairs between two components one is verified first. No pair across components is dropped.

Rarity comes from two tables of fixed size: of word counts, whose logs add up to what a shingle of independent words
would have, and of shingles that are common within some partition: any tables give a correct order, good ones short
lists. Lists are split by size, as sets of too different sizes can't be similar. Joins on hashes are plain equi-joins over written tables, whose skew Spark splits.

Defined results: null or wordless text has an empty set, no link and its own doc_id as component; fewer words
than a shingle make one shingle. Repeated rows are linked by their equal sets. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.llm.common import hand_back, id_text, record_batch
from chronolex.llm.components import components
from chronolex.storage import discard, load, materialise

#: op3_jaccard_join links at this similarity.
LEAST = Fraction(9, 10)
#: log2 of the slots of the tables of shingles and of words.
SLOTS, WORD_SLOTS = 21, 20
#: Bytes of a text whose words are held at a time, and what they end at.
PIECE, BLANK = 1 << 18, re.compile(rb"[\x20\x09-\x0D]")
#: Hashes that a batch of sets or prefixes holds before it is handed on.
BATCH = 500_000
#: Below so many ids (8 bytes each) a list of candidates is broadcast; a shuffled join takes longer ones.
BROADCAST_IDS = 1_000_000
BITS = ("b0", "b1", "b2", "b3")
SKETCH = "doc_id long, th long, ck binary, n int, b0 long, b1 long, b2 long, b3 long, pw int, ph long, prefix array<long>"


def words_hashed(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words, in order; a long text is split into words piece by piece."""
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""  # of bytes: A-Z and ASCII white space only
    parts, at = [], 0
    while at < len(data):
        blank = BLANK.search(data, at + PIECE)
        end = blank.start() if blank else len(data)
        parts.append(b"".join(map(xxhash.xxh3_64_digest, data[at:end].split())))
        at = end
    return np.frombuffer(b"".join(parts), dtype=np.uint64)


def shingled(h: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the shingles of these words, in order."""
    k = min(size, len(h))
    if not k:
        return np.zeros(0, dtype=np.int64)
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return np.unique(shingled(words_hashed(text), size))


@dataclass
class Rarity:
    """Tables of fixed size, a byte (log of a count) for each slot of hashes: of words, and of shingles that are common somewhere."""

    words: np.ndarray
    shingles: np.ndarray

    def weights(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The set of these words and each member's weight, larger for what is expected to be more common.

        A shingle's weight is the sum of its words' logs, as of independent words; common ones come after all others.
        """
        k = min(size, len(h))
        found, at = np.unique(shingled(h, size), return_index=True)
        own = self.words[(h & np.uint64(len(self.words) - 1)).astype(np.int64)].astype(np.int32)
        total = sum(own[i : len(h) - k + 1 + i] for i in range(k)) if k else own
        return found, total[at] + 4096 * self.shingles[found & (len(self.shingles) - 1)].astype(np.int32)


def rarity(texts: DataFrame, size: int) -> Rarity:
    """Words counted in hashed slots (those a partition has once aside), and shingles where they are many in some partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, used, total = np.zeros(1 << WORD_SLOTS, dtype=np.int32), np.zeros(1 << SLOTS, dtype=np.int32), 0
        for b in batches:
            for text in b.column(0):
                h = words_hashed(text.as_py())
                if len(h):
                    np.add.at(words, (h & np.uint64(len(words) - 1)).astype(np.int64), 1)
                    s = np.unique(shingled(h, size))
                    used[s & (len(used) - 1)] += 1
                    total += len(s)
        for table, counts, least in ((0, words, 1), (1, used, max(5, 4 * total / len(used)))):
            many = np.flatnonzero(counts > least)
            for i in range(0, len(many), 50_000):
                part = many[i : i + 50_000]
                slots = pa.array(part.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), table, dtype=np.int32)), slots, pa.array(counts[part].astype(np.int64))], ["of", "slot", "n"])

    tables = [np.zeros(1 << WORD_SLOTS, dtype=np.uint8), np.zeros(1 << SLOTS, dtype=np.uint8)]
    summed = texts.select("text").mapInArrow(count, "of int, slot int, n long").groupBy("of", "slot").agg(F.sum("n").alias("n"))
    logs = F.least(F.lit(255), F.round(8 * F.log2(1 + F.col("n")))).cast("int")
    block = F.shiftright("slot", 12)  # rows to the driver: one a block, 2 ** (WORD_SLOTS - 12) + 2 ** (SLOTS - 12) at most
    blocks = summed.select("of", block.alias("block"), F.struct("slot", logs.alias("w")).alias("x")).groupBy("of", "block").agg(F.collect_list("x.slot").alias("slots"), F.collect_list("x.w").alias("ws"))
    for r in blocks.toLocalIterator():
        tables[r.of][np.array(r.slots)] = r.ws
    return Rarity(*tables)


def sketches(texts: DataFrame, size: int, table: Rarity, least: Fraction) -> DataFrame:
    """One row for each document: key of its set, size, parity bitmap, last prefix hash and prefix."""
    p, q = least.numerator, least.denominator
    plain, _, _ = SKETCH.rpartition(", prefix ")

    def batch(rows: list[tuple], prefixes: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(ends, np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64))
        return pa.RecordBatch.from_arrays([*record_batch(rows, plain).columns, lists], [c.split()[0] for c in SKETCH.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        for b in batches:
            rows, prefixes, held = [], [], 0
            for doc_id, text, th in zip(*b.columns, strict=True):
                doc_id, th, words = doc_id.as_py(), th.as_py(), words_hashed(text.as_py())
                h, w = table.weights(words, size)
                n = len(h)
                if not n:
                    rows.append((doc_id, th, b"", 0, 0, 0, 0, 0, 0, 0))
                    prefixes.append(none)
                    continue
                key = xxhash.xxh3_128_digest(h.tobytes())
                parity = np.bincount((h >> 56) & 255, minlength=256) & 1
                bits = np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()
                order = np.lexsort((h, w))[: n - (p * n + q - 1) // q + 1]
                first = h[order]
                rows.append((doc_id, th, key, n, *bits, int(w[order[-1]]), int(first[-1])))
                prefixes.append(first)
                held += len(first)
                if held > BATCH:
                    yield batch(rows, prefixes)
                    rows, prefixes, held = [], [], 0
            yield batch(rows, prefixes)
        hand_back()

    return texts.select("doc_id", "text", text_hash().alias("th")).mapInArrow(run, SKETCH)


def whole_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, hashes) of the wanted classes (cid, ck, rep), read again from one document each."""
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    few = wanted.count() <= BROADCAST_IDS
    if few:
        ids = F.broadcast(ids)

    def batch(sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64))], ["ck", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, held = [], 0
            for text in b.column(0):
                sets.append(shingle_set(text.as_py(), size))
                held += len(sets[-1])
                if held > BATCH:
                    yield batch(sets)
                    sets, held = [], 0
            yield batch(sets)
        hand_back()

    sets = texts.join(ids, "doc_id", "left_semi").select("text").mapInArrow(run, "ck binary, hashes array<long>")
    known = wanted.select("cid", "ck")
    return sets.join(F.broadcast(known) if few else known, "ck").select("cid", "hashes")


def differing(a: list[str], b: list[str]) -> Column:
    """Number of bits in which two bitmaps differ."""
    bits = [F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)]
    return sum(bits[1:], bits[0])


def few_differ(bits: Column, total: Column, least: Fraction) -> Column:
    """Whether sets of total hashes can have the least similarity if so many hashes at least are in one of them only."""
    return bits * (least.numerator + least.denominator) <= (least.denominator - least.numerator) * total


def near(pairs: DataFrame, classes: DataFrame, least: Fraction) -> DataFrame:
    """Those pairs (a, b, ...) of classes that sizes and parity bitmaps don't rule out, with n_a, n_b, differing."""
    side = lambda s: classes.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in BITS])
    joined = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("differing", differing([f"a_{c}" for c in BITS], [f"b_{c}" for c in BITS]))
    close = joined.where(sizes_fit("n_a", "n_b", least) & few_differ(F.col("differing"), F.col("n_a") + F.col("n_b"), least))
    return close.drop(*[f"{s}_{c}" for s in "ab" for c in BITS])


def same_sets(close: DataFrame, classes: DataFrame, texts: DataFrame, size: int, least: Fraction) -> DataFrame:
    """Those pairs (a, b) of near classes whose whole sets have the least similarity or more."""
    close = materialise(close.select("a", "b", "n_a", "n_b"), "pairs")
    ends = close.select(F.col("a").alias("cid")).union(close.select("b")).distinct()
    wanted = materialise(classes.select("cid", "ck", "rep").join(ends, "cid", "left_semi"), "wanted")
    sets = materialise(whole_sets(texts, wanted, size), "sets")
    both = close.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb")), "b")
    # a document read twice (its id repeats) gives its pairs twice
    same = materialise(both.where(shares(F.size(F.array_intersect("ha", "hb")), F.col("n_a") + F.col("n_b"), least)).select("a", "b").distinct(), "links")
    discard(close, wanted, sets)
    return same


def sizes_fit(a: str, b: str, least: Fraction) -> Column:
    return (F.least(a, b) * least.denominator >= F.greatest(a, b) * least.numerator)


def shares(common: Column, total: Column, least: Fraction) -> Column:
    """Whether so many common hashes of sets of total hashes together make the least similarity."""
    return (least.numerator + least.denominator) * common >= least.numerator * total


def enough(c: str, n: str, k: str, other: str, least: Fraction) -> Column:
    """Whether sets of sizes n and other can be similar enough if c of n's k prefix hashes are in the other's prefix.

    n's is the prefix that ends first, so the other set holds no more of its k hashes; all the rest may be shared.
    """
    return shares(F.col(c) + F.col(n) - F.col(k), F.col(n) + F.col(other), least)


def text_hash() -> Column:
    return F.xxhash64("text", F.length("text"))


def jaccard_components(docs: DataFrame, size: int = 3, least: Fraction = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; links at a Jaccard similarity of least or more."""
    return _placed(docs, size, least)[0].select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = 3, least: Fraction = LEAST) -> DataFrame:
    """docs with one document of each component: one of smallest doc_id; columns as they are.

    Documents without words are linked with nothing, so they all stay.
    """
    found, tables = _placed(docs, size, least)
    placed = materialise(found, "placed")
    discard(*tables)
    gone = placed.where("n_shingles > 0 and not first").select("doc_id", "th").distinct()
    key = "text_hash_of_join"
    marked = docs.withColumn(key, F.xxhash64(F.col("text").cast("string"), F.length(F.col("text").cast("string"))))
    left = marked.join(gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_hash")), F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.col(key) == F.col("gone_hash")), "left_anti")
    again = placed.where("n_shingles > 0 and first").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_hash"))
    if again.isEmpty():
        return left.select(*docs.columns)
    repeated = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.col(key) == F.col("gone_hash"))
    once = left.join(again, repeated, "left_semi").dropDuplicates(["doc_id", key])
    return left.join(again, repeated, "left_anti").union(once).select(*docs.columns)


def _placed(docs: DataFrame, size: int, least: Fraction) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, th, n_shingles, component_id, first), and the tables it reads: first marks the class whose document stays."""
    p, q = least.numerator, least.denominator
    texts = id_text(docs)
    sketched = materialise(sketches(texts, size, rarity(texts, size), least), "sketches")
    kept = ["n", "b0", "b1", "b2", "b3", "pw", "ph", "prefix"]
    classes = sketched.where("n > 0").groupBy("ck").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in kept])
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    light = materialise(sketched.select("doc_id", "th", "ck", "n"), "documents")
    discard(sketched)
    del sketched
    # groups: one prefix and size; known by their smallest class
    keyed = classes.select("cid", "n", "pw", "ph", F.xxhash64("n", "prefix").alias("g1"), F.xxhash64(F.lit(1), "n", "prefix").alias("g2"))
    leaders = keyed.groupBy("g1", "g2").agg(F.min("cid").alias("gid"), F.count("*").alias("members"))
    members = materialise(keyed.join(leaders, ["g1", "g2"]).select("cid", "gid", "members"), "members")
    groups = members.where("cid = gid").select("gid", "members").join(classes.select(F.col("cid").alias("gid"), "n", "pw", "ph", "prefix"), "gid")
    # hashes that several groups have: (hash, group) is shuffled once, and sorted by hash, where another row of it is a neighbour
    postings = groups.select("gid", F.posexplode("prefix").alias("pos", "h"))
    beside = Window.partitionBy("h").orderBy("gid")
    known = postings.withColumn("before", F.lag("gid").over(beside)).withColumn("after", F.lead("gid").over(beside))
    listed = materialise(known.where("before is not null or after is not null").select("gid", "pos", "h"), "postings")
    del postings, known
    traits = groups.select("gid", "n", "pw", "ph", F.size("prefix").alias("k"))
    shared = materialise(listed.join(traits, "gid"), "traits")
    discard(listed)
    pivots = shared.groupBy("h").agg(F.max(F.struct("pw", "ph", "gid", "n", "k")).alias("top"))
    pivots = materialise(pivots.select("h", F.col("top.gid").alias("pivot"), F.col("top.n").alias("pivot_n"), F.col("top.k").alias("pivot_k")), "pivots")

    # every group to its lists' pivots, and the members of a group to its leader; a pivot's prefix ends last
    stars = shared.join(pivots, "h").where("gid <> pivot").groupBy("gid", "pivot", "n", "k", "pivot_n").agg(F.count("*").alias("c"))
    stars = stars.where(sizes_fit("n", "pivot_n", least) & enough("c", "n", "k", "pivot_n", least)).select(F.col("gid").alias("a"), F.col("pivot").alias("b"))
    inner = members.where("cid <> gid").select(F.col("cid").alias("a"), F.col("gid").alias("b"))
    first = same_sets(near(stars.union(inner), classes, least), classes, texts, size, least)
    labels = components(first)

    # whatever else can link: pairs of groups that meet in a list and aren't in one component as a whole
    labelled = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    whole = labelled.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    alone = shared.groupBy("gid").agg((F.max("k") - F.count("*")).alias("u"))  # prefix hashes that no other group's prefix has
    known = whole.join(alone, "gid").select("gid", "u", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(-1 - F.col("gid")).alias("component"))
    # rank of a hash among the listed ones of its prefix, and the listed one before it
    order = Window.partitionBy("gid").orderBy("pos")
    placed = materialise(shared.drop("k").join(known, "gid").withColumn("rank", F.row_number().over(order)).withColumn("prev", F.lag("h").over(order)), "placed")
    discard(shared, pivots)
    # lists within one component make no pair; the bitmap of a group of one class goes along, larger groups are filtered once they are expanded
    mixed = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h")
    bits = members.where("members = 1").select("gid").join(classes.select(F.col("cid").alias("gid"), *BITS), "gid")
    open_lists = materialise(placed.join(mixed, "h", "left_semi"), "open")
    discard(placed)
    ready = materialise(open_lists.join(bits, "gid", "left"), "ready")
    # the one whose prefix ends first can share all but its own hashes
    x = ready.where(f"{p + q} * (n - u - rank + 1) >= {p} * (n + ({p} * n + {q - 1}) div {q})").select("h", *[F.col(c).alias(f"x_{c}") for c in ("gid", "n", "pw", "ph", "u", "rank", "prev", "component", *BITS)])
    y = ready.where(f"{p + q} * (n - pos) >= {p} * (n + ({p} * n + {q - 1}) div {q})").select("h", *[F.col(c).alias(f"y_{c}") for c in ("gid", "n", "pw", "ph", "pos", "prev", "component", *BITS)])
    earlier = F.struct("x_pw", "x_ph", "x_gid") < F.struct("y_pw", "y_ph", "y_gid")
    # a pair is made where a run of common hashes begins; at the first of all, whatever comes before isn't shared
    begins = F.coalesce(F.col("x_prev") != F.col("y_prev"), F.lit(True))
    left = F.least(F.col("x_n") - F.col("x_u") - F.col("x_rank") + 1, F.col("y_n") - F.col("y_pos"))
    fits = sizes_fit("x_n", "y_n", least) & shares(left, F.col("x_n") + F.col("y_n"), least)
    # sizes that fit differ by 1 in log(n) / log(1 / t); classes are four wide, so they lie in one class or two
    size_class = lambda n, off: F.floor((F.log(F.col(n)) / (float(np.log(q / p)) or 1.0) + off) / 4)
    x = x.withColumn("size_class", F.explode(F.array_distinct(F.array(size_class("x_n", -1 - 1e-9), size_class("x_n", 1 + 1e-9)))))
    y = y.withColumn("size_class", size_class("y_n", 0.0))
    close = F.coalesce(few_differ(differing([f"x_{b}" for b in BITS], [f"y_{b}" for b in BITS]), F.col("x_n") + F.col("y_n"), least), F.lit(True))
    met = x.join(y, (x.h == y.h) & (x.size_class == y.size_class) & earlier & begins & fits & (F.col("x_component") != F.col("y_component")) & close)
    met = met.select(F.col("x_gid").alias("ga"), F.col("y_gid").alias("gb")).distinct()
    met = met.union(labelled.where("members > 1").groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(F.col("gid").alias("ga"), F.col("gid").alias("gb")))
    side = lambda s: labelled.select(F.col("gid").alias(f"g{s}"), F.col("cid").alias(s), F.col("component").alias(f"c{s}"))
    rest = met.join(side("a"), "ga").join(side("b"), "gb").where("ca <> cb and (ga <> gb or a < b)").select("a", "b", "ca", "cb")
    rest = materialise(near(rest, classes, least), "near")
    discard(ready, open_lists)
    # one pair of any two components is tried before the others, which mostly lie inside one component then
    tried = rest.groupBy(F.least("ca", "cb").alias("low"), F.greatest("ca", "cb").alias("high")).agg(F.min(F.struct("differing", "a", "b", "n_a", "n_b", "ca", "cb")).alias("p")).select("p.*")
    tried = materialise(tried, "tried")
    second = same_sets(tried, classes, texts, size, least)
    merged = components(tried.join(second, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    renamed = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c))
    left_over = rest.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    for c in ("ca", "cb"):
        left_over = left_over.join(merged.select(F.col("node").alias(c), F.col("component").alias(f"new_{c}")), c, "left")
    third = same_sets(left_over.where(renamed("ca") != renamed("cb")), classes, texts, size, least)
    discard(labels, members, rest, tried, merged)
    labels = components(first.union(second).union(third))
    discard(first, second, third)

    # component ids are document ids: the smallest of the classes of a component
    named = classes.select("cid", "ck", "rep").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = materialise(named, "named")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.min(F.struct(F.col("rep").isNull(), "rep", "cid")).alias("low"))
    final = materialise(named.join(smallest, "component").select("ck", "component_id", "rep", (F.col("cid") == F.col("low.cid")).alias("winner")), "components")
    discard(classes, labels, named)
    found = light.join(final, "ck", "left")
    first = F.coalesce(F.col("winner") & F.col("doc_id").eqNullSafe(F.col("rep")), F.lit(True))
    return found.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), first.alias("first")), [light, final]


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))
