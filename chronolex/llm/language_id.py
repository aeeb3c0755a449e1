"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector over hashed character n-grams (one to three letters, words padded by
a space). Every language has several centroids, clustered by spherical k-means; a text gets the language of the
centroid of largest cosine. Its distance decides on rejection: a text whose cosine lies below what nearly all stretches
of its length reach, and far below the middle one, measured on rows that no centroid was fitted to, is rejected (column
rejected), but still gets its nearest language.

Fit: document frequencies and centroids come from a bounded sample of labelled rows for each language (Fit), drawn by
a hash of the id; the rest of the labelled rows isn't needed. Scoring reads every whole text.

Defined results: null text or text without a letter is "und" with score 0, and rejected. With no labelled row,
every text is "und". Rows with null language are not learned from. Repeated rows are scored one by one. Very
long texts are hashed in pieces, so memory stays bounded by the text itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm.common import fold_of, record_batch
from chronolex.storage import load, materialise, small_batches

BITS = 13
SIZE = 1 << BITS
#: Length classes for rejection: powers of two of the number of letters.
LENGTHS = 24
PIECE = 1 << 20
UND = "und"


@dataclass(frozen=True)
class Fit:
    """Bounds of the fit: rows drawn of each language, centroids of each, rounds of k-means.

    One of five of the drawn rows is kept from the centroids and shows what unseen texts reach: a stretch of each
    length class is taken from every one that is long enough, so that each class has about as many. A text is rejected
    below the reject_quantile of its class's cosines, where that is no more than reject_share of their median; a shorter
    text never faces a higher bar than a longer one.
    """

    rows: int = 2000
    centroids: int = 4
    rounds: int = 12
    reject_quantile: float = 0.01
    reject_share: float = 0.3


def _letter_table() -> np.ndarray:
    """Code point to lower-case code point for letters, 32 for anything else."""
    table = np.full(0x10000, 32, dtype=np.uint32)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


FOLD = _letter_table()


def _folded(piece: str) -> np.ndarray:
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = FOLD[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():  # beyond the table: letters of rare scripts, and symbols
        found, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in found.tolist()], dtype=np.uint32)[at]
    return out


def _grams(before: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Counts of the one- to three-grams that end in x; before holds the (up to two) codes ahead of it."""
    k, all_ = len(before), np.concatenate((before, x))
    one, shift = all_ * np.uint32(0x9E3779B1), np.uint32(32 - BITS)
    two = (one[:-1] ^ (all_[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (all_[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    own = (one[k:], two[max(0, k - 1) :], three[max(0, k - 2) :])
    return sum(np.bincount(h >> shift, minlength=SIZE) for h in own).astype(float)


def vector(text: str | None) -> tuple[np.ndarray | None, int]:
    """Damped n-gram counts of the whole text and its number of letters; None without letters.

    Words have a space on either side; runs of other characters count as one space. A long text is read in
    pieces, each with the two codes before it, so pieces change nothing.
    """
    if not text:
        return None, 0
    total, letters, before = np.zeros(SIZE), 0, np.zeros(0, dtype=np.uint32)
    for i in range(0, len(text), PIECE):
        x = _folded(text[i : i + PIECE])
        letters += int((x != 32).sum())
        ends = ([32] if i == 0 else [], [32] if i + PIECE >= len(text) else [])
        x = np.concatenate((ends[0], x, ends[1])).astype(np.uint32)
        last = before[-1] if len(before) else 0
        x = x[(x != 32) | (np.concatenate(([last], x[:-1])) != 32)]
        total += _grams(before, x)
        before = np.concatenate((before, x))[-2:]
    return (np.log1p(total), letters) if letters else (None, 0)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each, normalised
    owner: np.ndarray  # index into languages of each centroid
    floor: np.ndarray  # least cosine by length class

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts, letters = vector(text)
        if counts is None or not self.languages:
            return UND, 0.0, True
        v = counts * self.idf
        norm = math.sqrt(float(v @ v))
        if not norm:
            return UND, 0.0, True
        cosines = (self.centroids @ v) / norm
        best = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[best])))
        return self.languages[self.owner[best]], score, score < self.floor[min(LENGTHS - 1, letters.bit_length())]


def sample_rows(docs: DataFrame, fit: Fit) -> DataFrame:
    """(lang, text, kept) rows to learn from: about fit.rows of each language, drawn by a hash of the id; kept ones calibrate."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where((fold_of("doc_id", 3) != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    drawn = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(5)) == 0
    return known.join(F.broadcast(counts), "lang").where(drawn * F.col("n") < fit.rows).select("lang", "text", kept.alias("kept"))


def learn(docs: DataFrame, fit: Fit) -> Model:
    small_batches(docs.sparkSession)
    rows = materialise(sample_rows(docs, fit), "language")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(SIZE, dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                counts, _ = vector(text)
                if counts is not None:
                    df += counts > 0
                    n += 1
        if n:
            yield record_batch([(i, int(x)) for i, x in enumerate(df) if x] + [(-1, n)], "slot int, n long")

    learned = rows.where("not kept")
    df = {r.slot: r["n"] for r in learned.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(-1, 0)
    idf = np.full(SIZE, math.log(1 + n) + 0.1)  # n-grams of no learned text are rare ones
    for slot, x in df.items():
        idf[slot] = math.log((1 + n) / (1 + x)) + 0.1
    k, rounds = fit.centroids, fit.rounds

    def cluster(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Spherical k-means over one language's sample, seeded by farthest points; bounded by fit.rows."""
        x, n = np.empty((len(part), SIZE), dtype=np.float32), 0
        for text in part["text"].sort_values():
            v, _ = vector(text)
            if v is not None:
                v *= idf
                x[n] = v / max(np.linalg.norm(v), 1e-9)
                n += 1
        if not n:
            return pd.DataFrame({"lang": [], "weights": []})
        x = x[:n]
        centre = x.mean(axis=0)
        seeds = [int(np.argmax(x @ centre))]
        near = x @ x[seeds[0]]
        while len(seeds) < min(k, len(x)):
            seeds.append(int(np.argmin(near)))
            near = np.maximum(near, x @ x[seeds[-1]])
        c = x[seeds]
        for _ in range(rounds):
            own = np.argmax(x @ c.T, axis=1)
            sums = (own[None, :] == np.arange(len(c))[:, None]).astype(np.float32) @ x
            c = np.where((own[None, :] == np.arange(len(c))[:, None]).any(axis=1, keepdims=True), sums, c)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
        kept = c[own >= max(2, 0.01 * len(x))] if (own >= max(2, 0.01 * len(x))).any() else c
        return pd.DataFrame({"lang": [key[0]] * len(kept), "weights": [row.astype("<f4").tobytes() for row in kept]})

    found = sorted(learned.select("lang", "text").groupBy("lang").applyInPandas(cluster, "lang string, weights binary").collect(), key=lambda r: (r.lang, bytes(r.weights)))
    languages = sorted({r.lang for r in found})
    centroids = np.array([np.frombuffer(r.weights, dtype="<f4") for r in found], dtype=float).reshape(len(found), SIZE)
    owner = np.array([languages.index(r.lang) for r in found], dtype=int)
    model = Model(languages, idf, centroids, owner, np.zeros(LENGTHS))
    if not languages:
        return model

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                for stretch in stretches(text):
                    lang, score, _ = model.predict(stretch)
                    if lang != UND:
                        out.append((min(LENGTHS - 1, vector(stretch)[1].bit_length()), score))
            yield record_batch(out, "length int, score double")

    seen = rows.where("kept").select("text").mapInArrow(cosines, "length int, score double").groupBy("length")
    got = seen.agg(F.expr(f"percentile_approx(score, array({fit.reject_quantile}, 0.5), 10000)").alias("q"), F.count("*").alias("n")).collect()
    bars = {r.length: min(r.q[0], fit.reject_share * r.q[1]) for r in got if r["n"] >= 20}
    least = None
    for length in reversed(range(LENGTHS)):
        if length in bars:
            least = bars[length] if least is None else min(least, bars[length])
        model.floor[length] = least if least is not None else 0.0
    longest = max(bars, default=0)  # texts longer than all that were seen face the bar of these
    model.floor[longest:] = model.floor[longest]
    return model


def stretches(text: str | None) -> Iterator[str]:
    """The text itself, and of each power of two a stretch of about so many characters from its middle, cut at blanks."""
    if not text:
        return
    yield text
    for k in range(3, LENGTHS):
        size = 5 << (k - 2)
        if size * 3 // 2 > len(text):
            return
        begin = text.find(" ", (len(text) - size) // 2) + 1
        yield text[begin : begin + size].rpartition(" ")[0]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document."""
    schema = "doc_id long, lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield record_batch([(i, *model.predict(text)) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def language_id(docs: DataFrame, fit: Fit | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document, by a model learned from docs itself."""
    found = predict(docs, learn(docs, fit or Fit()))
    return found.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, fit: Fit | None = None) -> DataFrame:
    """docs without those whose language is rejected; rows and columns otherwise as they are."""
    model = learn(docs, fit or Fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([not model.predict(text)[2] for text in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(load(spark, sf_dir, "documents"))
