"""Quality rules by distribution divergence.

Each language's reference is a histogram of character classes and one of common words, summed over all
documents of that language. A document is compared with every reference by Jensen-Shannon distance (square
root of the base-2 divergence, 0 to 1) and judged by its nearest one; short documents are not judged, as
their histograms say little. One scan finds which words can be common, a second one counts them whole, a third one
scores; only the references (bounded) reach the driver. Results don't depend on how rows are partitioned.

Defined results: null or empty text has zero counts, no distance, base_failed true (fewer than 50 words).
No row with a language: no references, so the divergence never fails a document. Repeated rows are scored
one by one. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm.common import WORD, record_batch
from chronolex.storage import load, small_batches

#: Character classes, by position in the histogram.
CLASSES = ("lower", "upper", "other letter", "digit", "space", "line end", "full stop or comma", "other mark", "symbol", "else")
SYMBOLS = "#*$%&|<>"


def _class_table() -> np.ndarray:
    table = np.full(0x250, 9, dtype=np.uint8)
    for cp in range(0x250):
        c = chr(cp)
        if c.isalpha():
            table[cp] = (1 if c.isupper() else 0) if cp < 128 else 2
        elif c.isdigit():
            table[cp] = 3
        elif c == "\n":
            table[cp] = 5
        elif c.isspace():
            table[cp] = 4
        elif c in ".,":
            table[cp] = 6
        elif c in SYMBOLS:
            table[cp] = 8
        elif 32 < cp < 127:
            table[cp] = 7
    table[-1] = 2  # stands for every later code point
    return table


CLASS_OF = _class_table()


@dataclass(frozen=True)
class Limits:
    """Parameters. common_share: least share of a language's words that makes a word common.

    The word distance of n words may reach max_word_distance + word_noise / sqrt(n), as few words scatter more.
    """

    common_share: float = 0.005
    min_words: int = 100
    max_char_distance: float = 0.30
    max_word_distance: float = 0.20
    word_noise: float = 1.0


def char_histogram(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(CLASS_OF[np.minimum(codes, len(CLASS_OF) - 1)], minlength=len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the count vector p from each row of the distributions q."""
    p = p / p.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text and lang is not None:
                yield text, lang


class Frequent:
    """Counts of frequent words in bounded memory: each is too low by slack at most, and words left out have slack at most."""

    def __init__(self, most: int = 200_000):
        self.most, self.slack, self.total, self.counts = most, 0, 0, Counter()

    def add(self, words: list[str]) -> None:
        self.counts.update(words)
        self.total += len(words)
        if len(self.counts) > self.most:
            cut = sorted(self.counts.values())[len(self.counts) // 2]
            self.slack += cut
            self.counts = Counter({w: n - cut for w, n in self.counts.items() if n > cut})

    def at_least(self, share: float) -> list[str]:
        """Every word with that share of all words, and maybe some with less."""
        return [w for w, n in self.counts.items() if n + self.slack >= share * self.total]


def references(docs: DataFrame, limits: Limits) -> dict:
    """Per language: distribution over CLASSES, the common words and their distribution (last place: all other words).

    A word with a share of all words of a language has that share in some partition, so the words that reach
    common_share in a partition hold all common ones (1 / common_share a partition, and few more). These are counted
    in all documents.
    """
    share = limits.common_share
    named = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Frequent] = defaultdict(Frequent)
        chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(CLASSES), dtype=np.int64))
        for text, lang in _pairs(batches):
            found[lang].add(text.lower().split())
            chars[lang] += char_histogram(text)
        rows = [(lang, f"c{i}", int(n)) for lang, h in chars.items() for i, n in enumerate(h)]
        rows += [(lang, "t", f.total) for lang, f in found.items()]
        rows += [(lang, f"w{w}", 0) for lang, f in found.items() for w in f.at_least(share)]
        yield record_batch(rows, "lang string, what string, n long")

    by: dict[str, dict[str, int]] = defaultdict(dict)
    for r in named.mapInArrow(candidates, "lang string, what string, n long").groupBy("lang", "what").agg(F.sum("n").alias("n")).collect():
        by[r.lang][r.what] = r.n
    wanted = {lang: frozenset(k[1:] for k in got if k[0] == "w") for lang, got in by.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, lang in _pairs(batches):
            counts[lang].update(filter(wanted.get(lang, frozenset()).__contains__, text.lower().split()))
        yield record_batch([(lang, w, n) for lang, c in counts.items() for w, n in c.items()], "lang string, word string, n long")

    if any(wanted.values()):
        for r in named.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
            by[r.lang]["w" + r.word] = r.n
    out: dict = {}
    for lang, got in sorted(by.items()):
        chars = np.array([got.get(f"c{i}", 0) for i in range(len(CLASSES))], dtype=float)
        total = got.get("t", 0)
        common = sorted(k[1:] for k, n in got.items() if k[0] == "w" and n >= share * total)
        hist = np.array([float(got[f"w{w}"]) for w in common] + [0.0])
        hist[-1] = total - hist.sum()
        if chars.sum() and total:
            out[lang] = (chars / chars.sum(), common, hist / total)
    return out


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the contract."""
    words = WORD.findall(text)
    n = len(words)
    repeats = 0
    if n > 3:
        if len(set(zip(words, words[1:], words[2:], strict=False))) < n - 2:
            windows = list(zip(words, words[1:], words[2:], strict=False))
            seen = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeats += i + 3 - max(i, end)
                    end = i + 3
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        full = [x for x in lines if x and (not x.isspace() or WORD.search(x))]
        dup = len(full) - len(set(full))
    symbols = sum(map(text.count, SYMBOLS))
    return n, sum(map(len, words)), symbols, dup, repeats


def score(docs: DataFrame, refs: dict, limits: Limits) -> DataFrame:
    """One row per document: base counts, base_failed, the nearest reference and its two distances, kept."""
    langs = sorted(refs)
    vocabulary = sorted({w for lang in langs for w in refs[lang][1]})
    place = {w: i for i, w in enumerate(vocabulary)}
    chars = np.array([refs[lang][0] for lang in langs])
    columns = [np.array([place[w] for w in refs[lang][1]], dtype=int) for lang in langs]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, nearest_lang string, char_distance double, word_distance double"

    def judge(text: str) -> tuple[str | None, float | None, float | None]:
        words = text.lower().split()
        if not langs or not words:
            return None, None, None
        d_char = js_distance(char_histogram(text).astype(float), chars)
        counts = np.zeros(len(vocabulary))
        got = Counter(map(place.get, words))
        got.pop(None, None)
        counts[list(got.keys())] = list(got.values())
        d_word = np.empty(len(langs))
        for k, lang in enumerate(langs):
            own = counts[columns[k]]
            d_word[k] = js_distance(np.append(own, len(words) - own.sum()), refs[lang][2])
        best = int(np.argmin(d_char + d_word))
        return langs[best], float(d_char[best]), float(d_word[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_counts(text)
                failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                lang, dc, dw = judge(text)
                diverges = base[0] >= limits.min_words and lang is not None and (dc > limits.max_char_distance or dw > limits.max_word_distance + limits.word_noise / base[0] ** 0.5)
                rows.append((doc_id, *base, failed, not failed and not diverges, lang, dc, dw))
            if rows:
                yield record_batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Learn the references from all of docs, then judge all of docs."""
    limits = limits or Limits()
    small_batches(docs.sparkSession)
    return score(docs, references(docs, limits), limits)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents"))
