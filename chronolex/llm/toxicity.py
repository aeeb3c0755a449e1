"""Toxicity by Levenshtein automata intersected with a lexicon trie, with context-window scores.

The lexicon is learned: terms and word stems that mark documents labelled toxic and stand in many different contexts
there, so that a passage which toxic documents share teaches nothing. A word is matched by walking
the product of the lexicon trie and a Levenshtein automaton (no edit below five letters, one from five, two
from nine; two neighbouring letters in each other's place are one edit), made deterministic as it is walked, so a word
costs one table step a letter and most end early. A word that clean documents have is no misspelling. An exact
hit or a stem has the reliability measured for its kind. A misspelling has that of its term: the misspellings to be
expected of a term that so many toxic documents have, against the ordinary words still to be met around it, which the
near words that the sample has once, and those one edit further off, give a measure of. Either is scaled by its context window: quotation marks or words of reporting
around it lower it, address to a person raises it. A document's score is the noisy-or of its hits, or the share of
toxic documents among those without a hit.

Fit: a bounded sample of labelled rows (Sample), near copies collapsed by minhashes (the row of least id stays) so
that one copied text can't make its own words look toxic. Scoring reads every whole text; nothing but the text is an input.

Defined results: null, empty or letterless text gets the score of documents without a hit. Labels that are
null are ignored; with no toxic label at all, every score is 0. Repeated documents are scored one by one;
repeated labels count once. Very long texts are matched word by word in memory bounded by their own length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.llm.common import fold_of, id_text, record_batch
from chronolex.storage import load, materialise

#: Marks of quotation, words of reporting and of address (in the languages at hand).
QUOTES = frozenset("\"“”„«»‘’")
REPORTING = frozenset("said says wrote called quoted quote reported according sagte schrieb zitierte laut dit écrit cité selon dijo escribió citó según".split())
ADDRESS = frozenset("you your you're u ur du dich dein ihr tu te vous votre toi tú usted vosotros eres".split())
PUNCTUATION = " .,;:!?()[]{}<>\"“”„«»‘’'*_-…\n\t"
#: Odd multipliers of the minhashes: bands of two, then those that similarity is estimated by.
MINHASH = (np.arange(1, 21, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BANDS = 2
EXACT, STEM, ONE_EDIT, TWO_EDITS = range(4)
#: Reliability believed of each kind before any evidence, worth two documents.
PRIOR = (0.9, 0.8, 0.6, 0.4)
#: Of the words one edit further off, the share that is to be expected nearer.
FURTHER = 1 / 8
#: Misspellings expected for each toxic document that has a term, with one and with two edits.
MISSPELLED = {ONE_EDIT: 0.1, TWO_EDITS: 0.03}


@dataclass(frozen=True)
class Sample:
    """Bounds of the fit: labelled rows of either class; least evidence for a term (in nats)."""

    toxic: int = 5000
    clean: int = 15000
    evidence: float = 18.0
    purity: float = 0.95


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(PUNCTUATION) for x in text.lower().split()) if w]


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Trie of terms and stems with the lazily determinised product of its Levenshtein automata.

    A state is a set of (trie node, letter still owed, edits so far); a transition consumes one letter of the word
    read. A letter is owed where the word has two letters in each other's place and the first of them has been read.
    """

    MOST_STEPS = 300_000

    def __init__(self, terms: dict[str, int], stems: list[str], known: frozenset[str] = frozenset()):
        """terms: with the edits allowed to each; known: words that are no misspellings."""
        self.terms, self.known = terms, known
        self.children: list[dict[str, int]] = [{}]
        self.most: list[int] = [0]  # edits that some term below the node allows
        self.ends: list[int] = [-1]  # edits allowed to a term that ends here
        self.names: dict[int, str] = {}
        for term, k in terms.items():
            node = 0
            for c in term:
                self.most[node] = max(self.most[node], k)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.ends.append(-1)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], k)
            self.ends[node] = k
            self.names[node] = term
        self.stems = frozenset(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[tuple[tuple[int, str], int], ...]] = []
        self.ids: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.accepts: list[tuple[int, str]] = []
        self.cache: dict[str, tuple[int, str]] = {}
        self.start = self._state({(0, ""): 0})

    def _state(self, nodes: dict[tuple[int, str], int]) -> int:
        """Adds skipped letters of the trie, then numbers the state; -1 if nothing is left."""
        todo = list(nodes.items())
        while todo:
            (node, owed), e = todo.pop()
            if not owed and e < self.most[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.most[child] and nodes.get((child, ""), 99) > e + 1:
                        nodes[child, ""] = e + 1
                        todo.append(((child, ""), e + 1))
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.accepts.append(min(((e, self.names[n]) for (n, owed), e in key if not owed and 0 <= e <= self.ends[n]), default=(-1, "")))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[tuple[int, str], int] = {}

        def reach(node: int, owed: str, e: int) -> None:
            if e <= self.most[node] and nodes.get((node, owed), 99) > e:
                nodes[node, owed] = e

        for (node, owed), e in self.states[state]:
            if owed:
                if c == owed:
                    reach(node, "", e)
                continue
            if e < self.most[node]:
                reach(node, "", e + 1)  # the word has a letter too many
            for letter, child in self.children[node].items():
                reach(child, "", e + (letter != c))
                if letter != c and c in self.children[child]:  # this letter and the next one have changed places
                    reach(self.children[child][c], letter, e + 1)
        return self._state(nodes)

    def match(self, word: str) -> tuple[int, str]:
        """(EXACT, STEM, ONE_EDIT or TWO_EDITS, the term or stem), or (-1, "")."""
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) > self.MOST_STEPS or len(self.steps) > self.MOST_STEPS:
                self._reset()
            found = self.cache[word] = self._match(word)
        return found

    def _match(self, word: str) -> tuple[int, str]:
        state, steps = self.start, self.steps
        for c in word:
            following = steps.get((state, c))
            if following is None:
                following = steps[state, c] = self._step(state, c)
            state = following
            if state < 0:
                break
        edits, term = self.accepts[state] if state >= 0 else (-1, "")
        if edits == 0:
            return EXACT, term
        for n in self.stem_sizes:
            if word[:n] in self.stems and n <= len(word):
                return STEM, word[:n]
        return (-1, "") if edits < 0 or word in self.known else (STEM + edits, term)


def context_factor(raw: list[str], i: int, width: int = 6) -> float:
    """Factor of a hit at raw word i: below 1 in quotation or report, above 1 where a person is addressed."""
    around = raw[max(0, i - width) : i + width + 1]
    before, after = raw[max(0, i - width) : i + 1], raw[i : i + width + 1]
    quoted = any(w[0] in QUOTES for w in before) and any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
    bare = {w.strip(PUNCTUATION) for w in around}
    factor = 1.0
    if quoted:
        factor *= 0.4
    if bare & REPORTING:
        factor *= 0.7
    if bare & ADDRESS:
        factor *= 1.15
    return factor


def hits(text: str, lexicon: Lexicon) -> list[tuple[int, str, float]]:
    """(kind, term, context factor) of every hit in the whole text."""
    raw = text.lower().split()
    found = {w: m for w in set(raw) if (m := lexicon.match(w.strip(PUNCTUATION)))[0] >= 0}
    return [(*found[w], context_factor(raw, i)) for i, w in enumerate(raw) if w in found] if found else []


@dataclass
class Model:
    lexicon: Lexicon
    reliability: tuple[float, ...]
    without: float
    edits: dict[tuple[int, str], float] = field(default_factory=dict)  # by kind and term, where measured

    def score(self, text: str | None) -> float:
        found = hits(text, self.lexicon) if text else []
        if not found:
            return self.without
        missed = 1.0
        for kind, term, factor in found:
            missed *= 1 - min(0.99, self.edits.get((kind, term), self.reliability[kind]) * factor)
        return max(self.without, 1 - missed)


def training_rows(docs: DataFrame, labels: DataFrame, sample: Sample) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled rows that may be learned from, copies collapsed."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & (fold_of("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1_000_000))
    share = {k: math.ceil(1_000_000 * most / max(1, counts.get(k, 0))) for k, most in ((1, sample.toxic), (0, sample.clean))}
    chosen = known.where(drawn < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))

    schema = "doc_id long, text string, toxic int, k0 long, k1 long, sketch array<long>"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = text.lower().split()
                h = np.array([xxhash.xxh3_64_intdigest(" ".join(x).encode("utf-8", "surrogatepass")) for x in zip(w, w[1:], w[2:], strict=False)] or [xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))], dtype=np.uint64)
                low = [int(((h * m) >> np.uint64(1)).min()) for m in MINHASH]
                bands = [xxhash.xxh3_64_intdigest(np.array(low[2 * i : 2 * i + 2], dtype="<u8").tobytes()) >> 1 for i in range(BANDS)]
                rows.append((doc_id, text, toxic, *bands, low[2 * BANDS :]))
            yield record_batch(rows, schema)

    # the chosen ids are bounded by the sample's parameters, so this broadcast is
    rows = id_text(docs).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").mapInArrow(keyed, schema)
    for k in range(BANDS):  # a row goes if it agrees with the first one of its band in half of the other minhashes
        first = Window.partitionBy("toxic", f"k{k}").orderBy("doc_id", "text")
        rows = rows.withColumn("lead", F.first("sketch").over(first)).withColumn("rank", F.row_number().over(first))
        agree = F.aggregate(F.zip_with("sketch", "lead", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
        rows = rows.where((F.col("rank") == 1) | (agree < (len(MINHASH) - 2 * BANDS) // 2)).drop("lead", "rank")
    return materialise(rows.select("text", "toxic"), "toxicity")


def learn(rows: DataFrame, sample: Sample) -> Model:
    """Lexicon and reliabilities from (text, toxic) rows."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = {w for w in words_of(text) if len(w) > 2 and not re.search(r"\d", w)}
                grams = {"=" + w for w in words}
                grams.update(w[:n] for w in words for n in (4, 5, 6) if len(w) > n)
                df[toxic].update(grams)
        grams = list(df[0].keys() | df[1].keys())
        for i in range(0, len(grams), 50_000):
            part = grams[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"gram": part, "toxic": [df[1][g] for g in part], "clean": [df[0][g] for g in part]})

    n = {r.toxic: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return Model(Lexicon({}, []), PRIOR, 0.0)
    base = n[1] / (n[1] + n.get(0, 0))
    least = max(3, math.ceil(sample.evidence / max(0.3, math.log(1 / base)))) if base < 1 else 3
    stats = rows.mapInArrow(frequencies, "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    pure = stats.where((F.col("toxic") >= least) & (F.col("toxic") >= sample.purity * (F.col("toxic") + F.col("clean"))))
    marks = {r.gram: r.toxic for r in pure.collect()}  # bounded by the sample: every one is in several of its rows

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for text in b.column(0).to_pylist():
                words = ["", *words_of(text), ""]
                beside = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 for w in words]
                for i, w in enumerate(words[1:-1], 1):
                    seen.update((g, side, beside[i + side]) for g in ("=" + w, *(w[:n] for n in (4, 5, 6) if len(w) > n)) if g in marks for side in (-1, 1))
            yield record_batch(sorted(seen), "gram string, side int, context long")

    contexts = rows.where("toxic = 1").select("text").mapInArrow(surroundings, "gram string, side int, context long")
    contexts = contexts.groupBy("gram", "side").agg(F.count_distinct("context").alias("n")).groupBy("gram").agg(F.min("n").alias("n"))
    spread = sorted(r.gram for r in contexts.where(F.col("n") >= least).collect())
    terms = {g[1:]: allowed_edits(g[1:]) for g in spread if g[0] == "="}
    stems: list[str] = []
    for s in sorted((g for g in spread if g[0] != "="), key=lambda g: (len(g), g)):
        if not any(s.startswith(t) for t in stems) and not any(t.startswith(s) for t in terms):  # terms find their own endings
            stems.append(s)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon({t: k + 1 for t, k in terms.items()}, stems)
        count: Counter = Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {(*lexicon.match(w), w) for w in set(words_of(text))}
                count.update((k, t, w, toxic) for k, t, w in found if k >= ONE_EDIT)
                count[min((k for k, _, _ in found if 0 <= k < ONE_EDIT), default=-1), "", "", toxic] += 1
        yield record_batch([(*k, n) for k, n in sorted(count.items())], "kind int, term string, word string, toxic int, n long")

    of_toxic = lambda value: F.sum(F.when(F.col("toxic") == value, F.col("n")).otherwise(0))
    got = rows.mapInArrow(evidence, "kind int, term string, word string, toxic int, n long").groupBy("kind", "term", "word").agg(of_toxic(1).alias("toxic"), of_toxic(0).alias("clean")).collect()
    whole = {r.kind: (r.toxic, r.clean) for r in got if not r.term}
    rate = lambda k, prior: (whole.get(k, (0, 0))[0] + 2 * prior) / (sum(whole.get(k, (0, 0))) + 2)
    near = [r for r in got if r.term]
    known = frozenset(r.word for r in near if r.kind <= STEM + terms[r.term] and r.clean and r.clean >= r.toxic)
    once, all_ = Counter((r.kind, r.term) for r in near if r.toxic + r.clean == 1), Counter((r.kind, r.term) for r in near)
    edits: dict[tuple[int, str], float] = {}
    for term, most in terms.items():
        for kind in (ONE_EDIT, TWO_EDITS)[:most]:
            expected = MISSPELLED[kind] * marks["=" + term]
            unseen = once[kind, term] + FURTHER * all_[kind + 1, term]
            edits[kind, term] = (expected + PRIOR[kind]) / (expected + unseen + 1)
    reliability = (rate(EXACT, PRIOR[EXACT]), rate(STEM, PRIOR[STEM]), *PRIOR[ONE_EDIT:])
    return Model(Lexicon(terms, stems, known), reliability, min(0.49, rate(-1, base / 2)), edits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    terms, stems, known = model.lexicon.terms, sorted(model.lexicon.stems), model.lexicon.known
    reliability, without, edits = model.reliability, model.without, model.edits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(Lexicon(terms, stems, known), reliability, without, edits)
        for b in batches:
            scores = [own.score(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: Sample | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a model learned from the labels."""
    sample = sample or Sample()
    scored = score(docs, learn(training_rows(docs, labels, sample), sample))
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
