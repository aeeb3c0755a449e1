"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both encodings agree.

A text longer than a chunk is never encoded in one piece. Its chunks overlap; from the ids of two neighbours follow
the places where their tokens end, and within the overlap a place is sought that (1) is a token border in both and
(2) is proven stable: the pre-tokeniser cuts there whatever stands further left or right, and no added token lies
across. Tokens of the left chunk count up to it, those of the right one from it on. Where an overlap has no such
place it is widened, twice as far each time; once it reaches the last splice, the next chunk starts there and is
twice as long, so a text without any border still ends in time that grows with its length.

Which places are stable follows from the pre-tokenisation (a fixed value in token_ids): its pieces are runs of
letters, of numbers or of other characters, each with a blank before it at most, runs of blanks, and contractions,
which begin with an apostrophe. So a piece always ends between a character that isn't blank and a blank, and between
two kinds of characters, unless the first is an apostrophe. Characters whose kind differs between versions of
Unicode, and blanks of other scripts, are left out of the proof.

Defined results: null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are counted like any
other. An empty table gives no rows. Other columns are ignored. One row is one task's work; memory beyond the text
itself is that of two chunks, unless a text has no border.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chronolex.llm.common import id_text, record_batch
from chronolex.llm.token_ids import encoder
from chronolex.storage import load

BLANKS = " \t\n\r\x0b\x0c"
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def kind(c: str) -> str | None:
    """blank, L(etter), N(umber) or O(ther); None if that depends on the version of Unicode."""
    if c in BLANKS:
        return "blank"
    now = unicodedata.category(c)
    if c.isspace() or now == "Cn" or now != unicodedata.ucd_3_2_0.category(c):
        return None
    return now[0] if now[0] in "LN" else "O"


def stable(text: str, at: int, added: list[str]) -> bool:
    """Whether a token ends before text[at] in whatever text holds these two characters and what is around them."""
    before, after = kind(text[at - 1]), kind(text[at])
    if before in (None, "blank") or after is None or before == after or text[at - 1] == "'":
        return False
    return all(text.find(t, max(at - len(t) + 1, 0), at + len(t) - 1) < 0 for t in added)


class TokenCounter:
    """Counts the tokens of whole texts; chunk and overlap are in characters."""

    def __init__(self, encode: Callable[[str], bytes], sizes: np.ndarray, added: list[str], chunk: int, overlap: int):
        if not 0 < overlap < chunk:
            raise ValueError("an overlap is shorter than a chunk")
        self.encode, self.sizes, self.added, self.chunk, self.overlap = encode, sizes, added, chunk, overlap

    def ends(self, text: str) -> np.ndarray:
        """Where each token of text ends, in bytes."""
        return np.cumsum(self.sizes[np.frombuffer(self.encode(text), dtype="<u4")])

    def places(self, text: str, begin: int, end: int) -> Iterator[int]:
        """The stable places between begin and end, from the middle outwards."""
        middle = (begin + 1 + end) // 2
        for d in range(end - begin):
            yield from (at for at in {middle - d, middle + d} if begin < at < end and stable(text, at, self.added))

    def splice(self, text: str, begin: int, end: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int, int] | None:
        """The first stable place that is a border in both encodings, with the tokens of left and right before it."""
        for at in self.places(text, begin, end):
            x, y = left[-1] - len(text[at:end].encode()), len(text[begin:at].encode())
            i, j = int(np.searchsorted(left, x)), int(np.searchsorted(right, y))
            if left[i] == x and right[j] == y:
                return at, i + 1, j + 1
        return None

    def __call__(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.encode(text)) // 4
        # tokens of left (the encoding of text up to end) before `done` are counted; they end at `at`
        total, done, at, end, size = 0, 0, 0, self.chunk, self.chunk
        left = self.ends(text[:end])
        while end < len(text):
            wide, found = self.overlap, None
            while found is None:
                begin, stop = max(end - wide, at), min(end + size, len(text))
                wide *= 2
                if begin > at and next(self.places(text, begin, end), None) is None:
                    continue
                right = self.ends(text[begin:stop])
                if begin == at:  # nothing left of it is open: right takes the place of left
                    break
                found = self.splice(text, begin, end, left, right)
            if found is None:
                done, size = 0, 2 * size
            else:
                at, i, j = found
                total, done, size = total + i - done, j, self.chunk
            left, end = right, stop
        return total + len(left) - done


def counter(path: str, chunk: int, overlap: int) -> TokenCounter:
    """One counter a process, file and size, kept between tasks of a reused Python worker."""
    kept = sys.modules.setdefault("_chronolex_counters", types.ModuleType("_chronolex_counters")).__dict__
    if (path, chunk, overlap) not in kept:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        encode = encoder(path)
        sizes = np.zeros(encode.top + 1, dtype=np.int64)
        for token, i in spec["model"]["vocab"].items():
            sizes[i] = len(token)  # a letter of a byte-level vocabulary is a byte
        for token, i in added.items():
            sizes[i] = len(token.encode())
        kept[path, chunk, overlap] = TokenCounter(encode, sizes, list(added), chunk, overlap)
    return kept[path, chunk, overlap]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, chunk: int = 1 << 15, overlap: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, for the tokenizer's JSON file at path."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, chunk, overlap)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                n = count(text)
                rows.append((doc_id, len(text.encode()), n, n > limit))
            yield record_batch(rows, COUNTS)

    return id_text(docs).mapInArrow(run, COUNTS)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"))
