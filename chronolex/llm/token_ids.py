"""Token ids of a byte-level BPE vocabulary, for use inside tasks.

The vocabulary is the tokenizer's JSON file (a parameter, as public_tokenizers.path gives it). Ids equal those
of the tokenizers library for that file as it comes: strings of added tokens in a text become their ids (with
special=False they are ordinary text, as with the library's encode_special_tokens). Text is cut at single
blanks between non-blank characters, where no token of this pre-tokenisation can reach across; the pieces' ids
come from a bounded cache, and new pieces from tiktoken with the same vocabulary. Where most words are rare, stretches
give the same ids without the cache, in half the time.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import tiktoken

#: Fixed value: the pre-tokenisation of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
MOST_CACHED = 150_000
#: Characters of a stretch, if the text has a single blank behind so many.
STRETCH = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """Ids (as bytes, unsigned 32-bit little-endian) of ' ' + piece, by piece."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise ValueError("blanks beside blanks")
        if len(self) > MOST_CACHED:  # what is asked for again comes back from the older half
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece) or np.array(self.encode(" " + piece), dtype="<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to ids, as bytes of unsigned 32-bit little-endian numbers."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take blanks or word borders into account aren't supported")
        self.top = max([*spec["model"]["vocab"].values(), *added.values()])
        self._added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()} if special else {}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self._encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._pieces = _Pieces(self._encode)

    def __call__(self, text: str) -> bytes:
        if self._added and any(t in text for t in self._added):
            return b"".join(self._added[x] if i % 2 else self._plain(x) for i, x in enumerate(self._cut.split(text)))
        return self._plain(text)

    def stretches(self, text: str, most: int = STRETCH) -> Iterator[list[int]]:
        """The ids of a whole text in order, so that a long text isn't held as one list of numbers."""
        parts = self._cut.split(text) if self._added and any(t in text for t in self._added) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield np.frombuffer(self._added[part], dtype="<u4").tolist()
                continue
            at = 0
            while at < len(part):
                blank = SINGLE_BLANK.search(part, at + most)
                end = blank.start() if blank else len(part)
                yield self._encode(part[at:end])
                at = end

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        try:
            rest = b"".join(map(self._pieces.__getitem__, parts[1:]))
            if parts[0] and not parts[0][-1].isspace() or len(parts) == 1:
                return np.array(self._encode(parts[0]), dtype="<u4").tobytes() + rest
        except ValueError:
            pass
        first, *parts = SINGLE_BLANK.split(text)
        out = [np.array(self._encode(first), dtype="<u4").tobytes()]
        for p in parts:
            out.append(self._pieces[p] if not p[-1].isspace() else np.array(self._encode(" " + p), dtype="<u4").tobytes())
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """One encoder a process and file, kept between tasks of a reused Python worker."""
    kept = sys.modules.setdefault("_chronolex_encoders", types.ModuleType("_chronolex_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]
