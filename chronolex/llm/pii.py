"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers. The field labels tokens (runs of
non-blank characters) by word-shape features of the token and its neighbours; it is trained here on a small table
made from the forms below, by gradient ascent on the exact likelihood, and decoded by Viterbi over padded numpy
batches. It adds what the patterns miss: disguised addresses, numbers of other layouts, card numbers with a wrong
digit, and a fifth kind, secrets (access tokens, keys, passwords) by the words before them. By definition a span
begins only at (or right before) a token with a digit, an @ or a mark of disguise and stays within REACH tokens of
one; so only those tokens are decoded, in whole runs, however long, with the features of their true neighbours. Spans
of the field that touch one of the patterns', or have a number of digits that their kind can't, are dropped; the patterns' spans always stay.

Defined results: null text counts as empty; empty text has no spans. Repeated rows are scanned one by one. Every
pattern is scanned in time linear in the text, so very long texts and runs of one character are no danger.
Other columns are ignored (redact keeps them).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm.common import id_text, record_batch
from chronolex.storage import load, small_batches

KINDS = ("email", "ip", "card", "phone", "secret")
#: The kinds that patterns find.
BASE_KINDS = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, as it takes runs whole; the look-behind keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out = [(s, 0, e) for s, e in _emails(text)]
    if any(c in text for c in "0123456789"):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub(r"[ -]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- the field -------------------------------------------------------------------------------------------------

#: Digits that a span of the kind can have; others are no such span.
DIGITS = {"ip": range(4, 18), "card": range(12, 20), "phone": range(7, 16)}
#: Labels: outside, then begin and inside of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(LABELS)
TOKEN = re.compile(r"\S+")
HEX = re.compile(r"[0-9A-Fa-f]{16,}")
DISGUISE = re.compile(r"[\[({<](?:at|AT|dot|DOT)[\])}>]")
TRIGGER = re.compile(r"[0-9@]|[\[({<](?:at|AT|dot|DOT)[\])}>]")
REACH = 3
CUES = frozenset("call phone tel mobile fax card visa mastercard number account ip address server host mail email e-mail contact write version page year token password section room secret key api_key apikey passwd pwd bearer commit revision checksum".split())
#: Marks that stand around a token without being part of it.
EDGES = ".,;:!?\"'#*$%&|<>"
#: Forms of the training table; # is a digit, @w a made-up word, @h hexadecimal digits, @k letters and
#: digits; what is before ~ only tells of the span.
FORMS = {
    "email": ("@w@@w.com", "@w.@w@@w.org", "@w [at] @w.com", "@w(at)@w.de", "@w [at] @w [dot] com", "@w @ @w.com", "@w_##@@w.example.com", "@w##@mail#.@w.net"),
    "ip": ("##.###.#.##", "###.##.###.#", "###[.]##[.]#[.]##", "##.##.##.##:80##"),
    "card": ("#### #### #### ####", "################", "####-####-####-####", "####.####.####.####", "#### ###### #####"),
    "phone": ("+# (###) ###-####", "(###) ###-####", "###-###-####", "###.###.####", "+## ## ########", "0## #######", "+##-###-#######"),
    "secret": ('token = "~@h"', 'token = "~@h"', "~token=@h", "password = '~@k'", "password: ~@k", 'api_key = "~@k"', "secret: ~@h", "secret key ~@k", "bearer ~@h", "Token: ~@h", "~password=@k", "key = ~@k"),
    "O": ("commit @h", "checksum @h", "@h", "@h", "@w @h", "@w: @h", "digest = @h", "@w=@h", "# # # # # # # # # # # # # # # #", "# # # #", "## ## ## ## ## ## ## ## ##", "## # ### # ## ### #", "### ### ### ### ### ### ### ###", "#.## #.## #.## #.##", "#, ##, ###, #, ##", "| ## | ### | ## | # |", "#.#", "####", "##.", "##:##", "####-##-##", "$##.##", "##%", "(##)", "#,###", "@w#", "v#.#.#", "#/#/####", "##########", "[#]", "#.#.#", "@w @w", "BY-NC #.#", "Version #.#.", "№##", "#####################", "token @w", "password @w", "the key of @w"),
}
#: What stands around them.
AROUND = ("{}", "call {} now", "my number is {} thanks", "write to {} or not", "the server {} was down", "paid with {} yesterday", "@w @w {} @w", "@w, {}, @w @w", "contact: {}.", "@w {}. @w @w", "see page {} of @w", "in {} the @w")


def shape(token: str) -> str:
    """Letters, digits and marks as A, a, 9 and themselves; runs longer than four are cut to four."""
    out = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", re.sub(r"[A-Z]", "A", token)))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", out)


def trimmed(token: str) -> str:
    return token.strip(EDGES)


def features(tokens: list[str]) -> list[list[str]]:
    cores = [trimmed(t) for t in tokens]
    shapes = [shape(c) for c in cores]
    out = []
    for i, core in enumerate(cores):
        digits = sum(c.isdigit() for c in core)
        own = [f"s={shapes[i][:16]}", f"d={min(digits, 20)}", f"l={min(len(core), 24)}", "bias"]
        own += ["@"] if "@" in core else []
        own += ["mixed"] if digits and len(core) > 11 and any(c.isalpha() for c in core) else []
        own += ["hex"] if digits and HEX.fullmatch(core) else []
        own += ["disguise"] if DISGUISE.search(core) else []
        own += ["dots=" + str(min(4, core.count(".")))] if digits else []
        own += ["luhn"] if 14 <= digits <= 19 and luhn(re.sub(r"\D", "", core)) else []
        for d in (-2, -1, 1, 2):
            j = i + d
            near = shapes[j] if 0 <= j < len(cores) else "|"
            own.append(f"{d}s={near if any(c in '9@[(' for c in near) else 'w' if near != '|' else near}")
            if 0 <= j < len(cores) and (cue := cores[j].lower()) in CUES:
                own.append(f"{d}c={cue}")
        head = re.match(r"([A-Za-z_]+)\W", core)
        own += [f"h={head[1].lower()}"] if head and head[1].lower() in CUES else []
        out.append(own)
    return out


def allowed_starts(tokens: list[str]) -> np.ndarray:
    """Tokens that may begin a span: those with a mark, and those before a lone @ or disguise of one."""
    after = [t == "@" or bool(DISGUISE.fullmatch(t)) for t in tokens[1:]] + [False]
    return np.array([bool(TRIGGER.search(t)) or a for t, a in zip(tokens, after, strict=True)])


def training_table(rows: int = 2000, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Token and label sequences made from the forms; some in capitals, some with marks at their words."""
    rng = np.random.default_rng(seed)
    some = lambda letters, least, most: "".join(rng.choice(list(letters)) for _ in range(rng.integers(least, most)))
    fillers = {"@h": lambda: some("0123456789abcdef", 16, 42), "@k": lambda: some("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", 10, 30) + some("0123456789", 1, 3), "@w": lambda: some("aeioulnrst", 2, 9), "#": lambda: some("0123456789", 1, 2)}
    fill = lambda form: re.sub(r"@[hkw]|#", lambda m: fillers[m[0]](), form)
    out = []
    for _ in range(rows):
        kind = rng.choice(["O", "O", *KINDS])
        before, _, after = rng.choice(AROUND).partition("{}")
        text, spans = fill(before), []
        for n in range(2 if kind in ("card", "ip", "phone") and rng.random() < 0.15 else 1):  # some follow each other
            cue, _, value = fill(rng.choice(FORMS[kind])).rpartition("~")
            if kind == "card" and rng.random() < 0.7 and not luhn(re.sub(r"\D", "", value)):  # the rest have a wrong digit
                at = max(i for i, c in enumerate(value) if c.isdigit())
                value = next(f for f in (value[:at] + str(d) + value[at + 1 :] for d in range(10)) if luhn(re.sub(r"\D", "", f)))
            text += " " * (n > 0) + cue
            spans.append((len(text), len(text) + len(value)))
            text += value
        tokens, labels, last = [], [], None
        marks, capitals = rng.random() < 0.1, rng.random() < 0.1
        for m in TOKEN.finditer(text + fill(after)):
            token = m[0].upper() if capitals else m[0]
            tokens.append(token + str(rng.choice(["###", "$$$", "%%%", "&&&", "***", "!!"])) if marks else token)
            span = next((x for x in spans if m.start() < x[1] and m.end() > x[0]), None) if kind != "O" else None
            labels.append(0 if span is None else 1 + 2 * KINDS.index(kind) + (span == last))
            last = span
        out.append((tokens, labels))
    return out


def _transitions() -> np.ndarray:
    """Minus infinity where a label can't follow: inside only after begin or inside of its kind."""
    out = np.zeros((N, N))
    for a in range(N):
        for b in range(2, N, 2):
            if a not in (b - 1, b):
                out[a, b] = -1e9
    return out


class Field:
    def __init__(self, index: dict[str, int], emission: np.ndarray, transition: np.ndarray):
        self.index, self.emission, self.transition = index, emission, transition

    def scores(self, sequences: list[list[str]], ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores (sequence, place, label) of the ranges' tokens, padded, and lengths."""
        lengths = np.array([hi - lo for lo, hi in ranges])
        out = np.zeros((len(sequences), lengths.max(), N))
        for i, (tokens, (lo, hi)) in enumerate(zip(sequences, ranges, strict=True)):
            starts = allowed_starts(tokens)[lo:hi]
            for t, own in enumerate(features(tokens)[lo:hi]):
                ids = [self.index[f] for f in own if f in self.index]
                out[i, t] = self.emission[ids].sum(axis=0)
                if not starts[t]:
                    out[i, t, 1::2] = -1e9
            out[i, 0, 2::2] = -1e9
        return out, lengths

    def decode(self, sequences: list[list[str]], ranges: list[tuple[int, int]] | None = None) -> list[np.ndarray]:
        """Best label sequences of the ranges (or all) by Viterbi, all sequences at once."""
        e, lengths = self.scores(sequences, ranges or [(0, len(s)) for s in sequences])
        best, back = e[:, 0], np.zeros(e.shape, dtype=np.int8)
        history = [best]
        for t in range(1, e.shape[1]):
            through = best[:, :, None] + self.transition[None]
            back[:, t] = through.argmax(axis=1)
            best = through.max(axis=1) + e[:, t]
            history.append(best)
        out = []
        for i, n in enumerate(lengths):
            path = np.zeros(n, dtype=int)
            path[-1] = history[n - 1][i].argmax()
            for t in range(n - 1, 0, -1):
                path[t - 1] = back[i, t, path[t]]
            out.append(path)
        return out


def train(table: list[tuple[list[str], list[int]]], steps: int = 100, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Gradient ascent (Adam) on the log-likelihood, by forward-backward over the padded table."""
    extracted = [features(tokens) for tokens, _ in table]
    counts: dict[str, int] = {}
    for sequence in extracted:
        for own in sequence:
            for f in own:
                counts[f] = counts.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= 3))}
    length = np.array([len(x) for x, _ in table])
    b, most = len(table), int(length.max())
    rows, cols, y = [], [], np.zeros((b, most), dtype=int)
    for i, (sequence, (_, labels)) in enumerate(zip(extracted, table, strict=True)):
        y[i, : len(labels)] = labels
        for t, own in enumerate(sequence):
            ids = [index[f] for f in own if f in index]
            rows += [i * most + t] * len(ids)
            cols += ids
    rows, cols = np.array(rows), np.array(cols)
    mask = (np.arange(most)[None] < length[:, None]).astype(float)
    params = [np.zeros((len(index), N)), np.zeros((N, N))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    barred = _transitions()
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    gold = np.zeros((b, most, N))
    np.put_along_axis(gold, y[:, :, None], 1.0, axis=2)
    gold *= mask[:, :, None]
    gold_pairs = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
    for step in range(1, steps + 1):
        e = np.zeros((b * most, N))
        np.add.at(e, rows, params[0][cols])
        e = e.reshape(b, most, N)
        trans = params[1] + barred
        alpha, beta = np.zeros((b, most, N)), np.zeros((b, most, N))
        alpha[:, 0] = e[:, 0] + np.where(np.arange(N) % 2 == 0, np.where(np.arange(N) == 0, 0.0, -1e9), 0.0)
        for t in range(1, most):
            forward = lse(alpha[:, t - 1, :, None] + trans[None], 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None] > 0, forward, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            backward = lse(trans[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None] > 0, backward, 0.0)
        z = lse(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pairs = np.zeros((N, N))
        for t in range(1, most):
            p = np.exp(alpha[:, t - 1, :, None] + trans[None] + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            pairs += (p * mask[:, t, None, None]).sum(axis=0)
        grad0 = np.zeros_like(params[0])
        np.add.at(grad0, cols, (gold - marginal).reshape(b * most, N)[rows])
        for p, (m, v), g in zip(params, moments, (grad0 / b, (gold_pairs - pairs) / b), strict=True):
            g -= decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Field(index, params[0], params[1] + barred)


@lru_cache(maxsize=1)
def trained() -> Field:
    return train(training_table())


def windows(text: str) -> list[tuple[list[str], tuple[int, int], list[tuple[int, int]]]]:
    """Token windows around every token that can begin a span, with two tokens of context: tokens, range, places."""
    if not TRIGGER.search(text):
        return []
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    starts = [s for s, _ in tokens]
    hot = sorted({max(0, bisect_left(starts, m.start() + 1) - 1) for m in TRIGGER.finditer(text)})
    out: list[list[int]] = []
    for i in hot:
        lo, hi = max(0, i - REACH), min(len(tokens), i + REACH + 1)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    found = []
    for lo, hi in out:
        first = max(0, lo - 2)
        found.append(([text[s:e] for s, e in tokens[first : hi + 2]], (lo - first, hi - first), tokens[lo:hi]))
    return found


#: Words that make a number beside them a card's whatever its check digit.
CARD_CUES = frozenset("card cards visa mastercard amex karte carte tarjeta".split())
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[\x20-]?$")


def admissible(kind: str, text: str, s: int, e: int) -> bool:
    """Whether a span of the field may be of its kind: what rules a pattern's match out rules it out as well.

    An address has four parts up to 255 (a port may follow); a card's number has no letter at it, isn't the rest
    of a bank account's and passes Luhn, unless a word for cards stands within three words before it.
    """
    span = text[s:e]
    digits = re.sub(r"[^0-9]", "", span)
    if len(digits) not in DIGITS.get(kind, range(e)):
        return False
    if kind == "ip":
        parts = [int(x) for x in re.findall(r"[0-9]+", re.sub(r":[0-9]+$", "", span))]
        beside = (s > 1 and text[s - 1] == "." and text[s - 2].isdigit()) or (text[e : e + 1] == "." and text[e + 1 : e + 2].isdigit())
        return len(parts) == 4 and max(parts) <= 255 and not beside
    if kind == "card":
        if any(c.isalpha() for c in span) or text[s - 1 : s].isalnum() or text[e : e + 1].isalnum() or IBAN.search(text[max(0, s - 6) : s]):
            return False
        before = re.findall(r"[^\W\d_]+", text[max(0, s - 60) : s].lower())[-3:]
        return 14 <= len(digits) <= 19 and (luhn(digits) or not CARD_CUES.isdisjoint(before))
    return True


def added_spans(found: list[tuple[str, list[Span]]], field: Field, most_cells: int = 20_000) -> list[list[Span]]:
    """Per text: spans of the field that touch none of the base spans. A batch holds so many padded tokens, or one window."""
    work = [(i, *w) for i, (text, _) in enumerate(found) for w in windows(text)]
    out: list[list[Span]] = [[] for _ in found]
    work.sort(key=lambda x: len(x[3]))
    while work:
        n = 1
        while n < len(work) and (n + 1) * len(work[n][3]) <= most_cells:
            n += 1
        part, work = work[:n], work[n:]
        for (i, tokens, (lo, hi), places), path in zip(part, field.decode([w[1] for w in part], [w[2] for w in part]), strict=True):
            text, base = found[i]
            own = tokens[lo:hi]
            t = 0
            while t < len(path):
                if path[t] % 2 == 1:
                    kind, end = path[t] // 2, t + 1
                    while end < len(path) and path[end] == path[t] + 1:
                        end += 1
                    s = places[t][0] + len(own[t]) - len(own[t].lstrip(EDGES))
                    e = places[end - 1][0] + len(own[end - 1].rstrip(EDGES))
                    at = bisect_left(base, (e,)) - 1  # base spans of a kind don't overlap; those of others may
                    if s < e and admissible(KINDS[kind], text, s, e) and not any(bs < e and s < be for bs, _, be in base[: at + 1]):
                        out[i].append((s, int(kind), e))
                    t = end
                else:
                    t += 1
    return out


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [(t, base_spans(t)) for t in texts]
    return [(b, sorted({*b, *more})) for (_, b), more in zip(base, added_spans(base, field), strict=True)]


def pii_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    field = field or trained()
    """One row per document: counts and digest of the patterns' spans, all spans, and how many the field added and all are."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, (base, spans) in zip(b.column(0).to_pylist(), find([t or "" for t in b.column(1).to_pylist()], field), strict=True):
                counts = [sum(k == i for _, k, _ in base) for i in range(BASE_KINDS)]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)))
            yield record_batch(rows, schema)

    return id_text(docs).mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones merged) replaced by its kind in angle brackets."""
    out, last = [], 0
    for s, k, e in spans:
        if s >= last:
            out += [text[last:s], f"<{KINDS[k]}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with all spans of text redacted and n_chars (if there) counted anew; other columns as they are."""
    field = field or trained()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            spans = [s for _, s in find([t or "" for t in texts], field)]
            new = [t if t is None else redacted(t, s) for t, s in zip(texts, spans, strict=True)]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            n = b.schema.get_field_index("n_chars")
            if n >= 0:
                old = b.column(n).to_pylist()
                b = b.set_column(n, b.schema.field(n), pa.array([o if t == u or u is None else len(u) for o, t, u in zip(old, texts, new, strict=True)], b.schema.field(n).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(load(spark, sf_dir, "documents"))
