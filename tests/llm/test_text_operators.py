"""Operators that map over rows: toxicity, language, personal data, quality rules."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from chronolex.llm import language_id, pii, quality_rules, toxicity
from chronolex.llm.common import WORD

SF = "/root/testdata/sf0.001"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- toxicity


def edits(a, b):
    """Edit distance in which two neighbouring letters in each other's place are one edit."""
    older, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            if i > 1 and j > 1 and a[i - 2] == y and x == b[j - 2]:
                new[j] = min(new[j], older[j - 2] + 1)
        older, row = row, new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "scum", "worthless", "worth", "moron"]
    lexicon = toxicity.Lexicon({t: toxicity.allowed_edits(t) for t in terms}, [])
    random.seed(1)
    words = [*terms]
    for _ in range(3000):
        w = list(random.choice(terms))
        for _ in range(random.randrange(4)):
            i = random.randrange(len(w) + 1)
            w[i : i + random.randrange(2)] = random.choice(["", "x", "o", "t"])
            i = random.randrange(len(w) + 1)
            w[i : i + 2] = w[i : i + 2][:: random.choice([1, -1])]
        words.append("".join(w))
    for w in words:
        within = [edits(w, t) for t in terms if edits(w, t) <= toxicity.allowed_edits(t)]
        got = lexicon.match(w)[0]
        assert (got == -1) == (not within), w
        assert not within or {0: toxicity.EXACT, 1: toxicity.ONE_EDIT, 2: toxicity.TWO_EDITS}[min(within)] == got, w


def test_context_lowers_quotations_and_raises_address():
    model = toxicity.Model(toxicity.Lexicon({"idiot": 1}, ["lowei"]), (0.7, 0.7, 0.6, 0.5), 0.05)
    plain, quoted, direct = (model.score(t) for t in ("what an idiot he is", 'she wrote "what an idiot" of him', "you are an idiot"))
    assert quoted < 0.5 < plain < direct
    assert model.score("that idioot again") >= 0.5 and model.score("ein loweischaft") >= 0.5
    assert model.score("a quiet day") == model.score("") == model.score(None) == 0.05


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = by_id(toxicity.toxicity(docs, labels))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [(truth[i], r.predicted) for i, r in out.items() if r.held_out and i in truth]
    assert sum(p for t, p in held if not t) <= 0.02 * len(held) and sum(p for t, p in held if t) >= 0.5 * sum(t for t, _ in held)


def plain_score(text, model):
    """Score by comparing every word with every term."""
    raw, missed, found = (text or "").lower().split(), 1.0, False
    lexicon = model.lexicon
    for i, w in enumerate(raw):
        word = w.strip(toxicity.PUNCTUATION)
        within = sorted((e, t) for t, k in lexicon.terms.items() if abs(len(t) - len(word)) <= k and (e := edits(word, t)) <= k)
        if within and within[0][0] == 0:
            kind, term = toxicity.EXACT, word
        elif any(word.startswith(s) for s in lexicon.stems):
            kind, term = toxicity.STEM, ""
        elif within and word not in lexicon.known:
            kind, term = toxicity.STEM + within[0][0], within[0][1]
        else:
            continue
        found = True
        missed *= 1 - min(0.99, model.edits.get((kind, term), model.reliability[kind]) * toxicity.context_factor(raw, i))
    return max(model.without, 1 - missed) if found else model.without


def misspelled(word, rng):
    """word with one letter changed, left out, added, or two neighbours swapped."""
    i, c = rng.randrange(len(word)), rng.choice("abcdefghijklmnopqrstuvwxyz01")
    return rng.choice([word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + word[i : i + 2][::-1] + word[i + 2 :]])


def test_misspellings_decide(spark):
    """Held-out toxic texts whose insults are all misspelled by a letter are still found, by the automata alone; clean ones stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity.Sample()
    model = toxicity.learn(toxicity.training_rows(docs, labels, sample), sample)
    held = docs.join(labels, "doc_id").where(toxicity.fold_of("doc_id", 5) == 0).select("text", "toxic").collect()
    clean = [model.score(r.text) >= 0.5 for r in held if not r.toxic]
    assert np.mean(clean) < 0.01 and np.mean([model.score(r.text) >= 0.5 for r in held if r.toxic]) >= 0.8
    rng, changed, deaf = random.Random(1), [], toxicity.Model(toxicity.Lexicon({t: 0 for t in model.lexicon.terms}, sorted(model.lexicon.stems)), model.reliability, model.without)
    for r in held:
        words, long = r.text.split(), False
        for i, w in enumerate(words):
            core = w.strip(toxicity.PUNCTUATION).lower()
            if core in model.lexicon.terms:
                long |= len(core) >= 5
                words[i] = misspelled(core, rng) if len(core) >= 5 else ""
                while words[i] in model.lexicon.terms:
                    words[i] = misspelled(core, rng)
        if r.toxic and long:
            changed.append(" ".join(words))
    assert len(changed) >= 50
    with_edits, without = (np.mean([m.score(t) >= 0.5 for t in changed]) for m in (model, deaf))
    assert with_edits >= 0.9 and without <= 0.25
    for text in changed[:25] + [r.text for r in held[:100] if len(r.text) < 4000]:
        assert abs(model.score(text) - plain_score(text, model)) < 1e-12


def test_shared_passages_teach_nothing(spark):
    """A word that toxic documents have in one passage only is no term; one that stands among different words is."""
    rng = random.Random(6)
    filler = [f"w{i}" for i in range(400)]
    toxic = [" ".join([*rng.choices(filler, k=60), "the", "borrowed", "phrase", "here", *rng.choices(filler, k=20), "insultus", *rng.choices(filler, k=20)]) for _ in range(60)]
    clean = [" ".join(rng.choices(filler, k=100)) for _ in range(240)]
    rows = spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in clean], "text string, toxic int").repartition(3)
    assert list(toxicity.learn(rows, toxicity.Sample()).lexicon.terms) == ["insultus"]


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, many = (by_id(toxicity.toxicity(docs.repartition(n), labels.repartition(n))) for n in (1, 7))
    assert one == many


def test_near_copies_teach_once(spark):
    base = [f"w{i}" for i in range(80)]
    copies = [(i, " ".join(f"x{i}" if j == i else w for j, w in enumerate(base)), 1) for i in range(30)]
    apart = [(100 + i, " ".join(base[:10]) + " " + " ".join(f"y{i}z{j}" for j in range(40)), 1) for i in range(10)]
    docs = spark.createDataFrame([r[:2] for r in copies + apart], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in copies + apart], "doc_id long, toxic int")
    left = [r.text for r in toxicity.training_rows(docs, labels, toxicity.Sample()).collect()]
    usable = {r.doc_id for r in labels.where(toxicity.fold_of("doc_id", 5) != 0).collect()}
    assert sum(" y" in t for t in left) == sum(i >= 100 for i in usable) and sum(" y" not in t for t in left) <= 4


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (5, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(awkward, labels).count() == awkward.count()
    assert toxicity.toxicity(awkward, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0


# --- language


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = by_id(language_id.language_id(docs))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [truth[i] == r.lang_pred for i, r in out.items() if r.held_out]
    assert np.mean(held) >= 0.95 and np.mean([r.rejected for r in out.values()]) <= 0.02


def test_language_awkward(spark, awkward, empty):
    out = language_id.language_id(awkward).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in out if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred != "und" for r in out if r.doc_id in (4, 5, 7, 8))
    assert language_id.language_id(empty).count() == 0
    assert not any(r.rejected for r in out if r.doc_id in (4, 5, 7, 8))  # no row is left to calibrate on
    kept = language_id.keep_known(awkward)
    assert kept.columns == awkward.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())


OUTSIDERS = {
    "pl": "Wczoraj wieczorem poszliśmy do kina na nowy film, który bardzo nam się podobał, a potem wróciliśmy do domu tramwajem. Dzieci spały już od dawna, więc rozmawialiśmy cicho przy herbacie o planach na przyszły rok.",
    "fi": "Eilen illalla menimme elokuviin katsomaan uutta elokuvaa, josta pidimme kovasti, ja sitten palasimme kotiin raitiovaunulla. Lapset olivat jo nukkumassa, joten juttelimme hiljaa teen ääressä ensi vuoden suunnitelmista.",
    "it": "Ieri sera siamo andati al cinema a vedere un nuovo film che ci è piaciuto molto e poi siamo tornati a casa in tram. I bambini dormivano già da tempo, quindi abbiamo parlato piano davanti al tè dei progetti per il prossimo anno.",
    "nl": "Gisteravond gingen we naar de bioscoop om een nieuwe film te zien die we erg leuk vonden, en daarna gingen we met de tram naar huis. De kinderen sliepen al lang, dus praatten we zachtjes bij de thee over plannen voor volgend jaar.",
    "ru": "Вчера вечером мы пошли в кино на новый фильм, который нам очень понравился, а потом вернулись домой на трамвае. Дети уже давно спали, поэтому мы тихо разговаривали за чаем о планах на следующий год.",
    "ja": "昨日の夜、私たちは新しい映画を見に映画館へ行きました。とても気に入って、それから電車で家に帰りました。子供たちはもう眠っていたので、来年の計画についてお茶を飲みながら静かに話しました。楽しい夜でした。",
    "code": "def merge(a, b):\n    out = []\n    while a and b:\n        out.append(a.pop(0) if a[0] < b[0] else b.pop(0))\n    return out + a + b\nclass Node:\n    def __init__(self, value, left=None, right=None):\n        self.value, self.left, self.right = value, left, right\n",
}


def test_rejection_rejects(spark):
    """Languages that no label has, code and random letters go, from fifty letters on; held-out documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs, language_id.Fit())
    rng = random.Random(2)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)) for _ in range(4)]
    strange = [t[: n + 20 * (k == "code")] for k, t in OUTSIDERS.items() for n in (70, 90, 110, 150, 200)] + [t * n for t in OUTSIDERS.values() for n in (5, 40)]
    strange += [t[:n] for t in noise for n in (70, 130, 300, 900)]
    assert min(language_id.vector(t)[1] for t in strange) >= 40
    assert np.mean([model.predict(t)[2] for t in strange]) >= 0.95
    held = [r for r in docs.where("text is not null").withColumn("held", language_id.fold_of("doc_id", 3) == 1).collect() if r.held]
    assert np.mean([model.predict(r.text)[2] for r in held if language_id.vector(r.text)[1]]) <= 0.01
    assert all(0 < model.floor[k] <= model.floor[k + 1] for k in range(5, language_id.LENGTHS - 1))


def test_symbols_are_no_letters_and_letters_have_a_language(spark):
    model = language_id.learn(spark.read.parquet(f"{SF}/documents.parquet"), language_id.Fit())
    for text in ("😀😀😀 😀", "\U0001d7ce 12 \U0001f1e9", "\ue000\U000f0000 ."):
        assert language_id.vector(text) == (None, 0) and model.predict(text) == ("und", 0.0, True)
    for text in ("漢", "\U00010400\U00010428", "\U0001d400 😀", "ﷺ", "a"):
        assert language_id.vector(text)[1] >= 1 and model.predict(text)[0] in model.languages
    assert (language_id.vector("\U00010400")[0] == language_id.vector("\U00010428")[0]).all()  # lower-cased like others


def test_pieces_change_nothing(monkeypatch):
    random.seed(4)
    texts = ["".join(random.choice("abcß é1.\n") for _ in range(random.randrange(1, 90))) for _ in range(400)]
    whole = [language_id.vector(t) for t in texts]
    for piece in (1, 2, 7, 40):
        monkeypatch.setattr(language_id, "PIECE", piece)
        for t, (v, n) in zip(texts, whole, strict=True):
            w, m = language_id.vector(t)
            assert n == m and (v is w or (v == w).all()), t
    assert language_id.vector("123 !") == (None, 0)


def plain_prediction(text, model):
    """Language and cosine by words padded with blanks and a dictionary of n-grams."""
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    padded = " " + " ".join(folded.split()) + " "
    counts = np.zeros(language_id.SIZE)
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            counts[slot_of(padded[i : i + n])] += 1
    v = np.log1p(counts) * model.idf
    cosines = model.centroids @ v / np.linalg.norm(v)
    return model.languages[model.owner[int(np.argmax(cosines))]], float(cosines.max())


def slot_of(gram):
    mixed = 0
    for i, (c, m) in enumerate(zip(gram, (0x9E3779B1, 0x85EBCA77, 0x27D4EB2F))):
        mixed = ord(c) * m % 2**32 if i == 0 else (mixed ^ ord(c) * m % 2**32) * (0xC2B2AE3D, 0x165667B1)[i - 1] % 2**32
    return mixed >> (32 - language_id.BITS)


def test_predictions_equal_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs, language_id.Fit())
    for r in docs.where("n_chars < 600").limit(60).collect():
        lang, cosine = plain_prediction(r.text, model)
        got = model.predict(r.text)
        assert got[0] == lang and abs(got[1] - min(1.0, cosine)) < 1e-9


# --- personal data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    random.seed(2)
    texts = ["".join(random.choice("0123456789.-+ ()@ab_%\n") for _ in range(60)) for _ in range(5000)] + ["".join(random.choice("12.@a ") for _ in range(30)) for _ in range(5000)]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + ["4111 1111 1111 1111", "a@b.c@d.e", "+1 (555) 555-1234."]
    assert all(plain_spans(t) == pii.base_spans(t) for t in texts)
    assert pii.base_spans("a" * 300_000 + "@" + "9" * 300_000) == []


def test_field_learns_its_table_and_keeps_clear_of_words():
    field = pii.trained()
    held = pii.training_table(200, seed=5)
    right = [(p == np.array(y)).all() for p, (_, y) in zip(field.decode([x for x, _ in held]), held, strict=True)]
    assert np.mean(right) >= 0.9
    text = "mail john [at] acme.com or ring (555) 123-4567 about version 2.0"
    assert [text[s:e] for s, _, e in pii.find([text], field)[0][1]] == ["john [at] acme.com", "(555) 123-4567"]


def test_pii_rows(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in by_id(pii.pii_spans(docs)).items():
        base = plain_spans(texts[i])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(","))
        assert (r.n_added, r.n_spans) == (r.n_spans - len(base), len(list(filter(None, r.spans.split(",")))))
    assert pii.pii_spans(awkward).count() == awkward.count() and pii.pii_spans(empty).count() == 0
    d = spark.createDataFrame([(1, "write to a.b@c.org now", 22), (2, None, 0)], "doc_id long, text string, n_chars long")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in pii.redact(d).collect()) == [(1, "write to <email> now", 20), (2, None, 0)]


def test_field_adds_secrets_and_numbers_of_documents():
    field = pii.trained()
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    found = wanted = caught = right = 0
    for text, (base, spans) in zip(texts, pii.find(texts, field), strict=True):
        secrets = {(m.start(1), 4, m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{16,})"', text)}
        added = set(spans) - set(base)
        wanted, caught, found = wanted + len(secrets), caught + len(secrets & added), found + len(added)
        right += sum(s in secrets or re.fullmatch(r"[0-9]{16}|\+1 \([0-9]{3}\) [0-9-]{8}", text[s[0] : s[2]]) is not None for s in added)
    assert wanted >= 5 and caught == wanted and right >= 0.95 * found > 0


def test_field_on_forms_it_has_not_seen():
    field = pii.trained()
    seen = [("use the access token: 0a9b8c7d6e5f4a3b2c1d0e9f today", ["0a9b8c7d6e5f4a3b2c1d0e9f"]), ("write to anna_k [at] posteo.net please", ["anna_k [at] posteo.net"]), ("two cards 4556 7375 8689 9855 and no more", []), ("chapter 12 of 1999, page 3", []), ("revision 9233a8ecf7c5b09fe5949719b6b82bc439e9329b was built", [])]
    for text, want in seen:
        base, spans = pii.find([text], field)[0]
        assert [text[s:e] for s, k, e in spans if (s, k, e) not in base] == want, text


def test_field_keeps_the_kinds_rules():
    """No address with a part above 255, no card that fails Luhn without a word for it, no rest of a bank account."""
    field = pii.trained()
    for text in ("version 10.2.3.4000 was built", "see 1.2.3.4.5 of it", "IBAN DE89 3704 0044 0532 0130 00 please", "number 2123465659789240 here", "in 5731080387325255 of them", "paid 4556 7375 8689 9854 yesterday"):
        base, spans = pii.find([text], field)[0]
        assert {k for _, k, _ in set(spans) - set(base)} <= {4}, text
    assert pii.admissible("card", "my visa card 4556737586899854", 13, 29) and not pii.admissible("card", "my code 4556737586899854", 8, 24)
    assert pii.admissible("card", "4556737586899855", 0, 16) and not pii.admissible("card", "x4556737586899855", 1, 17)
    assert pii.admissible("ip", "at 10[.]2[.]3[.]4:80", 3, 20) and not pii.admissible("ip", "10[.]2[.]3[.]256", 0, 16)


def test_long_runs_are_decoded_whole():
    field = pii.trained()
    numbers = " ".join(str(i % 10) for i in range(197))
    text = f"{numbers} mail eva [at] acme.com or {numbers} 12 {numbers} token = \"{'a1b2' * 8}\" 7"
    got = [text[s:e] for s, k, e in pii.find([text], field)[0][1]]
    assert "eva [at] acme.com" in got and "a1b2" * 8 in got


# --- quality


def plain_counts(text):
    words = WORD.findall(text)
    covered = set()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark, awkward, empty):
    random.seed(3)
    texts = ["".join(random.choice("ab \n#\x0b ") for _ in range(80)) for _ in range(2000)]
    assert all(plain_counts(t) == quality_rules.base_counts(t) for t in texts)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = {r.doc_id: r.text for r in docs.where("n_chars < 4000").collect()}
    out = by_id(quality_rules.quality_rules(docs))
    for i, t in small.items():
        r, want = out[i], plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    odd = quality_rules.quality_rules(awkward).collect()
    assert len(odd) == awkward.count() and all(r.base_failed for r in odd if r.doc_id in (1, 2, 3, 4))
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (by_id(quality_rules.quality_rules(docs.repartition(n))) for n in (1, 64))
    assert one == many


def test_references_equal_plain_counts(spark, monkeypatch):
    docs, limits = spark.read.parquet(f"{SF}/documents.parquet"), quality_rules.Limits()
    words = defaultdict(Counter)
    for r in docs.collect():
        words[r.lang].update((r.text or "").lower().split())
    for lang, (_, common, hist) in quality_rules.references(docs.repartition(9), limits).items():
        total = sum(words[lang].values())
        want = sorted(w for w, n in words[lang].items() if n >= limits.common_share * total)
        assert common == want and hist[:-1] == pytest.approx([words[lang][w] / total for w in want])
    small = quality_rules.Frequent(most=50)
    many = [f"r{i}" for i in range(3000)] + ["common"] * 200
    random.shuffle(many)
    for i in range(0, len(many), 10):
        small.add(many[i : i + 10])
    assert len(small.counts) <= 60 and "common" in small.at_least(200 / 3200)


def test_verdicts_equal_plain_ones(spark):
    docs, limits = spark.read.parquet(f"{SF}/documents.parquet"), quality_rules.Limits()
    refs = quality_rules.references(docs, limits)

    def js(p, q):
        kl = lambda a, m: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
        return max(0.0, (kl(p, m) + kl(q, m)) / 2) ** 0.5

    out = by_id(quality_rules.quality_rules(docs))
    for r in docs.where("n_chars < 3000").limit(60).collect():
        got, words = out[r.doc_id], r.text.lower().split()
        if not words:
            continue
        chars = quality_rules.char_histogram(r.text)
        best = min((js(chars / chars.sum(), c) + js([*(words.count(w) / len(words) for w in common), sum(w not in set(common) for w in words) / len(words)], h), lang) for lang, (c, common, h) in refs.items())
        assert got.char_distance + got.word_distance == pytest.approx(best[0], abs=1e-6)
        fails = got.n_words >= limits.min_words and (got.char_distance > limits.max_char_distance or got.word_distance > limits.max_word_distance + limits.word_noise / got.n_words**0.5)
        assert got.kept == (not got.base_failed and not fails)


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    quality = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(quality[i], r.kept) for i, r in by_id(quality_rules.quality_rules(docs)).items() if i in quality and not r.base_failed]
    assert np.mean([k for q, k in judged if q]) >= 0.99 and np.mean([k for q, k in judged if not q]) <= 0.3


def test_distance_is_one_for_disjoint_and_zero_for_equal():
    p = np.array([1.0, 1.0, 0.0])
    assert quality_rules.js_distance(p, np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])) == pytest.approx([0.0, 1.0])
