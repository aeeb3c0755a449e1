"""Operators over whole tables: near duplicates, chat, licences, token output, packing, decontamination, pipeline."""

import re
import tempfile
import time
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolex.llm import chat_formatting, decontamination, jaccard_join, language_id, license_scan, packing, pii, training_order
from chronolex.llm.components import components
from chronolex.llm.token_ids import STRETCH, Encoder, encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def plain_components(texts, size=3, least=90):
    sets, index, parent = {i: shingles(t, size) for i, t in texts.items()}, defaultdict(list), {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in index[x]:
                shared[j] += 1
            index[x].append(i)
        for j, n in shared.items():
            if 100 * n >= least * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_duplicates_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    base = [f"w{i}" for i in range(300)]
    for k in range(40):  # a family of near copies: some edits too many for some pairs
        w = list(base)
        for e in range(k % 6):
            w[(37 * k + 53 * e) % 300] = f"x{k}e{e}"
        texts[10_000 + k] = " ".join(w)
    texts |= {20_000: " ".join(base), 20_001: "  ".join(base).upper(), 20_002: "a b", 20_003: "A\tB", 20_004: None, 20_005: "?!"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == plain_components(texts)


def test_near_duplicates_awkward(spark, awkward, empty):
    rows = jaccard_join.jaccard_components(awkward).collect()
    assert len(rows) == awkward.count()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id in (1, 4, 8)} == {(1, 0, 1), (4, 1, 4), (8, 1, 4)}
    assert jaccard_join.jaccard_components(empty).count() == 0
    kept = jaccard_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7]
    wordless = spark.createDataFrame([(1, " ")] * 3 + [(2, None)] * 2 + [(3, "a b c")] * 2, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.keep_one(wordless).collect()) == [1, 1, 1, 2, 2, 3]


def test_both_ways_of_reading_sets_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {tuple(r) for r in jaccard_join.jaccard_components(docs).collect()}
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    assert {tuple(r) for r in jaccard_join.jaccard_components(docs).collect()} == want


def test_prefix_bound_misses_nothing():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.choice(10_000, n, replace=False)
        b = np.concatenate([a[: n - int(rng.integers(0, max(1, n // 8)))], rng.choice(np.arange(10_000, 20_000), int(rng.integers(0, 4)), replace=False)])
        o, keep = len(set(a) & set(b)), lambda x: x - (9 * x + 9) // 10 + 1
        if 100 * o >= 90 * len(set(a) | set(b)):
            first = [set(sorted(x.tolist())[: keep(len(x))]) for x in (a, b)]
            assert first[0] & first[1]


def test_chat_keeps_maximal_conversations(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes")]
    longer = [(2, 5, "user", "hi"), (2, 6, "assistant", "yes"), (2, 7, "user", "more")]
    same = [(3, *t[1:]) for t in longer]
    other = [(4, 0, "user", "hi"), (4, 1, "assistant", "no"), (4, 1, "assistant", "no"), (4, None, None, None), (None, 0, "user", "lost")]
    far = [(5, i, "user", f"t{i}") for i in range(150)] + [(6, i, "user", f"t{i}") for i in range(100)]
    c = spark.createDataFrame(turns + longer + same + other + far, "conv_id long, turn int, role string, text string").repartition(4)
    got = {(r.conv_id, r.part): (r.n_turns, r.text) for r in chat_formatting.chat_formatting(c).collect()}
    assert set(got) == {(2, 0), (4, -1), (4, 0), (5, 0), (5, 1), (5, 2)}
    assert got[2, 0] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n")
    assert got[4, -1] == (1, "<|im_start|>unknown\n<|im_end|>\n") and got[4, 0][0] == 2 and [got[5, p][0] for p in range(3)] == [64, 64, 22]
    d = duckdb.connect()
    d.register("conversations", c.toArrow())
    want = {(r[0], r[1]): r[2:] for r in d.sql(f"SELECT conv_id, part, n_turns, text FROM ({chat_formatting.ORACLE_SQL})").fetchall()}
    assert want == got
    assert chat_formatting.chat_formatting(c.limit(0)).count() == 0


@pytest.fixture(scope="module")
def licences(spark):
    return license_scan.learn(spark)


def test_licences(spark, licences, awkward, empty):
    texts = {
        1: ["Licensed under the BSD 3-Clause License.", "nothing here"], 2: ["Her driver's license was lost in the city."], 3: ["text", "Released under the Foo Bar License"], 4: ["This file is covered by the Mozilla Public License, v. 2.0"],
        5: ["All files are licensed under the GNU Affero General Public License version 3"], 6: ["Licensed under CC BY-NC 4.0."], 7: ["Released under the MIT License."],
    }
    d = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in license_scan.license_scan(d, licences).collect()}
    assert got == {(1, 0): ("bsd", True), (3, 1): ("unknown", False), (4, 0): ("mpl", True), (5, 0): ("agpl", True), (6, 0): ("cc-by-nc", True), (7, 0): ("mit", True)}
    wrapped = spark.createDataFrame([(1, "First.\nThis work is licensed under the GNU Lesser\nGeneral Public License, version 2.1.\nEnd."), (2, "Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer."), (3, "MIT License\nApache License 2.0")], "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): r.family for r in license_scan.license_scan(wrapped, licences).collect()}
    assert got[2, 0] == "bsd" and (got[3, 0], got[3, 1]) == ("mit", "apache") and "lgpl" in (got.get((1, 1)), got.get((1, 2)))
    assert license_scan.license_scan(awkward, licences).count() == 0 and license_scan.license_scan(empty, licences).count() == 0


def test_licences_without_an_anchor_are_none(spark, licences):
    """Every text of the model's words that holds no anchor is no licence: the bound is tried on its own grams."""
    free = sorted({w for g in licences.grams for w in g.split(" ")} - set(licences.anchors))
    assert licences.anchors and free
    row = spark.createDataFrame([(free,), (free[:1],), (free[::-1],)], "w array<string>")
    assert {r.best for r in row.select(license_scan.judged(F.col("w"), licences).alias("v")).select("v.best").collect()} == {license_scan.NONE}


def test_licence_lines_of_documents(spark, licences):
    """Precision and recall on the lines that name a licence in the documents, by their fixed wording."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {"apache": "Apache License", "mit": "MIT License", "gpl": "GNU General Public License", "cc-by-nc": "CC BY-NC", "bsd": "BSD", "mpl": "Mozilla Public License", "cc-by-sa": "CC BY-SA", "cc-by": "CC BY 4.0"}
    want = {(r.doc_id, i): f for r in docs.collect() for i, line in enumerate((r.text or "").split("\n")) for f, n in known.items() if n in line and re.search("[Ll]icen[sc]e", line)}
    got = {(r.doc_id, r.paragraph): r.family for r in license_scan.license_scan(docs, licences).collect()}
    right = sum(got.get(k) == f for k, f in want.items())
    assert len(want) >= 5 and right >= 0.95 * len(want) and right >= 0.9 * len(got)


def test_ids_equal_the_tokenizers_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "a  b", " a b ", "x\n\ny  z \n", "\x1c a \xa0 b", "don't  it's", "a b\tc d", "　a", "<|endoftext|> a", "x<|endoftext|><|endoftext|>  y", " <|endoftext|>", "<|endoftext|", "a" * 3000, "é ß   x"]
    assert [np.frombuffer(encoder(path)(x), "<u4").tolist() for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    t.encode_special_tokens = True
    assert [np.frombuffer(Encoder(path, special=False)(x), "<u4").tolist() for x in texts[-20:]] == [e.ids for e in t.encode_batch(texts[-20:], add_special_tokens=False)]


def check_packing(rows, texts, size=1024):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert [p[0] for p in own] == list(range(len(own))) and sum(p[2] for p in own) == len(ids) // 4
        assert all(p[2] == size for p in own[1:]) and (len(own) == 1 or len(ids) // 4 > size)
        assert all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for _, s, n, c in own)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.best_fit_packing(docs).collect()
    n = check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    assert n <= 1.02 * sum(r.length for r in rows) / 1024 + 1
    odd = packing.best_fit_packing(awkward.where("doc_id <> 4 or doc_id is null")).collect()
    check_packing(odd, {r.doc_id: r.text for r in awkward.collect() if r.doc_id != 4})
    assert sum(r.doc_id == 4 for r in packing.best_fit_packing(awkward).collect()) == 2
    assert packing.best_fit_packing(empty).count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        assert sorted(training_order.permuted(np.arange(n), n, 11).tolist()) == list(range(n))
    assert (training_order.permuted(np.arange(1000), 1000, 1) != training_order.permuted(np.arange(1000), 1000, 2)).any()


def test_shards_round_trip(spark, awkward, empty, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    uri = f"file://{tmp_path}/shards"
    how = {"length": 256, "shard_slots": 64}
    rows = {r.slot: r for r in training_order.written_order(docs, uri, **how).collect()}
    assert sorted(rows) == list(range(len(rows)))
    whole = {r.slot: bytes(r.ids) for r in training_order.training_order(docs, **how).collect()}
    for slot, r in rows.items():  # every sequence is where its row says
        found = training_order.read_shard(uri, slot // 64, 256, slot % 64)[0].astype("<u2").tobytes()
        assert found == whole[slot] and zlib.crc32(found) == r.ids_crc32 and r.byte_offset == slot % 64 * 512 and r.shard == slot // 64
    sizes = {r.shard: r.n_bytes for r in rows.values()}
    assert sum(sizes.values()) == len(rows) * 512
    one, other = tmp_path / "shards" / "shard-00000000.u16", tmp_path / "shards" / "shard-00000001.u16"
    before = one.stat().st_mtime_ns
    other.unlink()
    training_order.written_order(docs, uri, **how).count()  # resumes: writes what is missing only
    assert one.stat().st_mtime_ns == before and other.stat().st_size == sizes[1]
    kept = one.read_bytes()
    training_order.written_order(docs, uri, key=7, **how).count()  # another key: nothing is kept
    assert one.read_bytes() != kept and {one.read_bytes()[i : i + 512] for i in range(0, 64 * 512, 512)} <= set(whole.values())
    few = docs.where("doc_id < 20")
    training_order.written_order(few, uri, key=7, **how).count()  # a smaller corpus: no shard of the larger one stays
    n = training_order.training_order(few, **how).count()
    assert len(list((tmp_path / "shards").glob("*.u16"))) == len(list((tmp_path / "shards" / "manifest").glob("*.json"))) == -(-n // 64) < len(sizes)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(i for r in docs.collect() for i in [*library.encode(r.text, add_special_tokens=False).ids, 2])
    got = sorted(i for s, r in rows.items() for i in np.frombuffer(whole[s], "<u2")[: r.n_tokens].tolist())
    assert got == want
    assert training_order.training_order(awkward).count() > 0 and training_order.training_order(empty).count() == 0
    assert training_order.written_order(empty, f"file://{tmp_path}/none").count() == 0


def test_shards_leave_no_shuffle_files_or_sequences(spark, tmp_path):
    """Waves don't add up: what a wave shuffled is gone after it, and the table of sequences after the last."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))

    def left():
        local = Path(spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir()))
        return {f for f in local.glob("blockmgr-*/*/shuffle_*.data") if f.stat().st_size > 500_000} | set(shared.glob("chronolex/sequences-*"))

    before = left()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    training_order.written_order(docs.union(docs).union(docs), f"file://{tmp_path}/shards", length=256, shard_slots=64)
    until = time.monotonic() + 10
    while (new := left() - before) and time.monotonic() < until:
        time.sleep(0.2)
    assert not new


def test_stretches_give_the_library_ids(spark):
    """Whole texts without the cache, cut at single blanks, with added tokens, no blanks and blanks in a row."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoded = Tokenizer.from_file(path), encoder(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    texts += ["", " ", "a  b   c d", " x \n y\u00a0z ", "a" * 5000, "it's <|endoftext|> two<|endoftext|>", "\u00e9 \u4e2d\u6587 12 345\t6"]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        for most in (1, 7, 1000, STRETCH):
            assert [i for ids in encoded.stretches(text, most) for i in ids] == want


def test_decontamination(spark, awkward, empty):
    item = " ".join(f"Q{i}" for i in range(30))
    near = item.replace("Q29", "other").replace("Q28", "words")  # 24 of 26 shingles
    cut = " ".join(item.split()[:20])
    long = " ".join(f"z{i}" for i in range(5000))
    rows = [(1, f"{long} {item.lower()} {long}"), (2, f"{long}\n{near} end"), (3, cut), (4, None), (5, ""), (6, item), (6, item), (7, "What now"), (8, "say what now")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, item), (2, "what NOW"), (3, ""), (4, None), (5, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontamination.contaminated(d, items).collect()}
    assert got == {(i, k): (n, 26) for i, n in ((1, 26), (2, 24), (6, 26)) for k in (1, 5)} | {(7, 2): (1, 1), (8, 2): (1, 1)}
    assert sorted(r.doc_id for r in decontamination.decontaminate(d, items).collect()) == [3, 4, 5]
    assert decontamination.decontaminate(awkward, items).count() == awkward.count() and decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(d, items.limit(0)).count() == 0


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in language_id.language_id(docs).where("not rejected").collect()}  # the stage's decision
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(texts) - len(known) <= 0.01 * len(texts)
    texts = {i: t for i, t in texts.items() if i in known}
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    first = {i for i, (_, c) in plain_components(texts, 5, 80).items() if i == c}
    sh = {r.item_id: shingles(r.text.lower(), 5) for r in items}
    leaks = {i for i, t in texts.items() if any(len(s & shingles(t.lower(), 5)) >= 0.8 * len(s) for s in sh.values())}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == first - leaks
    field = pii.trained()
    left = {i: pii.redacted(texts[i], pii.find([texts[i]], field)[0][1]) for i in first - leaks}
    check_packing(rows, left)


def test_stages_on_odd_tables(spark, awkward, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (awkward, empty):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count(), name
    assert corpus_pipeline.packing(spark, empty, SF).count() == 0


def test_pipeline_links_near_copies_at_five_words_and_four_fifths(spark):
    import corpus_pipeline

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    base = [f"w{i}" for i in range(100)]
    for k in range(40):  # near copies with up to five changed words
        w = list(base)
        for e in range(k % 6):
            w[(37 * k + 23 * e) % 100] = f"x{k}e{e}"
        texts[10_000 + k] = " ".join(w)
    alone = [f"v{i}" for i in range(100)]
    texts |= {20_000: " ".join(alone), 20_001: " ".join("x" if i in (30, 60) else x for i, x in enumerate(alone)), 20_002: None}
    sets, parent = {i: shingles(t, 5) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, t in sets.items():
            if j < i and s and 10 * len(s & t) >= 8 * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert left == {i for i in texts if root(i) == i}
    assert 20_001 not in left and 20_001 in {r.doc_id for r in jaccard_join.keep_one(docs).collect()}


def test_the_query_writes_its_shards(spark):
    def folders():
        found = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("chronolex/shards-*/")
        return set(found)

    before = folders()
    rows = training_order.op8_training_order(spark, SF).collect()
    (folder,) = folders() - before
    assert rows and {f.name for f in folder.glob("*.u16")} == {f"shard-{r.shard:08d}.u16" for r in rows}
    stride = 2 * 2048
    for r in rows:
        data = (folder / f"shard-{r.shard:08d}.u16").read_bytes()
        assert len(data) == r.n_bytes == r.n_slots * stride and zlib.crc32(data[r.byte_offset : r.byte_offset + stride]) == r.ids_crc32
    assert len(rows) == sum({r.shard: r.n_slots for r in rows}.values())


def test_licence_verdicts_are_computed_once(spark, licences):
    """No filter repeats the verdicts, and known grams are found without going through the list for every gram."""
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = license_scan.license_scan(docs, licences)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if line.lstrip(" +-:").startswith("Filter") and "xxhash64" in line]
    assert "array_contains" in plan


def test_licence_verdicts_by_brute_force(spark, licences):
    """Classes and probabilities equal those summed in Python over the model's weights."""
    lines = ["the terms of the program", "licensed under the gnu general public license version 2", "mit license mit license", "of the of the of the", "spdx license identifier epl 2.0", "an unknown word or none", "permission to use copy and modify"]
    got = spark.createDataFrame([(x.split(" "),) for x in lines], "w array<string>").select("w", license_scan.judged(F.col("w"), licences).alias("v")).select("w", "v.*").collect()
    for r in got:
        grams = {" ".join(r.w[i : i + n]) for n in (1, 2, 3) for i in range(len(r.w) - n + 1)}
        sums = [b + sum(licences.weights[g][j] for g in grams if g in licences.weights) for j, b in enumerate(licences.intercept)]
        assert r.best == licences.classes[int(np.argmax(sums))] and abs(r.probability - 1 / np.exp(np.array(sums) - max(sums)).sum()) < 1e-9
