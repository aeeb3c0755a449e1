"""Truth tables of the operators on small inputs."""

import hashlib
import io
import json
import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex import storage
from chronolex.functions import text as fn
from chronolex.functions.identity import content_id
from chronolex.operators import activity, chunk, linkage, merge, records, search, temporal, tree, watch
from chronolex.operators import nodes as tree_nodes
from chronolex.plans import queries
from chronolex.sources import readers


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_derive_temporal(spark):
    data = [("a", "0000", "20200101", None), ("b", "0001", "20200101", None), ("c", "0001", "20200101", "20200101"), ("d", "0001", "20200101", "20200202")]
    d = spark.createDataFrame(data, "id string, suffix string, i string, a string")
    out = d.select("id", temporal.derive_temporal(F.col("suffix"), F.try_to_date("i", "yyyyMMdd"), F.try_to_date("a", "yyyyMMdd")).alias("t")).select("id", "t.quality", "t.valid_from", "t.issue")
    day = date(2020, 1, 1)
    assert rows(out) == [("a", "ambiguous", day, None), ("b", "confirmed-revision-id", day, None), ("c", "confirmed-api", day, None), ("d", "ambiguous", None, "EFFECTIVE_DATE_CONFLICT")]


def test_intervals_and_resolution(spark):
    data = [(1, "a", "2020-01-01", "confirmed-api"), (1, "b", "2021-01-01", "confirmed-api"), (2, "c", "2022-01-01", "confirmed-api"), (2, "d", "2022-01-01", "confirmed-api"), (2, "e", "2023-01-01", "confirmed-api"), (3, "f", "2020-01-01", "baseline"), (4, "g", None, "confirmed-api")]
    r = spark.createDataFrame(data, "k int, rev string, d string, q string").select("k", "rev", F.col("d").cast("date").alias("vf"), "q")
    i = temporal.derive_intervals(r, "k", "rev", "vf", "q")
    got = {x.rev: (x.valid_to_exclusive, x.interval_quality, x.sequence) for x in i.collect()}
    assert got["a"] == (date(2021, 1, 1), "confirmed-api", 1) and got["b"][0] is None
    assert got["c"] == (date(2023, 1, 1), "ambiguous", 1) and got["d"] == (date(2023, 1, 1), "ambiguous", 2)
    assert got["g"] == (None, "confirmed-api", 1)
    probes = spark.createDataFrame([(1, "2019-12-31"), (1, "2020-06-01"), (1, "2021-01-01"), (2, "2022-06-01"), (3, "2020-06-01"), (4, "2020-01-01")], "k int, p string").select("k", F.col("p").cast("date").alias("p"))
    contents = spark.createDataFrame([("b", 1)], "rev string, n_contents long")
    out = temporal.resolve_as_of(i, contents, probes, "k", "rev", "vf", "p")
    assert [(x[0], x[2], x[3], x[4]) for x in rows(out, "k", "p", "status", "selected", "content_status")] == [
        (1, "not-found", None, "none"), (1, "resolved", "a", "missing"), (1, "resolved", "b", "available"), (2, "ambiguous", None, "candidate-dependent"), (3, "unresolved", None, "candidate-dependent"), (4, "not-found", None, "none")]


def test_identity_keeps_nulls_apart(spark):
    d = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert d.select(content_id("x", "y", "z").alias("i")).distinct().count() == 2


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(fn.normalise(F.lit("　 a\n\tb 　"))) == "a b" and get(fn.normalise(F.lit(None).cast("string"))) == ""
    assert round(get(fn.similarity(fn.trigrams(F.lit("word")), fn.trigrams(F.lit("two words")))), 6) == 0.363636
    assert get(fn.similarity(fn.trigrams(F.lit("")), fn.trigrams(F.lit("")))) == 0
    assert get(fn.ascii_digits(F.lit("第１２条"))) == "第12条"
    assert get(fn.revision_date(F.lit("A" * 15 + "_20240230_" + "0" * 15))) is None
    assert get(fn.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert get(fn.quote(F.lit("x" * 1001))) == "x" * 1000 + "…"


def test_upsert_keeps_first_run(spark):
    old = spark.createDataFrame([(1, None, "x", 1), (2, "k", "y", 1)], "a int, b string, v string, run int")
    new = spark.createDataFrame([(1, None, "z", 2), (3, "k", "w", 2)], "a int, b string, v string, run int")
    assert rows(merge.upsert(old, new, ["a", "b"], "run")) == [(1, None, "z", 1, 2), (2, "k", "y", 1, 1), (3, "k", "w", 2, 2)]


def test_chunks_never_split_a_unit(spark):
    d = spark.createDataFrame([(1, "a" * 60 + "\n\n" + "b" * 60 + "\nc"), (2, "x" * 150), (3, None)], "k long, t string")
    assert rows(chunk.chunk_documents(d, "k", "t", 100)) == [(1, 0, 1, 1, 1, 60, False), (1, 1, 3, 4, 2, 62, False), (2, 0, 1, 1, 1, 150, True)]


def test_budget_skips_and_goes_on(spark):
    d = spark.createDataFrame([("g", 1, 5000, 10), ("g", 2, 2000, 11), ("g", 3, 900, 12), ("h", 1, 9000, 13), ("h", 2, 1, 14)], "g string, r int, n int, k int")
    assert rows(search.budgeted(d, "g", "r", "n", "k"), "g", "position", "k") == [("g", 1, 10), ("g", 2, 12), ("h", 1, 13)]


def test_fusion_uses_the_best_rank(spark):
    h = spark.createDataFrame([(1, "lexical", 1), (1, "lexical", 5), (1, "structural", 2), (2, "vector", 1)], "k int, channel string, rank int")
    assert {r.k: r.score for r in search.fuse(h, "k").collect()} == {1: round(1 / 61 + 0.75 / 62, 9), 2: round(1 / 61, 9)}


def test_mentions_both_ways(spark):
    t = spark.createDataFrame([(1, "see the  Law of\nthe sea"), (2, "ab"), (3, None)], "doc_id long, text string")
    n = spark.createDataFrame([(7, "law of the sea"), (8, "Law of the sea"), (9, "ab")], "item_id long, text string")
    for most in (10**6, 0):
        assert rows(linkage.contained_mentions(t, n, "doc_id", "item_id", most_chars=most)) == [(1, 8)]


def test_watch_actions(spark):
    base = spark.createDataFrame([(1, "resolved", "a"), (2, "resolved", "a"), (4, "resolved", "a")], "k int, status string, selected string")
    now = spark.createDataFrame([(1, "resolved", "a"), (2, "resolved", "b"), (3, "resolved", "c"), (4, "ambiguous", None)], "k int, status string, selected string")
    assert rows(watch.evaluate(base, now, "k")) == [(1, "no-change", None, None), (2, "effective-change", "a", "b"), (3, "initialized", None, "c"), (4, "blocked-ambiguous", None, None)]


def test_html_tree_is_tolerant():
    nodes = tree.html_rows(1, "<p>a<br>b<p>c<!-- x --></div></p>tail")
    assert [n[7] for n in nodes] == ["#document", "p", "br", "p", None]
    assert [n[2] for n in nodes] == [None, 1, 2, 2, 4]


def test_xml_tree_keeps_mixed_content(spark):
    nodes = tree.xml_rows(1, b"<a>x<b k='1'>y</b> tail<!--c--><b/></a>")
    assert [(n[7], n[8], n[11]) for n in nodes] == [("a", "/a[1]", "x tail"), ("b", "/a[1]/b[1]", "y"), (None, "/a[1]/comment()[1]", "c"), ("b", "/a[1]/b[2]", "")]
    assert tree.xml_rows(1, b"<a>") is None
    files = spark.createDataFrame([(1, bytearray(b"<a><b/></a>")), (2, bytearray(b"<a>"))], "k long, c binary")
    assert rows(tree.shred_xml(files, "k", "c"), "doc", "status", "n_nodes") == [(1, "succeeded", 2), (2, "failed", 0)]


def test_sources(spark, tmp_path):
    name = "A" * 15 + "_20240101_" + "0" * 15
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr(f"x/{name}.xml", "<a/>")
        f.writestr("readme.txt", "no")
    (tmp_path / "a.zip").write_bytes(z.getvalue())
    members = readers.archive_members(spark, f"file://{tmp_path}/a.zip")
    assert rows(members, "revision_id", "size") == [(name, 4)] and readers.duplicate_members(members).count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"meetingRecord": [{"issueID": "i", "date": "2024-02-03", "speechRecord": [{"speechID": "s", "speechOrder": 1, "speech": "hi"}]}]}))
    assert rows(readers.minutes(spark, f"file://{tmp_path}/m.json"), "speechID", "held_on") == [("s", date(2024, 2, 3))]
    oai = b"<r><record><header status='deleted'><identifier>x</identifier></header></record><record><header><identifier>y</identifier></header><metadata><dc><title>t</title><title>t</title></dc></metadata></record></r>"
    got = rows(readers.metadata_records(spark.createDataFrame([(bytearray(oai),)], "c binary"), "c"), "oai_id", "deleted", "fields")
    assert got == [("x", True, {}), ("y", False, {"title": ["t"]})]
    (tmp_path / "g.pdf").write_bytes(b"%PDF-1.7 /Type /Sig /ByteRange [0 1]\xff")
    assert rows(readers.pdf_signatures(spark, f"file://{tmp_path}/g.pdf"), "is_pdf", "n_byte_ranges", "n_signatures") == [(True, 1, 1)]


def test_vector_topk_of_many_queries(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(3000, 8)).round(1)
    m[5], m[9] = 0, m[4]  # a zero vector, a tie
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(9000, [1.0, 2.0]), (9001, None)], "id long, e array<float>").repartition(3)
    asked = v.where("id % 10 = 0")  # 300: more than a block
    got = {}
    for r in search.vector_topk_batch(asked, v, "id", "e", 7).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id))
    assert sorted(got.pop(9000)) == [(-1.0, 9000)]
    f = m.astype(np.float32).astype(float)
    good = [i for i in range(3000) if f[i].any()]
    unit = f[good] / np.sqrt((f[good] ** 2).sum(axis=1))[:, None]
    for i in range(0, 3000, 10):
        want = sorted(zip((-np.round(unit @ unit[good.index(i)], 6)).tolist(), good))[:7]
        assert np.allclose([x[0] for x in sorted(got[i])], [x[0] for x in want], atol=2e-6)
    assert set(got) == set(range(0, 3000, 10)) and got[0] and {r[1] for r in sorted(got[0])[:1]} == {0}


def test_channels_search_inside_the_scope(spark):
    sf = "/root/testdata/sf0.01"
    scope = queries.resolved_documents(spark, sf).where("lang = 'en'")
    inside = {r.doc_id: r for r in scope.collect()}
    resolved = {r.selected for r in queries.as_of_resolution(spark, sf).where("probe_date = '1996-01-01' and status = 'resolved'").collect()}
    assert inside and set(inside) <= resolved
    hits = {}
    for r in queries.scoped_channels(spark, sf, scope).collect():
        hits.setdefault(r.channel, set()).add(r.doc_id)
    vectors = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert hits.get("lexical", set()) == {i for i, r in inside.items() if "License" in r.text}
    assert hits["structural"] == {i for i, r in inside.items() if r.source == "src0"}
    assert hits["vector"] == set(sorted(inside)) & vectors
    assert {r.doc_id for r in queries.hybrid_pipeline(spark, sf).collect()} <= set(inside)


def test_guard_fails_outside_the_scope(spark):
    hits, scope = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, s string")
    assert rows(search.guarded(hits.where("k = 1"), scope, "k")) == [(1, "a")]
    with pytest.raises(Exception, match="outside the resolved scope"):
        search.guarded(hits, scope, "k").collect()


def test_latency_stats_hold_no_group(spark):
    rng = np.random.default_rng(5)
    data = [(g, float(x)) for g, n in (("a", 2000), ("b", 11), (None, 30), ("d", 1)) for x in rng.integers(0, 500, n)] + [("a", None), ("e", None)]
    d = spark.createDataFrame(data, "g string, v double").repartition(5)
    out = activity.latency_stats(d, "g", "v")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want = []
    for g in ("a", "b", None, "d"):
        v = sorted(x for k, x in data if k == g and x is not None)
        want.append((g, v[0], v[-1], v[round((len(v) - 1) * 0.95)], len(v)))
    assert rows(out, "g", "lo", "hi", "p95", "n") == sorted([*want, ("e", None, None, None, 0)], key=repr)


def test_xml_names_attachments_and_strings(spark):
    source = b"<?xml version='1.0' encoding='utf-8'?><n:a xmlns:n='u'><b src=''>x<!--no--><c x:src='f' xmlns:x='v'>y</c>z</b>t</n:a>"
    nodes = tree.xml_rows(1, source)
    assert [n[8] for n in nodes] == ["/*[local-name()='a' and namespace-uri()='u'][1]", "/*[local-name()='a' and namespace-uri()='u'][1]/b[1]", "/*[local-name()='a' and namespace-uri()='u'][1]/b[1]/comment()[1]", "/*[local-name()='a' and namespace-uri()='u'][1]/b[1]/c[1]"]
    assert tree.string_value(nodes) == "xyzt" and tree.string_value(nodes, 4) == "y" and tree.declared_encoding(source) == "utf-8" and tree.declared_encoding(b"<a/>") is None
    files = spark.createDataFrame([(1, bytearray(source)), (2, bytearray(b"<a>"))], "k long, c binary")
    shredded = tree.shred_xml_nodes(files, "k", "c")
    assert rows(tree.attachments(shredded), "ord", "tag", "attribute", "src") == [(2, "b", "src", ""), (4, "c", "{v}src", "f")]
    assert rows(shredded.select("ord", tree.local_name("tag").alias("name"), tree.attribute("attributes", "src").alias("src")).where("name is not null"), "ord", "name", "src") == [(1, "a", None), (2, "b", ""), (4, "c", "f")]
    assert rows(tree.shred_xml(files, "k", "c"), "doc", "encoding", "issue") == [(1, "utf-8", None), (2, None, "XML_NOT_WELL_FORMED")]


def test_deep_and_wide_documents():
    deep = tree.xml_rows(1, b"<a>" * 2000 + b"x" + b"</a>" * 2000)
    assert len(deep) == 2000 and deep[-1][5] == 1999 and deep[-1][11] == "x"
    wide = tree.xml_rows(1, b"<r>" + b"<a/><b/>" * 20_000 + b"</r>")
    assert len(wide) == 40_001 and wide[-1][3:5] == (40_000, 20_000)


def test_character_changes_rebuild_both_sides(spark):
    pairs = [(1, "abc def", "abd  ef"), (2, "", "new"), (3, None, None), (4, "same", "same")]
    d = spark.createDataFrame(pairs, "k int, a string, b string")
    got = records.character_changes(d, "a", "b", "k").collect()
    for k, a, b in pairs:
        own = sorted((r for r in got if r.k == k), key=lambda r: r.pos)
        assert "".join(r.left_text for r in own) == (a or "") and "".join(r.right_text for r in own) == (b or "")
        assert all((r.op == "equal") == (r.left_text == r.right_text) for r in own)


def test_records_refuse_what_is_wrong(spark):
    bad = spark.createDataFrame([("A", "B_20240101_0", None, None, "x")], "law_id string, revision_id string, amending_id string, api_date date, kind string")
    with pytest.raises(Exception, match="another law"):
        records.revision_rows(bad).collect()
    old, new = (spark.createDataFrame([(1, d)], "k int, digest string") for d in ("a", "b"))
    with pytest.raises(Exception, match="drifted"):
        records.stored_embeddings(old, new, "k", "digest").collect()
    assert records.stored_embeddings(old, old, "k", "digest").count() == 0
    assert [records.readiness(p, ["a", "b"]) for p in ([], ["a"], ["b", "a", "c"])] == ["empty", "partial", "ready"]
    faults = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1e300, 1.0]), (6, None)], "k int, v array<double>")
    assert rows(records.embedding_faults(faults, "v", 2), "k", "fault") == [(1, None), (2, "length"), (3, "zero"), (4, "not finite"), (5, "not finite"), (6, "missing")]


def test_hash_embedding_is_stable(spark):
    d = spark.createDataFrame([(1, "Law law text"), (2, ""), (3, None), (4, "law text LAW")], "k int, t string")
    got = {r.k: r.embedding for r in records.hash_embedding(d, "t", 16).collect()}
    assert got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and not any(got[2]) and not any(got[3])


def test_evidence_must_be_whole(spark):
    nodes = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b")], "doc long, ord int, body string")
    sha = hashlib.sha256(b"a\nb").hexdigest()
    whole = spark.createDataFrame([("c", 1, sha, [1, 2, 3])], "context_id string, doc long, sha string, ords array<int>")
    assert rows(tree_nodes.evidence_bundle(whole, nodes), "position", "ord", "body") == [(1, 1, "a"), (2, 2, None), (3, 3, "b")]
    for c, says in ((("c", 1, sha, [1, 3, 4]), "incomplete"), (("c", 1, "0", [1, 3]), "changed"), (("c", 2, sha, [1]), "missing")):
        with pytest.raises(Exception, match=says):
            tree_nodes.evidence_bundle(spark.createDataFrame([c], whole.schema), nodes).collect()


def test_chunk_configurations_and_filters(spark):
    chunks = spark.createDataFrame([(1, "x"), (2, "y")], "k int, config string")
    assert tree_nodes.chunk_config(chunks.where("k = 1")) == "x" and tree_nodes.chunk_config(chunks, "y") == "y"
    for configured in (None, "z"):
        with pytest.raises(ValueError):
            tree_nodes.chunk_config(chunks, configured)
    with pytest.raises(ValueError):
        search.chunk_structural_search(chunks, {"k": None}, ["k"])
    texts = spark.createDataFrame([(1, "old law text", ""), (2, "text", "Law 1"), (3, "none", "none")], "k int, text string, prefix string")
    assert [r.k for r in search.chunk_lexical_search(texts, " law  text", ["k"]).collect()] == [1] and search.chunk_lexical_search(texts, " ", ["k"]).count() == 0


def test_budget_of_streams(spark):
    d = spark.createDataFrame([("a", 1, 7000, 10), ("a", 2, 1, 11), ("b", 1, 4000, 12), ("b", 2, 3000, 13), ("b", 3, 2000, 14), *[("c", i, 1, 100 + i) for i in range(12)]], "g string, o int, n long, k int").repartition(3)
    got = {(r.g, r.position): (r.k, r.used) for r in search.budgeted(d, "g", "o", "n", "k").collect()}
    assert got == {("a", 1): (10, 7000), ("b", 1): (12, 6000), ("b", 2): (14, 6000)} | {("c", i + 1): (100 + i, 8) for i in range(8)}


def test_scan_counts_what_the_tree_has(spark):
    source = b"<n:a xmlns:n='u'>x<b><c/>tail</b> <b/>t</n:a>"
    files = spark.createDataFrame([(1, bytearray(source)), (2, bytearray(b"<a>"))], "k long, c binary")
    nodes = tree.xml_rows(1, source)
    got = {r.doc: r for r in tree.scan_xml(files, "k", "c").collect()}
    tags = [n[7] for n in nodes]
    assert (got[1].n_nodes, got[1].max_depth, got[1].tags) == (len(nodes), max(n[5] for n in nodes), {t: tags.count(t) for t in tags})
    assert got[1].n_tails == sum(k == "tail" and bool(v.strip()) for n in nodes for k, v, _ in n[10]) and not got[2].ok


def test_archives_against_a_manifest(spark, tmp_path):
    name = "A" * 15 + "_20240101_" + "0" * 15
    for z in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{z}.zip", "w") as f:
            f.writestr(f"x/{name}.xml", f"<{z}/>")
    members = readers.archive_members(spark, f"file://{tmp_path}/*.zip")
    sha = hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("a.zip", sha, 1), ("c.zip", "0", 1)], "archive string, sha256 string, n_members int")
    assert rows(readers.archive_report(members, manifest)) == [("a.zip", f"revision repeats: {name}"), ("b.zip", "not in the manifest"), ("b.zip", f"revision repeats: {name}"), ("c.zip", "missing")]


def test_catalogue_pages_must_follow(spark, tmp_path):
    for i, page in enumerate(({"total_count": 5, "count": 2, "next_offset": 2}, {"total_count": 5, "count": 2, "next_offset": 4}, {"total_count": 5, "count": 1, "next_offset": None})):
        (tmp_path / f"p{i}.json").write_text(json.dumps(page | {"laws": []}))
    assert readers.catalogue_gaps(spark, f"file://{tmp_path}").count() == 0
    (tmp_path / "p1.json").unlink()
    assert rows(readers.catalogue_gaps(spark, f"file://{tmp_path}")) == [(2,)]


def test_limits_are_refused():
    assert [fn.checked_limit(x, 20, 50) for x in (None, 1, 50)] == [20, 1, 50]
    for x in (0, 51):
        with pytest.raises(ValueError):
            fn.checked_limit(x, 20, 50)


def test_reports_are_whole(tmp_path):
    storage.write_report({"b": 1, "a": "é"}, f"file://{tmp_path}/x/r.json")
    storage.write_report({"a": 2}, f"file://{tmp_path}/x/r.json")
    assert json.loads((tmp_path / "x" / "r.json").read_text()) == {"a": 2} and len(list((tmp_path / "x").iterdir())) == 1
