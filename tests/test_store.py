"""The commit log: whole runs or nothing, pinned readers, replays, two writers, what is left of a killed one."""

import pytest
from pyspark.sql import functions as F

from chronolex.operators.intake import MALFORMED, UNKNOWN, file_parts, member_part, snapshot_parts
from chronolex.sinks.store import Part, Store, VersionTaken, local_orders

FILES = [("u1", "r1", b"<a><b src='x'/>t</a>"), ("u2", "r1", b"<a><b src='x'/>t</a>"), ("u3", "r2", b"<a>"), ("u4", "r9", b"<a/>"), ("u5", "r1", b"<a/>"), ("u6", "r1", None)]


def files(spark, rows):
    return spark.createDataFrame([(u, r, None if c is None else bytearray(c), 1) for u, r, c in rows], "uri string, revision string, content binary, document_id int")


def known(spark, *revisions):
    return spark.createDataFrame([(r,) for r in revisions], "revision string")


def pairs(spark, *ids):
    """Parents by id, each with two children."""
    parents = spark.createDataFrame([(i, f"p{i}") for i in ids], "id long, name string")
    return {"p": Part(parents, ["id"], {"c": Part(parents.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")), ["id", "n"])})}


def ids(snapshot, table="p"):
    return sorted(r.id for r in snapshot.read(table).collect())


def test_versions_replays_and_pinned_readers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.snapshot().tables() == [] and store.versions() == []
    assert store.commit(pairs(spark, 1, 2, 2)) == 1
    pinned = store.snapshot()
    assert store.commit(pairs(spark, 2, 3)) == 2
    assert store.commit(pairs(spark, 1, 2, 3)) is None and store.versions() == [1, 2]
    assert (ids(pinned), ids(store.snapshot(1)), ids(store.snapshot())) == ([1, 2], [1, 2], [1, 2, 3])
    assert ids(store.snapshot(), "c") == [1, 1, 2, 2, 3, 3]
    assert ids(Store(spark, f"file://{tmp_path}/s").snapshot()) == [1, 2, 3]


@pytest.mark.parametrize("dies", ["_publish", "_manifest"])
def test_killed_writer_leaves_the_former_version(spark, tmp_path, monkeypatch, dies):
    """All is staged, then the writer dies: the former version stays, a new try adds each row once, vacuum clears."""
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(pairs(spark, 1))
    with monkeypatch.context() as m:
        m.setattr(Store, dies, lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.commit(pairs(spark, 1, 2))
    assert store.versions() == [1] and ids(store.snapshot()) == [1]
    assert store.commit(pairs(spark, 1, 2)) == 2
    assert ids(store.snapshot()) == [1, 2] and ids(store.snapshot(), "c") == [1, 1, 2, 2]
    gone = store.vacuum(keep=2)
    assert len(gone) == 2 and ids(store.snapshot(1)) == [1] and ids(store.snapshot()) == [1, 2]


def test_killed_while_writing_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit(pairs(spark, 1))
    bad = pairs(spark, 2)
    bad["p"].children["c"].rows = bad["p"].children["c"].rows.withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.commit(bad)
    assert store.versions() == [1] and ids(store.snapshot()) == [1]


def test_two_writers(spark, tmp_path, monkeypatch):
    """The second to publish finds its version taken, and adds only what the first hasn't."""
    path = f"file://{tmp_path}/s"
    store, other = Store(spark, path), Store(spark, path)
    publish, met = Store._publish, []

    def between(self, version, manifest):
        if self is store and not met:
            met.append(other.commit(pairs(spark, 2, 3)))
        publish(self, version, manifest)

    monkeypatch.setattr(Store, "_publish", between)
    assert store.commit(pairs(spark, 1, 2)) == 2 and met == [1]
    assert ids(store.snapshot(1)) == [2, 3] and ids(store.snapshot()) == [1, 2, 3] and ids(store.snapshot(), "c") == [1, 1, 2, 2, 3, 3]
    monkeypatch.setattr(Store, "_publish", lambda self, version, manifest: (_ for _ in ()).throw(VersionTaken(version)))
    with pytest.raises(VersionTaken):
        store.commit(pairs(spark, 9), attempts=2)


def test_compaction_and_columns(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for i in range(3):
        store.commit(pairs(spark, i))
    before = store.snapshot()
    assert store.compact() == 4 and len(store.snapshot().manifest["tables"]["p"]["folders"]) == 1
    assert ids(store.snapshot()) == ids(before) == [0, 1, 2]
    store.vacuum(keep=1)
    assert store.versions() == [4] and ids(store.snapshot()) == [0, 1, 2]
    with pytest.raises(ValueError, match="columns"):
        store.commit({"p": Part(spark.createDataFrame([(7, 1)], "id long, name int"), ["id"])})


def test_files_documents_and_deferrals(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.commit(file_parts(files(spark, FILES), known(spark, "r1", "r2"))) == 1
    at = store.snapshot()
    size = lambda t: at.read(t).count()
    assert (size("raw_file"), size("source_file"), size("document"), size("node"), size("attachment")) == (3, 5, 2, 3, 1)
    uris = {r.source_file_id: r.uri for r in at.read("source_file").collect()}
    assert sorted((uris[r.source_file_id], r.code) for r in at.read("issue").collect()) == [("u3", MALFORMED), ("u4", UNKNOWN)]
    attachment = at.read("attachment").first()
    node = at.read("node").where(F.col("node_id") == attachment.ref_node_id).first()
    assert (node.tag, node.ord, attachment.ref_node_id_order, attachment.src) == ("b", 2, 2, "x")
    assert store.commit(file_parts(files(spark, FILES), known(spark, "r1", "r2"))) is None
    assert store.commit(file_parts(files(spark, FILES), known(spark, "r1", "r2", "r9"))) == 2
    assert store.snapshot().read("document").count() == 3 and at.read("document").count() == 2
    assert store.commit(file_parts(files(spark, []), known(spark, "r1"))) is None


def test_dangling_reference_fails(spark):
    nodes = spark.createDataFrame([("d", 1, "n")], "document_id string, ord int, node_id string")
    refs = spark.createDataFrame([("d", "n"), ("d", None)], "document_id string, ref string")
    assert sorted((r.ref or "", r.ref_order) for r in local_orders(refs, nodes, "ref").collect()) == [("", None), ("n", 1)]
    with pytest.raises(Exception, match="isn't there"):
        local_orders(spark.createDataFrame([("d", "m")], refs.schema), nodes, "ref").collect()


def test_members_and_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    members = spark.createDataFrame([("a", "m1", "s"), ("a", "m1", "s"), ("a", "m2", "s")], "archive_sha256 string, member string, sha256 string")
    assert store.commit(member_part(members)) == 1 and store.commit(member_part(members)) is None
    records = spark.createDataFrame([("p", "1", "x", ["a", "b"]), ("p", "1", "y", ["a"]), ("q", "1", "x", [])], "provider string, external_id string, payload string, lines array<string>")
    assert store.commit(snapshot_parts(records, ["lines"])) == 2 and store.commit(snapshot_parts(records, ["lines"])) is None
    at = store.snapshot()
    assert [at.read(t).count() for t in ("source_file_member", "provider", "external_document", "snapshot", "part")] == [2, 2, 2, 3, 3]


def test_stored_documents_are_not_parsed_again(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/parsed")
    assert store.commit(file_parts(files(spark, FILES), known(spark, "r1", "r2"), store.snapshot())) == 1
    again = file_parts(files(spark, FILES), known(spark, "r1", "r2"), store.snapshot())
    assert again["document"].rows.isEmpty() and again["document"].children["node"].rows.isEmpty()
    assert store.commit(again) is None
    assert store.commit(file_parts(files(spark, FILES), known(spark, "r1", "r2", "r9"), store.snapshot())) == 2
    whole = Store(spark, f"{tmp_path}/whole")
    whole.commit(file_parts(files(spark, FILES), known(spark, "r1", "r2")))
    whole.commit(file_parts(files(spark, FILES), known(spark, "r1", "r2", "r9")))
    for t in whole.snapshot().tables():
        assert sorted(map(str, store.snapshot().read(t).collect())) == sorted(map(str, whole.snapshot().read(t).collect()))
