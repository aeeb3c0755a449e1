"""Chains as table functions, drift of metadata, spans of literals."""

import pytest

from chronolex.operators import provenance


def test_chains_are_equi_joins(spark):
    """LATERAL becomes joins on the arguments; chains whose tables aren't there are left out."""
    part = spark.createDataFrame([("s", "lines", 0, "x"), ("s", "lines", 1, "y")], "snapshot_id string, kind string, position long, text string")
    snapshot = spark.createDataFrame([("s", "e", "p")], "snapshot_id string, external_document_id string, payload_sha256 string")
    external = spark.createDataFrame([("e", "prov", "1")], "external_document_id string, provider string, external_id string")
    made = provenance.provenance_functions({"part": part, "snapshot": snapshot, "external_document": external})
    assert set(made) == {"external_provenance", "part_provenance"}
    found = provenance.followed(part.where("position = 1"), made["part_provenance"], "snapshot_id", "position")
    assert [(r.position, r.provider, r.payload_sha256) for r in found.collect()] == [(1, "prov", "p")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_drift_fails(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "k int, sha string, title string")
    same = provenance.unchanged(rows, rows, ["k"], ["sha", "title"])
    assert same.columns == rows.columns and same.count() == 2
    other = spark.createDataFrame([(1, "a", None), (2, "b", "z")], rows.schema)
    with pytest.raises(Exception, match="metadata has drifted"):
        provenance.unchanged(rows, other, ["k"], ["sha", "title"]).collect()
    with pytest.raises(Exception, match="evidence is missing"):
        provenance.unchanged(rows, other.where("k = 1"), ["k"], ["sha"]).collect()


def test_spans(spark):
    df = spark.createDataFrame([(1, "aXaXXa"), (2, None), (3, "none"), (4, "😀X")], "k int, t string")
    assert sorted(map(tuple, provenance.spans(df, "k", "t", "X").collect())) == [(1, 1, 2), (1, 3, 4), (1, 4, 5), (4, 1, 2)]
    assert provenance.spans(df, "k", "t", "aa").count() == 0
