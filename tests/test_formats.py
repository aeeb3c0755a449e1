"""Answers of a search, gazette assets, the order of articles."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from chronolex.operators import records
from chronolex.operators.intake import gazette_parts
from chronolex.sinks.store import Store
from chronolex.sources import readers

ANSWER = """<s:r xmlns:s="u"><s:numberOfRecords>37</s:numberOfRecords><s:records><s:record><s:recordSchema>dc</s:recordSchema><s:recordData><d><t xmlns="v"> law </t><t>law</t><c>a</c><c/></d></s:recordData><s:recordPosition>3</s:recordPosition></s:record><s:record><s:recordData><t>b</t></s:recordData></s:record></s:records></s:r>"""


def answers(spark, *texts):
    return readers.search_answers(spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "c binary"), "c")


def test_search_answers(spark):
    got = sorted((r.n_found, r.position, r.schema, r.fields) for r in answers(spark, ANSWER).collect())
    assert got == [(37, 2, None, {"t": ["b"]}), (37, 3, "dc", {"t": ["law"], "c": ["a"]})]
    assert answers(spark, "<r><numberOfRecords>0</numberOfRecords></r>").count() == 0
    many = "<r><numberOfRecords>11</numberOfRecords>" + "<record/>" * 11 + "</r>"
    for text, message in (("<r><diagnostic><message>no such index</message></diagnostic></r>", "no such index"), ("<r/>", "lacks the number"), (many, "more than 10")):
        with pytest.raises(Exception, match=message):
            answers(spark, text).collect()


def test_gazette_assets(spark, tmp_path):
    pdf = b"%PDF-1.7 /FT /Sig /ByteRange [0 1] /Type/DocTimeStamp /ByteRange /SubFilter /ETSI.CAdES.detached"
    schema = "issued_on date, publication_kind string, issue_number int, page_start int, page_end int, url string, content binary"
    rows = [(date(2024, 2, 3), "extra", 7, 1, 2, "u", bytearray(pdf)), (date(2024, 2, 3), "extra", 7, 3, 4, "u2", bytearray(pdf)), (date(2024, 2, 3), "extra", 7, 3, 4, "u2", bytearray(pdf))]
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.commit(gazette_parts(spark.createDataFrame(rows, schema))) == 1
    assert store.commit(gazette_parts(spark.createDataFrame(rows, schema))) is None
    at = store.snapshot()
    assert [r.provider_key for r in at.read("gazette_issue").collect()] == ["derived:2024-02-03:extra:7"]
    assert at.read("gazette_asset").count() == 2
    seen = at.read("certificate_observation").collect()
    assert [(r.signature_field_count, r.document_timestamp_count, r.byte_range_count, r.cades_detached_count, r.verification_status) for r in seen] == [(1, 1, 2, 1, "not-checked")] * 2
    for wrong in (("daily", 7, 1, 2, pdf), ("extra", 0, 1, 2, pdf), ("extra", 7, 2, 1, pdf), ("extra", 7, 1, 2, b"no"), ("extra", 7, 1, 2, None)):
        kind, number, a, b, content = wrong
        with pytest.raises(Exception, match="invalid gazette asset"):
            gazette_parts(spark.createDataFrame([(date(2024, 2, 3), kind, number, a, b, "u", content and bytearray(content))], schema))["gazette_asset"].rows.collect()


def test_articles_in_scopes(spark):
    wanted = [("main", "2"), ("main", "2_1"), ("main", "2_10"), ("main", "2:3"), ("main", "10"), ("main", "x"), ("supplementary:a", "1"), ("supplementary:b", "1"), ("supplementary:b", "1_2:4")]
    df = spark.createDataFrame(wanted[::-1], "scope string, article string")
    got = [tuple(r) for r in df.orderBy(records.scoped_order("scope", "article")).collect()]
    # a range begins with its first side: 2 alone, then 2:3, then its branches
    assert got == sorted(wanted, key=lambda w: (w[0] != "main", w[0], not w[1][0].isdigit(), [[int(x) for x in side.split("_")] for side in w[1].split(":")] if w[1][0].isdigit() else [], w[1]))
    assert got == [tuple(r) for r in df.orderBy(F.desc("scope")).orderBy(records.scoped_order("scope", "article")).collect()]
