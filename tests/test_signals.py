"""Signals of links, latest texts, relations with their history."""

from datetime import date

from pyspark.sql import functions as F

from chronolex.operators import linkage, signals
from chronolex.plans.linking import relation_details

A, B = "A" * 15, "0" * 14 + "Z"
LAWS = [(A, "平成十一年法律第一号", ["民法", None, "個人情報 保護法"]), (B, None, None)]
REVISIONS = [("r1", B, "令和二年法律第二号", "改正法")]


def test_every_signal_once(spark):
    texts = [
        ("d1", "title", f"{A.lower()} と個人情報\n保護法、{A}", "discussion"),
        ("d1", "part:1", f"x{A} and {A}9 are longer tokens", "discussion"),
        ("d2", "part:1", "平成十一年 法律第一号を令和二年法律第二号で", "notice"),
        ("d3", "part:1", "民法", "discussion"),  # two characters are too few
        ("d4", "part:1", f"{A} 改正法", None),
        ("d5", "part:1", None, "discussion"),
    ]
    df = spark.createDataFrame(texts, "document string, locator string, text string, relation string")
    laws = spark.createDataFrame(LAWS, "law_id string, law_num string, titles array<string>")
    revisions = spark.createDataFrame(REVISIONS, "revision_id string, law_id string, law_num string, title string")
    got = {tuple(r) for r in signals.signals(df.union(df), laws, revisions).collect()}
    assert got == {
        ("d1", "law", A, "discussion", "identifier-match", "law-id-exact", A, "title"),
        ("d1", "law", A, "discussion", "text-match", "law-title-exact", "個人情報 保護法", "title"),
        ("d2", "law", A, "notice", "identifier-match", "law-number-exact", "平成十一年法律第一号", "part:1"),
        ("d2", "law_revision", "r1", "amendment-material", "identifier-match", "amendment-law-number-exact", "令和二年法律第二号", "part:1"),
    }


def test_latest_texts_leave_deletions_out(spark):
    days = [date(2024, 1, d) for d in (1, 2, 3)]
    snapshots = spark.createDataFrame([("d1", "s1", days[0], "old", False), ("d1", "s2", days[1], "new", None), ("d2", "s3", days[0], "t", False), ("d2", "s4", days[2], None, True), ("d3", "s5", days[0], " ", False)], "document string, snapshot string, taken_at date, title string, deleted boolean")
    parts = spark.createDataFrame([("s1", 1, "a"), ("s2", 2, "c"), ("s2", 1, "b"), ("s2", 3, " "), ("s3", 1, "x"), ("s5", 10, "y")], "snapshot string, position int, text string")
    assert [(r.document, r.locator[-1], r.text) for r in signals.text_sources(snapshots, parts).collect()] == [("d1", "e", "new"), ("d1", "1", "b"), ("d1", "2", "c"), ("d3", "0", "y")]


def test_details_in_order_of_time(spark):
    relations = spark.createDataFrame([("r1", "law"), ("r2", "law")], "relation_id string, kind string")
    assertions = spark.createDataFrame([("r1", date(2024, 2, 1), "rejected"), ("r1", date(2024, 1, 1), "candidate")], "relation_id string, observed_at date, status string")
    got = {r.relation_id: [a.status for a in r.assertions] for r in signals.relation_details(relations, assertions).collect()}
    assert got == {"r1": ["candidate", "rejected"], "r2": []}


def test_names_that_begin_alike_meet_few_texts(spark):
    """A large catalogue is looked up by what tells its names apart, not by a beginning that all of them have."""
    names = spark.range(3000).selectExpr("id AS item_id", "concat('Customer#', lpad(id, 9, '0')) AS text").union(spark.sql("SELECT 9001, 'Act'")).union(spark.sql("SELECT 9002, 'Act No.7'"))
    keys = linkage.rarest_grams(names.selectExpr("text AS name"), 3, 12)
    assert keys.count() == 3002 and keys.where("NOT contains(name, gram)").isEmpty()
    assert keys.groupBy("gram").count().agg({"count": "max"}).first()[0] == 1
    texts = spark.range(0, 3000, 7).selectExpr("id AS doc_id", "concat('see Customer #', lpad(id, 9, '0'), ' of the Act No.', id) AS text")
    got = [{tuple(r) for r in linkage.contained_mentions(texts, names, "doc_id", "item_id", most_chars=most).collect()} for most in (10**7, 0)]
    assert got[0] == got[1] and {(k, 9001) for k in range(0, 3000, 7)} < got[0] and {(k, k) for k in range(0, 3000, 7)} < got[0]


def test_assertions_of_one_time_stay_in_the_tables_order(spark, tmp_path):
    line = spark.createDataFrame([(1, 2, "O", 20.0), (1, 2, "F", 20.0), (1, 1, "X", 20.0), (1, 2, "A", 20.0)], "l_orderkey long, l_linenumber int, l_linestatus string, l_quantity double").withColumn("l_shipdate", F.lit("2024-01-01").cast("timestamp_ntz"))
    line.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT 1L AS o_orderkey, 'F' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.modes for r in relation_details(spark, str(tmp_path)).collect()] == ["X,O,F,A"]
