"""What a question is searched by."""

from chronolex.operators import questions

ASKED = [
    ("民法の時効に関する規定を教えてください", "民法", None, "時効"),
    ("2024年4月時点の民法の消滅時効について", "民法", None, "消滅時効"),
    ("２０２４/４/１の民法", "民法", None, "の"),
    ("民法第７０９条とは", "民法", "709", ""),
    ("現行の損害賠償と不法行為の要件は？", None, None, "損害賠償"),
    ("  民法  ", "民法", None, "民法"),
    ("確認したい内容", None, None, "確認したい内容"),
    ("", "民法", None, ""),
]


def test_channels(spark):
    df = spark.createDataFrame([(i, q, p) for i, (q, p, *_) in enumerate(ASKED)], "i int, q string, p string")
    got = [(r.structural_num, r.query_text) for r in questions.channels(df, "q", "p").orderBy("i").collect()]
    assert got == [(n, t) for _, _, n, t in ASKED]
    assert {r.tag_name for r in questions.channels(df, "q", "p").collect()} == {None, "Article"}


def test_explicit_laws(spark):
    asked = spark.createDataFrame([("0" * 15, 1), ("0" * 14, 2), (None, 3), ("A" * 15, 4)], "law_id string, k int")
    laws = spark.createDataFrame([("0" * 15, "t")], "law_id string, title string")
    assert {r.k: (r.status, r.title) for r in questions.explicit_laws(asked, laws, laws, "law_id").collect()} == {1: ("resolved", "t"), 2: ("invalid", None), 3: ("invalid", None), 4: ("not-found", None)}
