"""Canonical JSON against Python's, places and budgets of hot groups by brute force, the shared folder."""

import json
import random
import types

import pytest
from pyspark.sql import functions as F

from chronolex import storage
from chronolex.functions.canonical import canonical_json, json_kind
from chronolex.operators import activity, search

WEIRD = 'é"\\\b\f\n\r\t\x00\x1f\x7f/漢😀'


def test_canonical_json(spark):
    rows = [(1, 2.5, True, WEIRD, [1, None], {"b": 1, "a": None, "é": 3, WEIRD: 4}, [({"z": "1", "y": "2"}, None)]), (None,) * 7, (-5, -0.25, False, "", [], {}, [None])]
    schema = "i long, d double, b boolean, s string, a array<int>, m map<string,int>, n array<struct<q map<string,string>, p int>>"
    df = spark.createDataFrame(rows, schema)
    dump = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    fields = [f.name for f in df.schema]
    named = [dict(zip(fields, r, strict=True)) for r in rows]
    for r in named:
        r["n"] = r["n"] and [x and {"q": x[0], "p": x[1]} for x in r["n"]]
    for order in (fields, fields[::-1], ["m", "i", "n", "s", "a", "d", "b"]):
        made = df.select(F.struct(*order).alias("x"))
        assert [r[0] for r in made.select(canonical_json("x", made.schema["x"].dataType)).collect()] == [dump(r) for r in named]


def test_what_has_no_canonical_json(spark):
    df = spark.createDataFrame([(float("nan"), b"x", {1: 1})], "d double, b binary, m map<int,int>")
    with pytest.raises(Exception, match="no such number"):
        df.select(canonical_json("d", df.schema["d"].dataType)).collect()
    for c in ("b", "m"):
        with pytest.raises(TypeError):
            canonical_json(c, df.schema[c].dataType)
    day = spark.sql("SELECT DATE '2024-02-03' AS d, TIMESTAMP '2024-02-03 04:05:06.7' AS t, CAST(1.50 AS DECIMAL(5,2)) AS n")
    assert [day.select(canonical_json(c, day.schema[c].dataType)).first()[0] for c in "dtn"] == ['"2024-02-03"', '"2024-02-03T04:05:06.700000Z"', "1.50"]


def test_kinds_of_json(spark):
    texts = ['{"a":1}', "[1]", '"x"', "1", "1.5", "1e300", "true", "null", "{", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(json_kind("t")).collect()] == ["object", "array", "string", "number", "number", "number", "boolean", "null", None, None]


def test_places_equal_row_numbers(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab") if rng.random() < 0.9 else None, rng.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, d int, k int")
    got = sorted((repr(r.g), r.place, r.k) for r in activity.places(df, "g", [F.asc_nulls_last("d"), "k"]).collect())
    want = []
    for g in {r[0] for r in rows}:
        of = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        want += [(repr(g), i + 1, r[2]) for i, r in enumerate(of)]
    assert got == sorted(want)


@pytest.mark.parametrize("salts", [1, 4, 32])
def test_budget_of_hot_groups(spark, salts):
    """What is left out before the greedy choice is never chosen: equal to the choice from whole groups."""
    rng = random.Random(salts)
    rows = [(g, i, rng.choice([0, 1, 30, 200, 900, 2500, 7000, None]) if g != "flat" else 700, 10 * i + len(g)) for g in ("a", "bb", "flat") for i in range(rng.randrange(300, 900))]
    rows += [("huge", 1, 9000, 1), ("huge", 2, 0, 2), ("one", 1, 5, 3)]
    want = {}
    for g in {r[0] for r in rows}:
        taken, used = [], 0
        for _, _, n, k in sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: r[1]):
            if len(taken) < 8 and (not taken or used + n <= 6000):
                taken.append(k)
                used += n
        want |= {(g, i + 1): (k, used) for i, k in enumerate(taken)}
    df = spark.createDataFrame(rows, "g string, o int, n long, k int").repartition(5)
    assert {(r.g, r.position): (r.k, r.used) for r in search.budgeted(df, "g", "o", "n", "k", salts=salts).collect()} == want


def test_shared_folder():
    """A session without the setting: a local one keeps one temporary folder, a cluster must name one."""
    session = lambda master, found=None: types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: found), sparkContext=types.SimpleNamespace(master=master, applicationId="app-of-test"))
    local = storage.shared_dir(session("local[2]"))
    assert local.startswith("file:///") and storage.shared_dir(session("local[2]")) == local
    assert storage.shared_dir(session("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    with pytest.raises(ValueError, match="must name"):
        storage.shared_dir(session("spark://x"))
