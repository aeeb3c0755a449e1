"""The stored trigram index gives the rows of a scan, and reads the query's buckets only."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.functions.text import normalise
from chronolex.operators import search
from chronolex.operators import trigram_index as ti

SCHEMA = "doc long, unit long, text string, prefix string, uid_ string"


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(4)
    alphabet = ["the", "law", "The", "条文", "第", "一", "é", "ß", "Σ", "😀", "a1", "-", "%", "_", " ", "  ", "\t"]
    rows = [(i % 40, i, "".join(rng.choices(alphabet, k=rng.randrange(25))), f"part {i % 7}", "x") for i in range(4000)]
    rows += [(50, 9000, None, None, None), (50, 9001, "", "", ""), (51, 9002, "the law " * 30_000 + "needle", "", ""), (52, 9003, "twice", "", ""), (52, 9003, "twice", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def literal(units, tmp_path_factory):
    return ti.build_index(units, f"file://{tmp_path_factory.mktemp('index')}/a", normalise("text"))


QUERIES = ["the law", "law", "条文第", "第", "😀a1", "Σ", "%_", "needle", " the  law ", "absent from all", "theLAW", "", "twice", "law " * 40 + "needle"]


@pytest.mark.parametrize("q", QUERIES)
def test_literal_search_equals_scan(units, literal, q):
    want = search.lexical_search(units, q, ["doc", "unit"], 200).collect()
    assert literal.lexical_search(q, ["doc", "unit"], 200).collect() == want
    if q in ("the law", "needle", "twice"):
        assert want


def test_candidates_are_few(units, literal):
    """What is fetched holds all matches and little else."""
    q = "条文第一"
    matches = units.where(normalise("text").contains(q)).count()
    assert 0 < matches <= literal.holding(q).count() <= 3 * matches


def test_only_the_buckets_of_the_query_are_read(units, literal):
    grams = ti.codes_of(np.array([ord(c) for c in "needle"])).tolist()
    buckets = set(ti.buckets_of(np.array(grams), literal.bits).tolist())
    assert len(buckets) < 8
    read = literal.of(literal.postings, grams)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} <= buckets
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "gram" in plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    fetched = literal.holding("needle")
    shelves = {r[0] for r in fetched.select("shelf").distinct().collect()}
    assert len(shelves) == 1 and literal.units.select("shelf").distinct().count() > 1


@pytest.mark.parametrize("q", ["the law", "laws and a1", "条文", "é", "nothing like it zzz", "", "- - -"])
@pytest.mark.parametrize("least", [0.12, 0.5])
def test_similarity_equals_scan(spark, units, tmp_path, q, least):
    names = units.where("unit < 1500 or unit > 8999").withColumn("text", F.coalesce("text", F.lit("")))
    index = ti.build_index(names, f"file://{tmp_path}/b", "text", kind="words", bits=3)
    assert index.suggest(q, "doc", "text", least, 50).collect() == search.suggest(names, q, "doc", "text", least, 50).collect()


def test_chunk_search_equals_scan(spark, units, tmp_path):
    index = ti.build_index(units, f"file://{tmp_path}/c", F.concat(normalise("prefix"), F.lit("\n"), normalise("text")))
    scope = spark.range(3, 20).withColumnRenamed("id", "doc")
    for q in ("part 3", "the law", "第"):
        want = search.chunk_lexical_search(search.in_scope(units, scope, ["doc"]), q, ["doc", "unit"], 100).collect()
        assert want and index.chunk_lexical_search(q, ["doc", "unit"], scope, ["doc"], 100).collect() == want


def test_lists_survive_encoding():
    rng = np.random.default_rng(1)
    uids = np.unique(rng.integers(0, 5 << ti.BLOCK_BITS, 60_000))
    grams = rng.choice([3, 1 << 62, 12345], len(uids), p=[0.9, 0.05, 0.05])
    batch = ti.encoded(np.concatenate([grams, grams[:9]]), np.concatenate([uids, uids[:9]]), 6)  # repeats count once
    got = {(g, (b << ti.BLOCK_BITS) + x) for g, _, b, n, d in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in ti.decoded(n, d).tolist()}
    assert got == set(zip(grams.tolist(), uids.tolist(), strict=True))
    assert sum(len(d) for d in batch.column(4).to_pylist()) < 1.2 * len(uids)
    assert ti.encoded(np.empty(0, np.int64), np.empty(0, np.int64), 6).num_rows == 0


def test_lists_written_in_pieces(units, literal, tmp_path):
    """Lists of one block that several flushes wrote are put together."""
    index = ti.build_index(units, f"file://{tmp_path}/p", normalise("text"), held=50)
    assert index.postings.count() > 3 * literal.postings.count()
    for q in ("the law", "条文第", "needle"):
        assert index.lexical_search(q, ["doc", "unit"], 200).collect() == literal.lexical_search(q, ["doc", "unit"], 200).collect()


def test_no_units_and_wrong_kinds(units, tmp_path):
    index = ti.build_index(units.where("false"), f"file://{tmp_path}/d", "text")
    assert index.lexical_search("law", ["doc"]).count() == 0
    with pytest.raises(ValueError, match="words"):
        index.suggest("law", "doc", "text")
    with pytest.raises(ValueError, match="kind"):
        ti.build_index(units, f"file://{tmp_path}/e", "text", kind="other")
