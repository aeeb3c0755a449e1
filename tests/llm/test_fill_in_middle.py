"""Fill-in-middle: SQL on the smallest tables, brute force on awkward texts."""

import hashlib
import random
import re

import duckdb
from conftest import SF

from chronolex.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rate=50, spm_rate=80, seed=42):
    """The three parts and the output, by a list of units."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, None, text)
    if h[3] % 100 < spm_rate:
        return (doc_id, len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_sql(spark):
    got = fim.op12_fill_in_middle(spark, SF)
    sql = duckdb.sql(fim.ORACLE_SQL.replace("FROM documents", f"FROM '{SF}/documents.parquet'"))
    assert got.columns == sql.columns
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())


def test_brute_force_and_round_trip(spark):
    rng = random.Random(5)
    alphabet = ["a", "é", "漢", "😀", " ", "\n", "\t", " ", "\x01", "\x02", "d", "e", "<", "P", ">", "$1", "\\", "<S", "<M>"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randrange(30)))) for i in range(1500)]
    rows += [(None, None), (-3, "\x02d \x01 \x02\x02e"), (-4, " " * 50_000), (-5, "word " * 50_000), (-6, "x" * 100_000), (7, "twice"), (7, "twice")]
    made = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rate=90, spm_rate=50)
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(repr(plainly(i, t, 90, 50)) for i, t in rows)
    back = made.select("doc_id", fim.restored(made.output, made.form).alias("text"))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((i, t or "")) for i, t in rows)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}


def test_awkward(awkward, empty):
    assert fim.fill_in_middle(empty).count() == 0
    got = {tuple(r) for r in fim.fill_in_middle(awkward).collect()}
    assert got == {plainly(r.doc_id, r.text) for r in awkward.collect()}


def test_nothing_is_shuffled_or_sent_to_python(spark):
    plan = fim.op12_fill_in_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
