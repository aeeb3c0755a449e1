"""The conversation trie: SQL on the smallest tables, brute force on awkward logs, with subtries cut at many sizes."""

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest
from conftest import SF

from chronolex.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn int, role string, text string, digest string, n int, part string, a long"


def brute(rows, seed_every=100, most=6):
    """Nodes as rows of the contract, from a dictionary of all prefixes."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % seed_every) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + v[h:]
    members, ends = {}, {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(tuple(whole[c][:d]), []).append(c)
        ends.setdefault(tuple(whole[c]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[q] for q in children.get(p, [])]
        sums[p] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0))
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children.get(p, [])), *sums[p], hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()) for p, m in members.items()
    )


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()))


def log(seed):
    """Conversations with shared openings, copies, a long one, null and repeated turns, null roles and texts."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 450), 120):
        if rng.random() < 0.3:
            turns = ["hello", "hi", "same", "same", "end"]
        else:
            turns = [rng.choice(["hello", "hi", "é", "", None]) for _ in range(rng.randrange(9))]
        for i, text in enumerate(turns):
            turn = rng.choice([None, i, i]) if rng.random() < 0.2 else i
            rows.append((c, turn, rng.choice(["user", "user", None]), text))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    rows += [(500, i - 70, "user", f"turn {i % 7}") for i in range(200)] + [(501, i - 70, "user", f"turn {i % 7}") for i in range(150)]
    rows += [(None, 1, "user", "no conversation"), (-100, -3, None, "x"), (400, None, "user", "漢" * 30_000)]
    return [(*r, "d", 1, "p", 2) for r in rows]


def test_sql(spark):
    got = ct.op11_conversation_trie(spark, SF)
    sql = duckdb.sql(ct.ORACLE_SQL.replace("FROM conversations", f"FROM '{SF}/conversations.parquet'"))
    assert got.columns == sql.columns
    assert result(got) == sorted(sql.fetchall())


@pytest.mark.parametrize(("most", "bucket_rows"), [(1, 20), (4, 10_000), (60, 7), (5000, 50_000)])
def test_brute_force(spark, most, bucket_rows):
    """Tries of a row, of a few, and of everything: oversized first turns are cut further down each time."""
    rows = log(most)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(ct.conversation_trie(df, most=most, bucket_rows=bucket_rows)) == brute(rows)


def test_only_empty_openings_and_nothing(spark):
    assert ct.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # conversation 1 starts with turns of conversation 0, which doesn't exist, and has fewer turns than it gives away
    rows = [(c, 0, "user", "x", "", 0, "", 0) for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6]
    assert result(ct.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ends_of_many_ranges(spark):
    """One sequence of conversations whose ids fill several ranges."""
    rows = [(c, 9, "user", "same", "", 0, "", 0) for c in range(100, 1_500_000, 271) if zlib.crc32(str(c).encode()) % 6 == 0]
    assert result(ct.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_deep_subtrie_needs_no_recursion():
    n = 50_000
    part = pd.DataFrame({"rep": 1, "copies": 2, "pos": range(1, n + 1), "cut": 1, "a": range(n), "b": range(n), "pa": range(n), "pb": range(n), "chars": 3})
    nodes = ct.build_subtries(part)
    assert nodes["n_leaves"].eq(1).all() and nodes["saved_tokens"].tolist() == [3 * (n - i) for i in range(n)]
