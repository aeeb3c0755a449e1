"""Node tables: one pass with a stack against brute force, deep and long documents, rendering from segments."""

import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolex.operators import nodes, tree
from chronolex.plans.structure import mixed_content
from chronolex.storage import materialise

SF = "/root/testdata/sf0.001"
SCHEMA = "doc long, ord int, parent int, depth int, tag string, path_index int, label string"


def documents(seed, n_docs=6, size=60):
    rng = random.Random(seed)
    rows = []
    for doc in range(n_docs):
        stack, counts = [], {}
        for ord_ in range(1, rng.randrange(2, size)):
            depth = 0 if ord_ == 1 else rng.randrange(1, len(stack) + 1)
            del stack[depth:]
            parent, tag = stack[-1] if stack else None, rng.choice("abc")
            counts[parent, tag] = counts.get((parent, tag), 0) + 1
            rows.append((doc, ord_, parent, depth, tag, counts[parent, tag], rng.choice([None, "", " x ", tag * 2])))
            stack.append(ord_)
    return rows


@pytest.fixture(scope="module")
def some(spark):
    rows = documents(1)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def above(rows):
    """Ancestors of each node, from the root to itself."""
    parents = {(r[0], r[1]): r[2] for r in rows}
    out = {}
    for doc, ord_ in parents:
        chain = [ord_]
        while parents[doc, chain[0]] is not None:
            chain.insert(0, parents[doc, chain[0]])
        out[doc, ord_] = chain
    return out


def test_ends_and_ancestors(some):
    rows, df = some
    chains, by = above(rows), {(r[0], r[1]): r for r in rows}
    got = {(r.doc, r.ord): r for r in nodes.with_end(df).collect()}
    for (doc, ord_), r in got.items():
        later = [o for d, o in by if d == doc and o > ord_ and by[doc, o][3] <= by[doc, ord_][3]]
        assert r.end == min(later, default=None)
        assert r.last == max(o for d, o in by if d == doc and ord_ in chains[d, o])
    assert len(got) == len(rows)
    assert {(r.doc, r.ord): [a.ord for a in r.ancestors] for r in nodes.with_ancestors(df).collect()} == chains
    kept = {(r.doc, r.ord): [(a.ord, a.tag, a.label) for a in r.ancestors] for r in nodes.with_ancestors(df, "label", tags=["b"]).collect()}
    assert kept == {k: [(o, "b", by[k[0], o][6]) for o in v if by[k[0], o][4] == "b"] for k, v in chains.items()}


def test_numbering(spark, some):
    rows, _ = some
    keys = {k: [x + 1000 for x in v] for k, v in above(rows).items()}
    shuffled = spark.createDataFrame([(r[0], r[3], r[4], keys[r[0], r[1]]) for r in rows], "doc long, depth int, tag string, k array<int>").repartition(3)
    got = sorted((r.doc, r.ord, r.parent, r.depth, r.tag, r.path_index, r.ordinal) for r in nodes.numbered(shuffled, [F.col("k")]).collect())
    children = {}
    for r in rows:
        children.setdefault((r[0], r[2]), []).append(r[1])
    assert got == sorted((*r[:6], children[r[0], r[2]].index(r[1]) + 1) for r in rows)


def test_pointers_double_to_paths_and_boundaries(spark, some):
    rows, df = some
    by = {(r[0], r[1]): r for r in rows}
    step = F.concat(F.lit("/"), "tag", F.lit("["), F.col("path_index").cast("string"), F.lit("]"))
    want = {k: "".join(f"/{by[k[0], o][4]}[{by[k[0], o][5]}]" for o in v) for k, v in above(rows).items()}
    assert {(r.doc, r.ord): r.path for r in nodes.paths(df).collect()} == want
    got = {(r.doc, r.ord): (r.path, r.depth) for r in nodes.recursive_paths(df, ["doc"], "ord", "parent", step).collect()}
    assert got == {k: (p, by[k][3]) for k, p in want.items()}
    near = {(r.doc, r.ord): r.nearest for r in nodes.nearest_above(df, ["doc"], "ord", "parent", F.col("tag") == "c").collect()}
    assert near == {k: next((o for o in reversed(v) if by[k[0], o][4] == "c"), None) for k, v in above(rows).items()}


def test_orphans_end_and_circles_fail(spark, monkeypatch):
    df = spark.createDataFrame([(1, 5, 99, "x"), (1, 6, 5, "y")], "doc long, ord int, parent int, tag string")
    assert {r.ord: (r.path, r.depth) for r in nodes.recursive_paths(df, ["doc"], "ord", "parent", F.col("tag")).collect()} == {5: ("x", 0), 6: ("xy", 1)}
    monkeypatch.setattr(nodes, "ROUNDS", 4)
    circle = spark.createDataFrame([(1, 5, 6, "x"), (1, 6, 5, "y")], df.schema)
    with pytest.raises(ValueError, match="circle"):
        nodes.recursive_paths(circle, ["doc"], "ord", "parent", F.col("tag"))


def test_chain_of_5000(spark):
    chain = spark.range(1, 5001).select(F.lit(1).cast("long").alias("doc"), F.col("id").cast("int").alias("ord"), F.when(F.col("id") > 1, F.col("id") - 1).cast("int").alias("parent"), (F.col("id") - 1).cast("int").alias("depth"), F.lit("n").alias("tag"), F.lit(1).alias("path_index"))
    want = [(n, 5 * n - n) for n in (1, 2, 5000)]  # "/n[1]" for every level
    sizes = lambda df: [tuple(r) for r in df.where("ord in (1, 2, 5000)").select("ord", F.length("path") - F.col("ord")).orderBy("ord").collect()]
    assert sizes(nodes.paths(chain)) == want
    assert sizes(nodes.recursive_paths(chain.repartition(4), ["doc"], "ord", "parent", F.lit("/n[1]"))) == want
    near = nodes.nearest_above(chain, ["doc"], "ord", "parent", F.col("ord") == 3)
    assert near.where("nearest = 3").count() == 4998 and near.where("nearest is null").count() == 2


def test_linear_in_a_document(spark):
    """A document of 200,000 nodes takes ten times as long as one of 20,000, not a hundred times."""

    def seconds(n):
        wide = spark.range(n).select(F.lit(1).cast("long").alias("doc"), F.col("id").cast("int").alias("ord"), F.when(F.col("id") > 0, 1 + F.col("id") % 9).otherwise(0).cast("int").alias("depth"))
        began = time.perf_counter()
        total = nodes.with_end(wide).agg(F.sum("end"), F.count("end")).first()
        return time.perf_counter() - began, total

    seconds(1000)
    small, big = seconds(20_000), seconds(200_000)
    assert big[0] < 3 + 12 * small[0] and big[1][1] > 190_000


MIXED = [b"<a>1<b>2<c>3</c>4</b>5<!-- no --><b/>6<?no no?>7</a>", b"<a><b><c>x</c></b><!--c--></a>", b"<a><b>t<!--c-->u</b>v</a>", b"<a/>", b"<a> <b> </b> </a>", b"<a>" + b"<b>x" * 30 + b"</b>y" * 30 + b"</a>"]


def test_rendering_equals_string_values(spark):
    files = [(i, bytearray(x)) for i, x in enumerate(MIXED)]
    df = tree.shred_xml_nodes(spark.createDataFrame(files, "k long, c binary"), "k", "c")
    want = {(i, n[1]): tree.string_value(tree.xml_rows(i, x), n[1]) for i, x in enumerate(MIXED) for n in tree.xml_rows(i, x) if n[6] == "element"}
    assert {(r.doc, r.anchor): r.text for r in nodes.rendered_segments(df).collect()} == want
    only = {(r.doc, r.anchor): r.text for r in nodes.rendered_segments(df, ["b"]).collect()}
    tags = {(r.doc, r.ord): r.tag for r in df.collect()}
    assert only == {k: v for k, v in want.items() if tags[k] == "b"}


def test_rendering_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    df = tree.shred_html(pages, "page_id", "html")
    want = {}
    for p in pages.collect():
        rows = tree.html_rows(p.page_id, p.html)
        want |= {(p.page_id, n[1]): tree.string_value(rows, n[1]) for n in rows if n[6] == "element"}
    assert {(r.doc, r.anchor): r.text for r in nodes.rendered_segments(df).collect()} == want


def test_cached_text_where_no_segments(spark):
    df = spark.createDataFrame([(1, 1, None, 0, "a", None, "whole"), (2, 1, None, 0, "a", [], None)], "doc long, ord int, parent int, depth int, tag string, segments array<struct<kind string, value string, ord int>>, body string")
    assert {r.doc: r.text for r in nodes.rendered_segments(df).collect()} == {1: "whole", 2: ""}


def test_joins_of_nodes_send_none_through_the_driver(some, spark):
    """A stored table of few bytes may hold many nodes: joins with it are merges, however small it looks."""
    n = materialise(mixed_content(some[1].withColumn("body", F.lit("x"))), "nodes")
    up = nodes.recursive_paths(n, ["doc"], "ord", "parent", F.col("tag"))
    for made in (nodes.rendered_segments(n, ["a"]), nodes.rendered(n, "a"), up):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_chunks_deal_nodes_once(some, spark):
    """Anchors and chunks are passes over one order: one shuffle of stored nodes, none of numbered ones; the same chunks."""
    n = some[1].withColumn("body", F.concat(F.lit("x" * 40), F.col("ord").cast("string")))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    stored = nodes.anchored_chunks(n.drop("path_index"), ["a"], 100)
    numbered = nodes.numbered(n.drop("parent", "path_index").withColumnRenamed("ord", "place"), [F.col("place")])
    fused = nodes.anchored_chunks(numbered, ["a"], 100, dealt=True)
    assert plan(stored).count("Exchange hashpartitioning") == plan(fused).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in stored.collect()} == {tuple(r) for r in fused.collect()}


def test_subtrees_summed_in_one_pass(some):
    """Ends, counts and texts of subtrees, also of nodes inside one another, equal brute force; nodes are dealt once."""
    rows, df = some
    df = df.withColumn("body", F.when(F.col("ord") % 3 > 0, F.concat(F.lit("t"), F.col("ord").cast("string"))))
    chains, by = above(rows), {(r[0], r[1]): r for r in rows}
    text = lambda o: f"t{o}" if o % 3 else None
    want = {}
    for (doc, ord_), r in by.items():
        if r[4] == "b":
            below = sorted(o for d, o in by if d == doc and o != ord_ and ord_ in chains[d, o])
            end = min((o for d, o in by if d == doc and o > ord_ and by[d, o][3] <= r[3]), default=None)
            want[doc, ord_] = (end, len(below), sum(text(o) is not None for o in below), ",".join(x for x in map(text, [ord_, *below]) if x))
    got = nodes.summed(df, F.col("tag") == "b", ",")
    assert {(r.doc, r.anchor): tuple(r)[2:] for r in got.collect()} == want and len(want) > 20
    assert {(r.doc, r.anchor): tuple(r)[2:] for r in nodes.summed(df, F.col("tag") == "b", None).collect()} == {k: (*v[:3], None) for k, v in want.items()}
    some_of = nodes.rendered(df, "b", ",", only=F.col("ord") < 9)
    assert {(r.doc, r.anchor): r.text for r in some_of.collect()} == {k: v[3] for k, v in want.items() if k[1] < 9}
    for made in (got, some_of):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert nodes.summed(df.limit(0), F.lit(True)).count() == 0


def test_rounds_of_doubling_write_inner_nodes_only(some, monkeypatch):
    """Nodes that no other one points to take their value at last and are in no table of a round."""
    rows, df = some
    written = []

    def kept(table, label):
        made = materialise(table, label)
        written.append(made.count())
        return made

    monkeypatch.setattr(nodes, "materialise", kept)
    inner = {(r[0], r[2]) for r in rows if r[2] is not None}
    assert nodes.recursive_paths(df, ["doc"], "ord", "parent", F.col("tag")).count() == len(rows)
    assert len(written) > 1 and set(written) == {len(inner)} and len(inner) < len(rows)


def test_checks_of_broken_nodes_equal_sql_with_bounded_tasks(spark):
    """Every check finds what the SQL finds, in as many tasks as the rows ask for."""
    from chronolex.plans import queries, structure

    n = structure.nodes_of(spark, "/root/testdata/sf0.001").toPandas()
    n = n[n.doc.isin(sorted(n.doc.unique())[:40])].astype({"parent": "Int64"}).astype(object).where(lambda d: d.notna(), None)
    rows = [dict(zip(n.columns, r, strict=True)) for r in n.itertuples(index=False)]
    for i, r in enumerate(rows):
        if i % 97 == 5:
            r["depth"] += 1
        if i % 89 == 7:
            r["tag"] = " "
        if i % 83 == 11 and r["parent"] is not None:
            r["parent"] = 10_000
        if i % 79 == 13:
            r["ordinal"] = 1
        if i % 73 == 17:
            r["body"] = "text"
        if i % 151 == 20:
            r["parent"] = None
    rows += [dict(r) for r in rows[3::101]] + [dict(rows[0], doc=-1, parent=None, ord=1)]
    kind = structure.law_nodes(spark, "/root/testdata/sf0.001").schema
    table = materialise(spark.createDataFrame([tuple(r[f.name] for f in kind) for r in rows], kind), "broken")
    checked = structure.checked(table, most=50)
    got = dict(map(tuple, checked.collect()))
    con = duckdb.connect()
    con.register("n", table.toPandas().astype({"parent": "Int64"}))
    assert got == dict(con.sql("WITH " + queries.ORACLES["node_checks"].removeprefix(structure._NODES + ", ")).fetchall())
    assert all(got.values())
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-len(rows) // 50)}), REPARTITION_BY_NUM" in plan


def test_mixed_content_rendered_in_one_pass(some, spark, monkeypatch):
    """Children, segments and texts, also of nodes inside one another, equal brute force; nodes are dealt once, none are stored."""
    from chronolex.plans import structure

    rows, df = some
    names = {"a": "Article", "b": "Chapter", "c": "Sentence"}
    tagged = df.replace(names, subset="tag").withColumn("body", F.when(F.col("ord") % 5 > 0, F.concat(F.lit("t"), F.col("ord").cast("string"))))
    kids, by = {}, {(r[0], r[1]): r for r in rows}
    for r in rows:
        kids.setdefault((r[0], r[2]), []).append(r[1])

    def text(doc, ord_):
        tag, label, mark = names[by[doc, ord_][4]], by[doc, ord_][6], {"a": ". ", "b": "; ", "c": ""}[by[doc, ord_][4]]
        below = kids.get((doc, ord_), [])
        if not below and tag == "Sentence":
            return f"t{ord_}" if ord_ % 5 else ""
        own = f"{label}: " if mark and label is not None else ""
        return own + "".join(text(doc, k) + mark for k in below)

    assert {(r.doc, r.ord): r.children for r in nodes.with_children(tagged).collect()} == {k: kids.get(k) for k in by}
    want = {k: text(*k) for k in by if by[k][4] != "c"}
    for most in (1_000_000, 5):
        monkeypatch.setattr(nodes, "BATCH_CHARS", most, raising=False)
        made = nodes.rendered_segments(mixed_content(tagged), ["Article", "Chapter"])
        assert {(r.doc, r.anchor): r.text for r in made.collect()} == want
    fused = structure.rendered_mixed(spark, SF)
    assert fused._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert {f.rsplit("/", 2)[-2] for f in fused.inputFiles()} == {"sf0.001"}
    assert nodes.rendered_segments(mixed_content(tagged.limit(0))).count() == 0


def test_segments_behind_children(spark):
    """Texts follow the child named last, however often it is named; a null kind is no text; columns are read as they are."""
    kind = "doc string, ord long, depth int, tag string, kind string, segments array<struct<kind string, value string, ord long>>, body string"
    top = [("text", "A", None), ("child", None, 2), ("tail", "B", None), ("child", None, None), ("tail", "C", None), (None, "no", None), ("child", None, 3), ("child", None, 2), ("tail", "D", None), ("child", None, 3), ("tail", "E", None)]
    df = spark.createDataFrame([("d", 1, 0, "a", "element", top, "no"), ("d", 2, 1, "b", "element", None, "x"), ("d", 3, 1, None, "comment", None, "no"), ("e", 1, 0, "b", "element", [("text", None, None)], "no")], kind)
    assert {(r.doc, r.anchor): r.text for r in nodes.rendered_segments(df).collect()} == {("d", 1): "AxBCDE", ("d", 2): "x", ("e", 1): ""}
    for values in (["a", None, ""], [1, None, 3], [2**62 + 1, None], [True, None], [True, False], [[1], None], [None]):
        column = pa.array(values)
        assert nodes.listed(column) == values and nodes.listed(column[1:]) == values[1:]
