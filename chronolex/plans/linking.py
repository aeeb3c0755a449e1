"""Registered queries of links: signals of texts, sources of texts, relations with their history."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.operators import signals
from chronolex.plans.queries import query
from chronolex.storage import load

_TEXTS = """SELECT o_orderkey AS document, 'part:1' AS locator, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'discussion' END AS relation,
 CASE o_orderkey % 6 WHEN 0 THEN 'concerning ' || lpad(CAST(o_custkey AS VARCHAR), 15, '0') || ' only' WHEN 1 THEN 'the Act  No.' || o_custkey || ' of 1990' WHEN 2 THEN 'see Customer #' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
  WHEN 3 THEN 'amended by s' || lpad(CAST(o_custkey % 100 AS VARCHAR), 14, '0') || '.' WHEN 4 THEN 'amended by Decree ' || (o_custkey % 100) || ';' ELSE 'nothing known' END AS text FROM orders"""
_TARGETS = """SELECT 'law' AS target_kind, lpad(CAST(c_custkey AS VARCHAR), 15, '0') AS target_id, 'law-number-exact' AS signal, 'Act No.' || c_custkey AS value FROM customer UNION ALL SELECT 'law', lpad(CAST(c_custkey AS VARCHAR), 15, '0'), 'law-title-exact', c_name FROM customer
 UNION ALL SELECT 'law_revision', 'R' || s_suppkey, 'amendment-law-number-exact', 'Decree ' || s_suppkey FROM supplier UNION ALL SELECT 'law_revision', 'R' || s_suppkey, 'amendment-law-title-exact', s_name FROM supplier"""
_IDS = """SELECT 'law' AS target_kind, lpad(CAST(c_custkey AS VARCHAR), 15, '0') AS target_id, 'law-id-exact' AS signal, lpad(CAST(c_custkey AS VARCHAR), 15, '0') AS value FROM customer
 UNION ALL SELECT 'law_revision', 'R' || s_suppkey, 'amendment-law-id-exact', 'S' || lpad(CAST(s_suppkey AS VARCHAR), 14, '0') FROM supplier"""


@query(f"""WITH t AS (SELECT * FROM ({_TEXTS}) WHERE relation IS NOT NULL), q AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS squeezed FROM t), n AS (SELECT *, regexp_replace(value, '\\s+', '', 'g') AS name FROM ({_TARGETS})),
     f AS (SELECT document, locator, relation, target_kind, target_id, signal, value FROM q JOIN n ON contains(squeezed, name)
       UNION SELECT document, locator, relation, target_kind, target_id, signal, value FROM (SELECT *, unnest(regexp_extract_all(upper(text), '[0-9A-Z]{{15,}}')) AS token FROM t) JOIN ({_IDS}) ON value = token)
SELECT document, target_kind, target_id, CASE target_kind WHEN 'law' THEN relation ELSE 'amendment-material' END AS relation, CASE WHEN signal LIKE '%title%' THEN 'text-match' ELSE 'identifier-match' END AS basis, signal, value, locator FROM f""")
def link_signals(spark, sf_dir):
    """Texts about every order that name laws (customers) and amending laws (suppliers) by id, number or title."""
    o, key = load(spark, sf_dir, "orders"), F.col("o_custkey")
    padded = lambda c, n: F.lpad(c.cast("string"), n, "0")
    form = F.col("o_orderkey") % 6
    text = (
        F.when(form == 0, F.concat(F.lit("concerning "), padded(key, 15), F.lit(" only")))
        .when(form == 1, F.concat(F.lit("the Act  No."), key.cast("string"), F.lit(" of 1990")))
        .when(form == 2, F.concat(F.lit("see Customer #"), padded(key, 9)))
        .when(form == 3, F.concat(F.lit("amended by s"), padded(key % 100, 14), F.lit(".")))
        .when(form == 4, F.concat(F.lit("amended by Decree "), (key % 100).cast("string"), F.lit(";")))
        .otherwise(F.lit("nothing known"))
    )
    texts = o.select(F.col("o_orderkey").alias("document"), F.lit("part:1").alias("locator"), F.when(F.col("o_orderpriority") != "5-LOW", F.lit("discussion")).alias("relation"), text.alias("text"))
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    laws = c.select(padded(c.c_custkey, 15).alias("law_id"), F.concat(F.lit("Act No."), c.c_custkey.cast("string")).alias("law_num"), F.array("c_name").alias("titles"))
    number = s.s_suppkey.cast("string")
    revisions = s.select(F.concat(F.lit("R"), number).alias("revision_id"), F.concat(F.lit("S"), F.lpad(number, 14, "0")).alias("law_id"), F.concat(F.lit("Decree "), number).alias("law_num"), F.col("s_name").alias("title"))
    return signals.signals(texts, laws, revisions)


@query("""WITH s AS (SELECT l_orderkey AS snapshot, l_suppkey AS document, max(l_shipdate) AS taken_at, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
     b AS (SELECT document, arg_max(snapshot, (taken_at, snapshot)) AS snapshot, arg_max(flag, (taken_at, snapshot)) AS flag FROM s GROUP BY 1),
     k AS (SELECT * FROM b WHERE flag <> 'R')
SELECT document, 'title' AS locator, 'order ' || snapshot AS text FROM k UNION ALL SELECT document, 'part:' || lpad(CAST(l_linenumber AS VARCHAR), 9, '0'), l_linestatus FROM k JOIN lineitem ON l_orderkey = snapshot""")
def latest_text_sources(spark, sf_dir):
    """Suppliers as documents, their orders as snapshots; where the latest has a returned line it is a deletion."""
    line = load(spark, sf_dir, "lineitem")
    snapshots = line.groupBy(F.col("l_orderkey").alias("snapshot"), F.col("l_suppkey").alias("document")).agg(F.max("l_shipdate").alias("taken_at"), F.max("l_returnflag").alias("flag"))
    snapshots = snapshots.select("document", "snapshot", "taken_at", F.concat(F.lit("order "), F.col("snapshot").cast("string")).alias("title"), (F.col("flag") == "R").alias("deleted"))
    return signals.text_sources(snapshots, line.select(F.col("l_orderkey").alias("snapshot"), F.col("l_linenumber").alias("position"), F.col("l_linestatus").alias("text")))


@query("SELECT o_orderkey AS relation_id, o_orderstatus AS state, coalesce(n, 0) AS n_assertions, coalesce(modes, '') AS modes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_linestatus, ',' ORDER BY l_shipdate, l_linenumber) AS modes FROM lineitem WHERE l_quantity > 10 GROUP BY 1) ON l_orderkey = o_orderkey")
def relation_details(spark, sf_dir):
    """Orders as relations, their larger lines as assertions in order of time; those of one time and number stay in the table's order."""
    recorded = F.struct("_metadata.file_path", "_metadata.row_index").alias("recorded")
    assertions = load(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("relation_id"), F.col("l_shipdate").alias("observed_at"), "l_linenumber", recorded, "l_linestatus")
    found = signals.relation_details(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation_id"), F.col("o_orderstatus").alias("state")), assertions)
    return found.select("relation_id", "state", F.size("assertions").cast("long").alias("n_assertions"), F.array_join("assertions.l_linestatus", ",").alias("modes"))
