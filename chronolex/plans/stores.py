"""Registered queries over stores with a commit log, filled by several runs, replays included."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.operators.intake import file_parts, snapshot_parts
from chronolex.operators.provenance import followed, provenance_functions, spans
from chronolex.plans.queries import query
from chronolex.sinks.store import Store
from chronolex.storage import load, materialise, new_path


def customer_files(spark, sf_dir):
    """(uri, revision, content): a customer's orders as an XML file; every fiftieth file is cut off."""
    o = load(spark, sf_dir, "orders")
    article = F.concat(F.lit('<Article Num="'), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", '" src="scan.pdf">').otherwise('">'), F.col("o_orderpriority"), F.lit("</Article>"))
    body = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(article)), "").alias("body"))
    xml = F.concat(F.lit("<Law>"), "body", F.when(F.col("o_custkey") % 50 == 7, "</Lav>").otherwise("</Law>"))
    return body.select(F.concat(F.lit("file/"), F.col("o_custkey").cast("string")).alias("uri"), F.col("o_custkey").cast("string").alias("revision"), xml.cast("binary").alias("content"), "o_custkey")


def filled_store(spark, sf_dir):
    """Four runs: every third file, all files, all again, and all once the last tenth of revisions is known."""
    files = materialise(customer_files(spark, sf_dir), "files")
    every = files.select("revision", "o_custkey")
    most = every.where("o_custkey % 10 <> 9")
    store = Store(spark, new_path(spark, "store"))
    for rows, known in ((files.where("o_custkey % 3 = 0"), most), (files, most), (files, most), (files, every)):
        store.commit(file_parts(rows, known, store.snapshot()))
    return store


_FILES = """WITH o AS (SELECT o_custkey AS c, o_custkey % 50 = 7 AS broken, o_custkey % 10 = 9 AS late, o_custkey % 3 = 0 AS first, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS scans FROM orders GROUP BY 1),
     v AS (SELECT 1 AS version UNION ALL SELECT 2 UNION ALL SELECT 3), f AS (SELECT * FROM v, o WHERE version > 1 OR first)"""


@query(_FILES + """, d AS (SELECT * FROM f WHERE NOT broken AND (NOT late OR version = 3))
SELECT version, 'document' AS what, count(*) AS n FROM d GROUP BY 1 UNION ALL SELECT version, 'node', CAST(sum(n + 1) AS BIGINT) FROM d GROUP BY 1 UNION ALL SELECT version, 'attachment', CAST(sum(scans) AS BIGINT) FROM d GROUP BY 1
UNION ALL SELECT version, 'raw_file', count(*) FROM f GROUP BY 1 UNION ALL SELECT version, 'source_file', count(*) FROM f GROUP BY 1
UNION ALL SELECT version, 'issue', count(*) FROM f WHERE late OR broken GROUP BY 1""")
def stored_versions(spark, sf_dir):
    """Rows of every table at every version: the replay makes none, and later runs leave earlier versions as they were.

    A deferral stays on record when its revision becomes known; a broken file has one issue for each reason.
    """
    store = filled_store(spark, sf_dir)
    counts = None
    for v in store.versions():
        at = store.snapshot(v)
        for t in at.tables():
            n = at.read(t).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), F.lit(t).alias("what"), "n")
            counts = n if counts is None else counts.unionByName(n)
    return counts


@query("SELECT o_custkey AS revision, o_orderkey AS num, o_orderpriority AS body FROM orders WHERE o_custkey % 50 <> 7")
def stored_articles(spark, sf_dir):
    """The articles of the last version, from the nodes of its documents."""
    at = filled_store(spark, sf_dir).snapshot()
    n = at.read("node").where("tag = 'Article'").join(at.read("document").select("document_id", "revision"), "document_id")
    return n.select(F.col("revision").cast("long").alias("revision"), F.col("attributes")["Num"].cast("long").alias("num"), "body")


def chains(spark, sf_dir, name: str, *arguments: str, table: str):
    """The provenance of all rows of a table of the filled store."""
    at = filled_store(spark, sf_dir).snapshot()
    functions = provenance_functions({t: at.read(t) for t in at.tables()})
    return followed(at.read(table), functions[name], *arguments)


_XML = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS scan, '<Article Num="' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN '" src="scan.pdf">' ELSE '">' END || o_orderpriority || '</Article>' AS a FROM orders),
     x AS (SELECT CAST(o_custkey AS VARCHAR) AS revision, 'file/' || o_custkey AS uri, '<Law>' || string_agg(a, '' ORDER BY a) || CASE WHEN o_custkey % 50 = 7 THEN '</Lav>' ELSE '</Law>' END AS xml, o_custkey % 50 <> 7 AS sound FROM o GROUP BY o_custkey),
     f AS (SELECT *, sha256(xml) AS sha, CAST(length(xml) AS BIGINT) AS size, sha256(revision || chr(31) || sha256(xml)) AS document_id, sha256(uri || chr(31) || sha256(xml)) AS source_file_id FROM x),
     n AS (SELECT CAST(o_custkey AS VARCHAR) AS revision, CAST(1 + row_number() OVER (PARTITION BY o_custkey ORDER BY a) AS INT) AS ord, 'Article' AS tag, scan FROM o UNION ALL SELECT revision, 1, 'Law', false FROM x)"""


@query(_XML + " SELECT document_id, ord, tag, f.revision, sha AS source_sha256, uri, size FROM f JOIN n ON n.revision = f.revision WHERE sound")
def node_provenance(spark, sf_dir):
    return chains(spark, sf_dir, "node_provenance", "document_id", "ord", table="node")


@query(_XML + " SELECT source_file_id, uri, sha AS sha256, true AS immutable, size, CASE WHEN sound THEN document_id END AS document_id FROM f")
def source_provenance(spark, sf_dir):
    return chains(spark, sf_dir, "source_provenance", "source_file_id", table="source_file")


@query(_XML + " SELECT document_id, 'scan.pdf' AS src, ord, tag, f.revision FROM f JOIN n ON n.revision = f.revision WHERE sound AND scan")
def attachment_provenance(spark, sf_dir):
    return chains(spark, sf_dir, "attachment_provenance", "document_id", table="document")


def document_snapshots(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    store = Store(spark, new_path(spark, "store"))
    store.commit(snapshot_parts(d.select(F.col("source").alias("provider"), F.col("lang").alias("external_id"), F.col("text").alias("payload"), F.split("text", "\n").alias("lines")), ["lines"]))
    at = store.snapshot()
    return {t: at.read(t) for t in at.tables()}


_SNAPSHOTS = """WITH d AS (SELECT DISTINCT source, lang, text, sha256(text) AS payload_sha256, sha256(source || chr(31) || lang) AS external_document_id FROM documents),
     s AS (SELECT *, sha256(external_document_id || chr(31) || payload_sha256) AS snapshot_id FROM d)"""


@query(_SNAPSHOTS + " SELECT external_document_id, source AS provider, lang AS external_id, count(*) AS n_snapshots, min(payload_sha256) AS least_payload FROM s GROUP BY 1, 2, 3")
def external_provenance(spark, sf_dir):
    tables = document_snapshots(spark, sf_dir)
    return followed(tables["external_document"], provenance_functions(tables)["external_provenance"], "external_document_id")


@query(_SNAPSHOTS + " SELECT snapshot_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS position, sha256(unnest(string_split(text, chr(10)))) AS text_sha256, payload_sha256, source AS provider, lang AS external_id FROM s")
def part_provenance(spark, sf_dir):
    tables = document_snapshots(spark, sf_dir)
    return followed(tables["part"], provenance_functions(tables)["part_provenance"], "snapshot_id", "position")


@query("SELECT vec_id, CAST(label AS VARCHAR) AS profile, sha256(text) AS payload_sha256, lang AS external_id, source AS provider FROM embeddings JOIN documents ON doc_id = vec_id")
def embedding_provenance(spark, sf_dir):
    """A vector's document is the one of its id."""
    tables = document_snapshots(spark, sf_dir)
    d = load(spark, sf_dir, "documents")
    external = F.sha2(F.concat_ws("\x1f", "source", "lang"), 256)
    of = d.select(F.col("doc_id").alias("vec_id"), F.sha2(F.concat_ws("\x1f", external, F.sha2("text", 256)), 256).alias("snapshot_id"))
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("profile")).join(of, "vec_id")
    return followed(vectors, provenance_functions(tables | {"embedding": vectors})["embedding_provenance"], "vec_id")


@query("""WITH p AS (SELECT doc_id, string_split(text, 'License') AS parts FROM documents WHERE contains(text, 'License')), i AS (SELECT doc_id, parts, unnest(range(1, len(parts))) AS k FROM p)
SELECT doc_id, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + 7 * (k - 1) AS INT) AS start, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + 7 * k AS INT) AS "end" FROM i""")
def literal_spans(spark, sf_dir):
    """Where a literal stands in every document, by a Python table function called by LATERAL."""
    return spans(load(spark, sf_dir, "documents"), "doc_id", "text", "License")


@query("""WITH t AS (SELECT doc_id, source, lang, text, string_split(text, chr(10)) AS lines FROM documents), s AS (SELECT DISTINCT source, lang, text, len(lines) AS n FROM t)
SELECT 'provider' AS what, count(DISTINCT source) AS n FROM t UNION ALL SELECT 'external_document', count(*) FROM (SELECT DISTINCT source, lang FROM t)
UNION ALL SELECT 'snapshot', count(*) FROM s UNION ALL SELECT 'part', CAST(sum(n) AS BIGINT) FROM s""")
def stored_snapshots(spark, sf_dir):
    """Documents as snapshots of their source and language: each text once, with its lines as parts; stored twice."""
    d = load(spark, sf_dir, "documents")
    records = d.select(F.col("source").alias("provider"), F.col("lang").alias("external_id"), F.col("text").alias("payload"), F.split("text", "\n").alias("lines"))
    store = Store(spark, new_path(spark, "store"))
    store.commit(snapshot_parts(records.where(d.doc_id % 2 == 0), ["lines"]))
    store.commit(snapshot_parts(records, ["lines"]))
    at = store.snapshot()
    counts = [at.read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("what"), "n") for t in at.tables()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
