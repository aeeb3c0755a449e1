"""Chains of provenance as SQL table functions over a store's tables, called by LATERAL; spans as a Python table function."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: name -> (parameters, columns, body over the tables in braces); parameters begin with p_.
CHAINS: dict[str, tuple[str, str, str]] = {
    "node_provenance": (
        "p_document STRING, p_ord INT",
        "document_id STRING, ord INT, tag STRING, revision STRING, source_sha256 STRING, uri STRING, size BIGINT",
        "SELECT n.document_id, n.ord, n.tag, d.revision, d.sha256, s.uri, r.size FROM {node} n JOIN {document} d ON d.document_id = n.document_id JOIN {source_file} s ON s.sha256 = d.sha256 AND s.revision = d.revision JOIN {raw_file} r ON r.sha256 = d.sha256 WHERE n.document_id = p_document AND n.ord = p_ord",
    ),
    "source_provenance": (
        "p_source STRING",
        "source_file_id STRING, uri STRING, sha256 STRING, immutable BOOLEAN, size BIGINT, document_id STRING",
        "SELECT s.source_file_id, s.uri, s.sha256, s.immutable, r.size, d.document_id FROM {source_file} s JOIN {raw_file} r ON r.sha256 = s.sha256 LEFT JOIN {document} d ON d.sha256 = s.sha256 AND d.revision = s.revision WHERE s.source_file_id = p_source",
    ),
    "attachment_provenance": (
        "p_document STRING",
        "document_id STRING, src STRING, ord INT, tag STRING, revision STRING",
        "SELECT a.document_id, a.src, n.ord, n.tag, d.revision FROM {attachment} a JOIN {node} n ON n.document_id = a.document_id AND n.ord = a.ref_node_id_order JOIN {document} d ON d.document_id = a.document_id WHERE a.document_id = p_document",
    ),
    "external_provenance": (
        "p_external STRING",
        "external_document_id STRING, provider STRING, external_id STRING, n_snapshots BIGINT, least_payload STRING",
        "SELECT e.external_document_id, e.provider, e.external_id, count(*), min(s.payload_sha256) FROM {external_document} e JOIN {snapshot} s ON s.external_document_id = e.external_document_id WHERE e.external_document_id = p_external GROUP BY 1, 2, 3",
    ),
    "part_provenance": (
        "p_snapshot STRING, p_position BIGINT",
        "snapshot_id STRING, position BIGINT, text_sha256 STRING, payload_sha256 STRING, provider STRING, external_id STRING",
        "SELECT p.snapshot_id, p.position, sha2(p.text, 256), s.payload_sha256, e.provider, e.external_id FROM {part} p JOIN {snapshot} s ON s.snapshot_id = p.snapshot_id JOIN {external_document} e ON e.external_document_id = s.external_document_id WHERE p.snapshot_id = p_snapshot AND p.position = p_position",
    ),
    "embedding_provenance": (
        "p_vector BIGINT",
        "vec_id BIGINT, profile STRING, payload_sha256 STRING, external_id STRING, provider STRING",
        "SELECT v.vec_id, v.profile, s.payload_sha256, e.external_id, e.provider FROM {embedding} v JOIN {snapshot} s ON s.snapshot_id = v.snapshot_id JOIN {external_document} e ON e.external_document_id = s.external_document_id WHERE v.vec_id = p_vector",
    ),
}


def provenance_functions(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Makes the chains whose tables are given into temporary functions; their names in the session, by chain."""
    spark = next(iter(tables.values())).sparkSession
    mark = uuid.uuid4().hex
    views = {t: f"{t}_{mark}" for t in tables}
    for t, rows in tables.items():
        rows.createOrReplaceTempView(views[t])
    made = {}
    for name, (parameters, columns, body) in CHAINS.items():
        try:
            text = body.format(**views)
        except KeyError:
            continue
        made[name] = f"{name}_{mark}"
        spark.sql(f"CREATE TEMPORARY FUNCTION {made[name]}({parameters}) RETURNS TABLE({columns}) RETURN {text}")
    return made


def followed(rows: DataFrame, function: str, *arguments: str) -> DataFrame:
    """The chain of every row: rows joined by LATERAL with the function of these columns; the function's columns only."""
    view = f"asked_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    return rows.sparkSession.sql(f"SELECT f.* FROM {view} a, LATERAL {function}({', '.join(f'a.{x}' for x in arguments)}) f")


def unchanged(rows: DataFrame, current: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows, whose columns must be what current has for their keys: a row that is gone or has another value fails the query."""
    now = current.select(*keys, F.struct(*columns).alias("now_"))
    joined = rows.join(now, keys, "left")
    same: Column = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"now_.{c}"))
    fault = F.when(F.col("now_").isNull(), "evidence is missing").when(~same, "metadata has drifted")
    return joined.where(F.when(fault.isNull(), True).otherwise(F.raise_error(fault).cast("boolean"))).drop("now_")


class _LiteralSpans:
    """Where a literal occurs in a text, left to right and without overlap: offsets in characters, end exclusive."""

    def eval(self, text: str, literal: str) -> Iterator[tuple[int, int]]:
        at = text.find(literal) if text and literal else -1
        while at >= 0:
            yield at, at + len(literal)
            at = text.find(literal, at + len(literal))


literal_spans = udtf(_LiteralSpans, returnType="start int, end int")


def spans(rows: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    """(key, start, end) of every occurrence of the literal, for rows that hold it at all."""
    spark: SparkSession = rows.sparkSession
    name, view = f"literal_spans_{uuid.uuid4().hex}", f"asked_{uuid.uuid4().hex}"
    spark.udtf.register(name, literal_spans)
    rows.where(F.col(text).contains(literal)).select(F.col(key), F.col(text).alias("body_"), F.lit(literal).alias("literal_")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT a.{key}, f.start, f.end FROM {view} a, LATERAL {name}(a.body_, a.literal_) f")
