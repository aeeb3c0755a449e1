"""What becomes of fetched files: raw copies, their registration, documents with nodes and attachments, and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.operators import tree
from chronolex.sinks.store import Part, Snapshot, local_orders
from chronolex.storage import materialise

#: Issue codes.
UNKNOWN, MALFORMED = "REVISION_UNKNOWN", "XML_NOT_WELL_FORMED"


def _digest(*values) -> F.Column:
    return F.sha2(F.concat_ws("\x1f", *values), 256)


def file_parts(files: DataFrame, revisions: DataFrame, stored: Snapshot | None = None) -> dict[str, Part]:
    """What a store takes of files (uri, revision, content), as parts for one commit.

    raw_file holds each content once; source_file says which address and revision had it, and is immutable as its raw
    copy is stored with it. A file whose revision is known and that is well-formed becomes a document with its nodes
    and attachments. Of others the raw copy stays and an issue says why: one whose revision becomes known later is
    a document in a later run. Documents that stored has are not parsed again: a commit would leave them out.
    """
    f = files.select(F.col("uri").cast("string").alias("uri"), F.col("revision").cast("string").alias("revision"), F.col("content").cast("binary").alias("content")).where(F.col("content").isNotNull())
    f = f.withColumn("sha256", F.sha2("content", 256)).withColumn("source_file_id", _digest("uri", "sha256")).withColumn("document_id", _digest("revision", "sha256"))
    known = f.join(revisions.select(F.col("revision").cast("string").alias("revision")).distinct(), "revision", "left_semi").select("document_id", "revision", "sha256", "content")
    if stored is not None and "document" in stored.tables():
        known = known.join(stored.read("document").select("document_id").hint("merge"), "document_id", "left_anti")
    known = materialise(known.dropDuplicates(["document_id"]).withColumn("doc", F.monotonically_increasing_id()), "known")
    nodes = materialise(tree.shred_xml_nodes(known, "doc", "content"), "parsed")
    ids = known.select("doc", "document_id", "revision", "sha256")
    parsed = nodes.groupBy("doc").agg(F.count("*").alias("n_nodes"))
    documents = ids.join(parsed, "doc").select("document_id", "revision", "sha256", "n_nodes")
    placed = nodes.join(ids.select("doc", "document_id"), "doc").withColumn("node_id", _digest("document_id", "path"))
    stored = placed.select("document_id", "ord", "node_id", F.col("parent").alias("parent_ord"), "ordinal", "depth", "kind", "tag", "attributes", "body")
    references = tree.attachments(nodes).join(ids.select("doc", "document_id"), "doc").join(placed.select("document_id", "ord", "node_id"), ["document_id", "ord"])
    attached = local_orders(references.select("document_id", F.col("node_id").alias("ref_node_id"), "attribute", "src"), placed, "ref_node_id")
    issue = lambda d, code: d.select("source_file_id", F.lit(code).alias("code"))
    deferred = f.join(revisions.select(F.col("revision").cast("string").alias("revision")).distinct(), "revision", "left_anti")
    broken = f.join(ids.join(parsed, "doc", "left_anti").select("document_id"), "document_id", "left_semi")
    raw = f.select("sha256", F.octet_length("content").cast("long").alias("size"), "content")
    source = f.select("source_file_id", "uri", "revision", "sha256", F.lit(True).alias("immutable"))
    return {
        "raw_file": Part(raw, ["sha256"]),
        "source_file": Part(source, ["source_file_id"]),
        "document": Part(documents, ["document_id"], {"node": Part(stored, ["document_id", "ord"]), "attachment": Part(attached, ["document_id", "ref_node_id", "attribute"])}),
        "issue": Part(issue(deferred, UNKNOWN).unionByName(issue(broken, MALFORMED)), ["source_file_id", "code"]),
    }


def member_part(members: DataFrame) -> dict[str, Part]:
    """Provenance of archive members (archive_sha256, member, sha256), each once."""
    m = members.select(_digest("archive_sha256", "member", "sha256").alias("member_source_file_id"), "archive_sha256", "member", "sha256")
    return {"source_file_member": Part(m, ["member_source_file_id"])}


def snapshot_parts(records: DataFrame, parts: list[str]) -> dict[str, Part]:
    """Records (provider, external_id, payload, and array columns named by parts) as provider, document, snapshot and part rows.

    A record that comes again with another payload is a new snapshot of the same document; equal ones add nothing.
    """
    r = records.withColumn("external_document_id", _digest("provider", "external_id")).withColumn("payload_sha256", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("snapshot_id", _digest("external_document_id", "payload_sha256"))
    split = [r.select("snapshot_id", F.lit(p).alias("kind"), F.posexplode(p).alias("position", "text")) for p in parts]
    pieces = split[0]
    for s in split[1:]:
        pieces = pieces.unionByName(s)
    return {
        "provider": Part(r.select("provider"), ["provider"]),
        "external_document": Part(r.select("external_document_id", "provider", "external_id"), ["external_document_id"]),
        "snapshot": Part(r.select("snapshot_id", "external_document_id", "payload_sha256"), ["snapshot_id"], {"part": Part(pieces.withColumn("position", F.col("position").cast("long")), ["snapshot_id", "kind", "position"])}),
    }


#: Kinds of a gazette, and the byte patterns that a signed PDF shows.
PUBLICATIONS = ("regular", "extra", "government-procurement", "special-extra", "index")
PATTERNS = {"signature_field_count": r"/FT\s*/Sig\b", "document_timestamp_count": r"/DocTimeStamp\b", "byte_range_count": r"/ByteRange\b", "cades_detached_count": r"/ETSI\.CAdES\.detached\b"}


def gazette_parts(assets: DataFrame) -> dict[str, Part]:
    """Issues, assets and observations of certificates of PDFs (issued_on, publication_kind, issue_number, page_start, page_end, url, content).

    An issue's key is derived from its date, kind and number. Counted patterns are no check of a signature, so the
    status is not-checked. A kind, number, range of pages or content that can't be is refused.
    """
    key = F.concat_ws(":", F.lit("derived"), F.date_format("issued_on", "yyyy-MM-dd"), "publication_kind", F.col("issue_number").cast("string"))
    sound = F.col("publication_kind").isin(list(PUBLICATIONS)) & F.col("issued_on").isNotNull() & (F.col("issue_number") > 0) & (F.col("page_start") > 0) & (F.col("page_end") >= F.col("page_start")) & F.decode(F.substring("content", 1, 5), "ISO-8859-1").eqNullSafe("%PDF-")
    a = assets.where(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(F.lit("invalid gazette asset")).cast("boolean")))
    a = a.withColumn("provider_key", key).withColumn("payload_sha256", F.sha2("content", 256)).withColumn("asset_id", _digest("provider_key", F.col("page_start").cast("string"), F.col("page_end").cast("string"), "payload_sha256"))
    text = F.decode("content", "ISO-8859-1")
    counts = [F.regexp_count(text, F.lit(p)).cast("long").alias(name) for name, p in PATTERNS.items()]
    size = F.octet_length("content").cast("long").alias("byte_size")
    return {
        "gazette_issue": Part(a.select("provider_key", "issued_on", "publication_kind", "issue_number"), ["provider_key"]),
        "gazette_asset": Part(a.select("asset_id", "provider_key", "page_start", "page_end", "url", "payload_sha256", size), ["asset_id"], {"certificate_observation": Part(a.select("asset_id", *counts, F.lit("not-checked").alias("verification_status")), ["asset_id"])}),
    }
