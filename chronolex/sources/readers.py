"""Readers of the collection's source formats: paged JSON catalogues, archives, minutes, metadata records, PDF marks."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVISION_NAME = re.compile(r"^([0-9A-Z]{15}_[0-9]{8}_[0-9A-Z]{15})\.xml$")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Laws of the saved pages of a catalogue (JSON with laws[] and next_offset), one row each. catalogue_gaps checks the pages."""
    pages = spark.read.schema("total_count long, count long, next_offset long, laws array<struct<law_info: map<string,string>, revision_info: map<string,string>>>").json(path, multiLine=True)
    return pages.select(F.explode("laws").alias("l")).select("l.law_info", "l.revision_info")


def catalogue_gaps(spark: SparkSession, path: str) -> DataFrame:
    """(offset): next offsets of the saved pages at which no page begins. A page begins where the counts before it end."""
    pages = spark.read.schema("total_count long, count long, next_offset long").json(path, multiLine=True)
    starts = pages.select((F.col("next_offset") - F.col("count")).alias("offset"))
    last = pages.where("next_offset is null").select((F.col("total_count") - F.col("count")).alias("offset"))
    return pages.where("next_offset is not null").select(F.col("next_offset").alias("offset")).join(starts.union(last), "offset", "left_anti")


def history_file(spark: SparkSession, path: str) -> DataFrame:
    """Revisions of saved histories (JSON with law_info and revisions[]), with their place from 1."""
    rows = spark.read.schema("law_info map<string,string>, revisions array<map<string,string>>").json(path, multiLine=True)
    return rows.select("law_info", F.posexplode("revisions").alias("pos", "revision")).select("law_info", (F.col("pos") + 1).alias("api_ordinal"), "revision")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """XML members of ZIP archives: (archive, archive_sha256, member, revision_id, crc32, size, member_sha256, content).

    A member that can't be read whole fails the query; archives.members gives it as an issue instead.
    """
    from chronolex.sources import archives

    found = archives.members(spark, path).join(archives.digests(spark, path), "archive")
    sound = found.where(F.when(F.col("issue").isNull(), True).otherwise(F.raise_error(F.col("issue")).cast("boolean")))
    return sound.select("archive", "archive_sha256", "member", "revision_id", "crc32", "size", "member_sha256", "content")


def duplicate_members(members: DataFrame) -> DataFrame:
    """Revision ids found in more than one member."""
    return members.groupBy("revision_id").agg(F.count("*").alias("n")).where("n > 1")


def minutes(spark: SparkSession, path: str) -> DataFrame:
    """Speeches of saved meeting minutes; the record's unknown fields stay in its JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.sha2("value", 256).alias("payload_sha256"))
    speech = "struct<speechID: string, speechOrder: int, speaker: string, speech: string, startPage: int, speechURL: string>"
    meeting = f"struct<meetingRecord: array<struct<issueID: string, session: int, nameOfHouse: string, nameOfMeeting: string, issue: string, date: string, meetingURL: string, pdfURL: string, speechRecord: array<{speech}>>>>"
    m = raw.select("payload_sha256", F.explode(F.from_json("payload", meeting)["meetingRecord"]).alias("m"))
    s = m.select("payload_sha256", "m.issueID", "m.nameOfHouse", "m.nameOfMeeting", F.try_to_date("m.date", "yyyy-MM-dd").alias("held_on"), F.explode("m.speechRecord").alias("s"))
    return s.select("payload_sha256", "issueID", "nameOfHouse", "nameOfMeeting", "held_on", "s.*", F.sha2("s.speech", 256).alias("speech_sha256"))


def metadata_records(files: DataFrame, content: str) -> DataFrame:
    """OAI records of XML answers: (oai_id, datestamp, deleted, fields, metadata_sha256); a deletion is a row without fields."""
    schema = "oai_id string, datestamp string, deleted boolean, fields map<string,array<string>>, metadata_sha256 string"
    local = lambda tag: tag.rpartition("}")[2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b[content]:
                for record in (e for e in ET.fromstring(raw).iter() if local(e.tag) == "record"):
                    header = next(e for e in record if local(e.tag) == "header")
                    head = {local(e.tag): (e.text or "").strip() for e in header}
                    body = next((e for e in record if local(e.tag) == "metadata"), None)
                    deleted = header.get("status") == "deleted"
                    fields: dict[str, list[str]] = {}
                    for e in body.iter() if body is not None and not deleted else ():
                        value = (e.text or "").strip()
                        if value and value not in fields.setdefault(local(e.tag), []):
                            fields[local(e.tag)].append(value)
                    sha = None if deleted or body is None else hashlib.sha256(ET.tostring(body)).hexdigest()
                    rows.append((head.get("identifier"), head.get("datestamp"), deleted, {k: v for k, v in fields.items() if v}, sha))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select(content).mapInPandas(run, schema)


def search_answers(files: DataFrame, content: str, most: int = 10) -> DataFrame:
    """Records of saved answers of a library's search: (n_found, position, schema, fields, record_sha256).

    fields holds the distinct texts of each element by its local name, in order. A diagnostic, an answer without the
    number of records and one of more than most records fail the query.
    """
    schema = "n_found long, position long, schema string, fields map<string,array<string>>, record_sha256 string"
    local = lambda e: e.tag.rpartition("}")[2]

    def rows_of(raw: bytes) -> Iterator[tuple]:
        root = ET.fromstring(raw)
        first = {name: next((e for e in root.iter() if local(e) == name), None) for name in ("diagnostic", "numberOfRecords")}
        if first["diagnostic"] is not None:
            raise ValueError("the search answered: " + " ".join(t.strip() for t in first["diagnostic"].itertext() if t.strip()))
        if first["numberOfRecords"] is None:
            raise ValueError("the answer lacks the number of records")
        records = [e for e in root.iter() if local(e) == "record"]
        if len(records) > most:
            raise ValueError(f"the answer has more than {most} records")
        for i, record in enumerate(records, 1):
            of = {local(e): e for e in record}
            body = of.get("recordData")
            fields: dict[str, list[str]] = {}
            for e in body.iter() if body is not None else ():
                value = (e.text or "").strip()
                if e is not body and value and value not in fields.setdefault(local(e), []):
                    fields[local(e)].append(value)
            place = int(of["recordPosition"].text) if "recordPosition" in of else i
            kind = of["recordSchema"].text if "recordSchema" in of else None
            yield int(first["numberOfRecords"].text), place, kind, {k: v for k, v in fields.items() if v}, hashlib.sha256(ET.tostring(body)).hexdigest() if body is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for raw in b[content] for r in rows_of(bytes(raw))], columns=[c.split()[0] for c in schema.split(", ")])

    return files.select(content).mapInPandas(run, schema)


def pdf_signatures(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, is_pdf, n_byte_ranges, n_signatures): marks of signing, by counting byte patterns as text."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "ISO-8859-1")
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), text.startswith("%PDF-").alias("is_pdf"), count(r"/ByteRange").alias("n_byte_ranges"), count(r"/Type\s*/Sig\b").alias("n_signatures"))


def archive_report(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """(archive, problem): what differs between archives' members and a manifest (archive, sha256, n_members), with repeats.

    No row means that every archive is there with its hash and number of members and no revision comes twice.
    """
    name = F.regexp_extract("archive", r"([^/]+)$", 1)
    found = members.groupBy(name.alias("archive")).agg(F.max("archive_sha256").alias("sha"), F.count("*").alias("n"), F.count_distinct("member").alias("names"))
    both = manifest.join(found, "archive", "full_outer")
    problem = F.when(F.col("sha").isNull(), "missing").when(F.col("sha256").isNull(), "not in the manifest").when(F.col("sha") != F.col("sha256"), "another hash").when(F.col("n") != F.col("n_members"), "another number of members").when(F.col("n") != F.col("names"), "member names repeat")
    twice = members.join(duplicate_members(members), "revision_id", "left_semi").select(name.alias("archive"), F.concat(F.lit("revision repeats: "), "revision_id").alias("problem")).distinct()
    return both.select("archive", problem.alias("problem")).where("problem is not null").union(twice)
