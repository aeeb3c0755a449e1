"""Members of ZIP archives, an archive's bytes dealt to many tasks.

An archive's central directory says where each member's bytes are. It is read first, by seeking, and gives a row for each
member; these are dealt by archive and range of bytes, so that one large archive is many tasks' work. A task
inflates a member in steps up to a bound on its size, whatever the directory says about it, with the CRC along the way.
What can't be read is a row with an issue and without content, never a failure of the whole run.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.sources.catalogue import opened
from chronolex.sources.readers import REVISION_NAME

STEP = 1 << 20
DIRECTORY = "archive string, member string, place long, revision_id string, header long, packed long, size long, crc32 long, method int, issue string"
MEMBERS = "archive string, member string, place long, revision_id string, crc32 long, size long, member_sha256 string, content binary, issue string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "length")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """The central directories (DIRECTORY) of the archives at path: no member is read. A file that is none has one row with an issue."""
    names = [c.split()[0] for c in DIRECTORY.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b["archive"]:
                files, name = opened(archive)
                try:
                    with files.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                        rows = []
                        for i, m in enumerate(x for x in z.infolist() if not x.is_dir()):
                            found = REVISION_NAME.match(m.filename.rpartition("/")[2])
                            issue = "MEMBER_ENCRYPTED" if m.flag_bits & 1 else None if m.compress_type in (0, 8) else "METHOD_UNSUPPORTED"
                            rows.append((archive, m.filename, i, found[1] if found else None, m.header_offset, m.compress_size, m.file_size, m.CRC, m.compress_type, issue))
                except (zipfile.BadZipFile, OSError, EOFError, ValueError):
                    rows = [(archive, None, 0, None, 0, 0, 0, 0, 0, "ARCHIVE_UNREADABLE")]
                yield pd.DataFrame(rows, columns=names)

    archives = _files(spark, path).select("archive")
    return archives.repartition("archive").mapInPandas(run, DIRECTORY)


def inflated(f, header: int, packed: int, method: int, most: int) -> tuple[bytes | None, int, str | None]:
    """(content, CRC, issue) of the member at header, read in steps; no more than most bytes are ever made."""
    f.seek(header)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        return None, 0, "MEMBER_UNREADABLE"
    f.seek(header + 30 + sum(struct.unpack("<HH", head[26:30])))
    engine = zlib.decompressobj(-15) if method == 8 else None
    out, made, crc, left = [], 0, 0, packed
    try:
        while left > 0:
            block = f.read(min(STEP, left))
            if not block:
                return None, 0, "MEMBER_UNREADABLE"
            left -= len(block)
            while block:
                piece = engine.decompress(block, STEP) if engine else block
                block = engine.unconsumed_tail if engine else b""
                made += len(piece)
                if made > most:
                    return None, 0, "MEMBER_TOO_LARGE"
                crc = zlib.crc32(piece, crc)
                out.append(piece)
        rest = engine.flush() if engine else b""
    except zlib.error:
        return None, 0, "MEMBER_UNREADABLE"
    if made + len(rest) > most:
        return None, 0, "MEMBER_TOO_LARGE"
    return b"".join([*out, rest]), zlib.crc32(rest, crc), None


def members(spark: SparkSession, path: str, revisions_only: bool = True, most: int = 256 << 20, split: int = 32 << 20) -> DataFrame:
    """The members (MEMBERS) of the archives at path: those named as revisions, or all.

    A range of split bytes of an archive is one unit of work. A member of more than most bytes isn't read.
    """
    names = [c.split()[0] for c in MEMBERS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, f = None, None
        for b in batches:
            rows, held = [], 0
            for r in b.itertuples(index=False):
                content, crc, issue = None, r.crc32, r.issue
                if issue is None and r.size > most:
                    issue = "MEMBER_TOO_LARGE"
                if issue is None:
                    if r.archive != at:
                        files, name = opened(r.archive)
                        if f:
                            f.close()
                        at, f = r.archive, files.open_input_file(name)
                    content, crc, issue = inflated(f, r.header, r.packed, r.method, most)
                    if issue is None and (crc != r.crc32 or len(content) != r.size):
                        content, issue = None, "CRC_MISMATCH"
                sha = hashlib.sha256(content).hexdigest() if content is not None else None
                rows.append((r.archive, r.member, r.place, r.revision_id, r.crc32, r.size, sha, content, issue))
                held += len(content or b"")
                if held >= STEP:  # many small members make one batch, a large one is a batch of its own
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if f:
            f.close()

    found = directory(spark, path)
    if revisions_only:
        found = found.where("revision_id is not null or issue = 'ARCHIVE_UNREADABLE'")
    dealt = found.withColumn("range", F.floor(F.col("header") / split)).repartition("archive", "range").sortWithinPartitions("archive", "header")
    return dealt.drop("range").mapInPandas(run, MEMBERS)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(archive, length, archive_sha256), read in steps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shas = []
            for archive in b["archive"]:
                files, name = opened(archive)
                sha = hashlib.sha256()
                with files.open_input_stream(name) as f:
                    while block := f.read(STEP):
                        sha.update(block)
                shas.append(sha.hexdigest())
            yield b.assign(archive_sha256=shas)

    return _files(spark, path).repartition("archive").mapInPandas(run, "archive string, length long, archive_sha256 string")


def inspection(found: DataFrame) -> DataFrame:
    """One row for each archive of members(..., revisions_only=False): what a snapshot is accepted by.

    (archive, n_members, n_revisions, n_other, n_repeated_names, n_repeated_revisions, n_bytes, n_issues, manifest_sha256);
    the manifest is the sorted lines of name, CRC and size, digested by ranges of names first.
    """
    whole = found.where("member is not null")
    names = whole.groupBy("archive", "member").agg(F.count("*").alias("n"))
    repeated = names.groupBy("archive").agg(F.count_if(F.col("n") > 1).alias("n_repeated_names"))
    ids = whole.where("revision_id is not null").groupBy("archive", "revision_id").agg(F.count("*").alias("n"))
    twice = ids.groupBy("archive").agg(F.count_if(F.col("n") > 1).alias("n_repeated_revisions"))
    line = F.concat_ws(":", "member", F.col("crc32").cast("string"), F.col("size").cast("string"))
    parts = whole.groupBy("archive", F.substring(F.sha2("member", 256), 1, 2).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha"))
    manifest = parts.groupBy("archive").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("part", F.lit(":"), "sha"))), "\n"), 256).alias("manifest_sha256"))
    n = found.groupBy("archive").agg(F.count("member").alias("n_members"), F.count("revision_id").alias("n_revisions"), F.count_if(F.col("member").isNotNull() & F.col("revision_id").isNull()).alias("n_other"), F.sum("size").alias("n_bytes"), F.count("issue").alias("n_issues"))
    joined = n.join(repeated, "archive", "left").join(twice, "archive", "left").join(manifest, "archive", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("archive", "n_members", "n_revisions", "n_other", zero("n_repeated_names"), zero("n_repeated_revisions"), "n_bytes", "n_issues", "manifest_sha256")
