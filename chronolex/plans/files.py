"""Registered queries over files of the collection's formats, written from the tables and read by their readers."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from chronolex.plans.queries import query
from chronolex.sources import archives
from chronolex.sources.catalogue import SavedCatalogue, opened
from chronolex.storage import load, new_path
from chronolex.streaming.events import drain

PER_PAGE = 100


def saved_catalogue(spark, sf_dir) -> str:
    """The customers as saved catalogue pages of a hundred, in order of their keys; keys are dense from 0."""
    c = load(spark, sf_dir, "customer")
    page = (F.floor(F.col("c_custkey") / PER_PAGE) * PER_PAGE).cast("long")
    law = F.struct(F.struct(F.lpad(F.col("c_custkey").cast("string"), 15, "0").alias("law_id"), F.col("c_name").alias("law_title")).alias("law_info"), F.struct(F.col("c_mktsegment").alias("category")).alias("revision_info"))
    total = c.agg((F.max("c_custkey") + 1).alias("total_count"))
    pages = c.groupBy(page.alias("offset")).agg(F.array_sort(F.collect_list(law)).alias("laws"), F.count("*").alias("count")).crossJoin(F.broadcast(total))  # a row
    pages = pages.withColumn("next_offset", F.when(F.col("offset") + F.col("count") < F.col("total_count"), F.col("offset") + F.col("count")))
    path = new_path(spark, "catalogue")
    pages.repartition("offset").write.partitionBy("offset").json(path)
    return path


_LAWS = "SELECT CAST(floor(c_custkey / 100) * 100 AS BIGINT) AS \"offset\", CAST(c_custkey % 100 AS BIGINT) AS position, lpad(CAST(c_custkey AS VARCHAR), 15, '0') AS law_id, c_name AS title, c_mktsegment AS category FROM customer"


def _laws(rows):
    return rows.select("offset", "position", "law_id", F.col("law_info")["law_title"].alias("title"), F.col("revision_info")["category"].alias("category"))


@query(_LAWS)
def catalogue_pages(spark, sf_dir):
    """The saved pages read as a batch, a partition each."""
    spark.dataSource.register(SavedCatalogue)
    return _laws(spark.read.format("saved-catalogue").load(saved_catalogue(spark, sf_dir)))


@query(_LAWS)
def catalogue_stream(spark, sf_dir):
    """The same rows from the stream reader."""
    spark.dataSource.register(SavedCatalogue)
    return drain(_laws(spark.readStream.format("saved-catalogue").load(saved_catalogue(spark, sf_dir))))


def saved_archives(spark, sf_dir) -> str:
    """An archive for each nation, with a member for each of its customers and one that is no revision."""
    path = new_path(spark, "archives")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, target, z = None, None, None
        for b in batches:
            for nation, key, name in zip(b["c_nationkey"], b["c_custkey"], b["c_name"], strict=True):
                if nation != at:
                    if z:
                        z.close()
                        target.close()
                    files, folder = opened(path)
                    files.create_dir(folder, recursive=True)
                    at, target = nation, files.open_output_stream(f"{folder}/nation-{nation}.zip")
                    z = zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED)
                    z.writestr("readme.txt", "no revision")
                z.writestr(f"all/{key:015d}_20240101_{0:015d}.xml", f"<Law>{name}</Law>")
        if z:
            z.close()
            target.close()
        yield pd.DataFrame({"n": [1]})

    rows = load(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.mapInPandas(packed, "n long").count()
    return path


@query("SELECT 'nation-' || c_nationkey || '.zip' AS archive, lpad(CAST(c_custkey AS VARCHAR), 15, '0') || '_20240101_000000000000000' AS revision_id, CAST(length('<Law>' || c_name || '</Law>') AS BIGINT) AS size, sha256('<Law>' || c_name || '</Law>') AS member_sha256, CAST(NULL AS VARCHAR) AS issue FROM customer")
def archive_members(spark, sf_dir):
    """All members of all archives, by ranges of an archive's bytes."""
    found = archives.members(spark, saved_archives(spark, sf_dir), split=4096)
    return found.select(F.regexp_extract("archive", r"([^/]+)$", 1).alias("archive"), "revision_id", "size", "member_sha256", "issue")


@query("SELECT 'nation-' || c_nationkey || '.zip' AS archive, count(*) + 1 AS n_members, count(*) AS n_revisions, CAST(1 AS BIGINT) AS n_other, CAST(0 AS BIGINT) AS n_repeated_names, CAST(0 AS BIGINT) AS n_repeated_revisions, CAST(sum(length(c_name) + 11) + 11 AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS n_issues FROM customer GROUP BY c_nationkey")
def archive_inspection(spark, sf_dir):
    found = archives.inspection(archives.members(spark, saved_archives(spark, sf_dir), revisions_only=False))
    return found.withColumn("archive", F.regexp_extract("archive", r"([^/]+)$", 1)).drop("manifest_sha256")
