"""The catalogue as a data source, and archives by ranges of bytes, with what is wrong with them."""

import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from chronolex.sources import archives
from chronolex.sources.catalogue import SavedCatalogue, page_rows
from chronolex.streaming.events import drain

ID = "0" * 15 + "_20240101_" + "0" * 15


def save(folder, offset, n, following):
    laws = [{"law_info": {"law_id": f"L{offset + i}", "n": offset + i, "x": None}, "revision_info": None} for i in range(n)]
    (folder / f"offset-{offset}.json").write_text(json.dumps({"laws": laws, "next_offset": following}))


def rows(df):
    return sorted((r.offset, r.position, r.law_id, r.law_info["n"]) for r in df.collect())


def test_pages_are_partitions_and_stream_goes_on(spark, tmp_path):
    spark.dataSource.register(SavedCatalogue)
    read = lambda: spark.read.format("saved-catalogue").load(str(tmp_path))
    save(tmp_path, 0, 3, 3)
    save(tmp_path, 3, 2, 5)
    save(tmp_path, 5, 1, None)
    assert rows(read()) == [(o, i, f"L{o + i}", str(o + i)) for o, n in ((0, 3), (3, 2), (5, 1)) for i in range(n)]
    assert read().select(F.spark_partition_id()).distinct().count() == 3
    assert rows(drain(spark.readStream.format("saved-catalogue").load(str(tmp_path)))) == rows(read())


def test_stream_restarts_behind_what_it_has_read(spark, tmp_path):
    spark.dataSource.register(SavedCatalogue)
    pages = tmp_path / "pages"
    pages.mkdir()

    def run():
        stream = spark.readStream.format("saved-catalogue").load(str(pages))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out"))

    save(pages, 0, 2, 2)
    assert len(run()) == 2
    save(pages, 2, 2, 4)
    save(pages, 4, 1, None)
    assert len(run()) == 5 and len(run()) == 5
    assert run() == rows(spark.read.format("saved-catalogue").load(str(pages)))


@pytest.mark.parametrize(("following", "follower", "last", "message"), [(0, None, False, "invalid"), ("3", None, False, "invalid"), (True, None, False, "invalid"), (4, 3, True, "goes on at 4"), (None, 3, True, "goes on"), (3, None, True, "isn't there")])
def test_offsets_that_do_not_fit_are_refused(following, follower, last, message):
    with pytest.raises(ValueError, match=message):
        list(page_rows({"laws": [], "next_offset": following}, 1, follower, last))


def test_invalid_pages(spark, tmp_path):
    spark.dataSource.register(SavedCatalogue)
    for payload in ({}, {"laws": [{"law_info": {}}]}, {"laws": [3]}):
        with pytest.raises(ValueError, match="no laws|invalid"):
            list(page_rows(payload, 0, None, True))
    save(tmp_path, 2, 1, None)
    with pytest.raises(Exception, match="page at 0"):
        spark.read.format("saved-catalogue").load(str(tmp_path)).collect()
    (tmp_path / "twice").mkdir()
    save(tmp_path / "twice", 2, 1, None)
    with pytest.raises(Exception, match="saved twice"):
        spark.read.format("saved-catalogue").load(str(tmp_path)).collect()


def test_histories(spark, tmp_path):
    spark.dataSource.register(SavedCatalogue)
    (tmp_path / "L1.json").write_text(json.dumps({"law_info": {"law_id": "L1"}, "revisions": [{"law_revision_id": "a", "n": 1}, {"law_revision_id": "b"}]}))
    found = spark.read.format("saved-catalogue").option("kind", "revisions").load(str(tmp_path))
    assert [(r.law_id, r.api_ordinal, r.revision_id) for r in found.orderBy("api_ordinal").collect()] == [("L1", 1, "a"), ("L1", 2, "b")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """One large archive, and one of everything that may be wrong."""
    path = tmp_path_factory.mktemp("zip")
    with zipfile.ZipFile(path / "large.zip", "w") as z:
        for i in range(200):
            z.writestr(zipfile.ZipInfo(f"{i}/{i:015d}{ID[15:]}.xml"), zlib.compress(bytes(3000)) + bytes([i]) * 3000, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    with zipfile.ZipFile(path / "odd.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{ID}.xml", "sound")
        z.writestr(f"again/{ID}.xml", "same id")
        z.writestr("notes.txt", "no revision")
        z.writestr("empty.xml", "")
        z.writestr(f"{'1' + ID[1:]}.xml", "x" * 5_000_000)  # small in the archive
        z.writestr(f"{'2' + ID[1:]}.xml", "will be damaged" * 30)
        z.mkdir("folder")
    raw = (path / "odd.zip").read_bytes()
    with zipfile.ZipFile(path / "odd.zip") as z:
        at = z.getinfo(f"{'2' + ID[1:]}.xml").header_offset + 30 + 49 + 8
    (path / "odd.zip").write_bytes(raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :])
    (path / "no.zip").write_bytes(b"no archive")
    (path / "cut.zip").write_bytes(raw[: len(raw) // 2])
    return f"file://{path}"


def test_one_archive_is_read_by_many_tasks(spark, folder):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = archives.members(spark, f"{folder}/large.zip", split=20_000)
        assert found.select(F.spark_partition_id()).distinct().count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found.count() == 200 and found.where("issue is null and size = length(content)").count() == 200
    assert {bytes(r.content)[-1] for r in found.collect()} == set(range(200))


def test_issues_are_rows(spark, folder):
    found = archives.members(spark, f"{folder}/*.zip", revisions_only=False, most=1_000_000).where("archive not like '%large%'")
    got = sorted((r.archive.rpartition("/")[2], r.member or "", r.issue or "", r.content is not None) for r in found.collect())
    assert [g for g in got if g[0] != "odd.zip"] == [("cut.zip", "", "ARCHIVE_UNREADABLE", False), ("no.zip", "", "ARCHIVE_UNREADABLE", False)]
    odd = {g[1]: g[2:] for g in got if g[0] == "odd.zip"}
    assert odd.pop(f"{'2' + ID[1:]}.xml")[0] in ("CRC_MISMATCH", "MEMBER_UNREADABLE")
    assert odd == {f"{ID}.xml": ("", True), f"again/{ID}.xml": ("", True), "notes.txt": ("", True), "empty.xml": ("", True), f"{'1' + ID[1:]}.xml": ("MEMBER_TOO_LARGE", False)}
    row = archives.inspection(found.where("archive like '%odd%'")).first()
    assert (row.n_members, row.n_revisions, row.n_other, row.n_repeated_names, row.n_repeated_revisions, row.n_issues) == (6, 4, 2, 0, 1, 2)


def test_a_lying_header_makes_no_more_than_the_bound(tmp_path):
    """The size that the directory names isn't trusted."""
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b.xml", bytes(50_000_000))
        m = z.getinfo("b.xml")
    with open(tmp_path / "b.zip", "rb") as f:
        assert archives.inflated(f, m.header_offset, m.compress_size, 8, 1_000_000) == (None, 0, "MEMBER_TOO_LARGE")
        assert archives.inflated(f, 7, 10, 8, 100)[2] == "MEMBER_UNREADABLE"
        content, crc, issue = archives.inflated(f, m.header_offset, m.compress_size, 8, 50_000_000)
    assert (len(content), crc, issue) == (50_000_000, m.CRC, None)
