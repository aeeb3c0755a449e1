"""Saved pages of a law catalogue and saved revision histories as a Spark data source, for batches and streams.

    spark.dataSource.register(SavedCatalogue)
    spark.read.format("saved-catalogue").option("path", folder).load()
    spark.readStream.format("saved-catalogue").option("path", folder).load()

A page is a file whose path has its offset in it, as offset-<n>.json or offset=<n>/<file>.json. The driver lists
names only: every page is a partition of its own, and the task that reads it checks that its next_offset grows and is
the offset of the page that follows. A stream's position is an offset too; a page that has no follower yet is read
with the page after which it was saved last, and checked against its follower once that is there.
With the option kind=revisions, files <law id>.json are histories instead; these have no order and no stream.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

PAGE = re.compile(r"offset[-=](\d+)(?:\.json|/[^/]+\.json)$")
LAWS = "offset long, position long, law_id string, law_info map<string,string>, revision_info map<string,string>"
REVISIONS = "law_id string, api_ordinal long, revision_id string, revision map<string,string>"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of a local path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if ":" in uri else f"file://{uri}")


def saved_pages(folder: str) -> dict[int, str]:
    """Paths of the saved pages by offset; an offset that was saved twice is refused."""
    files, path = opened(folder)
    found: dict[int, str] = {}
    for f in files.get_file_info(fs.FileSelector(path, recursive=True)):
        m = PAGE.search(f.path)
        if m and f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
            if int(m[1]) in found:
                raise ValueError(f"offset {m[1]} was saved twice")
            found[int(m[1])] = f.path
    return dict(sorted(found.items()))


def _strings(values: dict | None) -> dict[str, str | None]:
    """Values as text; what isn't text stays JSON."""
    return {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (values or {}).items()}


def page_rows(payload: dict, offset: int, follower: int | None, last: bool) -> Iterator[tuple]:
    """Rows of a page; follower is the offset of the page behind it, last says whether there is to be none."""
    items, following = payload.get("laws"), payload.get("next_offset")
    if not isinstance(items, list):
        raise ValueError(f"the page at {offset} has no laws")
    if following is not None and (isinstance(following, bool) or not isinstance(following, int) or following <= offset):
        raise ValueError(f"the page at {offset} has the invalid next offset {following!r}")
    if follower is not None and following != follower:
        raise ValueError(f"the page at {offset} goes on at {following}, saved is {follower}")
    if follower is None and last and following is not None:
        raise ValueError(f"the page at {following} isn't there")
    for i, item in enumerate(items):
        if not isinstance(item, dict) or not isinstance(item.get("law_info"), dict) or not item["law_info"].get("law_id"):
            raise ValueError(f"the item at {offset + i} is invalid")
        yield offset, i, str(item["law_info"]["law_id"]), _strings(item["law_info"]), _strings(item.get("revision_info"))


@dataclass
class Page(InputPartition):
    path: str
    offset: int
    follower: int | None = None
    last: bool = True


class _Reading:
    def __init__(self, options: dict):
        self.folder, self.kind = options["path"], options.get("kind", "laws")

    def _payload(self, path: str) -> dict:
        files, _ = opened(self.folder)
        with files.open_input_stream(path) as f:
            return json.loads(f.read())

    def read(self, partition: Page) -> Iterator[tuple]:
        payload = self._payload(partition.path)
        if self.kind == "laws":
            yield from page_rows(payload, partition.offset, partition.follower, partition.last)
            return
        law = (payload.get("law_info") or {}).get("law_id")
        if not law or not isinstance(payload.get("revisions"), list):
            raise ValueError(f"{partition.path} is no history")
        for i, r in enumerate(payload["revisions"], 1):
            yield str(law), i, r.get("law_revision_id"), _strings(r)


class CatalogueReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Page]:
        if self.kind != "laws":
            files, path = opened(self.folder)
            return [Page(f.path, 0) for f in files.get_file_info(fs.FileSelector(path, recursive=True)) if f.extension == "json" and not f.base_name.startswith(("_", "."))]
        pages = saved_pages(self.folder)
        if pages and 0 not in pages:
            raise ValueError("the page at 0 isn't there")
        return [Page(p, o, follower) for (o, p), follower in zip(pages.items(), [*list(pages)[1:], None], strict=True)]


class CatalogueStream(_Reading, DataSourceStreamReader):
    """Positions are offsets: everything before it has been read."""

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        return {"offset": max(saved_pages(self.folder), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        pages = saved_pages(self.folder)
        if pages and 0 not in pages:
            raise ValueError("the page at 0 isn't there")
        follower = dict(zip(pages, [*list(pages)[1:], None], strict=True))
        # the last page of the batch before is behind us; it must go on where this one starts
        before = max((o for o in pages if o < start["offset"]), default=None)
        if before is not None and follower[before] is not None and follower[before] < end["offset"]:
            following = self._payload(pages[before]).get("next_offset")
            if following != follower[before]:
                raise ValueError(f"the page at {before} goes on at {following}, saved is {follower[before]}")
        return [Page(p, o, follower[o], last=False) for o, p in pages.items() if start["offset"] <= o < end["offset"]]

    def commit(self, end: dict) -> None:
        pass


class SavedCatalogue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved-catalogue"

    def schema(self) -> str:
        kind = self.options.get("kind", "laws")
        if kind not in ("laws", "revisions"):
            raise ValueError("kind is laws or revisions")
        return LAWS if kind == "laws" else REVISIONS

    def reader(self, schema: StructType) -> CatalogueReader:
        return CatalogueReader(dict(self.options))

    def streamReader(self, schema: StructType) -> CatalogueStream:
        if self.options.get("kind", "laws") != "laws":
            raise ValueError("histories have no order, and no stream")
        return CatalogueStream(dict(self.options))
