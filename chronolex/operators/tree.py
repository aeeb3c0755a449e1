"""Ordered trees from marked-up documents, their paths and ancestors, and quality checks over them."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
import xml.parsers.expat as expat
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
COLUMNS = ("doc", "ord", "parent", "ordinal", "path_index", "depth", "kind", "tag", "path", "attributes", "segments", "body")
NODE = "doc long, ord int, parent int, ordinal int, path_index int, depth int, kind string, tag string, path string, attributes map<string,string>, segments array<struct<kind string, value string, ord int>>, body string"


class _Builder:
    """Depth-first numbered nodes of one document."""

    def __init__(self, doc: int):
        self.doc, self.nodes, self.stack = doc, [], []

    def open(self, kind: str, tag: str | None, attributes: dict | None = None) -> dict:
        parent = self.stack[-1] if self.stack else None
        same = ordinal = 1
        if parent:
            parent["n_children"] = ordinal = parent["n_children"] + 1
            alike = parent["alike"]
            alike[kind, tag] = same = alike.get((kind, tag), 0) + 1
        node = {"doc": self.doc, "ord": len(self.nodes) + 1, "parent": parent["ord"] if parent else None, "ordinal": ordinal, "path_index": same, "depth": len(self.stack), "kind": kind, "tag": tag, "attributes": attributes or {}, "segments": [], "n_children": 0, "alike": {}, "body": None}
        node["path"] = (parent["path"] if parent else "") + _step(kind, tag, same)
        if parent:
            parent["segments"].append(("child", None, node["ord"]))
        self.nodes.append(node)
        return node

    def text(self, value: str) -> None:
        if self.stack and value:
            top = self.stack[-1]
            top["segments"].append(("tail" if top["n_children"] else "text", value, None))

    def rows(self) -> list[tuple]:
        out = []
        for n in self.nodes:
            direct = "".join(v for k, v, _ in n["segments"] if v)
            leaf = not n["n_children"]
            n["body"] = n["body"] if n["kind"] != "element" else direct if leaf or direct.strip() else None
            out.append(tuple(n[c] for c in COLUMNS))
        return out


def _step(kind: str, tag: str | None, place: int) -> str:
    """One step of a path; names of a namespace ({uri}local) are tested by both parts."""
    if kind != "element":
        return f"/{'processing-instruction' if kind == 'instruction' else kind}()[{place}]"
    if tag and tag[0] == "{":
        uri, _, local = tag[1:].partition("}")
        return f"/*[local-name()='{local}' and namespace-uri()='{uri}'][{place}]"
    return f"/{tag}[{place}]"


class _Html(HTMLParser):
    """Tolerant: void tags never open, an end tag closes what is open inside it, stray ones are ignored."""

    def __init__(self, doc: int):
        super().__init__(convert_charrefs=True)
        self.b = _Builder(doc)
        self.b.stack.append(self.b.open("element", "#document"))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = self.b.open("element", tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.b.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.b.open("element", tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.b.stack) - 1, 0, -1) if self.b.stack[i]["tag"] == tag), None)
        if at:
            del self.b.stack[at:]

    def handle_data(self, data: str) -> None:
        self.b.text(data)

    def handle_comment(self, data: str) -> None:
        self.b.open("comment", None)["body"] = data


def html_rows(doc: int, source: str) -> list[tuple]:
    parser = _Html(doc)
    parser.feed(source or "")
    parser.close()
    return parser.b.rows()


def xml_rows(doc: int, source: bytes) -> list[tuple] | None:
    """Nodes of a well-formed document, comments and instructions included; None if it isn't well-formed."""
    try:
        root = ET.fromstring(source, parser=ET.XMLParser(target=ET.TreeBuilder(insert_comments=True, insert_pis=True)))
    except ET.ParseError:
        return None
    b = _Builder(doc)
    todo: list[tuple[str, object]] = [("open", root)]
    while todo:  # a stack of its own: documents may be deeper than Python's
        what, e = todo.pop()
        if what == "text":
            b.text(e)
        elif what == "close":
            b.stack.pop()
        elif e.tag is ET.Comment or e.tag is ET.ProcessingInstruction:
            b.open("comment" if e.tag is ET.Comment else "instruction", None)["body"] = e.text
        else:
            b.stack.append(b.open("element", e.tag, dict(e.attrib)))
            b.text(e.text or "")
            todo.append(("close", e))
            for child in reversed(e):
                todo += [("text", child.tail or ""), ("open", child)]
    return b.rows()


def declared_encoding(source: bytes) -> str | None:
    """The encoding named in the XML declaration within the first 512 bytes."""
    m = re.search(rb"<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", source[:512])
    return m[1].decode("ascii") if m else None


def string_value(rows: list[tuple], at: int = 1) -> str:
    """Text of a node and all below in document order, without comments and instructions."""
    by, out, todo = {r[1]: r for r in rows}, [], [("node", at)]
    while todo:
        what, x = todo.pop()
        if what == "text":
            out.append(x)
        elif by[x][6] == "element":
            todo += [("node", o) if k == "child" else ("text", v) for k, v, o in reversed(by[x][10])]
    return "".join(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(COLUMNS)
    plain = [pa.array(c, t) for c, t in zip(columns[:9], (pa.int64(), *[pa.int32()] * 5, *[pa.string()] * 3), strict=True)]
    counts = np.cumsum([0, *map(len, columns[9])], dtype=np.int32)
    pairs = [x for d in columns[9] for x in d.items()]
    attributes = pa.MapArray.from_arrays(counts, pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    ends = np.cumsum([0, *map(len, columns[10])], dtype=np.int32)
    flat = [x for c in columns[10] for x in c]
    parts = [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
    segments = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["kind", "value", "ord"]))
    return pa.RecordBatch.from_arrays([*plain, attributes, segments, pa.array(columns[11], pa.string())], list(COLUMNS))


def _shredded(sources: DataFrame, key: str, column: str, parse: Callable[[int, object], list[tuple] | None], most: int = 20_000) -> DataFrame:
    """Node rows of every source, in batches of about most nodes (a source's nodes are together)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += parse(k, source) or []
                if len(rows) >= most:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return sources.select(F.col(key).cast("long"), column).mapInArrow(run, NODE)


def shred_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Node rows of every page."""
    return _shredded(pages, key, html, html_rows)


def shred_xml_nodes(files: DataFrame, key: str, content: str) -> DataFrame:
    """Node rows of every well-formed document; shred_xml says which failed."""
    return _shredded(files, key, content, lambda k, raw: xml_rows(k, bytes(raw)))


def scan_xml(files: DataFrame, key: str, content: str) -> DataFrame:
    """(doc, ok, n_nodes, max_depth, n_tails, tags): counts of a document read as a stream, without a tree."""
    schema = "doc long, ok boolean, n_nodes long, max_depth int, n_tails long, tags map<string,long>"

    def counted(source: bytes) -> tuple:
        depth = deepest = nodes = tails = 0
        closed, tags = [False], {}

        def start(name: str, _: dict) -> None:
            nonlocal depth, deepest, nodes
            deepest, depth, nodes = max(deepest, depth), depth + 1, nodes + 1
            tags[name] = tags.get(name, 0) + 1
            closed.append(False)

        def end(_: str) -> None:
            nonlocal depth
            depth -= 1
            closed.pop()
            closed[-1] = True

        def text(value: str) -> None:
            nonlocal tails
            tails += closed[-1] and bool(value.strip())

        parser = expat.ParserCreate(namespace_separator="}")
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
        try:
            parser.Parse(source, True)
        except expat.ExpatError:
            return (False, 0, 0, 0, {})
        return (True, nodes, deepest, tails, {("{" + k if "}" in k else k): v for k, v in tags.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(int(k), *counted(bytes(raw))) for k, raw in zip(b[key], b[content], strict=True)], columns=[c.split()[0] for c in schema.split(", ")])

    return files.select(key, content).mapInPandas(run, schema)


def shred_xml(files: DataFrame, key: str, content: str) -> DataFrame:
    """(doc, sha256, status, encoding, n_nodes, max_depth, issue, paths, bodies) of XML documents.

    Malformed ones have status failed, the issue XML_NOT_WELL_FORMED and no nodes.
    """
    schema = "doc long, sha256 string, status string, encoding string, n_nodes int, max_depth int, issue string, paths array<string>, bodies array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, raw in zip(b[key], b[content], strict=True):
                raw = bytes(raw)
                nodes = xml_rows(int(k), raw)
                found = nodes or []
                rows.append((int(k), hashlib.sha256(raw).hexdigest(), "succeeded" if nodes else "failed", declared_encoding(raw), len(found), max((n[5] for n in found), default=0), None if nodes else "XML_NOT_WELL_FORMED", [n[8] for n in found], [n[11] for n in found]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select(key, content).mapInPandas(run, schema)


def local_name(name: Column | str) -> Column:
    """The part of {namespace}name after the namespace."""
    return F.regexp_replace(name, r"^\{[^}]*\}", "")


def attribute(attributes: str, local: str) -> Column:
    """The value of the one attribute with that local name; null if there are none or several."""
    found = F.map_values(F.map_filter(attributes, lambda k, _: local_name(k) == local))
    return F.when(F.size(found) == 1, F.element_at(found, 1))


def attachments(nodes: DataFrame) -> DataFrame:
    """(doc, ord, tag, attribute, src): every attribute with the local name src, empty values kept."""
    found = nodes.select("doc", "ord", "tag", F.explode(F.map_entries("attributes")).alias("a"))
    return found.where(local_name("a.key") == "src").select("doc", "ord", "tag", F.col("a.key").alias("attribute"), F.col("a.value").alias("src"))


def tree_checks(nodes: DataFrame) -> DataFrame:
    """(check_name, violations): one root, contiguous order and ordinals, child segments match nodes, kinds and tags agree.

    What holds within a document comes from one aggregate by document, the rest from aggregates by parent and two joins.
    """
    by_doc = nodes.groupBy("doc").agg(F.count_if(F.col("parent").isNull()).alias("roots"), F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("n"), F.count_if((F.col("kind") == "element") & F.col("tag").isNull()).alias("untagged"))
    counted = by_doc.agg(F.count_if(F.col("roots") != 1).alias("one_root"), F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n"))).alias("order_contiguous"), F.coalesce(F.sum("untagged"), F.lit(0)).alias("elements_have_tags"))
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("violations")) for c in ("one_root", "order_contiguous", "elements_have_tags")])).alias("r")).select("r.*")
    siblings = nodes.where("parent is not null").groupBy("doc", "parent").agg(F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count("*").alias("n")).where("lo <> 1 or hi <> n").agg(F.count("*").alias("violations")).select(F.lit("ordinals_contiguous").alias("check_name"), "violations")
    child = nodes.select("doc", F.explode(F.filter("segments", lambda s: s["kind"] == "child")).alias("s")).select("doc", F.col("s.ord").alias("ord"), F.lit(True).alias("named"))
    placed = nodes.where("parent is not null").select("doc", "ord", F.lit(True).alias("there")).join(child, ["doc", "ord"], "full_outer")
    met = placed.agg(F.count_if(F.col("there").isNull()).alias("child_segments_resolve"), F.count_if(F.col("named").isNull()).alias("nodes_have_segments"))
    return rows.union(siblings).union(met.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("violations")) for c in ("child_segments_resolve", "nodes_have_segments")])).alias("r")).select("r.*"))


def turn_ranges(turns: DataFrame, key: str, order: str, role: str, opener: str) -> DataFrame:
    """For each opener turn, the turns up to the next one: (key, start, end exclusive or null, n)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = turns.withColumn("start", F.max(F.when(F.col(role) == opener, F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("start is not null")
    grouped = marked.groupBy(key, "start").agg(F.count("*").alias("n"))
    return grouped.withColumn("end", F.lead("start").over(Window.partitionBy(key).orderBy("start"))).select(key, "start", "end", "n")
