"""Node tables: trees stored as rows (doc, ord, depth, tag, ...) in depth-first order.

What a node owes to the nodes around it (parent, ancestors, the end of its subtree) follows from one pass over its
document in order, or backwards, with a stack of open nodes: linear in the document, memory of its depth, and no
number of levels in the plan. A document came from one file and is read by one task; documents are dealt by key.
Tables that know parents only, in no order, are resolved by pointer doubling: as many joins as the depth has
binary digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from chronolex.operators.chunk import chunk_identity
from chronolex.storage import discard, materialise

#: Rounds of pointer doubling: paths of up to 2 ** 40 nodes; more means that parents run in a circle.
ROUNDS = 40
#: Rows of a task where a whole stored table is joined or grouped.
TASK_ROWS = 400_000
#: Characters of rendered texts that leave a task at once: nodes inside one another each have the text of all below.
BATCH_CHARS = 1_000_000


def listed(column: pa.Array) -> list:
    """column.to_pylist(), by way of numpy where that gives the same values: it makes an object for each otherwise."""
    if pa.types.is_integer(column.type) and column.null_count:
        values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(object)
        values[column.is_null().to_numpy(zero_copy_only=False)] = None
        return values.tolist()
    kinds = (pa.types.is_integer, pa.types.is_string, *([] if column.null_count else [pa.types.is_boolean]))
    return column.to_numpy(zero_copy_only=False).tolist() if any(k(column.type) for k in kinds) else column.to_pylist()


def streamed(rows: DataFrame, order: list[Column | str], uses: list[str], added: list[StructField], visitor: Callable[[], Callable[..., tuple]], dealt: bool = False) -> DataFrame:
    """rows with columns added by a visitor, which is made anew for each document and called for its rows in order.

    Rows keep their partition and order. dealt says that they already lie by document and in order, as those of
    another pass do that nothing has shuffled or stored since: they are then read as they come.
    """
    names, types = [f.name for f in added], [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, visit = None, None
        for b in batches:
            out: list[tuple] = []
            for doc, *values in zip(*(listed(b.column(c)) for c in ("doc", *uses)), strict=True):
                if visit is None or doc != current:
                    current, visit = doc, visitor()
                out.append(visit(*values))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [*b.schema.names, *names])

    rows = rows if dealt else rows.repartition("doc").sortWithinPartitions("doc", *order)
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *added]))


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left.join(right) as a merge of sorted rows: nodes are many and compress well, so the planner takes a few columns
    of a stored table for small and would send them whole through the driver to be broadcast."""
    return left.join(right.hint("merge"), on, how)


def shares(*tables: DataFrame, most: int = TASK_ROWS) -> int:
    """Into how many tasks stored tables are dealt for some most rows each. The planner goes by bytes of shuffled data
    that compresses well, so the memory of its tasks grows with the table up to many times those bytes."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-sum(t.count() for t in tables) // most))


def numbered(rows: DataFrame, order: list[Column], dealt: bool = False) -> DataFrame:
    """Adds ord, parent, ordinal (among all siblings) and path_index (among those of the tag) to rows (doc, depth, tag, ...).

    order sorts a document's rows depth-first: a parent before its children, keys of deeper levels null above. dealt
    says that a document's rows already lie in one partition; they are sorted there.
    """

    def visitor() -> Callable[..., tuple]:
        n, roots = 0, [0, {}]
        stack: list[list] = []  # depth, ord, number of children, number of children by tag

        def visit(depth: int, tag: str | None) -> tuple:
            nonlocal n
            n += 1
            while stack and stack[-1][0] >= depth:
                stack.pop()
            above = stack[-1] if stack else [0, None, *roots]
            above[2] += 1
            alike = above[3][tag] = above[3].get(tag, 0) + 1
            if not stack:
                roots[0] = above[2]
            stack.append([depth, n, 0, {}])
            return n, above[1], above[2], alike

        return visit

    rows = rows.sortWithinPartitions("doc", *order) if dealt else rows
    return streamed(rows, order, ["depth", "tag"], [StructField(c, IntegerType()) for c in ("ord", "parent", "ordinal", "path_index")], visitor, dealt)


def with_ancestors(nodes: DataFrame, *columns: str, tags: list[str] | None = None) -> DataFrame:
    """Adds ancestors: array of structs (ord, tag and the columns) from the root down to the node itself.

    With tags only the nodes of these tags are in it, so that deep documents don't carry all their levels.
    """
    names = list(dict.fromkeys(["ord", "tag", *columns]))
    item = StructType([nodes.schema[c] for c in names])

    def visitor() -> Callable[..., tuple]:
        stack: list[tuple] = []

        def visit(depth: int, *values) -> tuple:
            while stack and stack[-1][0] >= depth:
                stack.pop()
            if tags is None or values[1] in tags:
                stack.append((depth, dict(zip(names, values, strict=True))))
            return ([v for _, v in stack],)

        return visit

    return streamed(nodes, ["ord"], ["depth", *names], [StructField("ancestors", ArrayType(item))], visitor)


def with_end(nodes: DataFrame) -> DataFrame:
    """Adds end, the first later node that is no deeper (null at the end of the document), and last, the last node of the subtree.

    Read backwards, the nodes still to be met as an end are a stack of falling depths: each is put there once.
    """
    kind = nodes.schema["ord"].dataType

    def visitor() -> Callable[..., tuple]:
        stack: list[tuple] = []  # depth, ord, last

        def visit(depth: int, ord_: int) -> tuple:
            last = ord_
            while stack and stack[-1][0] > depth:
                last = stack.pop()[2]
            end = stack[-1][1] if stack else None
            stack.append((depth, ord_, last))
            return end, last

        return visit

    return streamed(nodes, [F.desc("ord")], ["depth", "ord"], [StructField("end", kind), StructField("last", kind)], visitor)


def with_children(nodes: DataFrame, dealt: bool = False) -> DataFrame:
    """Adds children: the ords of a node's children in order, null for a leaf. Rows leave dealt by document and in order."""

    def visitor() -> Callable[..., tuple]:
        stack: list[tuple] = []  # depth and ord of nodes whose parent is still to come, read backwards

        def visit(depth: int, ord_: int) -> tuple:
            children = []
            while stack and stack[-1][0] > depth:
                children.append(stack.pop()[1])
            stack.append((depth, ord_))
            return (children or None,)

        return visit

    nodes = nodes if dealt else nodes.repartition("doc")
    backwards = nodes.sortWithinPartitions("doc", F.desc("ord"))
    found = streamed(backwards, [], ["depth", "ord"], [StructField("children", ArrayType(nodes.schema["ord"].dataType))], visitor, dealt=True)
    return found.sortWithinPartitions("doc", "ord")


def paths(nodes: DataFrame) -> DataFrame:
    """(doc, ord, path): the steps from the root, each with its place among siblings of the tag."""

    def visitor() -> Callable[..., tuple]:
        stack: list[tuple] = []

        def visit(depth: int, tag: str | None, place: int | None) -> tuple:
            while stack and stack[-1][0] >= depth:
                stack.pop()
            step = "" if tag is None or place is None else f"/{tag}[{place}]"
            stack.append((depth, (stack[-1][1] if stack else "") + step))
            return (stack[-1][1],)

        return visit

    light = nodes.select("doc", "ord", "depth", "tag", "path_index")
    return streamed(light, ["ord"], ["depth", "tag", "path_index"], [StructField("path", StringType())], visitor).select("doc", "ord", "path")


def _doubled(links: DataFrame, keys: list[str], node: str, merge: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """links (keys, node, up, ...) followed to the top: every round takes each link as far again.

    merge gives a column's value from that of the link above and the node's own. A link's up is null once it has
    arrived. Only links that another one leads to are taken through the rounds, in tables of which the earlier ones
    are removed; all others, the most of a usual tree, take their value from the one above at last.
    """
    led_to = links.where(F.col("up").isNotNull()).select(*keys, F.col("up").alias(node)).distinct()
    inner = materialise(matched(links, led_to, [*keys, node], "left_semi"), "links")
    for _ in range(ROUNDS):
        if inner.where(F.col("up").isNotNull()).isEmpty():
            return _followed(links, inner, keys, node, merge)
        moved = _followed(inner.where(F.col("up").isNotNull()), inner, keys, node, merge)
        former, inner = inner, materialise(inner.where(F.col("up").isNull()).unionByName(moved), "links")
        discard(former)
    raise ValueError("parents run in a circle")


def _followed(links: DataFrame, above: DataFrame, keys: list[str], node: str, merge: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """links joined to the ones above them, whose up they take; one that isn't there ends the way."""
    over = above.select(*keys, F.col(node).alias("up"), F.col("up").alias("further"), F.lit(True).alias("there"), *[F.col(c).alias(f"above_{c}") for c in merge])
    met = matched(links, over, [*keys, "up"], "left")
    values = [F.when(F.col("there"), f(F.col(f"above_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c, f in merge.items()]
    return met.select(*keys, node, F.col("further").alias("up"), *values)


def recursive_paths(nodes: DataFrame, keys: list[str], node: str, parent: str, step: Column) -> DataFrame:
    """(keys, node, path, depth): root-to-node paths from parent pointers alone, by pointer doubling.

    A node whose parent isn't in the table is a root. Nodes may come in any order and be any number of levels deep.
    """
    links = nodes.select(*keys, node, F.col(parent).alias("up"), step.alias("path"), F.lit(0).cast("long").alias("depth"))
    done = _doubled(links, keys, node, {"path": F.concat, "depth": lambda above, own: above + own + 1})
    return done.select(*keys, node, "path", "depth")


def nearest_above(nodes: DataFrame, keys: list[str], node: str, parent: str, boundary: Column) -> DataFrame:
    """(keys, node, nearest): the nearest node at or above it that is a boundary, from parent pointers; null if none is.

    Boundaries and roots end the way, so pointers double towards them.
    """
    here = F.coalesce(boundary, F.lit(False))
    links = nodes.select(*keys, node, F.when(~here, F.col(parent)).alias("up"), F.struct(F.when(here, F.col(node)).alias("id")).alias("nearest"))
    done = _doubled(links, keys, node, {"nearest": lambda above, own: above})
    return done.select(*keys, node, F.col("nearest.id").alias("nearest"))


def anchored(nodes: DataFrame, boundaries: list[str], dealt: bool = False) -> DataFrame:
    """Adds anchor (nearest node above or itself with a boundary's tag, else the parent, else itself) and prefix.

    prefix joins the labels of the boundaries and the anchor, from the root on.
    """

    def visitor() -> Callable[..., tuple]:
        stack: list[tuple] = []  # depth, ord, label of every open node
        bounds: list[tuple] = []

        def visit(depth: int, ord_: int, parent: int | None, tag: str | None, label: str | None) -> tuple:
            for s in (stack, bounds):
                while s and s[-1][0] >= depth:
                    s.pop()
            stack.append((depth, ord_, (label or "").strip(" ")))
            if tag in boundaries:
                bounds.append(stack[-1])
            named = bounds or [next((s for s in reversed(stack) if s[1] == parent), stack[-1])]
            return named[-1][1], " > ".join(x for _, _, x in named if x)

        return visit

    return streamed(nodes, ["ord"], ["depth", "ord", "parent", "tag", "label"], [StructField("anchor", nodes.schema["ord"].dataType), StructField("prefix", StringType())], visitor, dealt)


def scoped(nodes: DataFrame, main: str, supplement: str) -> DataFrame:
    """Adds scope: main below the main part, supplementary:<its number> below a numbered supplement, else null; the nearest decides."""
    near = F.try_element_at("ancestors", F.lit(-1))
    scope = F.when(near["tag"] == main, F.lit("main")).when((near["tag"] == supplement) & near["num"].isNotNull(), F.concat(F.lit("supplementary:"), near["num"]))
    return with_ancestors(nodes, "num", tags=[main, supplement]).withColumn("scope", scope).drop("ancestors")


def subtrees(nodes: DataFrame, tag: str) -> DataFrame:
    """(doc, anchor, ord, depth, tag, body): the nodes below every node of the tag, the node itself left out.

    Nodes of the tag inside one another give rows to each. Membership is read off the ancestors, so no range join runs.
    """
    below = with_ancestors(nodes.select("doc", "ord", "depth", "tag", "body"), tags=[tag]).select("doc", "ord", "depth", "tag", "body", F.explode("ancestors").alias("a"))
    return below.where(F.col("a.ord") != F.col("ord")).select("doc", F.col("a.ord").alias("anchor"), "ord", "depth", "tag", "body")


def summed(nodes: DataFrame, wanted: Column, between: str | None = "\n") -> DataFrame:
    """(doc, anchor, end, n_below, n_texts, text) of every wanted node.

    end is the first later node that is no deeper (null at the end of the document); n_below counts the nodes below, n_texts
    those of them with a text. text joins the node's own text and those below in document order; it is null if
    between is. A node is given when the pass comes to its end, so only open subtrees' texts are held, each once.
    """
    texts = between is not None
    kind = nodes.schema["ord"].dataType
    body = F.col("body") if texts else F.when(F.col("body").isNotNull(), F.lit(""))
    light = nodes.select("doc", "ord", "depth", F.coalesce(wanted, F.lit(False)).alias("wanted"), body.alias("body"))
    made = StructType([nodes.schema["doc"], StructField("anchor", kind), StructField("end", kind), StructField("n_below", LongType()), StructField("n_texts", LongType()), StructField("text", StringType())])
    names, types = made.names, [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack, out = None, [], []  # of every open wanted node: depth, ord, nodes below, texts, their number, its own

        def close(end: int | None) -> None:
            _, ord_, below, parts, count, own = stack.pop()
            out.append((current, ord_, end, below, count - own, between.join(parts) if texts else None))
            if stack:
                stack[-1][2] += below + 1
                stack[-1][3] += parts
                stack[-1][4] += count

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            for doc, ord_, depth, want, body in zip(*(listed(b.column(c)) for c in ("doc", "ord", "depth", "wanted", "body")), strict=True):
                if doc != current:
                    while stack:
                        close(None)
                    current = doc
                while stack and stack[-1][0] >= depth:
                    close(ord_)
                there = body is not None
                if want:
                    stack.append([depth, ord_, 0, [body] if there and texts else [], int(there), int(there)])
                elif stack:
                    stack[-1][2] += 1
                    stack[-1][4] += there
                    if there and texts:
                        stack[-1][3].append(body)
            yield rows()
        while stack:
            close(None)
        yield rows()

    return light.repartition("doc").sortWithinPartitions("doc", "ord").mapInArrow(run, made)


def rendered(nodes: DataFrame, tag: str, between: str = "\n", only: Column | None = None) -> DataFrame:
    """(doc, anchor, text): the texts of each such node (only: of those for which it holds) and of all below, in document order."""
    wanted = F.col("tag") == tag
    return summed(nodes, wanted if only is None else wanted & only, between).select("doc", "anchor", "text")


def pieces(segments: pa.ListArray) -> Iterator[tuple[tuple, ...]]:
    """Kind, value and ord of every row's segments, taken from Arrow a column at a time: a dict for each takes most of a pass."""
    flat = segments.flatten()
    named = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    every = zip(*(listed(named[c]) for c in ("kind", "value", "ord")), strict=True)
    for n in listed(segments.value_lengths().fill_null(0)):
        yield tuple(islice(every, n)) if n else ()


def rendered_segments(nodes: DataFrame, wanted: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """(doc, anchor, text): the texts of each element with a wanted tag (None: of every one) and of all below, tails included.

    One pass over a document in order: a node's segments before its first child go out where it begins, those behind
    a child where that child's subtree ends. An element without segments has its cached text; comments and
    instructions have none. Only texts of open wanted nodes are held, and a node inside another gives it one text.
    """
    element = F.coalesce(F.col("kind") == "element", F.lit(False)) if "kind" in nodes.columns else F.lit(True)
    want = element if wanted is None else element & F.coalesce(F.col("tag").isin(wanted), F.lit(False))
    filled = F.coalesce(F.size("segments") > 0, F.lit(False))
    light = nodes.select("doc", "ord", "depth", want.alias("wanted"), F.when(element & filled, F.col("segments")).alias("segments"), F.when(element & ~filled, F.col("body")).alias("body"))
    made = StructType([nodes.schema["doc"], StructField("anchor", nodes.schema["ord"].dataType), StructField("text", StringType())])
    names, types = made.names, [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, 0
        stack: list[tuple] = []  # of every open node: depth, ord, whether wanted, texts of the wanted node at or next above it, its own behind each child
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            out.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def close(least: int) -> Iterator[pa.RecordBatch]:
            """Ends the open nodes from the depth on."""
            nonlocal held
            while stack and stack[-1][0] >= least:
                _, ord_, want, texts, _ = stack.pop()
                above, tails = stack[-1][3:] if stack else (None, None)
                if want:
                    text = "".join(texts)
                    out.append((current, ord_, text))
                    held += len(text)
                    if above is not None:
                        above.append(text)
                if above is not None and tails:
                    above += tails.pop(ord_, ())
                if held > BATCH_CHARS:
                    yield rows()

        for b in batches:
            plain = (listed(b.column(c)) for c in ("doc", "ord", "depth", "wanted", "body"))
            for doc, ord_, depth, want, body, segments in zip(*plain, pieces(b.column("segments")), strict=True):
                if doc != current:
                    yield from close(0)
                    current = doc
                yield from close(depth)
                texts = [] if want else stack[-1][3] if stack else None
                tails: dict[int, list[str]] = {}
                if texts is not None:
                    if body:
                        texts.append(body)
                    to = texts
                    for kind, value, child in segments:
                        if kind == "child":
                            to = to if child is None else tails.setdefault(child, [])
                        elif kind is not None and value:
                            to.append(value)
                stack.append((depth, ord_, want, texts, tails))
            yield rows()
        yield from close(0)
        yield rows()

    light = light if dealt else light.repartition("doc").sortWithinPartitions("doc", "ord")
    return light.mapInArrow(run, made)


def display_labels(nodes: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(doc, ord, tag, label): text of the first child with the title tag that belongs to the node's tag."""
    table = F.create_map(*[F.lit(x) for k, v in titles.items() for x in (k, v)])
    owners = nodes.where(F.col("tag").isin(list(titles))).select("doc", "ord", "tag", table[F.col("tag")].alias("title"))
    children = nodes.where(F.col("tag").isin(list(set(titles.values())))).select("doc", F.col("parent").alias("ord"), F.col("tag").alias("title"), F.col("ord").alias("child"), "body")
    first = children.groupBy("doc", "ord", "title").agg(F.min_by("body", "child").alias("label"))
    return matched(owners, first, ["doc", "ord", "title"], "left").select("doc", "ord", "tag", "label")


def statistics(nodes: DataFrame, main: str, article: str) -> DataFrame:
    """(what, name, n): documents and nodes by tag, greatest depth and size, main parts without an article directly or anywhere."""
    tags = nodes.groupBy("tag").agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("nodes"))
    by_tag = tags.select(F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.col("tag").alias("name"), F.col(c).alias("n")) for w, c in (("documents with tag", "docs"), ("nodes with tag", "nodes"))])).alias("r")).select("r.*")
    sizes = nodes.groupBy("doc").agg(F.count("*").alias("n"), F.max("depth").alias("d")).agg(F.max("n").alias("n"), F.max("d").cast("long").alias("d"))
    largest = sizes.select(F.explode(F.array(F.struct(F.lit("greatest").alias("what"), F.lit("nodes").alias("name"), F.col("n")), F.struct(F.lit("greatest").alias("what"), F.lit("depth").alias("name"), F.col("d").alias("n")))).alias("r")).select("r.*")
    parts = nodes.where(F.col("tag") == main).select("doc", F.col("ord").alias("anchor"))
    inside = matched(subtrees(nodes, main).where(F.col("tag") == article), nodes.select("doc", "ord", "parent"), ["doc", "ord"])
    found = inside.groupBy("doc", "anchor").agg(F.bool_or(F.col("parent") == F.col("anchor")).alias("direct"))
    none = matched(parts, found, ["doc", "anchor"], "left").agg(F.count_if(~F.coalesce("direct", F.lit(False))).alias("direct"), F.count_if(F.col("direct").isNull()).alias("anywhere"))
    bare = none.select(F.explode(F.array(*[F.struct(F.lit("main parts without article").alias("what"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("direct", "anywhere")])).alias("r")).select("r.*")
    return by_tag.union(largest).union(bare)


def anchored_chunks(nodes: DataFrame, boundaries: list[str], most: int = 1200, version: str = "1", dealt: bool = False) -> DataFrame:
    """(doc, chunk, anchor, prefix, first_ord, last_ord, n_units, n_chars, oversize, text, chunk_id).

    Units are nodes with text. Consecutive ones of one anchor are packed, joined by a line break, while the text has
    at most most characters; a unit is never split. Documents are sorted within partitions and read as a stream, so
    only one chunk is held. Anchors and chunks are two passes over the same order: rows are dealt once for both, and
    not at all if they are dealt already (as numbered leaves them).
    """
    if most < 100:
        raise ValueError("a chunk holds at least 100 characters")
    units = anchored(nodes.select("doc", "ord", "parent", "depth", "tag", "label", "body"), boundaries, dealt).where(F.trim(F.coalesce("body", F.lit(""))) != "").select("doc", "ord", "anchor", "prefix", F.trim("body").alias("body"))
    names = ["doc", "chunk", "anchor", "prefix", "first_ord", "last_ord", "n_units", "n_chars", "oversize", "text"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, chunk, held, size = None, 0, [], 0

        def packed() -> tuple:
            return (doc, chunk, held[0][1], held[0][2], held[0][0], held[-1][0], len(held), size, size > most, "\n".join(h[3] for h in held))

        for b in batches:
            rows = []
            for d, o, anchor, prefix, body in zip(*(b[c] for c in ("doc", "ord", "anchor", "prefix", "body")), strict=True):
                if held and (d != doc or anchor != held[0][1] or size + 1 + len(body) > most):
                    rows.append(packed())
                    chunk, held, size = (chunk + 1 if d == doc else 0), [], 0
                if d != doc:
                    doc, chunk = d, 0
                size += len(body) + bool(held)
                held.append((o, anchor, prefix, body))
            yield pd.DataFrame(rows, columns=names)
        if held:
            yield pd.DataFrame([packed()], columns=names)

    kind = {c: nodes.schema[c].dataType.simpleString() for c in ("doc", "ord")}
    schema = f"doc {kind['doc']}, chunk long, anchor {kind['ord']}, prefix string, first_ord {kind['ord']}, last_ord {kind['ord']}, n_units long, n_chars long, oversize boolean, text string"
    made = units.mapInPandas(pack, schema)
    return made.withColumn("chunk_id", chunk_identity(version, most, "doc", "anchor", "first_ord", "last_ord", F.sha2("text", 256)))


def chunk_config(chunks: DataFrame, configured: str | None = None) -> str:
    """The configuration to search: the one named, or the only one there is."""
    found = [r[0] for r in chunks.select("config").distinct().limit(2).collect()]
    if configured is not None:
        if chunks.where(F.col("config") == configured).isEmpty():
            raise ValueError("no chunk has the configuration named")
        return configured
    if len(found) != 1:
        raise ValueError("there must be exactly one chunk configuration")
    return found[0]


def evidence_bundle(contexts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(context_id, position, doc, ord, body): the source nodes of every context, in the context's order.

    contexts: (context_id, doc, sha, ords). A node that is missing, or a context whose nodes' texts don't have its
    sha, fails the query.
    """
    wanted = contexts.select("context_id", "doc", "sha", F.size("ords").alias("n"), F.posexplode("ords").alias("pos", "ord"))
    found = matched(wanted, nodes.select("doc", "ord", "body"), ["doc", "ord"])
    grouped = found.groupBy("context_id", "doc", "sha", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "ord", "body"))).alias("nodes"))  # one context
    whole = matched(contexts.select("context_id"), grouped, ["context_id"], "left")
    text = F.array_join(F.filter("nodes.body", lambda b: F.trim(F.coalesce(b, F.lit(""))) != ""), "\n")
    state = F.when(F.size("nodes") != F.col("n"), "evidence is incomplete").when(F.col("nodes").isNull(), "evidence is missing").when(F.sha2(text, 256) != F.col("sha"), "evidence has changed")
    sound = whole.where(F.when(state.isNull(), True).otherwise(F.raise_error(state).cast("boolean")))
    return sound.select("context_id", "doc", F.explode_outer("nodes").alias("s")).select("context_id", (F.col("s.pos") + 1).cast("long").alias("position"), "doc", F.col("s.ord").alias("ord"), F.col("s.body").alias("body"))
