"""Registered queries over a node table: the orders of a customer as one document with provisions, chapters, articles and sentences."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronolex.operators import evidence, quality, search
from chronolex.operators import nodes as tree
from chronolex.plans.queries import page_tree_nodes, query
from chronolex.storage import load, materialise, replace_partitions, shared_dir, small_batches

PARTS = ("MainProvision", "SupplProvision", "AppendixTable")
BOUNDARIES = ["MainProvision", "SupplProvision", "Chapter", "Article"]
#: Chunks hold so many characters here, so that articles split.
MOST = 100


def law_nodes(spark, sf_dir):
    """(doc, ord, parent, ordinal, path_index, depth, tag, num, label, body). Rows are dealt by document as keys and numbers, in tasks by their number; texts are made there."""
    o, line = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    tasks = tree.shares(o, line)
    part = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    o = o.select(F.col("o_custkey").alias("doc"), part.alias("k1"), F.year("o_orderdate").alias("k2"), F.col("o_orderkey").cast("long").alias("k3"), F.month("o_orderdate").cast("string").alias("month"), "o_orderstatus")
    level = lambda d, depth, *columns: d.select("doc", F.lit(depth).alias("depth"), *columns)
    roots = level(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), "c_name"), 0, F.col("c_name").alias("word"))
    parts = level(o.select("doc", "k1", "o_orderstatus").distinct(), 1, "k1", F.col("o_orderstatus").alias("word"))
    chapters = level(o.select("doc", "k1", "k2").distinct(), 2, "k1", "k2")
    articles = level(o, 3, "k1", "k2", "k3", F.col("month").alias("word"))
    lines = line.select(F.col("l_orderkey").cast("long").alias("k3"), F.col("l_linenumber").cast("long").alias("k4"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("quantity"))
    sentences = level(lines.join(o, "k3"), 4, "k1", "k2", "k3", "k4", "l_partkey", "l_suppkey", "quantity")
    rows = roots
    for below in (parts, chapters, articles, sentences):
        rows = rows.unionByName(below, allowMissingColumns=True)
    rows = rows.repartition(tasks, "doc")
    word, year, at = F.col("word").cast("string"), F.col("k2").cast("string"), F.col("depth")
    of_part = F.element_at(F.array(*[F.lit(p) for p in PARTS]), F.col("k1") + 1)
    tag = F.when(at == 0, "Law").when(at == 1, of_part).when(at == 2, "Chapter").when(at == 3, "Article").otherwise("Sentence")
    text = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" from supplier "), F.col("l_suppkey").cast("string"), F.lit(" of "), F.col("quantity").cast("string"))
    rows = rows.select(
        "doc", "depth", "k1", "k2", "k3", "k4", tag.alias("tag"),
        F.when(at.isin(1, 3), word).when(at == 2, year).when(at == 4, F.col("k4").cast("string")).alias("num"),
        F.when(at == 0, word).when(at == 1, of_part).when(at == 2, F.concat(F.lit("Chapter "), year)).when(at == 3, F.concat(F.lit("Article "), word)).alias("label"),
        text.alias("body"),
    )
    order = [F.asc_nulls_first(c) for c in ("k1", "k2", "k3", "k4", "body")]
    return tree.numbered(rows, order, dealt=True).drop("k1", "k2", "k3", "k4")


def nodes_of(spark, sf_dir):
    return materialise(law_nodes(spark, sf_dir), "law_nodes")


_NODES = """
WITH RECURSIVE o AS (SELECT o_custkey AS doc, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS k1, year(o_orderdate) AS k2, o_orderkey AS k3, CAST(month(o_orderdate) AS VARCHAR) AS m, o_orderstatus AS s FROM orders),
     raw AS (SELECT c_custkey AS doc, 0 AS depth, CAST(NULL AS BIGINT) AS k1, CAST(NULL AS BIGINT) AS k2, CAST(NULL AS BIGINT) AS k3, CAST(NULL AS BIGINT) AS k4, 'Law' AS tag, CAST(NULL AS VARCHAR) AS num, c_name AS label, CAST(NULL AS VARCHAR) AS body FROM customer
       UNION ALL SELECT DISTINCT doc, 1, k1, NULL, NULL, NULL, ['MainProvision', 'SupplProvision', 'AppendixTable'][k1 + 1], s, ['MainProvision', 'SupplProvision', 'AppendixTable'][k1 + 1], NULL FROM o
       UNION ALL SELECT DISTINCT doc, 2, k1, k2, NULL, NULL, 'Chapter', CAST(k2 AS VARCHAR), 'Chapter ' || k2, NULL FROM o
       UNION ALL SELECT doc, 3, k1, k2, k3, NULL, 'Article', m, 'Article ' || m, NULL FROM o
       UNION ALL SELECT doc, 4, k1, k2, k3, l_linenumber, 'Sentence', CAST(l_linenumber AS VARCHAR), NULL, 'part ' || l_partkey || ' from supplier ' || l_suppkey || ' of ' || CAST(l_quantity AS INT) FROM o JOIN lineitem ON l_orderkey = k3),
     placed AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY k1 NULLS FIRST, k2 NULLS FIRST, k3 NULLS FIRST, k4 NULLS FIRST, body NULLS FIRST) AS ord FROM raw),
     upper_ AS (SELECT *, max(CASE WHEN depth = 0 THEN ord END) OVER w AS a0, max(CASE WHEN depth = 1 THEN ord END) OVER w AS a1, max(CASE WHEN depth = 2 THEN ord END) OVER w AS a2, max(CASE WHEN depth = 3 THEN ord END) OVER w AS a3 FROM placed WINDOW w AS (PARTITION BY doc ORDER BY ord)),
     p AS (SELECT doc, ord, CASE depth WHEN 1 THEN a0 WHEN 2 THEN a1 WHEN 3 THEN a2 WHEN 4 THEN a3 END AS parent, depth, tag, num, label, body FROM upper_),
     n AS (SELECT *, row_number() OVER (PARTITION BY doc, parent ORDER BY ord) AS ordinal, row_number() OVER (PARTITION BY doc, parent, tag ORDER BY ord) AS path_index FROM p)"""


@query(_NODES + " SELECT doc, ord, parent, ordinal, path_index, depth, tag, num, label, body FROM n")
def node_numbering(spark, sf_dir):
    return law_nodes(spark, sf_dir)


@query(_NODES + """, r AS (SELECT doc, ord, '/' || tag || '[' || path_index || ']' AS path FROM n WHERE parent IS NULL
       UNION ALL SELECT n.doc, n.ord, r.path || '/' || n.tag || '[' || n.path_index || ']' FROM r JOIN n ON n.doc = r.doc AND n.parent = r.ord) SELECT doc, ord, path FROM r""")
def node_paths(spark, sf_dir):
    """Root-to-node paths; the SQL walks the parents recursively."""
    return tree.paths(nodes_of(spark, sf_dir))


@query(_NODES + """, r AS (SELECT doc, ord, '/' || tag || '[' || path_index || ']' AS path, CAST(0 AS BIGINT) AS depth FROM n WHERE parent IS NULL
       UNION ALL SELECT n.doc, n.ord, r.path || '/' || n.tag || '[' || n.path_index || ']', r.depth + 1 FROM r JOIN n ON n.doc = r.doc AND n.parent = r.ord) SELECT doc, ord, path, depth FROM r""")
def xml_path_recursive(spark, sf_dir):
    """Paths from parent pointers alone, whatever their order and depth."""
    step = F.concat(F.lit("/"), "tag", F.lit("["), F.col("path_index").cast("string"), F.lit("]"))
    return tree.recursive_paths(nodes_of(spark, sf_dir), ["doc"], "ord", "parent", step)


_ANCESTORS = """, up AS (SELECT doc, ord, ord AS above, parent AS next, tag AS tag_, label AS label_, num AS num_, depth AS d_ FROM n
       UNION ALL SELECT up.doc, up.ord, n.ord, n.parent, n.tag, n.label, n.num, n.depth FROM up JOIN n ON n.doc = up.doc AND n.ord = up.next)"""
_BOUNDS = "('MainProvision', 'SupplProvision', 'Chapter', 'Article')"
_ANCHORS = _ANCESTORS + f""", nb AS (SELECT doc, ord, max(above) FILTER (tag_ IN {_BOUNDS}) AS b FROM up GROUP BY 1, 2),
     an AS (SELECT n.*, coalesce(b, parent, n.ord) AS anchor FROM n JOIN nb USING (doc, ord)),
     px AS (SELECT up.doc, up.ord, string_agg(trim(label_), ' > ' ORDER BY above) AS prefix FROM up JOIN an USING (doc, ord) WHERE (tag_ IN {_BOUNDS} OR above = anchor) AND trim(coalesce(label_, '')) <> '' GROUP BY 1, 2)"""


@query(_NODES + _ANCHORS + " SELECT doc, ord, anchor, coalesce(prefix, '') AS prefix FROM an LEFT JOIN px USING (doc, ord)")
def boundary_anchors(spark, sf_dir):
    return tree.anchored(nodes_of(spark, sf_dir), BOUNDARIES).select("doc", "ord", "anchor", "prefix")


@query(_NODES + _ANCESTORS + " SELECT doc, ord, max(above) FILTER (tag_ IN ('SupplProvision', 'Chapter')) AS nearest FROM up GROUP BY 1, 2")
def nearest_ancestor(spark, sf_dir):
    """The nearest chapter or supplement at or above every node, from parent pointers alone."""
    return tree.nearest_above(nodes_of(spark, sf_dir), ["doc"], "ord", "parent", F.col("tag").isin("SupplProvision", "Chapter"))


@query(_NODES + """, e AS (SELECT a.doc, a.ord AS anchor, min(b.ord) AS "end" FROM n a LEFT JOIN n b ON b.doc = a.doc AND b.ord > a.ord AND b.depth <= a.depth WHERE a.tag = 'Article' GROUP BY 1, 2)
SELECT e.doc, anchor, "end", count(n.ord) AS n_below, count(n.body) AS n_texts FROM e LEFT JOIN n ON n.doc = e.doc AND n.ord > anchor AND ("end" IS NULL OR n.ord < "end") GROUP BY 1, 2, 3""")
def article_subtrees(spark, sf_dir):
    """Ends and members of articles in one pass with a stack; the SQL finds both by range joins."""
    return tree.summed(nodes_of(spark, sf_dir), F.col("tag") == "Article", None).select("doc", "anchor", "end", "n_below", "n_texts")


_TEXTS = ", tx AS (SELECT a.doc, a.ord AS anchor, coalesce(string_agg(s.body, chr(10) ORDER BY s.ord), '') AS text FROM n a LEFT JOIN n s ON s.doc = a.doc AND s.parent = a.ord WHERE a.tag = 'Article' GROUP BY 1, 2)"


@query(_NODES + _TEXTS + " SELECT doc, anchor, sha256(text) AS sha, length(text) AS n_chars FROM tx")
def rendered_articles(spark, sf_dir):
    return tree.rendered(nodes_of(spark, sf_dir), "Article").select("doc", "anchor", F.sha2("text", 256).alias("sha"), F.length("text").alias("n_chars"))


def mixed_content(n, dealt=False):
    """Nodes with segments: articles and chapters begin with a text of their own, and a text follows each of their children."""
    mark = F.when(F.col("tag") == "Article", ". ").when(F.col("tag") == "Chapter", "; ")
    segment = lambda kind, value, at: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), at.cast("int").alias("ord"))
    none = F.lit(None)
    after = F.flatten(F.transform(F.coalesce("children", F.array().cast("array<int>")), lambda c: F.array(segment("child", none, c), segment("tail", F.col("mark"), none))))
    own = F.array(segment("text", F.when(F.col("mark").isNotNull(), F.concat("label", F.lit(": "))), none))
    joined = tree.with_children(n, dealt).withColumn("mark", mark)
    return joined.withColumn("segments", F.when(F.col("children").isNotNull() | F.col("mark").isNotNull(), F.concat(own, after))).drop("children", "mark")


@query(_NODES + """, a AS (SELECT n.doc, n.ord, n.parent, n.label || ': ' || coalesce(string_agg(s.body || '. ', '' ORDER BY s.ord), '') AS t FROM n LEFT JOIN n s ON s.doc = n.doc AND s.parent = n.ord WHERE n.tag = 'Article' GROUP BY n.doc, n.ord, n.parent, n.label),
     c AS (SELECT n.doc, n.ord, n.parent, n.label || ': ' || string_agg(a.t || '; ', '' ORDER BY a.ord) AS t FROM n JOIN a ON a.doc = n.doc AND a.parent = n.ord WHERE n.tag = 'Chapter' GROUP BY n.doc, n.ord, n.parent, n.label),
     l AS (SELECT n.doc, n.ord, coalesce(string_agg(c.t, '' ORDER BY c.ord), '') AS t FROM n LEFT JOIN c ON c.doc = n.doc WHERE n.depth = 0 GROUP BY n.doc, n.ord)
SELECT doc, ord AS anchor, sha256(t) AS sha, length(t) AS n_chars FROM (SELECT doc, ord, t FROM a UNION ALL SELECT doc, ord, t FROM c UNION ALL SELECT doc, ord, t FROM l)""")
def rendered_mixed(spark, sf_dir):
    """Articles, chapters and whole documents rendered from mixed content, texts between and behind children included."""
    small_batches(spark)
    nodes = law_nodes(spark, sf_dir).select("doc", "ord", "depth", "tag", "label", "body")
    rendered = tree.rendered_segments(mixed_content(nodes, dealt=True), ["Article", "Chapter", "Law"], dealt=True)
    return rendered.select("doc", "anchor", F.sha2("text", 256).alias("sha"), F.length("text").alias("n_chars"))


@query()
def rendered_pages(spark, sf_dir):
    """The text of every block of every page, as a browser's textContent gives it."""
    small_batches(spark)
    nodes = page_tree_nodes(spark, sf_dir)
    return tree.rendered_segments(nodes, ["body", "div", "p", "li", "td", "title"]).select("doc", "anchor", F.sha2("text", 256).alias("sha"), F.length("text").alias("n_chars"))


@query(_NODES + """ SELECT 'documents with tag' AS what, tag AS name, count(DISTINCT doc) AS n FROM n GROUP BY tag UNION ALL SELECT 'nodes with tag', tag, count(*) FROM n GROUP BY tag
 UNION ALL SELECT 'greatest', 'nodes', max(k) FROM (SELECT count(*) AS k FROM n GROUP BY doc) UNION ALL SELECT 'greatest', 'depth', max(depth) FROM n
 UNION ALL SELECT 'main parts without article', 'direct', count(*) FROM n m WHERE tag = 'MainProvision' AND NOT EXISTS (SELECT 1 FROM n c WHERE c.doc = m.doc AND c.parent = m.ord AND c.tag = 'Article')
 UNION ALL SELECT 'main parts without article', 'anywhere', count(*) FROM n m WHERE tag = 'MainProvision' AND NOT EXISTS (SELECT 1 FROM n c JOIN n a ON a.doc = c.doc AND a.parent = c.ord WHERE c.doc = m.doc AND c.parent = m.ord AND a.tag = 'Article')""")
def structure_statistics(spark, sf_dir):
    return tree.statistics(nodes_of(spark, sf_dir), "MainProvision", "Article")


@query(_NODES + """ SELECT a.doc, a.ord, a.tag, (SELECT arg_min(c.body, c.ord) FROM n c WHERE c.doc = a.doc AND c.parent = a.ord AND c.tag = CASE a.tag WHEN 'Article' THEN 'Sentence' ELSE 'ChapterTitle' END) AS label FROM n a WHERE a.tag IN ('Article', 'Chapter')""")
def node_display_labels(spark, sf_dir):
    return tree.display_labels(nodes_of(spark, sf_dir), {"Article": "Sentence", "Chapter": "ChapterTitle"})


_SCOPES = _ANCESTORS + """, sc AS (SELECT doc, ord, arg_max(tag_, above) AS t, arg_max(num_, above) AS m FROM up WHERE tag_ IN ('MainProvision', 'SupplProvision') GROUP BY 1, 2),
     ar AS (SELECT n.doc, n.ord, CASE WHEN t = 'MainProvision' THEN 'main' WHEN t = 'SupplProvision' AND m IS NOT NULL THEN 'supplementary:' || m END AS scope, num FROM n LEFT JOIN sc USING (doc, ord) WHERE tag = 'Article')"""


def scoped_articles(n):
    """Articles with their scope. Sentences are leaves below articles: none is a scope or ends one, so the pass goes without them."""
    n = n.where("tag <> 'Sentence'").select("doc", "ord", "depth", "tag", "num")
    return tree.scoped(n, "MainProvision", "SupplProvision").where("tag = 'Article'").select("doc", "ord", "scope", "num")


@query(_NODES + _SCOPES + """ SELECT doc, count(*) AS n_articles, count(*) FILTER (scope IS NULL) AS without_scope, count(*) FILTER (scope IS NOT NULL AND k > 1) AS in_repeats, count(*) FILTER (scope IS NOT NULL AND k = 1) AS indexed
 FROM (SELECT *, count(*) OVER (PARTITION BY doc, scope, num) AS k FROM ar) GROUP BY doc""")
def article_index_counts(spark, sf_dir):
    """What an article index leaves out: repeated numbers within a scope, and articles without scope."""
    a = scoped_articles(nodes_of(spark, sf_dir))
    k = a.where("scope is not null").groupBy("doc", "scope", "num").agg(F.count("*").alias("k"))
    per = k.groupBy("doc").agg(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("in_repeats"), F.count_if(F.col("k") == 1).alias("indexed"))
    n = a.groupBy("doc").agg(F.count("*").alias("n_articles"), F.count_if(F.col("scope").isNull()).alias("without_scope"))
    return n.join(per, "doc", "left").select("doc", "n_articles", "without_scope", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_repeats", "indexed")])


@query(_NODES + _SCOPES + _TEXTS + """ SELECT ar.doc, scope, text, CASE WHEN scope IS NULL THEN 'no-scope' WHEN count(*) OVER (PARTITION BY ar.doc, scope) > 1 THEN 'repeated' WHEN count(*) FILTER (scope IS NOT NULL) OVER (PARTITION BY ar.doc) > 1 THEN 'ambiguous-scope' ELSE 'found' END AS status
 FROM ar JOIN tx ON tx.doc = ar.doc AND tx.anchor = ar.ord WHERE num = '7'""")
def article_detail(spark, sf_dir):
    """Article 7 of every document: its text, and whether its number is unique within and across scopes."""
    n = nodes_of(spark, sf_dir)
    a = scoped_articles(n).where("num = '7'")
    a = tree.matched(a, tree.rendered(n, "Article", only=F.col("num") == "7").withColumnRenamed("anchor", "ord"), ["doc", "ord"])
    counts = a.where("scope is not null").groupBy("doc", "scope").agg(F.count("*").alias("same"))
    total = counts.groupBy("doc").agg(F.sum("same").alias("all"))
    joined = a.join(counts, ["doc", "scope"], "left").join(total, "doc", "left")
    status = F.when(F.col("scope").isNull(), "no-scope").when(F.col("same") > 1, "repeated").when(F.col("all") > 1, "ambiguous-scope").otherwise("found")
    return joined.select("doc", "scope", "text", status.alias("status"))


_CHUNKED = _ANCHORS + f""", un AS (SELECT an.doc, an.ord, anchor, coalesce(prefix, '') AS prefix, trim(body) AS body, length(trim(body)) AS len, row_number() OVER (PARTITION BY an.doc ORDER BY an.ord) AS i FROM an LEFT JOIN px USING (doc, ord) WHERE trim(coalesce(body, '')) <> ''),
     ck AS (SELECT doc, i, ord, anchor, prefix, body, CAST(0 AS BIGINT) AS chunk, len AS size FROM un WHERE i = 1
       UNION ALL SELECT un.doc, un.i, un.ord, un.anchor, un.prefix, un.body, ck.chunk + CASE WHEN un.anchor <> ck.anchor OR size + 1 + len > {MOST} THEN 1 ELSE 0 END, CASE WHEN un.anchor <> ck.anchor OR size + 1 + len > {MOST} THEN len ELSE size + 1 + len END FROM ck JOIN un ON un.doc = ck.doc AND un.i = ck.i + 1),
     cx AS (SELECT doc, chunk, min(anchor) AS anchor, min(prefix) AS prefix, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n_units, string_agg(body, chr(10) ORDER BY ord) AS text FROM ck GROUP BY 1, 2),
     cd AS (SELECT *, CAST(length(text) AS BIGINT) AS n_chars, length(text) > {MOST} AS oversize, sha256(concat_ws(chr(31), '1', 'soft_max_chars={MOST}', doc, anchor, first_ord, last_ord, sha256(text))) AS chunk_id FROM cx)"""


def chunks_of(n, dealt=False):
    return tree.anchored_chunks(n, BOUNDARIES, MOST, dealt=dealt)


def new_chunks(spark, sf_dir):
    """The chunks where nothing else is asked of the nodes: numbered, anchored and packed as they come, not stored between."""
    small_batches(spark)
    return chunks_of(law_nodes(spark, sf_dir), dealt=True)


@query(_NODES + _CHUNKED + " SELECT * FROM cd")
def anchored_chunks(spark, sf_dir):
    return new_chunks(spark, sf_dir)


#: A tenth of the documents are the resolved scope of the chunk searches.
_SCOPE = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"


def building(spark, sf_dir):
    return load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc"))


@query(_NODES + _CHUNKED + f" SELECT chunk_id, doc, first_ord, n_chars FROM cd WHERE doc IN {_SCOPE} AND contains(text, 'from supplier 7 of')")
def chunk_lexical_matches(spark, sf_dir):
    """All chunks of the scope that hold the text; chunk_lexical_search ranks and limits them."""
    c = search.in_scope(new_chunks(spark, sf_dir), building(spark, sf_dir), ["doc"])
    return search.chunk_matches(c, "from supplier 7 of").select("chunk_id", "doc", "first_ord", "n_chars")


@query(_NODES + _CHUNKED + f", h AS (SELECT cd.doc, chunk_id, first_ord, CAST(1.0 AS DOUBLE) AS score FROM cd JOIN n ON n.doc = cd.doc AND n.ord = cd.anchor WHERE cd.doc IN {_SCOPE} AND n.tag = 'Article' AND n.num = '7') SELECT doc, chunk_id, first_ord, score FROM h ORDER BY doc, first_ord, chunk_id LIMIT 200")
def chunk_structural_search(spark, sf_dir):
    """Chunks by their anchor's tag and number within the scope."""
    n = nodes_of(spark, sf_dir)
    c = search.in_scope(chunks_of(n), building(spark, sf_dir), ["doc"]).join(n.select("doc", F.col("ord").alias("anchor"), F.col("tag").alias("anchor_tag"), F.col("num").alias("anchor_num")), ["doc", "anchor"])
    return search.chunk_structural_search(c, {"anchor_tag": "Article", "anchor_num": "7", "anchor_label": None}, ["doc", "first_ord", "chunk_id"], 200)


@query(_NODES + _CHUNKED + """, hit AS (SELECT doc, ord AS anchor, row_number() OVER (PARTITION BY doc ORDER BY ord) AS rk FROM n WHERE tag = 'Article' AND num = '7'), one AS (SELECT * FROM hit WHERE rk = 1),
     dc AS (SELECT cd.doc, chunk_id, cd.first_ord, n_chars, row_number() OVER (PARTITION BY cd.doc ORDER BY cd.first_ord) AS i FROM cd JOIN one ON one.doc = cd.doc AND cd.anchor = one.anchor),
     sup AS (SELECT doc, i, CASE WHEN n_chars <= 150 THEN n_chars ELSE 0 END AS used, CASE WHEN n_chars <= 150 THEN [chunk_id] ELSE [] END AS taken FROM dc WHERE i = 1
       UNION ALL SELECT dc.doc, dc.i, CASE WHEN len(taken) < 3 AND used + n_chars <= 150 THEN used + n_chars ELSE used END, CASE WHEN len(taken) < 3 AND used + n_chars <= 150 THEN list_append(taken, chunk_id) ELSE taken END FROM sup JOIN dc ON dc.doc = sup.doc AND dc.i = sup.i + 1 WHERE dc.i <= 9)
SELECT doc, chunk_id, 'structural-scope' AS channel, CAST(0.0 AS DOUBLE) AS score FROM (SELECT doc, unnest(taken) AS chunk_id FROM (SELECT doc, arg_max(taken, i) AS taken FROM sup GROUP BY doc))""")
def scope_supplement(spark, sf_dir):
    """Chunks below the first Article 7 of every document, as many as three free slots and 150 characters leave room for."""
    n = nodes_of(spark, sf_dir)
    hits = n.where("tag = 'Article' and num = '7'").groupBy("doc").agg(F.min("ord").alias("anchor"))
    room = hits.withColumn("slots", F.lit(3)).withColumn("room", F.lit(150))
    return search.scope_supplement(chunks_of(n), tree.subtrees(n, "Article").select("doc", "anchor", "ord"), room)


@query(_NODES + _CHUNKED + f" SELECT cd.chunk_id AS context_id, row_number() OVER (PARTITION BY cd.chunk_id ORDER BY n.ord) AS position, n.doc, n.ord, n.body FROM cd JOIN n ON n.doc = cd.doc AND n.ord BETWEEN first_ord AND last_ord WHERE cd.doc IN {_SCOPE}")
def evidence_bundle(spark, sf_dir):
    """The source nodes of all chunks of the scope, fetched again in order and checked against the chunk's text."""
    n = nodes_of(spark, sf_dir)
    c = search.in_scope(chunks_of(n), building(spark, sf_dir), ["doc"])
    contexts = c.select(F.col("chunk_id").alias("context_id"), "doc", F.sha2("text", 256).alias("sha"), F.sequence("first_ord", "last_ord").alias("ords"))
    return tree.evidence_bundle(contexts, n)


@query(_NODES + """, x AS (SELECT 'one_root' AS check_name, count(*) AS violations FROM (SELECT doc FROM n GROUP BY doc HAVING count(*) FILTER (parent IS NULL) <> 1)
 UNION ALL SELECT 'order_contiguous', count(*) FROM (SELECT doc FROM n GROUP BY doc HAVING min(ord) <> 1 OR max(ord) <> count(*) OR count(DISTINCT ord) <> count(*))
 UNION ALL SELECT 'ordinals_contiguous', count(*) FROM (SELECT doc, parent FROM n WHERE parent IS NOT NULL GROUP BY ALL HAVING min(ordinal) <> 1 OR max(ordinal) <> count(*) OR count(DISTINCT ordinal) <> count(*))
 UNION ALL SELECT 'parents_resolve', count(*) FROM n c WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n p WHERE p.doc = c.doc AND p.ord = c.parent)
 UNION ALL SELECT 'parents_one_level_up', count(*) FROM n c JOIN n p ON p.doc = c.doc AND p.ord = c.parent WHERE p.depth + 1 <> c.depth OR p.ord >= c.ord
 UNION ALL SELECT 'elements_have_tags', count(*) FROM n WHERE coalesce(trim(tag), '') = ''
 UNION ALL SELECT 'texts_on_leaves_only', count(*) FROM n p WHERE body IS NOT NULL AND EXISTS (SELECT 1 FROM n c WHERE c.doc = p.doc AND c.parent = p.ord)
 UNION ALL SELECT 'numbers_repeat_among_siblings', count(*) FROM (SELECT doc, parent, tag, num FROM n WHERE num IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT 'documents_without_nodes', count(*) FROM (SELECT doc FROM n GROUP BY doc HAVING count(*) = 1)) SELECT * FROM x""")
def node_checks(spark, sf_dir):
    return checked(nodes_of(spark, sf_dir))


def checked(n, most=tree.TASK_ROWS):
    """The checks of a stored node table. Joins and distinct counts are dealt so that a task has some most rows, however many there are."""
    tasks = tree.shares(n, most=most)
    dealt = lambda rows, *keys: rows.repartition(tasks, *keys)
    below = n.where("parent is not null")
    roots = n.groupBy("doc").agg(F.count_if(F.col("parent").isNull()).alias("roots"), F.count("*").alias("k"))
    up = dealt(n.select("doc", F.col("ord").alias("parent"), F.col("depth").alias("up")), "doc", "parent")
    children = dealt(below.select("doc", "ord", "parent", "depth"), "doc", "parent")
    texts = dealt(n.where("body is not null").select("doc", "ord"), "doc", "ord")
    owners = dealt(below.select("doc", F.col("parent").alias("ord")), "doc", "ord")
    return quality.report(
        quality.violates("one_root", roots, F.col("roots") != 1),
        quality.contiguous("order_contiguous", dealt(n.select("doc", "ord"), "doc"), ["doc"], "ord"),
        quality.contiguous("ordinals_contiguous", dealt(below.select("doc", "parent", "ordinal"), "doc"), ["doc", "parent"], "ordinal"),
        quality.violates("parents_resolve", tree.matched(children, up, ["doc", "parent"], "left_anti"), F.lit(True)),
        quality.violates("parents_one_level_up", tree.matched(children, up, ["doc", "parent"]), (F.col("up") + 1 != F.col("depth")) | (F.col("parent") >= F.col("ord"))),
        quality.violates("elements_have_tags", n, F.trim(F.coalesce("tag", F.lit(""))) == ""),
        quality.violates("texts_on_leaves_only", tree.matched(texts, owners, ["doc", "ord"], "left_semi"), F.lit(True)),
        quality.unique("numbers_repeat_among_siblings", dealt(n.where("num is not null").select("doc", "parent", "tag", "num"), "doc"), ["doc", "parent", "tag", "num"]),
        quality.violates("documents_without_nodes", roots, F.col("k") == 1),
    )


@query(_NODES + _CHUNKED + f" SELECT cd.chunk_id AS context_id, substr(arg_min(n.body, n.ord), 1, 240) AS answer_text, [min(n.ord)] AS evidence_ords FROM cd JOIN n ON n.doc = cd.doc AND n.ord BETWEEN first_ord AND last_ord WHERE cd.doc IN {_SCOPE} AND trim(n.body) <> '' GROUP BY 1")
def extractive_answers(spark, sf_dir):
    return evidence.extractive_answers(evidence_bundle(spark, sf_dir))


@query(_NODES + _CHUNKED + " SELECT CAST(doc % 8 AS INT) AS bucket, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM cd GROUP BY 1")
def chunk_store(spark, sf_dir):
    """A store by bucket of documents: built from empty texts, then every second bucket is replaced, then the others."""
    made = materialise(new_chunks(spark, sf_dir).withColumn("bucket", (F.col("doc") % 8).cast("int")), "chunks")
    path = f"{shared_dir(spark)}/chronolex/chunk-store-{uuid.uuid4().hex}"
    replace_partitions(made.withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")), path, ["bucket"])
    for odd in (0, 1):
        replace_partitions(made.where(F.col("bucket") % 2 == odd), path, ["bucket"])
    return spark.read.parquet(path).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
