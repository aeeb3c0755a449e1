"""Registered queries: every operator applied to the tables at hand, each with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions.identity import content_id, manifest_hash
from chronolex.functions.text import normalise, quote, similarity, trigrams
from chronolex.operators import activity, chunk, evidence, linkage, merge, quality, search, temporal, tree, watch
from chronolex.storage import load, materialise
from chronolex.streaming import events as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Dates at which revisions are asked for.
PROBES = ("1993-06-30", "1996-01-01", "1998-12-31")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as revisions: a customer is the key, an order a revision valid from its day."""
    o = load(spark, sf_dir, "orders")
    grade = F.when(F.col("o_orderstatus") == "F", "confirmed-api").when(F.col("o_orderstatus") == "O", "confirmed-revision-id").otherwise("baseline-boundary")
    return o.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("valid_from"), grade.alias("quality"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.derive_intervals(revisions(spark, sf_dir), "o_custkey", "o_orderkey", "valid_from", "quality")


def probes(spark: SparkSession, sf_dir: str, dates: tuple[str, ...] = PROBES) -> DataFrame:
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in dates]))
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), days.alias("probe_date"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of returned lines of an order, as its number of contents."""
    return load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_contents"))


def resolution(spark: SparkSession, sf_dir: str, dates: tuple[str, ...] = PROBES) -> DataFrame:
    return temporal.resolve_as_of(intervals(spark, sf_dir), contents(spark, sf_dir), probes(spark, sf_dir, dates), "o_custkey", "o_orderkey", "valid_from", "probe_date")


_INTERVALS = """
WITH r AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS valid_from,
             CASE o_orderstatus WHEN 'F' THEN 'confirmed-api' WHEN 'O' THEN 'confirmed-revision-id' ELSE 'baseline-boundary' END AS quality FROM orders),
     d0 AS (SELECT o_custkey, valid_from, count(*) AS same FROM r GROUP BY 1, 2),
     dd AS (SELECT *, lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS valid_to_exclusive FROM d0),
     i AS (SELECT r.*, row_number() OVER (PARTITION BY r.o_custkey ORDER BY r.valid_from, o_orderkey) AS sequence, valid_to_exclusive,
             CASE WHEN same > 1 THEN 'ambiguous' ELSE quality END AS interval_quality FROM r JOIN dd USING (o_custkey, valid_from))"""


def _resolution_sql(dates: tuple[str, ...]) -> str:
    values = ", ".join(f"(DATE '{d}')" for d in dates)
    return f"""{_INTERVALS},
     c AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
     p AS (SELECT c_custkey AS o_custkey, d AS probe_date FROM customer, (VALUES {values}) v(d)),
     g AS (SELECT p.o_custkey, p.probe_date, count(i.o_orderkey) AS k, max(i.o_orderkey) AS id, max(interval_quality) AS q, coalesce(max(c.n), 0) AS n
           FROM p LEFT JOIN i ON i.o_custkey = p.o_custkey AND valid_from <= probe_date AND (valid_to_exclusive IS NULL OR probe_date < valid_to_exclusive)
           LEFT JOIN c ON c.o_orderkey = i.o_orderkey GROUP BY 1, 2),
     s AS (SELECT *, CASE WHEN k = 0 THEN 'not-found' WHEN k > 1 THEN 'ambiguous' WHEN q NOT IN ('confirmed-api', 'confirmed-revision-id') THEN 'unresolved' ELSE 'resolved' END AS status FROM g),
     resolution AS (SELECT o_custkey, probe_date, k AS n_candidates, status, CASE WHEN status = 'resolved' THEN id END AS selected,
       CASE WHEN k = 0 THEN 'none' WHEN status <> 'resolved' THEN 'candidate-dependent' WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'available' ELSE 'multiple' END AS content_status FROM s)"""


@query(_INTERVALS + " SELECT o_custkey, o_orderkey, valid_from, quality, sequence, valid_to_exclusive, interval_quality FROM i")
def revision_intervals(spark, sf_dir):
    return intervals(spark, sf_dir)


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS valid_from, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS ids FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def same_day_groups(spark, sf_dir):
    return temporal.same_day_groups(revisions(spark, sf_dir), "o_custkey", "o_orderkey", "valid_from")


@query(_INTERVALS + f", p AS (SELECT c_custkey AS o_custkey, d AS probe_date FROM customer, (VALUES {', '.join(f'(DATE {chr(39)}{d}{chr(39)})' for d in PROBES)}) v(d)) SELECT o_custkey, probe_date, o_orderkey, interval_quality FROM p JOIN i USING (o_custkey) WHERE valid_from <= probe_date AND (valid_to_exclusive IS NULL OR probe_date < valid_to_exclusive)")
def as_of_candidates(spark, sf_dir):
    return temporal.as_of_candidates(intervals(spark, sf_dir), probes(spark, sf_dir), "o_custkey", "valid_from", "probe_date").select("o_custkey", "probe_date", "o_orderkey", "interval_quality")


@query(_resolution_sql(PROBES) + " SELECT * FROM resolution")
def as_of_resolution(spark, sf_dir):
    return resolution(spark, sf_dir)


@query(_resolution_sql(PROBES[1:2]) + " SELECT i.o_custkey, probe_date, o_orderkey, valid_from, sequence, valid_from <= probe_date AND (valid_to_exclusive IS NULL OR probe_date < valid_to_exclusive) AS candidate_for_as_of, coalesce(selected = o_orderkey, false) AS selected_for_as_of FROM i JOIN resolution r ON r.o_custkey = i.o_custkey")
def revision_history_flags(spark, sf_dir):
    return temporal.history(intervals(spark, sf_dir), resolution(spark, sf_dir, PROBES[1:2]), "o_custkey", "o_orderkey", "valid_from", "probe_date")


@query("SELECT 'orders without lineitem' AS what, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'documents without labels', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unresolved_refs(spark, sf_dir):
    a = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    b = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return a.select(F.lit("orders without lineitem").alias("what"), F.col("o_orderkey").alias("id")).union(b.select(F.lit("documents without labels"), "doc_id"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    return merge.latest_per_key(load(spark, sf_dir, "events"), "user_id", [F.col("ts"), F.col("event_id")], ["event_id", "event_type", "value"])


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS scheduled FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1998-06-01'")
def scheduled_after_date(spark, sf_dir):
    return load(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-06-02").cast("timestamp_ntz")).select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("scheduled"))


def _event_days(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("run", F.to_date("ts"))
    per = e.groupBy("user_id", "event_type", "run").agg(F.round(F.sum("value"), 4).alias("value"))
    even = per.where("day(run) % 2 = 0").groupBy("user_id", "event_type").agg(F.max_by("value", "run").alias("value"), F.max("run").alias("run"))
    odd = per.where("day(run) % 2 = 1").groupBy("user_id", "event_type").agg(F.max_by("value", "run").alias("value"), F.max("run").alias("run"))
    return even, odd


_DAYS = """WITH per AS (SELECT user_id, event_type, CAST(ts AS DATE) AS run, round(sum(value), 4) AS value FROM events GROUP BY ALL),
     o AS (SELECT user_id, event_type, arg_max(value, run) AS value, max(run) AS run FROM per WHERE day(run) % 2 = 0 GROUP BY 1, 2),
     n AS (SELECT user_id, event_type, arg_max(value, run) AS value, max(run) AS run FROM per WHERE day(run) % 2 = 1 GROUP BY 1, 2)"""


@query(_DAYS + " SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, CASE WHEN n.user_id IS NOT NULL THEN n.value ELSE o.value END AS value, coalesce(o.run, n.run) AS first_run, coalesce(n.run, o.run) AS last_run FROM n FULL JOIN o ON n.user_id = o.user_id AND n.event_type = o.event_type")
def upsert_merge(spark, sf_dir):
    old, new = _event_days(spark, sf_dir)
    return merge.upsert(old, new, ["user_id", "event_type"], "run")


@query("SELECT DISTINCT sha256(text) AS sha FROM documents WHERE source <> 'src0' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def insert_if_absent(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha"))
    return merge.insert_if_absent(d.where("source = 'src0'"), d.where("source <> 'src0'"), "sha").select("sha")


@query("SELECT sha256(text) AS sha, count(DISTINCT source) AS n_values, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def drift_detection(spark, sf_dir):
    return merge.drift(load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), "source"), "sha", "source")


@query("""WITH i AS (SELECT user_id, nullif(event_type, 'view') AS code, min(event_id) AS issue_id FROM events WHERE day(ts) % 2 = 0 GROUP BY 1, 2),
     s AS (SELECT user_id, nullif(event_type, 'view') AS code, count(*) AS n_seen FROM events WHERE day(ts) % 2 = 1 GROUP BY 1, 2)
SELECT s.user_id, s.code, n_seen, CASE WHEN issue_id IS NULL THEN 'opened' ELSE 'seen-again' END AS action, issue_id FROM s LEFT JOIN i ON i.user_id = s.user_id AND i.code IS NOT DISTINCT FROM s.code""")
def open_issue_merge(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("code", F.nullif(F.col("event_type"), F.lit("view")))
    issues = e.where("day(ts) % 2 = 0").groupBy("user_id", "code").agg(F.min("event_id").alias("issue_id")).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    return merge.open_issue_merge(issues, e.where("day(ts) % 2 = 1"), ["user_id", "code"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer")
def field_assertions(spark, sf_dir):
    return merge.field_assertions(load(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


def _states(spark, sf_dir):
    return load(spark, sf_dir, "labels").groupBy("doc_id").agg(linkage.effective_state(F.col("quality") == 1, F.col("toxic") == 1).alias("state"))


_STATES = "WITH s AS (SELECT doc_id, CASE WHEN bool_or(quality = 1) AND bool_or(toxic = 1) THEN 'conflicted' WHEN bool_or(quality = 1) THEN 'confirmed' WHEN bool_or(toxic = 1) THEN 'rejected' ELSE 'candidate' END AS state FROM labels GROUP BY doc_id)"


@query(_STATES + " SELECT doc_id, state FROM s")
def effective_state(spark, sf_dir):
    return _states(spark, sf_dir)


@query(_STATES + " SELECT d.doc_id, lang, source, state, state = 'confirmed' AS citation_ready FROM documents d JOIN s USING (doc_id)")
def citation_ready_docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(_states(spark, sf_dir), "doc_id").withColumn("citation_ready", F.col("state") == "confirmed")


@query(_STATES + " SELECT source, count(*) AS n, count(*) FILTER (state = 'confirmed') AS confirmed, count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'conflicted') AS conflicted, count(*) FILTER (state = 'candidate') AS candidate, bool_or(state = 'confirmed') AS citation_ready FROM documents JOIN s USING (doc_id) GROUP BY source")
def related_materials(spark, sf_dir):
    return activity.related_materials(load(spark, sf_dir, "documents").select("doc_id", "source").join(_states(spark, sf_dir), "doc_id"), "source", "state")


@query(r"SELECT doc_id, item_id FROM documents d, benchmark b WHERE length(regexp_replace(b.text, '\s+', '', 'g')) >= 3 AND contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g'))")
def text_linkage(spark, sf_dir):
    return linkage.contained_mentions(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), "doc_id", "item_id")


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _sim(a: str, b: str) -> str:
    x, y = _TRI.format(x=a), _TRI.format(x=b)
    return f"round(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 6)"


@query(rf"WITH u AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS unit, trim(unnest(string_split(text, chr(10))), ' ') AS body FROM documents), n AS (SELECT doc_id, unit, trim(regexp_replace(body, '\s+', ' ', 'g'), ' ') AS body FROM u WHERE body <> '') SELECT doc_id, unit, {_sim('body', chr(39) + 'License' + chr(39))} AS score FROM n WHERE contains(body, 'License') ORDER BY score DESC, doc_id, unit LIMIT 20")
def lexical_search_units(spark, sf_dir):
    units = chunk.text_units(load(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("body", "text")
    return search.lexical_search(units, "License", ["doc_id", "unit"])


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src0' AND contains(text, 'Apache') ORDER BY doc_id LIMIT 100")
def structural_search(spark, sf_dir):
    return search.structural_search(load(spark, sf_dir, "documents"), {"lang": "en", "source": "src0", "n_chars": None}, {"text": "Apache"}, ["doc_id"])


@query("SELECT page_id FROM pages WHERE contains(html, '%%%')")
def literal_wildcards(spark, sf_dir):
    return load(spark, sf_dir, "pages").where(F.col("html").contains("%%%")).select("page_id")


@query(f"SELECT p_brand, p_name, score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_name DESC) AS rn FROM (SELECT p_brand, p_name, {_sim('p_name', chr(39) + 'larg brushd part' + chr(39))} AS score FROM part) WHERE score >= 0.12) WHERE rn = 1 ORDER BY score DESC, p_brand LIMIT 5")
def trigram_suggest(spark, sf_dir):
    return search.suggest(load(spark, sf_dir, "part"), "larg brushd part", "p_brand", "p_name")


_QUESTIONS = ("What does Brand#12 cost", "compare Brand#1 with Brand#13", "nothing known here", "which ECONOMY part is from Brand#22")


@query(f"""WITH q AS (SELECT unnest([{', '.join(repr(x) for x in _QUESTIONS)}]) AS question),
     n AS (SELECT DISTINCT p_brand AS entity, p_brand AS phrase, 2 AS priority FROM part UNION SELECT DISTINCT p_type, p_type, 1 FROM part),
     m AS (SELECT * FROM n JOIN q ON contains(question, phrase)), b AS (SELECT *, rank() OVER (PARTITION BY question ORDER BY priority DESC, length(phrase) DESC) AS rk FROM m)
SELECT question, CASE WHEN count(DISTINCT entity) = 1 THEN 'resolved' ELSE 'candidates' END AS status, CASE WHEN count(DISTINCT entity) = 1 THEN min(entity) END AS entity, count(DISTINCT entity) AS n_candidates FROM b WHERE rk = 1 GROUP BY question""")
def phrase_resolution(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    names = p.select(F.col("p_brand").alias("entity"), F.col("p_brand").alias("phrase"), F.lit(2).alias("priority")).union(p.select("p_type", "p_type", F.lit(1))).distinct()
    questions = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in _QUESTIONS])).alias("question"))
    return search.phrase_resolution(names, questions, "phrase", "question")


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(v, qv), 6) AS score FROM e, q ORDER BY round(list_cosine_similarity(v, qv), 6) DESC, vec_id LIMIT 20""")
def vector_topk(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").first()
    return search.vector_topk(e, list(q.embedding), "vec_id", "embedding")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, e q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def vector_topk_batch(spark, sf_dir):
    """Every hundredth vector as a query against all vectors."""
    e = load(spark, sf_dir, "embeddings")
    return search.vector_topk_batch(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding")


_FUSED = rf"""WITH sc AS (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS body FROM documents),
     h AS (SELECT doc_id, 1.0 AS w, row_number() OVER (ORDER BY {_sim("body", "'License'")} DESC, doc_id) AS rk FROM sc WHERE contains(body, 'License')
       UNION ALL SELECT doc_id, 0.75, row_number() OVER (ORDER BY doc_id) FROM sc WHERE source = 'src0'
       UNION ALL SELECT e.vec_id, 1.0, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, e.vec_id) FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id IN (SELECT doc_id FROM sc)),
     f AS (SELECT doc_id, round(sum(CAST(w AS DOUBLE) / (60 + rk)), 9) AS score, count(*) AS n_channels FROM h WHERE rk <= 50 GROUP BY doc_id)"""


@query(_FUSED + " SELECT * FROM f")
def rrf_fusion(spark, sf_dir):
    """The lexical, structural and vector hits of all documents, fused."""
    return search.fuse(scoped_channels(spark, sf_dir, load(spark, sf_dir, "documents")), "doc_id")


_BUDGET = """, r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents),
     b AS (SELECT source, CAST(1 AS BIGINT) AS rk, n_chars AS used, [doc_id] AS taken FROM r WHERE rk = 1
           UNION ALL SELECT b.source, r.rk, CASE WHEN len(taken) < 8 AND used + n_chars <= 6000 THEN used + n_chars ELSE used END,
             CASE WHEN len(taken) < 8 AND used + n_chars <= 6000 THEN list_append(taken, doc_id) ELSE taken END FROM b JOIN r ON r.source = b.source AND r.rk = b.rk + 1)"""


@query("WITH RECURSIVE x AS (SELECT 1)" + _BUDGET + " SELECT source, CAST(generate_subscripts(taken, 1) AS BIGINT) AS position, unnest(taken) AS doc_id, used FROM (SELECT source, arg_max(taken, rk) AS taken, arg_max(used, rk) AS used FROM b GROUP BY source)")
def context_budget(spark, sf_dir):
    return search.budgeted(load(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", "doc_id")


def resolved_documents(spark, sf_dir):
    """Documents whose revision (the order of their id) is the one resolved on the probe's date, with content to read."""
    d = load(spark, sf_dir, "documents")
    contents = d.groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.count("*").alias("n_contents"))
    r = temporal.resolve_as_of(intervals(spark, sf_dir), contents, probes(spark, sf_dir, PROBES[1:2]), "o_custkey", "o_orderkey", "valid_from", "probe_date")
    selected = r.where("status = 'resolved' and content_status = 'available'").select(F.col("selected").alias("doc_id"))
    return d.join(selected, "doc_id", "left_semi")


def scoped_channels(spark, sf_dir, scope: DataFrame) -> DataFrame:
    """The hits of all three channels; each searches the scope only, before its limit."""
    e = load(spark, sf_dir, "embeddings")
    lexical = search.lexical_search(scope, "License", ["doc_id"], 50)
    structural = search.structural_search(scope, {"source": "src0"}, {}, ["doc_id"], 50)
    inside = e.join(scope.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    vector = search.vector_topk_batch(e.where("vec_id = 0"), inside, "vec_id", "embedding", 50).withColumnRenamed("vec_id", "doc_id")
    hits = search.ranked(lexical, "lexical", "doc_id", [F.desc("score"), F.col("doc_id")])
    hits = hits.unionByName(search.ranked(structural, "structural", "doc_id", [F.col("doc_id")]))
    return hits.unionByName(search.ranked(vector, "vector", "doc_id", [F.desc("score"), F.col("doc_id")]))


_HYBRID = _resolution_sql(PROBES[1:2]).replace("WITH r AS", "WITH RECURSIVE r AS", 1) + rf""",
     sc AS (SELECT doc_id, source, n_chars, text, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS body FROM documents WHERE lang = 'en' AND doc_id IN (SELECT selected FROM resolution WHERE status = 'resolved') AND doc_id IN (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) = 1)),
     h AS (SELECT doc_id, 1.0 AS w, row_number() OVER (ORDER BY {_sim("body", "'License'")} DESC, doc_id) AS rk FROM sc WHERE contains(body, 'License')
       UNION ALL SELECT doc_id, 0.75, row_number() OVER (ORDER BY doc_id) FROM sc WHERE source = 'src0'
       UNION ALL SELECT e.vec_id, 1.0, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) DESC, e.vec_id) FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id IN (SELECT doc_id FROM sc)),
     f AS (SELECT doc_id, round(sum(CAST(w AS DOUBLE) / (60 + rk)), 9) AS score FROM h WHERE rk <= 50 GROUP BY doc_id),
     o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rk FROM f JOIN sc USING (doc_id)),
     b AS (SELECT source, CAST(1 AS BIGINT) AS rk, n_chars AS used, [doc_id] AS taken FROM o WHERE rk = 1
       UNION ALL SELECT b.source, o.rk, CASE WHEN len(taken) < 8 AND used + n_chars <= 6000 THEN used + n_chars ELSE used END,
         CASE WHEN len(taken) < 8 AND used + n_chars <= 6000 THEN list_append(taken, doc_id) ELSE taken END FROM b JOIN o ON o.source = b.source AND o.rk = b.rk + 1),
     t AS (SELECT source, CAST(generate_subscripts(taken, 1) AS BIGINT) AS position, unnest(taken) AS doc_id, used FROM (SELECT source, arg_max(taken, rk) AS taken, arg_max(used, rk) AS used FROM b GROUP BY source))
SELECT doc_id, t.source, position, used, CASE WHEN length(body) > 1000 THEN substr(body, 1, 1000) || '…' ELSE body END AS quote, sha256(text) AS sha FROM t JOIN sc USING (doc_id)"""


@query(_HYBRID)
def hybrid_pipeline(spark, sf_dir):
    """Resolve the revisions as of a date, search three channels in their English documents, fuse, choose contexts within the budget, validate the scope.

    Revisions that aren't resolved or have no single content are blocked: they add no document to the scope.
    """
    scope = materialise(resolved_documents(spark, sf_dir).where("lang = 'en'"), "scope")
    fused = search.fuse(scoped_channels(spark, sf_dir, scope), "doc_id")
    found = search.guarded(fused, scope.select("doc_id", "source", "n_chars", "text"), "doc_id")
    w = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    chosen = search.budgeted(found.withColumn("rk", F.row_number().over(w)), "source", "rk", "n_chars", "doc_id")
    return chosen.join(scope.select("doc_id", quote(normalise("text")).alias("quote"), F.sha2("text", 256).alias("sha")), "doc_id")


_CHUNKS = r"""WITH RECURSIVE u AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS unit, length(trim(unnest(string_split(text, chr(10))), ' ')) AS n FROM documents),
     v AS (SELECT doc_id, unit, n, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS k FROM u WHERE n > 0),
     c AS (SELECT doc_id, k, unit, CAST(0 AS BIGINT) AS chunk, n AS size, n FROM v WHERE k = 1
           UNION ALL SELECT v.doc_id, v.k, v.unit, CASE WHEN size + 1 + v.n > 1200 THEN chunk + 1 ELSE chunk END, CASE WHEN size + 1 + v.n > 1200 THEN v.n ELSE size + 1 + v.n END, v.n
           FROM c JOIN v ON v.doc_id = c.doc_id AND v.k = c.k + 1),
     g AS (SELECT doc_id, chunk, min(unit) AS first_unit, max(unit) AS last_unit, count(*) AS n_units, CAST(max(size) AS BIGINT) AS n_chars, max(size) > 1200 AS oversize FROM c GROUP BY 1, 2)"""


@query(_CHUNKS + " SELECT * FROM g")
def chunk_documents(spark, sf_dir):
    return chunk.chunk_documents(load(spark, sf_dir, "documents"), "doc_id", "text")


@query(_CHUNKS + " SELECT lang, count(*) AS n_chunks, count(*) FILTER (oversize) AS n_oversize, CAST(sum(g.n_chars) AS BIGINT) AS chars, max(g.n_chars) AS longest FROM g JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return chunk.chunk_stats(chunk.chunk_documents(d, "doc_id", "text"), d, "doc_id", "lang")


@query()
def page_tree_nodes(spark, sf_dir):
    return tree.shred_html(load(spark, sf_dir, "pages"), "page_id", "html")


@query()
def page_tree_dq(spark, sf_dir):
    return tree.tree_checks(materialise(page_tree_nodes(spark, sf_dir), "nodes"))


@query("""WITH m AS (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS start FROM conversations),
     g AS (SELECT conv_id, start, count(*) AS n FROM m WHERE start IS NOT NULL GROUP BY 1, 2)
SELECT conv_id, start, lead(start) OVER (PARTITION BY conv_id ORDER BY start) AS "end", n FROM g""")
def subtree_range(spark, sf_dir):
    return tree.turn_ranges(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "user")


@query("""WITH s AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y, sha256(o_orderstatus || '|' || CAST(count(*) OVER (PARTITION BY o_custkey, o_orderpriority, year(o_orderdate)) AS VARCHAR)) AS sha,
             count(*) OVER (PARTITION BY o_custkey, o_orderpriority, year(o_orderdate)) AS n FROM orders),
     l AS (SELECT * FROM s WHERE y = 1995 AND n = 1), r AS (SELECT * FROM s WHERE y = 1996 AND n = 1)
SELECT coalesce(l.o_custkey, r.o_custkey) AS o_custkey, coalesce(l.o_orderpriority, r.o_orderpriority) AS o_orderpriority,
       CASE WHEN l.sha IS NULL THEN 'added' WHEN r.sha IS NULL THEN 'removed' WHEN l.sha <> r.sha THEN 'changed' ELSE 'unchanged' END AS change
FROM l FULL JOIN r ON l.o_custkey = r.o_custkey AND l.o_orderpriority = r.o_orderpriority""")
def snapshot_compare(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"), F.sha2(F.concat("o_orderstatus", F.lit("|1")), 256).alias("sha"))
    return linkage.snapshot_compare(o.where("y = 1995"), o.where("y = 1996"), ["o_custkey", "o_orderpriority"], "sha")


@query(_resolution_sql(PROBES[:2]) + f""", rb AS (SELECT * FROM resolution WHERE probe_date = DATE '{PROBES[0]}'), rc AS (SELECT * FROM resolution WHERE probe_date = DATE '{PROBES[1]}'),
     a AS (SELECT rc.o_custkey, CASE WHEN rc.status <> 'resolved' THEN 'blocked-' || rc.status WHEN rb.selected IS NULL THEN 'initialized' WHEN rb.selected = rc.selected THEN 'no-change' ELSE 'effective-change' END AS action, rb.selected AS bs, rc.selected AS cs FROM rc LEFT JOIN rb USING (o_custkey))
SELECT o_custkey, action, CASE WHEN action = 'effective-change' THEN bs END AS from_revision, CASE WHEN action IN ('effective-change', 'initialized') THEN cs END AS to_revision FROM a""")
def watch_state(spark, sf_dir):
    r = resolution(spark, sf_dir, PROBES[:2])
    return watch.evaluate(r.where(F.col("probe_date") == F.lit(PROBES[0]).cast("date")), r.where(F.col("probe_date") == F.lit(PROBES[1]).cast("date")), "o_custkey")


@query("""WITH d AS (SELECT date_trunc('day', min(ts)) + INTERVAL 1 DAY AS second FROM events), b AS (SELECT ts, event_id FROM events, d WHERE ts < second ORDER BY ts DESC, event_id DESC LIMIT 1), e AS (SELECT ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
SELECT event_id, user_id FROM events WHERE (ts, event_id) > (SELECT (ts, event_id) FROM b) AND (ts, event_id) <= (SELECT (ts, event_id) FROM e)""")
def observed_since(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    pair, first = F.struct("ts", "event_id"), e.agg(F.date_trunc("day", F.min("ts")).alias("d")).first().d
    day_end = (first + timedelta(days=1)).replace(tzinfo=None)
    b = e.agg(F.max(F.when(F.col("ts") < F.lit(str(day_end)).cast("timestamp_ntz"), pair)).alias("after"), F.max(pair).alias("through")).first()
    return watch.observed_since(e, "ts", "event_id", tuple(b.after), tuple(b.through)).select("event_id", "user_id")


@query("SELECT DISTINCT user_id, nullif(event_type, 'view') AS code, CAST(ts AS DATE) AS day FROM events EXCEPT SELECT DISTINCT user_id, nullif(event_type, 'view'), CAST(ts AS DATE) FROM events WHERE value < 20")
def event_idempotence(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "value", "user_id", F.nullif(F.col("event_type"), F.lit("view")).alias("code"), F.to_date("ts").alias("day"))
    return watch.new_events(e.where("value < 20"), e.unionByName(e), ["user_id", "code", "day"]).select("user_id", "code", "day")


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY 1, 2")
def recent_activity(spark, sf_dir):
    return activity.recent(load(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id")


_DRAFTS = """WITH d AS (SELECT DISTINCT conv_id AS draft_id FROM conversations),
     c AS (SELECT conv_id AS draft_id, turn, CASE WHEN turn % 5 = 3 THEN '' ELSE 'c' || CAST(turn AS VARCHAR) END AS claim_id, CASE WHEN turn % 7 = 5 THEN [] ELSE [turn - 1, CASE WHEN turn % 3 = 0 THEN turn - 1 ELSE turn + 1 END] END AS refs FROM conversations WHERE role = 'assistant'),
     e AS (SELECT conv_id AS draft_id, turn AS evidence_id FROM conversations WHERE role <> 'assistant'),
     x AS (SELECT draft_id, 'CLAIMS_EMPTY' AS code FROM d WHERE draft_id NOT IN (SELECT draft_id FROM c)
       UNION ALL SELECT draft_id, 'CLAIM_ID_BLANK' FROM c WHERE claim_id = ''
       UNION ALL SELECT draft_id, 'CLAIM_ID_DUPLICATE' FROM c GROUP BY draft_id, claim_id HAVING count(*) > 1
       UNION ALL SELECT draft_id, 'CLAIM_WITHOUT_EVIDENCE' FROM c WHERE len(refs) = 0
       UNION ALL SELECT draft_id, 'EVIDENCE_REF_DUPLICATE' FROM c WHERE len(refs) > len(list_distinct(refs))
       UNION ALL SELECT draft_id, 'EVIDENCE_UNKNOWN' FROM (SELECT draft_id, unnest(list_distinct(refs)) AS r FROM c) u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.draft_id = u.draft_id AND evidence_id = r)),
     k AS (SELECT draft_id, count(DISTINCT code) AS n_codes FROM x GROUP BY 1)"""


def _drafts(spark, sf_dir):
    v = load(spark, sf_dir, "conversations")
    drafts = v.select(F.col("conv_id").alias("draft_id"), F.lit("answer").alias("answer_text")).distinct()
    refs = F.when(F.col("turn") % 7 == 5, F.array().cast("array<int>")).otherwise(F.array(F.col("turn") - 1, F.when(F.col("turn") % 3 == 0, F.col("turn") - 1).otherwise(F.col("turn") + 1)))
    claims = v.where("role = 'assistant'").select(F.col("conv_id").alias("draft_id"), F.when(F.col("turn") % 5 == 3, "").otherwise(F.concat(F.lit("c"), F.col("turn").cast("string"))).alias("claim_id"), refs.alias("evidence_ids"))
    return drafts, claims, v.where("role <> 'assistant'").select(F.col("conv_id").alias("draft_id"), F.col("turn").alias("evidence_id"))


@query(_DRAFTS + " SELECT draft_id, code, count(*) AS n FROM x GROUP BY 1, 2")
def claims_validation(spark, sf_dir):
    return evidence.claim_errors(*_drafts(spark, sf_dir))


@query(_DRAFTS + " SELECT d.draft_id, CASE WHEN n_codes > 0 THEN 'blocked' ELSE 'citation-ready' END AS status, coalesce(n_codes, 0) AS n_codes FROM d LEFT JOIN k USING (draft_id)")
def answer_finalise(spark, sf_dir):
    drafts, claims, known = _drafts(spark, sf_dir)
    return evidence.finalise(drafts, evidence.claim_errors(drafts, claims, known))


@query("SELECT doc_id, CASE WHEN length(t) > 1000 THEN substr(t, 1, 1000) || '…' ELSE t END AS quote FROM (SELECT doc_id, array_to_string(string_split(text, chr(10)), ' / ') AS t FROM documents)")
def evidence_quote(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", quote(F.array_join(F.split("text", "\n"), " / ")).alias("quote"))


@query("SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_extendedprice), 6) AS mean, median(l_extendedprice) AS median, list_sort(list(l_extendedprice))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95, count(*) AS n FROM lineitem GROUP BY 1")
def latency_stats(spark, sf_dir):
    return activity.latency_stats(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@query("SELECT event_type AS tag, count(*) AS n, count(DISTINCT user_id) AS n_owners FROM events GROUP BY 1 UNION ALL SELECT p_type, count(*), count(DISTINCT p_brand) FROM part GROUP BY 1")
def tag_inventory(spark, sf_dir):
    count = lambda d, tag, owner: d.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n"), F.count_distinct(owner).alias("n_owners"))
    return count(load(spark, sf_dir, "events"), "event_type", "user_id").union(count(load(spark, sf_dir, "part"), "p_type", "p_brand"))


@query("""WITH b AS (SELECT source, doc_id // 4096 AS block, sha256(string_agg(id || chr(9) || sha || chr(10), '' ORDER BY id)) AS sha, count(*) AS n FROM (SELECT source, doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, sha256(text) AS sha FROM documents) GROUP BY 1, 2)
SELECT source, sha256(string_agg(lpad(CAST(block AS VARCHAR), 12, '0') || chr(9) || sha || chr(10), '' ORDER BY block)) AS manifest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY source""")
def run_manifest_hash(spark, sf_dir):
    """Blocks of 4,096 ids are hashed first, then the hashes of a source's blocks: no task holds a source's rows."""
    named = lambda c: F.lpad(c.cast("string"), 12, "0")
    d = load(spark, sf_dir, "documents").select("source", F.expr("doc_id div 4096").alias("block"), named(F.col("doc_id")).alias("id"), F.sha2("text", 256).alias("sha"))
    blocks = d.groupBy("source", "block").agg(manifest_hash(F.collect_list(F.struct("id", "sha"))).alias("sha"), F.count("*").alias("n"))
    return blocks.groupBy("source").agg(manifest_hash(F.collect_list(F.struct(named(F.col("block")).alias("id"), "sha"))).alias("manifest"), F.sum("n").alias("n"))


@query("SELECT doc_id, sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), lang, sha256(text))) AS content_id FROM documents")
def content_ids(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", content_id("doc_id", "lang", F.sha2("text", 256)).alias("content_id"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    e = streaming.event_stream(load(spark, sf_dir, "events"), "ts")
    return streaming.drain(streaming.daily_counts(e, "ts", "event_type"), "complete")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    e = streaming.event_stream(load(spark, sf_dir, "events"), "ts")
    return streaming.drain(streaming.deduplicated(e.union(e), "ts", ["event_id"]).select("event_id", "user_id", "event_type"))


@query("""SELECT 'order_total_negative' AS check_name, count(*) AS violations FROM orders WHERE o_totalprice < 0
 UNION ALL SELECT 'order_key_unique', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'order_customer_resolves', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'order_has_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
 UNION ALL SELECT 'turns_contiguous', count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING min(turn) <> 0 OR max(turn) + 1 <> count(*) OR count(DISTINCT turn) <> count(*))
 UNION ALL SELECT 'n_chars_matches', count(*) FROM documents WHERE n_chars <> length(text)
 UNION ALL SELECT 'text_repeats', count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def quality_report(spark, sf_dir):
    o, d = load(spark, sf_dir, "orders"), load(spark, sf_dir, "documents")
    return quality.report(
        quality.violates("order_total_negative", o, F.col("o_totalprice") < 0),
        quality.unique("order_key_unique", o, ["o_orderkey"]),
        quality.resolves("order_customer_resolves", o, load(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]),
        quality.resolves("order_has_lines", o, load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"]),
        quality.contiguous("turns_contiguous", load(spark, sf_dir, "conversations"), ["conv_id"], "turn", 0),
        quality.violates("n_chars_matches", d, F.col("n_chars") != F.length("text")),
        quality.unique("text_repeats", d.select(F.sha2("text", 256).alias("sha")), ["sha"]),
    )


@query(f"SELECT item_id, {_sim('text', chr(39) + 'the and attion to thanedble' + chr(39))} AS score FROM benchmark")
def trigram_similarity(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.round(similarity(trigrams("text"), trigrams(F.lit("the and attion to thanedble"))), 6).alias("score"))


@query("SELECT user_id, event_type AS item FROM (SELECT user_id, event_type, arg_max(event_id % 2, (ts, event_id)) AS last FROM events GROUP BY 1, 2) WHERE last = 0")
def favourites_state(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("item"), F.when(F.col("event_id") % 2 == 0, "add").otherwise("remove").alias("action"), "ts", "event_id")
    return activity.favourites(e, "user_id", "item", "action", ["ts", "event_id"])


@query("""SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, grouping(r_name, n_name) AS level FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def revenue_rollup(spark, sf_dir):
    n = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = load(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "n_name")
    j = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id("r_name", "n_name").alias("level"))
