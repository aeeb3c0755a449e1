"""Registered queries over revision rows, comparisons by date, linkage, refresh states, user records and retrieval plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronolex.functions.identity import content_id
from chronolex.functions.canonical import canonical_json, json_kind
from chronolex.functions.text import first_iso_date, normalise
from chronolex.operators import activity, linkage, quality, records, temporal, watch
from chronolex.plans.queries import PROBES, _INTERVALS, _resolution_sql, intervals, probes, query
from chronolex.plans.structure import nodes_of
from chronolex.storage import load, materialise
from chronolex.streaming import events as streaming

# --- revision rows


def raw_revisions(spark, sf_dir):
    """Orders as raw revisions: ids of three parts, dates of a record that are missing, equal or in conflict."""
    o = load(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    law = F.lpad(F.col("o_custkey").cast("string"), 15, "0")
    suffix = F.when(F.col("o_orderpriority") == "5-LOW", "0" * 15).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 15, "0"))
    api = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_totalprice") > 400000, F.date_add("day", 1)).otherwise(F.col("day"))
    amending = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " ").when(F.col("o_orderpriority") == "3-MEDIUM", "X").otherwise(suffix)
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "unknown").when(F.col("o_totalprice") < 20000, "enactment").otherwise("amendment")
    return o.select(law.alias("law_id"), F.concat_ws("_", law, F.date_format("day", "yyyyMMdd"), suffix).alias("revision_id"), amending.alias("amending_id"), api.alias("api_date"), kind.alias("kind"), "day", "o_orderkey")


_RAW = """WITH raw AS (SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 15, '0') AS law_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderpriority = '5-LOW' THEN repeat('0', 15) ELSE lpad(CAST(o_orderkey AS VARCHAR), 15, '0') END AS suffix,
       CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice > 400000 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END AS api_date,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' WHEN o_totalprice < 20000 THEN 'enactment' ELSE 'amendment' END AS kind, o_orderpriority AS pr FROM orders),
     r AS (SELECT *, law_id || '_' || strftime(day, '%Y%m%d') || '_' || suffix AS revision_id, CASE pr WHEN '4-NOT SPECIFIED' THEN NULL WHEN '3-MEDIUM' THEN 'X' ELSE suffix END AS amending_id, suffix = repeat('0', 15) AS base, api_date IS NOT NULL AND api_date <> day AS conflict FROM raw)"""


@query(_RAW + """ SELECT law_id, revision_id, amending_id, CASE WHEN base THEN 'unknown' ELSE 'amendment' END AS kind, CASE WHEN base OR NOT conflict THEN day END AS valid_from,
 CASE WHEN base OR conflict THEN 'ambiguous' WHEN api_date IS NULL THEN 'confirmed-revision-id' ELSE 'confirmed-api' END AS quality,
 concat_ws(',', CASE WHEN NOT base AND conflict THEN 'EFFECTIVE_DATE_CONFLICT' END, CASE WHEN amending_id <> suffix THEN 'AMENDMENT_ID_MISMATCH' END, CASE WHEN kind <> CASE WHEN base THEN 'unknown' ELSE 'amendment' END THEN 'REVISION_KIND_MISMATCH' END) AS issues FROM r""")
def revision_rows(spark, sf_dir):
    return records.revision_rows(raw_revisions(spark, sf_dir))


@query(_RAW + """ SELECT 'id_format' AS check_name, count(*) AS violations FROM r WHERE NOT regexp_full_match(revision_id, '[0-9A-Z]{15}_[0-9]{8}_[0-9A-Z]{15}')
 UNION ALL SELECT 'id_of_another_law', count(*) FROM r WHERE split_part(revision_id, '_', 1) <> law_id
 UNION ALL SELECT 'amending_law_differs', count(*) FROM r WHERE amending_id <> split_part(revision_id, '_', 3)
 UNION ALL SELECT 'record_date_differs', count(*) FROM r WHERE api_date <> strptime(split_part(revision_id, '_', 2), '%Y%m%d')
 UNION ALL SELECT 'id_repeats', count(*) FROM (SELECT revision_id FROM r GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'record_date_missing', count(*) FROM r WHERE api_date IS NULL""")
def history_checks(spark, sf_dir):
    r = raw_revisions(spark, sf_dir).withColumn("amending_id", F.nullif(F.trim("amending_id"), F.lit("")))
    part = lambda i: F.split_part("revision_id", F.lit("_"), F.lit(i))
    return quality.report(
        quality.violates("id_format", r, ~F.col("revision_id").rlike("^[0-9A-Z]{15}_[0-9]{8}_[0-9A-Z]{15}$")),
        quality.violates("id_of_another_law", r, part(1) != F.col("law_id")),
        quality.violates("amending_law_differs", r, F.col("amending_id") != part(3)),
        quality.violates("record_date_differs", r, F.col("api_date") != F.try_to_date(part(2), "yyyyMMdd")),
        quality.unique("id_repeats", r, ["revision_id"]),
        quality.violates("record_date_missing", r, F.col("api_date").isNull()),
    )


@query(_INTERVALS + """ SELECT 'negative_interval' AS check_name, count(*) AS violations FROM i WHERE valid_to_exclusive <= valid_from UNION ALL SELECT 'sequence_repeats', count(*) FROM (SELECT o_custkey, sequence FROM i GROUP BY 1, 2 HAVING count(*) > 1)
 UNION ALL SELECT 'sequence_contiguous', count(*) FROM (SELECT o_custkey FROM i GROUP BY 1 HAVING min(sequence) <> 1 OR max(sequence) <> count(*)) UNION ALL SELECT 'same_day_not_ambiguous', count(*) FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, valid_from) AS k FROM i) WHERE k > 1 AND interval_quality <> 'ambiguous'""")
def interval_checks(spark, sf_dir):
    i = materialise(intervals(spark, sf_dir), "intervals")
    days = i.groupBy("o_custkey", "valid_from").agg(F.count("*").alias("k"), F.count_if(F.col("interval_quality") != "ambiguous").alias("sure"))
    several = days.where("k > 1").agg(F.coalesce(F.sum("sure"), F.lit(0)).alias("violations")).select(F.lit("same_day_not_ambiguous").alias("check_name"), "violations")
    return quality.report(
        quality.violates("negative_interval", i, F.col("valid_to_exclusive") <= F.col("valid_from")), quality.unique("sequence_repeats", i, ["o_custkey", "sequence"]), quality.contiguous("sequence_contiguous", i, ["o_custkey"], "sequence"), several,
    )


@query(_INTERVALS + " SELECT o_custkey, valid_from, count(*) AS n FROM i WHERE valid_to_exclusive IS NULL AND valid_from IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguous_today(spark, sf_dir):
    return records.ambiguous_keys(intervals(spark, sf_dir), "o_custkey", "valid_from")


@query("SELECT p_brand, arg_max(p_name, (p_type = 'ECONOMY', p_size, p_name)) AS title FROM part GROUP BY 1")
def latest_titles(spark, sf_dir):
    t = load(spark, sf_dir, "part").withColumn("day", F.lit(None).cast("date"))
    return records.title_of(t, "p_brand", "p_name", F.col("p_type") == "ECONOMY", "p_size", "day")


# --- comparison of two dates


def _articles(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("revision"), F.concat(F.lit("2:"), F.col("l_linenumber").cast("string")).alias("article"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"))


@query(_resolution_sql((PROBES[0], PROBES[2])).replace("WHERE l_returnflag = 'R'", "WHERE l_linenumber = 1") + f""",
     z AS (SELECT l.o_custkey, l.selected AS ls, r.selected AS rs, CASE WHEN l.status <> 'resolved' OR r.status <> 'resolved' THEN 'blocked-temporal' WHEN l.content_status <> 'available' OR r.content_status <> 'available' THEN 'blocked-content' WHEN l.selected = r.selected THEN 'same-revision' ELSE 'compared' END AS status
       FROM resolution l JOIN resolution r USING (o_custkey) WHERE l.probe_date = DATE '{PROBES[0]}' AND r.probe_date = DATE '{PROBES[2]}'),
     a AS (SELECT l_orderkey AS rev, '2:' || l_linenumber AS article, max(sha256(l_returnflag || ' ' || l_linestatus)) AS sha FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1),
     x AS (SELECT o_custkey, article, sha FROM z JOIN a ON rev = ls WHERE status = 'compared'), y AS (SELECT o_custkey, article, sha FROM z JOIN a ON rev = rs WHERE status = 'compared'),
     d AS (SELECT o_custkey, article, CASE WHEN x.sha IS NULL THEN 'added' WHEN y.sha IS NULL THEN 'removed' WHEN x.sha <> y.sha THEN 'changed' ELSE 'unchanged' END AS change FROM x FULL JOIN y USING (o_custkey, article)),
     pl AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN change = 'unchanged' THEN 1 ELSE 0 END, CAST(split_part(article, ':', 2) AS INT)) AS place, count(*) OVER (PARTITION BY o_custkey) > 3 AS truncated FROM d)
SELECT z.o_custkey, status, article, change, place, truncated FROM z LEFT JOIN (SELECT * FROM pl WHERE place <= 3) q USING (o_custkey)""")
def compare_dates(spark, sf_dir):
    """Articles (lines) of every customer's order on two dates; three changes of each are listed."""
    o = materialise(intervals(spark, sf_dir), "intervals")
    contents = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_contents"))
    dates = (PROBES[0], PROBES[2])
    r = temporal.resolve_as_of(o, contents, probes(spark, sf_dir, dates), "o_custkey", "o_orderkey", "valid_from", "probe_date")
    return records.compare_dates(_articles(spark, sf_dir), materialise(r, "resolutions"), "o_custkey", *dates, most=3)


@query()
def character_changes(spark, sf_dir):
    """Edits from every part's name to that of the next part."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    return records.character_changes(p.join(following, "p_partkey"), "p_name", "next_name", "p_partkey")


# --- linkage


def _supply(spark, sf_dir):
    """Texts that name brands, types and names of parts; targets are brands with the names of their parts."""
    p = load(spark, sf_dir, "part")
    texts = p.select(F.col("p_partkey").alias("text_id"), F.concat_ws(" ", F.lit("for"), "p_brand", F.lit("or the"), "p_name").alias("text"), F.lit("mentions").alias("relation"))
    targets = p.groupBy(F.col("p_brand").alias("target")).agg(F.array_sort(F.collect_set(F.when(F.col("p_size") > 48, F.col("p_name")))).alias("names")).withColumn("id_token", F.col("target"))
    return texts, targets


@query("""WITH t AS (SELECT p_partkey AS text_id, 'for ' || p_brand || ' or the ' || p_name AS text FROM part), g AS (SELECT p_brand AS target, list(DISTINCT p_name) FILTER (p_size > 48) AS names FROM part GROUP BY 1),
     i AS (SELECT text_id, target, 'id' AS signal FROM t JOIN g ON list_contains(string_split(upper(text), ' '), upper(target))),
     m AS (SELECT DISTINCT text_id, target, 'name' AS signal FROM t, (SELECT target, unnest(names) AS name FROM g) u WHERE length(replace(name, ' ', '')) >= 3 AND contains(replace(text, ' ', ''), replace(name, ' ', '')))
SELECT text_id, target, 'mentions' AS relation, string_agg(signal, ',' ORDER BY signal) AS signals FROM (SELECT * FROM i UNION ALL SELECT * FROM m) GROUP BY 1, 2""")
def link_proposals(spark, sf_dir):
    return records.link_proposals(*_supply(spark, sf_dir))


@query("SELECT p_brand AS target, coalesce(array_to_string(list_sort(list(DISTINCT p_name) FILTER (p_size > 48)), '|'), '') AS names, count(*) AS n FROM part GROUP BY 1")
def link_catalogue(spark, sf_dir):
    """Targets with their distinct names in order, an empty list where there is none."""
    _, targets = _supply(spark, sf_dir)
    n = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("target")).agg(F.count("*").alias("n"))
    return targets.join(n, "target").select("target", F.array_join("names", "|").alias("names"), "n")


@query("""WITH l AS (SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations GROUP BY 1), f AS (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM l)
SELECT conv_id, turn, CAST(generate_subscripts(parts, 1) AS BIGINT) AS field, unnest(parts) AS text FROM f""")
def text_sources(spark, sf_dir):
    """Fields (lines) of the latest snapshot (turn) of every document (conversation)."""
    last = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))
    return last.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("field"), "text")


@query("SELECT user_id, event_id, event_type AS basis, CASE WHEN event_type = 'purchase' THEN 'confirmed' ELSE 'candidate' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events")
def assertion_history(spark, sf_dir):
    """All assertions of a relation, the latest first, each with the status its basis starts with."""
    e = load(spark, sf_dir, "events").withColumn("basis", F.when(F.col("event_type") == "purchase", "official-link").otherwise(F.col("event_type")))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.select("user_id", "event_id", F.col("event_type").alias("basis"), linkage.default_status(F.col("basis")).alias("status"), F.row_number().over(w).alias("place"))


@query("""WITH r AS (SELECT event_id, user_id AS target, CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'view' THEN 'rejected' ELSE event_type END AS decision, CASE WHEN value < 10 THEN ' ' ELSE props END AS rationale FROM events)
SELECT event_id, target, decision, CASE WHEN decision NOT IN ('confirmed', 'rejected') THEN 'unknown-decision' WHEN trim(coalesce(rationale, '')) = '' THEN 'rationale-missing' WHEN target NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'target-missing' ELSE 'appended' END AS result FROM r""")
def manual_reviews(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    decision = F.when(F.col("event_type") == "click", "confirmed").when(F.col("event_type") == "view", "rejected").otherwise(F.col("event_type"))
    reviews = e.select("event_id", F.col("user_id").alias("target"), decision.alias("decision"), F.when(F.col("value") < 10, " ").otherwise(F.col("props")).alias("rationale"))
    targets = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("target"))
    return records.reviewed(reviews, targets).select("event_id", "target", "decision", "result")


@query("SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY d IS NULL, d, lang, doc_id) AS place FROM (SELECT source, doc_id, lang, CASE WHEN lang <> 'de' THEN DATE '2020-01-01' + CAST(n_chars AS INT) END AS d FROM documents)")
def materials_in_order(spark, sf_dir):
    """Materials of each target by date, undated ones last, then provider and id."""
    d = load(spark, sf_dir, "documents").select("source", "doc_id", "lang", F.when(F.col("lang") != "de", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_chars").cast("int"))).alias("d"))
    return activity.places(d, "source", [F.asc_nulls_last("d"), "lang", "doc_id"]).drop("d")


@query("""SELECT d.doc_id, d.lang, b.n AS n_same, CASE WHEN b.n = 1 THEN d.doc_id END AS single_id, l.state FROM documents d JOIN (SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1) b ON b.sha = sha256(d.text)
 LEFT JOIN (SELECT doc_id, max(quality * 2 + toxic) AS state FROM labels GROUP BY 1) l USING (doc_id)""")
def document_provenance(spark, sf_dir):
    """Document, digest, label: a chain of joins, and a value that is given only where the digest is of one document."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    states = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") * 2 + F.col("toxic")).alias("state"))
    joined = d.join(d.groupBy("sha").agg(F.count("*").alias("n_same")), "sha").join(states, "doc_id", "left")
    return joined.select("doc_id", "lang", "n_same", F.when(F.col("n_same") == 1, F.col("doc_id")).alias("single_id"), "state")


# --- refresh states

_ATTEMPTS = """WITH t AS (SELECT CAST(ts AS DATE) AS run, user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) AS attempt FROM events),
     p AS (SELECT run, user_id, bool_or(ok) AS ok, max(attempt) AS last FROM t WHERE attempt <= 2 AND (attempt = 1 OR user_id IN (SELECT f.user_id FROM t f WHERE f.run = t.run AND f.user_id = t.user_id AND f.attempt = 1 AND NOT f.ok)) AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1, 2)"""


@query(_ATTEMPTS + " SELECT run, count(*) AS n, count(*) FILTER (last > 1) AS n_retried, count(*) FILTER (NOT ok) AS n_failed, CASE WHEN count(*) FILTER (NOT ok) = 0 THEN 'succeeded' WHEN count(*) FILTER (NOT ok) = count(*) THEN 'failed' ELSE 'partial' END AS status, count(*) FILTER (NOT ok) = 0 AS evaluated FROM p GROUP BY run")
def refresh_outcome(spark, sf_dir):
    """Daily runs over watched users: the first event of a day is the attempt, a second one counts if the first was an error."""
    w = Window.partitionBy("run", "user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").select(F.to_date("ts").alias("run"), "user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    tried = e.withColumn("attempt", F.row_number().over(w)).withColumn("first_ok", F.first("ok").over(w)).where("attempt = 1 or not first_ok")
    watched = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return records.refresh_outcome(tried, watched, "run", "user_id")


@query("SELECT o_orderkey AS run, CAST(o_orderdate AS DATE) AS started_at, CASE o_orderstatus WHEN 'P' THEN DATE '1999-01-01' WHEN 'F' THEN CAST(o_orderdate AS DATE) + 1 END AS finished_at, CASE o_orderstatus WHEN 'P' THEN 'partial' WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status FROM orders")
def closed_runs(spark, sf_dir):
    day = F.to_date("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed")
    runs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), day.alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 1)).alias("finished_at"), status.alias("status"))
    return records.closed_runs(runs, F.lit("1999-01-01").cast("date"))


@query("""WITH b AS (SELECT o_custkey AS key, max(o_orderkey) FILTER (o_orderstatus = 'F') AS br, coalesce(max(o_orderdate) FILTER (o_orderstatus = 'F'), DATE '1990-01-01') AS bs FROM orders GROUP BY 1)
SELECT key, o_orderkey AS revision, CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'fetch' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'rebuild-chunks' ELSE 'ready' END AS action FROM orders JOIN b ON key = o_custkey WHERE o_orderdate > bs OR o_orderkey = br""")
def content_refresh(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    f = F.col("o_orderstatus") == "F"
    base = o.groupBy(F.col("o_custkey").alias("key")).agg(F.max(F.when(f, F.col("o_orderkey"))).alias("baseline_revision"), F.coalesce(F.max(F.when(f, F.col("o_orderdate"))), F.lit("1990-01-01").cast("timestamp_ntz")).alias("baseline_seen"))
    line = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "revision")
    return records.missing_content(o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("revision"), F.col("o_orderdate").alias("seen")), base, line, line.where("l_returnflag = 'R'"))


_ACK = "CASE WHEN event_type = 'view' THEN ts WHEN event_type = 'click' THEN TIMESTAMP '2030-01-01' END"


@query(f"SELECT event_id, user_id, {_ACK} AS acknowledged_at FROM events")
def acknowledged_events(spark, sf_dir):
    """Views were acknowledged when they happened, clicks are now; naming a view again keeps its time."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_type") == "view", F.col("ts")).alias("acknowledged_at"))
    done = watch.acknowledge(e, e.where("event_type in ('view', 'click')").select("event_id"), "event_id", "2030-01-01")
    return done.select("event_id", "user_id", F.col("acknowledged_at").cast("timestamp_ntz").alias("acknowledged_at"))


@query("""SELECT c_custkey AS user_id, c_name AS title, coalesce(n, 0) AS n_events, coalesce(k, 0) AS n_open, m AS latest_open FROM customer LEFT JOIN
 (SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'view') AS k, max(ts) FILTER (event_type <> 'view') AS m FROM events GROUP BY 1) e ON user_id = c_custkey""")
def watch_list(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "view", F.col("ts")).alias("acknowledged_at"), F.col("ts").alias("created_at"))
    c = load(spark, sf_dir, "customer")
    return records.watch_list(c.select(F.col("c_custkey").alias("user_id")), e, c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("title")), "user_id")


# --- users


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 GROUP BY 1, 2")
def query_history(spark, sf_dir):
    """A history in which an id (user and type) is appended once, when it is first seen."""
    e = load(spark, sf_dir, "events").withColumn("query_id", F.concat_ws("/", "user_id", "event_type"))
    return records.appended_once(e, "query_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""WITH g AS (SELECT user_id AS owner, event_type AS theme_id, CASE WHEN value < 5 THEN 'delete' ELSE 'save' END AS action, trim(CASE WHEN value > 60 THEN repeat('x', 200) ELSE props END) AS title, event_id AS seq FROM events),
     l AS (SELECT owner, theme_id, arg_max(action, seq) AS action, arg_max(title, seq) AS title FROM g WHERE action = 'delete' OR length(title) BETWEEN 1 AND 120 GROUP BY 1, 2) SELECT owner, theme_id, title FROM l WHERE action <> 'delete'""")
def saved_themes(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("owner"), F.col("event_type").alias("theme_id"), F.when(F.col("value") < 5, "delete").otherwise("save").alias("action"), F.when(F.col("value") > 60, F.repeat(F.lit("x"), 200)).otherwise(F.col("props")).alias("title"), F.col("event_id").alias("at"))
    return records.themes(log)


@query("""SELECT user_id, 'recent' AS section, event_type AS item, count(*) AS n FROM events GROUP BY 1, 3 UNION ALL SELECT user_id, 'history', CAST(min(event_id) AS VARCHAR), count(*) FROM events GROUP BY user_id
 UNION ALL SELECT user_id, 'favourite', event_type, 1 FROM (SELECT user_id, event_type, arg_max(event_id % 2, (ts, event_id)) AS last FROM events GROUP BY 1, 2) WHERE last = 0""")
def daily_state(spark, sf_dir):
    """Recent items, history and favourites of all users in one table."""
    e = load(spark, sf_dir, "events")
    recent = e.groupBy("user_id", F.lit("recent").alias("section"), F.col("event_type").alias("item")).agg(F.count("*").alias("n"))
    history = e.groupBy("user_id", F.lit("history").alias("section")).agg(F.min("event_id").cast("string").alias("item"), F.count("*").alias("n"))
    last = e.groupBy("user_id", "event_type").agg(F.max_by(F.col("event_id") % 2, F.struct("ts", "event_id")).alias("last")).where("last = 0")
    return recent.unionByName(history).unionByName(last.select("user_id", F.lit("favourite").alias("section"), F.col("event_type").alias("item"), F.lit(1).cast("long").alias("n")))


# --- plans and texts

_STOP = ("とは何ですか", "について", "の")


@query(r"""WITH q AS (SELECT p_partkey, translate(x, '０１２３４５６７８９', '0123456789') AS q, p_brand FROM (SELECT p_partkey, p_brand, CASE p_size % 3 WHEN 0 THEN '２０２０年１月０２日の' || p_brand || '第' || p_size || '条の' || p_name WHEN 1 THEN '2021-03-04 ' || p_brand || 'の' || p_name || '、' || p_type || 'とは何ですか？' ELSE p_brand || 'について' END AS x FROM part)),
     a AS (SELECT *, nullif(regexp_extract(q, '第([0-9]+(?:の[0-9]+)*)条', 1), '') AS article, coalesce(TRY_CAST(nullif(regexp_extract(q, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') AS DATE), TRY_CAST(regexp_extract(q, '([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日', 1) || '-' || lpad(regexp_extract(q, '([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日', 2), 2, '0') || '-' || lpad(regexp_extract(q, '([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日', 3), 2, '0') AS DATE)) AS as_of,
       list_filter(regexp_split_to_array(replace(replace(replace(regexp_replace(regexp_replace(replace(q, p_brand, ' '), '([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日|[0-9]{4}-[0-9]{2}-[0-9]{2}', ' ', 'g'), '第([0-9]+(?:の[0-9]+)*)条', ' ', 'g'), 'とは何ですか', ' '), 'について', ' '), 'の', ' '), '[\s、。？?,.!]+'), lambda s: length(s) >= 2) AS seg FROM q),
     s AS (SELECT *, (list_sort(list_transform(seg, lambda s: {'n': length(s), 's': s})))[-1].s AS longest FROM a)
SELECT p_partkey, article, as_of, CASE WHEN article IS NULL THEN longest END AS segment, CASE WHEN article IS NOT NULL THEN 'structural' WHEN longest IS NOT NULL THEN 'lexical' ELSE 'none' END AS mode FROM s""")
def retrieval_plan(spark, sf_dir):
    """Questions about every part: some with a date, some with an article, some with neither."""
    p, size = load(spark, sf_dir, "part"), F.col("p_size") % 3
    q = (
        F.when(size == 0, F.concat(F.lit("２０２０年１月０２日の"), "p_brand", F.lit("第"), F.col("p_size").cast("string"), F.lit("条の"), "p_name"))
        .when(size == 1, F.concat(F.lit("2021-03-04 "), "p_brand", F.lit("の"), "p_name", F.lit("、"), "p_type", F.lit("とは何ですか？")))
        .otherwise(F.concat("p_brand", F.lit("について")))
    )
    return records.retrieval_plan(p.select("p_partkey", "p_brand", q.alias("question")), "question", "p_brand", list(_STOP)).select("p_partkey", "article", "as_of", "segment", "mode")


@query(r"SELECT doc_id, sha256(regexp_replace(nfc_normalize(text), '\s+', '', 'g')) AS exact_sha, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS retrieval_sha, sha256(regexp_replace(trim(text, ' '), '\s+', ' ', 'g')) AS search_sha FROM documents")
def normal_forms(spark, sf_dir):
    """The three normal forms of every text; these texts hold no character that NFKC changes and NFC does not."""
    d = load(spark, sf_dir, "documents")
    search_form = F.regexp_replace(F.trim("text"), r"(?U)\s+", " ")
    return d.select("doc_id", F.sha2(records.exact_text("text"), 256).alias("exact_sha"), F.sha2(normalise("text"), 256).alias("retrieval_sha"), F.sha2(search_form, 256).alias("search_sha"))


@query("""SELECT event_id, CAST(props ->> '$.k' AS INT) AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z, lower(json_type(props)) AS kind, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' END AS k_kind,
 CAST(json_array_length('[' || props || ',' || props || ']') AS INT) AS n, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","missing":null,"props":{"k":"' || (props ->> '$.k') || '"},"tags":["' || event_type || '",null],"user_id":' || user_id || '}') AS canonical FROM events""")
def json_fields(spark, sf_dir):
    """A field, the presence and types of keys in JSON, lengths of arrays, and rows as canonical JSON, whatever the order of their fields."""
    e = load(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    row = F.struct("user_id", F.from_json("props", "map<string,string>").alias("props"), F.array("event_type", F.lit(None).cast("string")).alias("tags"), F.lit(None).cast("string").alias("missing"), "event_type", "event_id")
    made = e.withColumn("row", row)
    listed = F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))
    return made.select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.array_contains(keys, "k").alias("has_k"), F.array_contains(keys, "z").alias("has_z"),
        json_kind("props").alias("kind"), json_kind(F.get_json_object("props", "$.k")).alias("k_kind"), F.json_array_length(listed).alias("n"), F.sha2(canonical_json("row", made.schema["row"].dataType), 256).alias("canonical"),
    )


@query("SELECT vec_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> (SELECT max(len(embedding)) FROM embeddings) THEN 'length' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' END AS fault FROM embeddings")
def embedding_faults(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    dims = e.agg(F.max(F.size("embedding"))).first()[0]
    return records.embedding_faults(e, "embedding", dims).select("vec_id", "fault")


@query("WITH n AS (SELECT vec_id, label, sha256(CAST(label AS VARCHAR)) AS digest FROM embeddings) SELECT vec_id, digest FROM n WHERE label % 2 = 1")
def stored_embeddings(spark, sf_dir):
    """Vectors of even labels are there already; the others are inserted. A digest that differs would fail the query."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.sha2(F.col("label").cast("string"), 256).alias("digest"))
    return records.stored_embeddings(e.where("label % 2 = 0"), e, "vec_id", "digest").select("vec_id", "digest")


@query()
def hash_embeddings(spark, sf_dir):
    """Embeddings of every document's language and text."""
    d = load(spark, sf_dir, "documents").select("doc_id", records.embedding_input("lang", "text").alias("text"))
    return records.hash_embedding(d, "text").select("doc_id", "embedding")


@query("SELECT doc_id, sha256(CASE WHEN trim(coalesce(lang, '')) = '' THEN text ELSE trim(lang) || chr(10) || chr(10) || text END) AS sha FROM documents")
def embedding_inputs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(records.embedding_input("lang", "text"), 256).alias("sha"))


_TEXT_DATES = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y-02-30') ELSE strftime(o_orderdate, '%Y-%m-%d') || ' (draft)' END AS a, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') END AS b FROM orders"
_ISO = "CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({x} AS DATE) END"


@query(f"SELECT o_orderkey, coalesce({_ISO.format(x='a')}, {_ISO.format(x='b')}) AS issued FROM ({_TEXT_DATES})")
def issue_dates(spark, sf_dir):
    """The first full ISO date of an order among two texts: slashes, days that don't exist, remarks and months alone are none."""
    o = load(spark, sf_dir, "orders")
    day, rest = lambda f, d="o_orderdate": F.date_format(d, f), lambda n: F.col("o_orderkey") % n
    a = F.when(rest(4) == 0, day("yyyy-MM-dd")).when(rest(4) == 1, day("yyyy/MM/dd")).when(rest(4) == 2, day("yyyy-'02-30'")).otherwise(F.concat(day("yyyy-MM-dd"), F.lit(" (draft)")))
    b = F.when(rest(3) == 0, day("yyyy-MM-dd", F.date_add(F.to_date("o_orderdate"), 9))).when(rest(3) == 1, day("yyyy-MM"))
    return o.select("o_orderkey", a.alias("a"), b.alias("b")).select("o_orderkey", first_iso_date("a", "b").alias("issued"))


# --- document store

_STORED = "SELECT max(doc_id) / 2 FROM documents"


@query(f"""SELECT doc_id, 'insert' AS action FROM documents WHERE doc_id > ({_STORED}) AND lang <> 'es' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id <= ({_STORED}))
 UNION ALL SELECT doc_id, 'deferred: LAW_REVISION_NOT_RECONCILED' FROM documents WHERE doc_id > ({_STORED}) AND lang = 'es' UNION ALL SELECT doc_id, 'present' FROM documents WHERE doc_id > ({_STORED}) AND lang <> 'es' AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id <= ({_STORED}))""")
def document_store(spark, sf_dir):
    """What a run does with new documents: insert, leave those that are there, defer those whose revision is unknown."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    half = d.agg(F.max("doc_id") / 2).first()[0]
    old, new = d.where(F.col("doc_id") <= half), d.where(F.col("doc_id") > half)
    known = old.select("sha").distinct().withColumn("known", F.lit(True))
    action = F.when(F.col("lang") == "es", "deferred: LAW_REVISION_NOT_RECONCILED").when(F.col("known"), "present").otherwise("insert")
    return new.join(known, "sha", "left").select("doc_id", action.alias("action"))


@query("SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.title, o.title) AS title FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'q' || doc_id END AS title FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)) n FULL JOIN (SELECT doc_id, lang AS title FROM documents) o USING (doc_id)")
def coalesced_titles(spark, sf_dir):
    """Metadata merge that keeps an old title where the new one is null."""
    n = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("new"))
    o = load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("old"))
    return n.join(o, "doc_id", "full_outer").select("doc_id", F.coalesce("new", "old").alias("title"))


@query("SELECT doc_id, sha256(concat_ws(chr(31), 'v1', source, CAST(doc_id AS VARCHAR))) AS document_id, sha256(concat_ws(chr(31), 'v1', sha256(concat_ws(chr(31), 'v1', source, CAST(doc_id AS VARCHAR))), sha256(text))) AS snapshot_id FROM documents")
def snapshot_ids(spark, sf_dir):
    """Identity of external documents, and of their snapshots by payload."""
    d = load(spark, sf_dir, "documents").withColumn("document_id", content_id(F.lit("v1"), "source", "doc_id"))
    return d.select("doc_id", "document_id", content_id(F.lit("v1"), "document_id", F.sha2("text", 256)).alias("snapshot_id"))


# --- payloads, exports, scopes of evidence


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '{"question":"' || p_name || '","as_of":"1995-02-30"}' WHEN 1 THEN '{"question":" ","law_id":"1"}' WHEN 2 THEN '{"question":"' || p_name || '","x":1}' WHEN 3 THEN '{"question":"' || p_name || '","law_id":"short"}' ELSE '{"question":" ' || p_name || '","law_id":"' || lpad(CAST(p_partkey AS VARCHAR), 15, '0') || '"}' END AS j, p_name, p_size FROM part)
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'question length' WHEN 2 THEN 'unknown field' WHEN 3 THEN 'law id' END AS error, CASE WHEN p_size % 5 = 4 THEN p_name END AS question, CASE WHEN p_size % 5 = 4 THEN DATE '2024-01-01' END AS as_of, CASE WHEN p_size % 5 = 4 THEN lpad(CAST(p_partkey AS VARCHAR), 15, '0') END AS law_id FROM p""")
def query_payloads(spark, sf_dir):
    p, size, name = load(spark, sf_dir, "part"), F.col("p_size") % 5, F.to_json(F.struct(F.col("p_name").alias("question")))
    head = F.substr(name, F.lit(1), F.length(name) - 1)
    law = F.lpad(F.col("p_partkey").cast("string"), 15, "0")
    payload = (
        F.when(size == 0, F.concat(head, F.lit(',"as_of":"1995-02-30"}'))).when(size == 1, F.lit('{"question":" ","law_id":"1"}')).when(size == 2, F.concat(head, F.lit(',"x":1}')))
        .when(size == 3, F.concat(head, F.lit(',"law_id":"short"}'))).otherwise(F.concat(F.replace(head, F.lit('":"'), F.lit('":" ')), F.lit(',"law_id":"'), law, F.lit('"}')))
    )
    return records.payloads(p.select("p_partkey", payload.alias("payload")), "payload", "2024-01-01").select("p_partkey", "error", "question", "as_of", "law_id")


@query("SELECT o_custkey, count(*) AS n, '[' || string_agg('{\"place\":' || k || ',\"text\":\"' || substr(t, 1, 6) || '\"}', ',' ORDER BY k) || ']' AS payload FROM (SELECT o_custkey, o_orderpriority AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 8 GROUP BY 1")
def bounded_export(spark, sf_dir):
    return records.bounded_export(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", 8, 6)


@query("SELECT DISTINCT o_custkey AS doc FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def substantive_documents(spark, sf_dir):
    return records.substantive(nodes_of(spark, sf_dir))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))
 OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error')""")
def nested_exists(spark, sf_dir):
    """Keys with a finished order without returned line, or with an error: semi and anti joins, joined as sets."""
    c = load(spark, sf_dir, "customer").select("c_custkey")
    returned = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    clean = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(returned, "o_orderkey", "left_anti").select(F.col("o_custkey").alias("c_custkey"))
    failed = load(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return c.join(clean.union(failed).distinct(), "c_custkey", "left_semi")


@query("""WITH s AS (SELECT doc_id AS relation_id, CASE WHEN bool_or(quality = 1) AND bool_or(toxic = 1) THEN 'conflicted' WHEN bool_or(quality = 1) THEN 'confirmed' WHEN bool_or(toxic = 1) THEN 'rejected' ELSE 'candidate' END AS state FROM labels GROUP BY 1)
SELECT doc_id AS relation_id, source, state, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, true AS citation_ready FROM documents JOIN s ON relation_id = doc_id WHERE state = 'confirmed'""")
def relation_envelopes(spark, sf_dir):
    states = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("relation_id")).agg(linkage.effective_state(F.col("quality") == 1, F.col("toxic") == 1).alias("state"))
    return records.envelopes(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("relation_id"), "source"), states, "source")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
     s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    """Runs of a user's events less than half an hour apart, by session windows of the stream."""
    e = streaming.event_stream(load(spark, sf_dir, "events"), "ts")
    found = streaming.drain(streaming.sessions(e, "ts", "user_id"), "complete")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})
