"""Records of runs, relations and users: revision rows, proposals, refresh states, histories, comparisons by date."""

from __future__ import annotations

import difflib
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.text import ascii_digits
from chronolex.operators import linkage, temporal
from chronolex.operators.activity import places

# --- revision rows


def revision_rows(raw: DataFrame) -> DataFrame:
    """Derived columns and issues of raw revisions (law_id, revision_id, amending_id, api_date, kind).

    An id of another law fails the query. An amending id that isn't the id's suffix is an error, a kind that
    isn't the derived one a warning; a blank amending id is stored as null.
    """
    parts = F.split("revision_id", "_")
    suffix, day = F.get(parts, F.lit(2)), F.try_to_date(F.get(parts, F.lit(1)), "yyyyMMdd")
    amending = F.nullif(F.trim("amending_id"), F.lit(""))
    derived = temporal.derive_temporal(suffix, day, F.col("api_date"))
    same_law = F.when(F.get(parts, F.lit(0)) == F.col("law_id"), True).otherwise(F.raise_error(F.lit("revision id of another law")).cast("boolean"))
    rows = raw.where(same_law).withColumn("d", derived).withColumn("amending_id", amending)
    codes = F.array_compact(F.array(F.col("d.issue"), F.when(F.col("amending_id") != suffix, "AMENDMENT_ID_MISMATCH"), F.when(F.col("kind") != F.col("d.kind"), "REVISION_KIND_MISMATCH")))
    return rows.select("law_id", "revision_id", "amending_id", F.col("d.kind").alias("kind"), F.col("d.valid_from").alias("valid_from"), F.col("d.quality").alias("quality"), F.array_join(codes, ",").alias("issues"))


def ambiguous_keys(intervals: DataFrame, key: str, valid_from: str) -> DataFrame:
    """(key, valid_from, n): dates on which a key has several revisions and no later one, so that asking today is ambiguous."""
    last = intervals.where(F.col("valid_to_exclusive").isNull() & F.col(valid_from).isNotNull())
    return last.groupBy(key, valid_from).agg(F.count("*").alias("n")).where("n > 1")


def title_of(titles: DataFrame, key: str, title: str, current: Column, sequence: str, day: str) -> DataFrame:
    """The title of each key: a current one first, then the latest by sequence, then by date; nulls last."""
    order = F.struct(F.coalesce(current, F.lit(False)), F.coalesce(F.col(sequence), F.lit(-1)), F.coalesce(F.col(day), F.lit("0001-01-01").cast("date")), F.col(title))
    return titles.groupBy(key).agg(F.max_by(title, order).alias("title"))


# --- comparison of two dates


def compare_dates(articles: DataFrame, resolutions: DataFrame, key: str, left: str, right: str, most: int = 500) -> DataFrame:
    """(key, status, article, change, place, truncated): the articles of each key's revisions on two dates.

    articles: (revision, article, text). resolutions: (key, probe_date, status, selected, content_status). A key whose
    revision isn't resolved, or has no single content, on either date is blocked; one whose revision is the same has
    nothing to compare. Articles that repeat in a revision are left out. Of each key the first most changes by article
    number are given, unchanged articles last.
    """
    side = lambda d, s: resolutions.where(F.col("probe_date") == F.lit(d).cast("date")).select(key, F.col("status").alias(f"{s}_status"), F.col("selected").alias(s), F.col("content_status").alias(f"{s}_content"))
    both = side(left, "l").join(side(right, "r"), key)
    status = (
        F.when((F.col("l_status") != "resolved") | (F.col("r_status") != "resolved"), "blocked-temporal")
        .when((F.col("l_content") != "available") | (F.col("r_content") != "available"), "blocked-content")
        .when(F.col("l") == F.col("r"), "same-revision").otherwise("compared")
    )
    both = both.withColumn("compare_status", status)
    asked = both.where("compare_status = 'compared'").select(key, "l", "r")
    once = articles.groupBy("revision", "article").agg(F.count("*").alias("n"), F.max(F.sha2("text", 256)).alias("sha")).where("n = 1")
    of = lambda s: asked.select(key, F.col(s).alias("revision")).join(once, "revision").select(key, "article", F.col("sha").alias(s))
    joined = of("l").join(of("r"), [key, "article"], "full_outer")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.col("l") != F.col("r"), "changed").otherwise("unchanged")
    changed = joined.withColumn("change", change)
    w = Window.partitionBy(key).orderBy((F.col("change") == "unchanged").cast("int"), article_order("article"), "article")
    placed = changed.withColumn("place", F.row_number().over(w)).withColumn("n_all", F.count("*").over(Window.partitionBy(key)))
    listed = placed.where(F.col("place") <= most).select(key, "article", "change", F.col("place").cast("long").alias("place"), (F.col("n_all") > most).alias("truncated"))
    return both.select(key, F.col("compare_status").alias("status")).join(listed, key, "left")


def scoped_order(scope: Column | str, article: Column | str) -> Column:
    """Sort key of articles in their scopes: the main part first, then other scopes by name; numbers (2, 2_1, 2:3) before other texts."""
    s, a = (F.col(x) if isinstance(x, str) else x for x in (scope, article))
    is_number = a.rlike(r"^[0-9]+(_[0-9]+)*(:[0-9]+(_[0-9]+)*)*$")
    sides = F.transform(F.split(a, ":"), lambda side: F.transform(F.split(side, "_"), lambda x: x.cast("long")))
    none = F.array().cast("array<array<bigint>>")
    return F.struct((s != "main").alias("other"), s.alias("scope"), (~is_number).alias("odd"), F.when(is_number, sides).otherwise(none).alias("sides"), a.alias("article"))


def article_order(article: Column | str) -> Column:
    """Sort key of article numbers: their numeric parts in order; ranges and branches (2:3, 2_1) follow their first number."""
    return F.transform(F.expr(f"regexp_extract_all({article}, '([0-9]+)', 1)") if isinstance(article, str) else F.regexp_extract_all(article, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))


def character_changes(pairs: DataFrame, left: str, right: str, *keys: str) -> DataFrame:
    """(keys, op, left_text, right_text): the edits that turn left into right, character by character, in order."""
    ops = "array<struct<op string, left_text string, right_text string>>".replace(" string", ": string")

    @F.pandas_udf(ops)
    def opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            codes = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
            found.append([{"op": op, "left_text": x[i:j], "right_text": y[k:m]} for op, i, j, k, m in codes])
        return pd.Series(found)

    return pairs.select(*keys, F.posexplode(opcodes(left, right)).alias("pos", "o")).select(*keys, F.col("pos").cast("long").alias("pos"), "o.*")


# --- linkage


def compatible_form(text: Column | str) -> Column:
    """NFKC form."""

    @F.pandas_udf("string")
    def form(t: pd.Series) -> pd.Series:
        return t.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))

    return form(text)


def exact_text(text: Column | str) -> Column:
    """NFKC form without any white space; null becomes empty."""
    return F.regexp_replace(F.coalesce(compatible_form(text), F.lit("")), r"(?U)\s+", "")


def link_proposals(texts: DataFrame, targets: DataFrame, least: int = 3) -> DataFrame:
    """(text_id, target, relation, signals): proposed relations with what they rest on.

    texts: (text_id, text, relation). targets: (target, id_token, names array). An id counts as a whole token of the
    upper-cased text only; names count anywhere, without regard to white space, from least characters on. Several
    signals of one target and relation make one proposal. Ids are found by an equi-join on tokens, names by
    contained_mentions.
    """
    form = texts.select("text_id", "relation", compatible_form("text").alias("text")).where(F.col("text").isNotNull())
    tokens = form.select("text_id", "relation", F.explode(F.array_distinct(F.split(F.upper("text"), r"[^\p{L}\p{N}#_-]+"))).alias("id_token"))
    ids = targets.select("target", F.upper(compatible_form("id_token")).alias("id_token")).where("id_token <> ''")
    by_id = tokens.join(ids, "id_token").select("text_id", "target", "relation", F.lit("id").alias("signal"))
    names = targets.select("target", F.explode("names").alias("text")).where("text is not null").distinct().withColumn("name_id", F.xxhash64("text"))
    named = names.select("name_id", compatible_form("text").alias("text")).distinct()
    numbered = form.withColumn("row_id", F.xxhash64("text_id", "relation"))
    met = linkage.contained_mentions(numbered, named, "row_id", "name_id", least)
    by_name = met.join(numbered.select("row_id", "text_id", "relation"), "row_id").join(names.select("name_id", "target"), "name_id").select("text_id", "target", "relation", F.lit("name").alias("signal"))
    return by_id.union(by_name).groupBy("text_id", "target", "relation").agg(F.array_join(F.sort_array(F.collect_set("signal")), ",").alias("signals"))


def reviewed(reviews: DataFrame, targets: DataFrame) -> DataFrame:
    """Manual reviews (target, decision, rationale) with what becomes of each: appended, or why it is refused."""
    known = targets.select("target").distinct().withColumn("known", F.lit(True))
    refused = (
        F.when(~F.coalesce(F.col("decision").isin("confirmed", "rejected"), F.lit(False)), "unknown-decision")
        .when(F.trim(F.coalesce("rationale", F.lit(""))) == "", "rationale-missing")
        .when(F.col("known").isNull(), "target-missing")
    )
    return reviews.join(known, "target", "left").withColumn("result", F.coalesce(refused, F.lit("appended"))).drop("known")


# --- watched keys: refresh states


def refresh_outcome(attempts: DataFrame, watched: DataFrame, run: str, key: str) -> DataFrame:
    """(run, n, n_retried, n_failed, status, evaluated) of each run over the watched keys.

    attempts: (run, key, attempt from 1, ok). A failed key is tried once more; a run with every key read is
    succeeded, with none failed, else partial. Watches are evaluated after a full success only.
    """
    mine = attempts.join(watched.select(key).distinct(), key, "left_semi").where("attempt <= 2")
    per = mine.groupBy(run, key).agg(F.bool_or("ok").alias("ok"), F.max("attempt").alias("last"))
    g = per.groupBy(run).agg(F.count("*").alias("n"), F.count_if(F.col("last") > 1).alias("n_retried"), F.count_if(~F.col("ok")).alias("n_failed"))
    status = F.when(F.col("n_failed") == 0, "succeeded").when(F.col("n_failed") == F.col("n"), "failed").otherwise("partial")
    return g.withColumn("status", status).withColumn("evaluated", F.col("status") == "succeeded")


def closed_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Runs (run, started_at, finished_at, status) with those still running closed as partial at now."""
    open_ = (F.col("status") == "running") & F.col("finished_at").isNull()
    return runs.select("run", "started_at", F.when(open_, now).otherwise(F.col("finished_at")).alias("finished_at"), F.when(open_, "partial").otherwise(F.col("status")).alias("status"))


def missing_content(revisions: DataFrame, baselines: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, revision, action) of what a refresh has to look at.

    revisions: (key, revision, seen); baselines: (key, baseline_revision, baseline_seen). A revision counts if it was
    seen after its watch's baseline or is the baseline. With a document that has chunks it is ready, with one
    without chunks those are to be rebuilt, else it is to be fetched.
    """
    mine = revisions.join(baselines, "key").where((F.col("seen") > F.col("baseline_seen")) | (F.col("revision") == F.col("baseline_revision")))
    has = lambda d, name: d.select("revision").distinct().withColumn(name, F.lit(True))
    joined = mine.join(has(documents, "document"), "revision", "left").join(has(chunks, "chunk"), "revision", "left")
    action = F.when(F.col("document").isNull(), "fetch").when(F.col("chunk").isNull(), "rebuild-chunks").otherwise("ready")
    return joined.select("key", "revision", action.alias("action")).distinct()


def watch_list(watches: DataFrame, events: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """Watches with their title, number of events, those not acknowledged and the latest of these."""
    open_ = F.col("acknowledged_at").isNull()
    per = events.groupBy(key).agg(F.count("*").alias("n_events"), F.count_if(open_).alias("n_open"), F.max(F.when(open_, F.col("created_at"))).alias("latest_open"))
    return watches.join(titles, key, "left").join(per, key, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_events", "n_open")})


# --- users


def appended_once(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A history in which the first entry of each id counts; later ones with it are dropped."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def themes(log: DataFrame, most: int = 120) -> DataFrame:
    """(owner, theme_id, title, state): saved themes after a log of saves and deletions; titles are 1 to most characters.

    log: (owner, theme_id, action, title, at). Saves with another length are refused and change nothing.
    """
    good = (F.col("action") == "delete") | F.length(F.trim(F.coalesce("title", F.lit("")))).between(1, most)
    last = log.where(good).groupBy("owner", "theme_id").agg(F.max_by(F.struct("action", F.trim("title").alias("title")), F.struct("at", "action")).alias("l"))
    return last.where("l.action <> 'delete'").select("owner", "theme_id", F.col("l.title").alias("title"))


def readiness(present: list[str], required: list[str]) -> str:
    """empty, partial or ready, by which of the required tables there are."""
    found = set(present) & set(required)
    return "ready" if found == set(required) else "partial" if found else "empty"


# --- planning of a question

ARTICLE = r"第([0-9]+(?:の[0-9]+)*)条"
DATE = r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日|[0-9]{4}-[0-9]{2}-[0-9]{2}"


def retrieval_plan(questions: DataFrame, question: str, phrase: str, stop: list[str]) -> DataFrame:
    """Adds article, as_of, segment and mode to questions whose law phrase was resolved.

    Full-width digits are read as ASCII ones. Phrase, dates, article numbers and stop words are taken out; the longest
    segment left (the greater text among equals) is the lexical query. A question that names an article is answered by
    structure alone.
    """
    q = ascii_digits(question)
    japanese = lambda i: F.regexp_extract(q, DATE, i)
    iso = F.try_to_date(F.nullif(F.regexp_extract(q, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), "yyyy-MM-dd")
    spelled = F.try_to_date(F.concat_ws("-", japanese(1), F.lpad(japanese(2), 2, "0"), F.lpad(japanese(3), 2, "0")), "yyyy-MM-dd")
    article = F.nullif(F.regexp_extract(q, ARTICLE, 1), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(F.replace(q, F.coalesce(F.col(phrase), F.lit("\x00")), F.lit(" ")), DATE, " "), ARTICLE, " ")
    for word in sorted(stop, key=lambda w: (-len(w), w)):
        rest = F.replace(rest, F.lit(word), F.lit(" "))
    segments = F.filter(F.split(rest, r"[\s、。？?,.!]+"), lambda s: F.length(s) >= 2)
    longest = F.array_max(F.transform(segments, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    out = questions.withColumn("article", article).withColumn("as_of", F.coalesce(iso, spelled))
    return out.withColumn("segment", F.when(article.isNull(), longest)).withColumn("mode", F.when(article.isNotNull(), "structural").when(longest.isNotNull(), "lexical").otherwise("none"))


# --- embeddings of text


def embedding_input(prefix: Column | str, text: Column | str) -> Column:
    """Prefix, a blank line and the text; the text alone without a prefix."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat_ws("\n\n", F.nullif(F.trim(col(prefix)), F.lit("")), col(text))


def hash_embedding(texts: DataFrame, text: str, dims: int = 64) -> DataFrame:
    """Adds embedding: unit vector of signed hashed tokens, the same on every machine; zero for a text without tokens."""

    @F.pandas_udf("array<float>")
    def embed(t: pd.Series) -> pd.Series:
        out = []
        for x in t.fillna(""):
            v = np.zeros(dims)
            for token in re.findall(r"\w+", x.lower()):
                h = int.from_bytes(hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()[:8], "big")
                v[h % dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return texts.withColumn("embedding", embed(text))


def embedding_faults(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """Adds fault: why a vector can't be stored as 32-bit floats of the profile's length, or null."""
    c = F.col(column).cast("array<float>")
    fault = F.when(c.isNull(), "missing").when(F.size(c) != dims, "length").when(F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("float"))), "not finite").when(F.forall(c, lambda x: x == 0), "zero")
    return vectors.withColumn("fault", fault)


def stored_embeddings(existing: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of new to insert; a key that is there with another digest fails the query."""
    old = existing.select(key, F.col(digest).alias("old_digest"))
    joined = new.dropDuplicates([key, digest]).join(old, key, "left")
    absent = F.when(F.col("old_digest").isNull(), True).when(F.col("old_digest") == F.col(digest), False).otherwise(F.raise_error(F.lit("stored embedding has drifted")).cast("boolean"))
    return joined.where(absent).drop("old_digest")


# --- payloads and exports

FIELDS = ("question", "as_of", "law_id")


def payloads(rows: DataFrame, column: str, default_date: str, most: int = 4000) -> DataFrame:
    """Adds question, as_of, law_id and error to rows with a query as JSON.

    Only the known fields may be there; the question has 1 to most characters, the date is an ISO date (the default
    where there is none), the id has 15 digits and capitals. The first fault found is the error.
    """
    value = lambda f: F.get_json_object(column, f"$.{f}")
    keys = F.json_object_keys(column)
    day = F.when(value("as_of").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(value("as_of"), "yyyy-MM-dd"))
    question = F.trim(F.coalesce(value("question"), F.lit("")))
    error = (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, F.lit(list(FIELDS)))) > 0, "unknown field")
        .when(~F.length(question).between(1, most), "question length")
        .when(value("as_of").isNotNull() & day.isNull(), "date")
        .when(~F.coalesce(value("law_id").rlike("^[0-9A-Z]{15}$"), F.lit(True)), "law id")
    )
    return rows.withColumn("error", error).withColumns({"question": F.when(F.col("error").isNull(), question), "as_of": F.when(F.col("error").isNull(), F.coalesce(day, F.lit(default_date).cast("date"))), "law_id": F.when(F.col("error").isNull(), value("law_id"))})


def bounded_export(evidence: DataFrame, group: str, order: str, text: str, most_rows: int = 8, most_chars: int = 4000) -> DataFrame:
    """(group, n, payload): each group's first most_rows texts, cut to most_chars characters, as JSON."""
    w = Window.partitionBy(group).orderBy(order)
    first = evidence.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most_rows).withColumn("cut", F.substring(text, 1, most_chars))
    items = F.array_sort(F.collect_list(F.struct("place", F.col("cut").alias("text"))))
    return first.groupBy(group).agg(F.count("*").alias("n"), F.to_json(items).alias("payload"))


def substantive(nodes: DataFrame, suffix: str = "Sentence") -> DataFrame:
    """Documents with a node whose tag ends with the suffix and has text."""
    return nodes.where(F.col("tag").endswith(suffix) & (F.trim(F.coalesce("body", F.lit(""))) != "")).select("doc").distinct()


def envelopes(relations: DataFrame, states: DataFrame, target: str, include_candidates: bool = False) -> DataFrame:
    """Relations of each target with their state; only confirmed ones unless candidates are asked for."""
    joined = relations.join(states, "relation_id", "left").withColumn("state", F.coalesce("state", F.lit("candidate")))
    kept = joined if include_candidates else joined.where("state = 'confirmed'")
    return places(kept, target, ["relation_id"]).withColumn("citation_ready", F.col("state") == "confirmed")
