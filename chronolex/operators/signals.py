"""Links proposed from texts, with every signal they rest on, and relations with their history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.operators.linkage import contained_mentions
from chronolex.operators.records import compatible_form

#: The relation of a text to the revision that an amendment made, and of signals what they are based on.
AMENDMENT = "amendment-material"
BASIS = {"law-id-exact": "identifier-match", "law-number-exact": "identifier-match", "law-title-exact": "text-match", "amendment-law-id-exact": "identifier-match", "amendment-law-number-exact": "identifier-match", "amendment-law-title-exact": "text-match"}
#: An id: 15 digits and capitals that no further one adjoins.
ID_TOKEN = r"(?<![0-9A-Z])[0-9A-Z]{15}(?![0-9A-Z])"


def text_sources(snapshots: DataFrame, parts: DataFrame) -> DataFrame:
    """(document, locator, text) of each document's latest snapshot, its title first, then its parts in order.

    snapshots: (document, snapshot, taken_at, title, deleted); parts: (snapshot, position, text). A document whose
    latest snapshot is a deletion has none.
    """
    last = snapshots.groupBy("document").agg(F.max(F.struct("taken_at", "snapshot", "title", "deleted")).alias("s")).select("document", "s.*")
    there = last.where(~F.coalesce("deleted", F.lit(False)))
    titles = there.where(F.trim(F.coalesce("title", F.lit(""))) != "").select("document", F.lit("title").alias("locator"), F.col("title").alias("text"))
    texts = there.join(parts, "snapshot").where(F.trim(F.coalesce("text", F.lit(""))) != "").select("document", F.concat(F.lit("part:"), F.lpad(F.col("position").cast("string"), 9, "0")).alias("locator"), "text")
    return titles.unionByName(texts).withColumn("place", (F.col("locator") != "title").cast("int")).orderBy("document", "place", "locator").drop("place")


def signals(texts: DataFrame, laws: DataFrame, revisions: DataFrame) -> DataFrame:
    """(document, target_kind, target_id, relation, basis, signal, value, locator): everything that links a text to a law or a revision, once each.

    texts: (document, locator, text, relation); a null relation proposes nothing. laws: (law_id, law_num, titles array);
    revisions: (revision_id, law_id, law_num, title), of the amending law. Ids count as whole tokens of the upper-cased
    text, by an equi-join; numbers and titles anywhere, from three characters on, without regard to white space.
    """
    form = texts.where(F.col("text").isNotNull() & F.col("relation").isNotNull()).select("document", "locator", "relation", compatible_form("text").alias("text"))
    whole = F.array().cast("array<string>")
    names = laws.select(F.lit("law").alias("target_kind"), F.col("law_id").alias("target_id"), F.explode(F.concat(F.array(F.struct(F.lit("law-number-exact").alias("signal"), F.col("law_num").alias("value"))), F.transform(F.coalesce("titles", whole), lambda t: F.struct(F.lit("law-title-exact").alias("signal"), t.alias("value"))))).alias("n"))
    of_revisions = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(c).alias("value")) for s, c in (("amendment-law-number-exact", "law_num"), ("amendment-law-title-exact", "title"))])
    names = names.union(revisions.select(F.lit("law_revision"), "revision_id", F.explode(of_revisions)))
    names = names.select("target_kind", "target_id", "n.signal", "n.value").where(F.col("value").isNotNull()).distinct().withColumn("name_id", F.xxhash64("value"))
    ids = laws.select(F.lit("law").alias("target_kind"), F.col("law_id").alias("target_id"), F.lit("law-id-exact").alias("signal"), F.col("law_id").alias("value"))
    ids = ids.union(revisions.select(F.lit("law_revision"), "revision_id", F.lit("amendment-law-id-exact"), "law_id")).where(F.col("value").isNotNull())
    tokens = form.select("document", "locator", "relation", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(ID_TOKEN), F.lit(0)))).alias("value"))
    columns = ["document", "locator", "relation", "target_kind", "target_id", "signal", "value"]
    by_id = tokens.join(ids.hint("merge"), "value").select(columns)
    rows = form.withColumn("row_id", F.xxhash64("document", "locator", "relation"))
    met = contained_mentions(rows, names.select("name_id", compatible_form("value").alias("text")).distinct(), "row_id", "name_id")
    by_name = met.join(rows.drop("text").hint("merge"), "row_id").join(names.hint("merge"), "name_id").select(columns)
    table = F.create_map(*[F.lit(x) for kv in BASIS.items() for x in kv])
    found = by_id.union(by_name).withColumn("basis", table[F.col("signal")])
    relation = F.when(F.col("target_kind") == "law", F.col("relation")).otherwise(AMENDMENT)
    return found.select("document", "target_kind", "target_id", relation.alias("relation"), "basis", "signal", "value", "locator").distinct()


def relation_details(relations: DataFrame, assertions: DataFrame) -> DataFrame:
    """relations (relation_id, ...) with their assertions (relation_id, observed_at, ...) in order of time: the whole record of each."""
    rest = [c for c in assertions.columns if c not in ("relation_id", "observed_at")]
    listed = assertions.groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("observed_at", *rest))).alias("assertions"))  # one relation
    return relations.join(listed, "relation_id", "left").withColumn("assertions", F.coalesce("assertions", F.array().cast(listed.schema["assertions"].dataType)))
