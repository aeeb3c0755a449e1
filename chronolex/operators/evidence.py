"""Validation of answer drafts against evidence, and evidence rows for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Error codes of a draft, in the order they are tested.
CODES = ("ANSWER_TEXT_EMPTY", "CLAIMS_EMPTY", "CLAIM_ID_BLANK", "CLAIM_ID_DUPLICATE", "CLAIM_WITHOUT_EVIDENCE", "EVIDENCE_REF_DUPLICATE", "EVIDENCE_UNKNOWN")


def claim_errors(drafts: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(draft_id, code, n): every error of every draft.

    drafts (draft_id, answer_text); claims (draft_id, claim_id, evidence_ids); evidence (draft_id, evidence_id).
    """
    blank = drafts.where(F.trim(F.coalesce("answer_text", F.lit(""))) == "").select("draft_id", F.lit(CODES[0]).alias("code"))
    none = drafts.join(claims.select("draft_id").distinct(), "draft_id", "left_anti").select("draft_id", F.lit(CODES[1]))
    unnamed = claims.where(F.trim(F.coalesce("claim_id", F.lit(""))) == "").select("draft_id", F.lit(CODES[2]))
    twice = claims.groupBy("draft_id", "claim_id").count().where("count > 1").select("draft_id", F.lit(CODES[3]))
    bare = claims.where(F.size("evidence_ids") == 0).select("draft_id", F.lit(CODES[4]))
    repeated = claims.where(F.size("evidence_ids") > F.size(F.array_distinct("evidence_ids"))).select("draft_id", F.lit(CODES[5]))
    refs = claims.select("draft_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    unknown = refs.join(evidence.select("draft_id", "evidence_id").distinct(), ["draft_id", "evidence_id"], "left_anti").select("draft_id", F.lit(CODES[6]))
    found = blank
    for part in (none, unnamed, twice, bare, repeated, unknown):
        found = found.union(part)
    return found.groupBy("draft_id", "code").agg(F.count("*").alias("n"))


def finalise(drafts: DataFrame, errors: DataFrame) -> DataFrame:
    """Drafts as blocked (with the number of error codes) or citation-ready."""
    n = errors.groupBy("draft_id").agg(F.count("*").alias("n_codes"))
    return drafts.join(n, "draft_id", "left").select("draft_id", F.when(F.col("n_codes") > 0, "blocked").otherwise("citation-ready").alias("status"), F.coalesce("n_codes", F.lit(0)).cast("long").alias("n_codes"))


def extractive_answers(bundle: DataFrame, most: int = 240) -> DataFrame:
    """(context_id, answer_text, evidence_ords): an answer that needs no model: the first text of the evidence, cut to most characters."""
    texts = bundle.where(F.trim(F.coalesce("body", F.lit(""))) != "")
    first = texts.groupBy("context_id").agg(F.min_by(F.struct("ord", "body"), "position").alias("f"))
    return first.select("context_id", F.substring("f.body", 1, most).alias("answer_text"), F.array("f.ord").alias("evidence_ords"))
