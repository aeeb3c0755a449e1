"""Registered queries of questions: what is searched for, and laws named by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.operators import questions, records
from chronolex.plans.queries import query
from chronolex.storage import load

_ASKED = """SELECT p_partkey, p_brand, CASE p_partkey % 6 WHEN 0 THEN '２０２４年４月の' || p_brand || 'の' || p_name || '規定を教えてください' WHEN 1 THEN ' ' || p_brand || 'について確認したい ' WHEN 2 THEN '現在の' || p_brand || 'に関する' || p_type || 'は？'
 WHEN 3 THEN p_brand || '第１２条とは' WHEN 4 THEN '2024/4/1時点の' || p_name || '、内容' ELSE 'のにが' END AS q FROM part"""
_REST = "trim(regexp_replace(regexp_replace(regexp_replace(replace(trim(q), p_brand, ' '), '[0-9０-９]{4}[-/][0-9０-９]{1,2}[-/][0-9０-９]{1,2}|[0-9０-９]{4}年[0-9０-９]{1,2}月([0-9０-９]{1,2}日)?', ' ', 'g'), '現在|現行|時点', ' ', 'g'), '[、。！？!?：:；;（）()\\[\\]【】「」『』\\s]+', ' ', 'g'))"
_STOPPED = ", ".join(f"'{s}'" for s in questions.STOP_SEGMENTS)


@query(f"""WITH a AS (SELECT *, {_REST} AS rest, translate(nullif(regexp_extract(q, '第([0-9０-９]+)条', 1), ''), '０１２３４５６７８９', '0123456789') AS structural_num FROM ({_ASKED})),
     s AS (SELECT *, list_filter(list_transform(regexp_split_to_array(rest, '{'|'.join(questions.SPLIT_WORDS)}'), lambda x: trim(x)), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '第([0-9０-９]+)条') AND x NOT IN ({_STOPPED})) AS seg FROM a)
SELECT p_partkey, structural_num, CASE WHEN structural_num IS NOT NULL THEN 'Article' END AS tag_name,
       CASE WHEN structural_num IS NOT NULL THEN '' ELSE coalesce((list_sort(list_transform(seg, lambda x: {{'n': length(x), 's': x}})))[-1].s, nullif(rest, ''), trim(q)) END AS query_text FROM s""")
def planned_channels(spark, sf_dir):
    """Questions about every part: with dates, words of the present, an article, or nothing that tells anything."""
    p, form = load(spark, sf_dir, "part"), F.col("p_partkey") % 6
    asked = (
        F.when(form == 0, F.concat(F.lit("２０２４年４月の"), "p_brand", F.lit("の"), "p_name", F.lit("規定を教えてください")))
        .when(form == 1, F.concat(F.lit(" "), "p_brand", F.lit("について確認したい ")))
        .when(form == 2, F.concat(F.lit("現在の"), "p_brand", F.lit("に関する"), "p_type", F.lit("は？")))
        .when(form == 3, F.concat("p_brand", F.lit("第１２条とは")))
        .when(form == 4, F.concat(F.lit("2024/4/1時点の"), "p_name", F.lit("、内容")))
        .otherwise(F.lit("のにが"))
    )
    planned = questions.channels(p.select("p_partkey", "p_brand", asked.alias("question")), "question", "p_brand")
    return planned.select("p_partkey", "structural_num", "tag_name", "query_text")


@query("""WITH l AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 15, '0') AS law_id, c_name FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'no id' ELSE lpad(CAST(o_custkey AS VARCHAR), 15, '0') END AS law_id, o_orderkey FROM orders)
SELECT o_orderkey, CASE WHEN o.law_id = 'no id' THEN 'invalid' WHEN l.law_id IS NULL THEN 'not-found' ELSE 'resolved' END AS status, c_name AS title FROM o LEFT JOIN l ON l.law_id = o.law_id""")
def explicit_laws(spark, sf_dir):
    """Every order asks for its customer's law by id; some ids are none, some laws aren't there."""
    laws = load(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.lpad(F.col("c_custkey").cast("string"), 15, "0").alias("law_id"), "c_name", "c_mktsegment", F.lit(None).cast("int").alias("sequence"), F.lit(None).cast("date").alias("day"))
    titles = records.title_of(laws, "law_id", "c_name", F.col("c_mktsegment") == "BUILDING", "sequence", "day")
    asked = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "no id").otherwise(F.lpad(F.col("o_custkey").cast("string"), 15, "0")).alias("law_id"))
    return questions.explicit_laws(asked, laws, titles, "law_id").select("o_orderkey", "status", "title")
