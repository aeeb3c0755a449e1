"""What a question asks for: the text to search, the article it names, and a law that it names by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions.text import ascii_digits

# Words that part a question, segments that say nothing, words of the present, marks, dates and article numbers.
SPLIT_WORDS = ("について", "に関係する", "に関する", "を教えてください", "を教えて", "教えてください", "教えて", "とは", "では", "から", "まで", "より", "で", "は", "が", "を", "に", "の", "と")
STOP_SEGMENTS = ("規定", "内容", "法律", "法令", "時点", "場合", "場面", "ください", "確認", "確認する", "確認したい", "知りたい", "調べる", "調べたい", "見たい")
PRESENT = "現在|現行|時点"
MARKS = r"(?U)[、。！？!?：:；;（）()\[\]【】「」『』\s]+"
DATES = r"[0-9０-９]{4}[-/][0-9０-９]{1,2}[-/][0-9０-９]{1,2}|[0-9０-９]{4}年[0-9０-９]{1,2}月(?:[0-9０-９]{1,2}日)?"
ARTICLE_NUMBER = "第([0-9０-９]+)条"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def search_text(question: Column, phrase: Column) -> Column:
    """The longest telling segment of a question (the greater text among equals), without its law phrase and dates.

    Where no segment tells anything it is the whole rest, and where nothing is left the question itself.
    """
    asked = _stripped(question)
    rest = F.when(F.coalesce(phrase, F.lit("")) != "", F.replace(asked, phrase, F.lit(" "))).otherwise(asked)
    for pattern in (DATES, PRESENT, MARKS):
        rest = F.regexp_replace(rest, pattern, " ")
    rest = _stripped(rest)
    parts = F.transform(F.split(rest, "|".join(SPLIT_WORDS)), _stripped)
    telling = F.filter(parts, lambda s: (F.length(s) >= 2) & ~s.rlike(f"^{ARTICLE_NUMBER}$") & ~s.isin(list(STOP_SEGMENTS)))
    longest = F.array_max(F.transform(telling, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    return F.coalesce(longest, F.nullif(rest, F.lit("")), asked)


def channels(questions: DataFrame, question: str, phrase: str) -> DataFrame:
    """Adds tag_name, structural_num and query_text: a question that names an article is answered by structure, with no text."""
    number = F.nullif(ascii_digits(F.regexp_extract(question, ARTICLE_NUMBER, 1)), F.lit(""))
    out = questions.withColumn("structural_num", number).withColumn("tag_name", F.when(number.isNotNull(), "Article"))
    return out.withColumn("query_text", F.when(F.col("structural_num").isNotNull(), "").otherwise(search_text(F.col(question), F.col(phrase))))


def explicit_laws(asked: DataFrame, laws: DataFrame, titles: DataFrame, law: str) -> DataFrame:
    """asked (a law's id, ...) with status and the title (of titles, one for each law): invalid, not-found or resolved.

    An id has 15 digits and capitals; one that hasn't isn't looked up.
    """
    found = asked.join(laws.select(law).distinct().withColumn("known", F.lit(True)), law, "left").join(titles.select(law, "title"), law, "left")
    valid = F.coalesce(F.col(law).rlike("^[0-9A-Z]{15}$"), F.lit(False))
    status = F.when(~valid, "invalid").when(F.col("known").isNull(), "not-found").otherwise("resolved")
    return found.withColumn("status", status).withColumn("title", F.when(F.col("status") == "resolved", F.col("title"))).drop("known")
