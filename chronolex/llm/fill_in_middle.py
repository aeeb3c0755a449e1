"""Fill-in-middle transformation by escaped marker injection.

A text is cut into units (a word with the blanks before it, or the blanks at the end). No unit is ever put into an
array: a delimiter character is escaped in the text, regexp_replace appends it after each unit, counting it gives
the number of units, and substring_index takes the parts before, between and after two of them. A seeded digest of
the id chooses the two cuts and the form. Parts are unescaped and put together with the marks of the form.

All of it is one projection of DataFrame functions over each row: no shuffle, no Python, memory of one row.

Defined results: a null text counts as empty, and an empty text stays plain; so does a text that holds one of the
marks. A null doc_id is digested as the empty string. Repeated rows give equal results each. Texts may hold the
delimiter and the escape character; they come back unchanged. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.storage import load

#: The marks before prefix, suffix and middle, and the pattern of a unit.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Two characters that aren't blanks, so that escaping changes no unit's borders.
DELIMITER, ESCAPE = "\u0001", "\u0002"


def escaped(text: Column) -> Column:
    """text without the delimiter; every escape character is followed by e (itself) or d (the delimiter)."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(part: Column) -> Column:
    """The text of a part: marks taken out, escaped characters put back."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def part_of(text: Column, delimiter: Column | str, count: Column | int) -> Column:
    """substring_index with a delimiter and a count by row."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.call_function("substring_index", text, column(delimiter), column(count))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: each mark stands once in an output that isn't plain."""
    head, last = part_of(output, MIDDLE, 1), part_of(output, MIDDLE, -1)
    between = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    first, second = F.substr(part_of(head, between, 1), F.lit(len(PREFIX) + 1)), part_of(head, between, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, last, second)).otherwise(F.concat(second, last, first))


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output): n units, the three parts (null if plain) and the text to train on.

    rate per cent of the texts are transformed, spm_rate per cent of these put the suffix first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), f"({UNIT})", "$1" + DELIMITER))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long"))
    taken = F.greatest(*[F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    plain = (F.col("text") == "") | taken | (h3 % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm"))
    cut = [h % (F.col("n") + 1) for h in (h1, h2)]
    rows = rows.withColumn("a", F.least(*cut).cast("int")).withColumn("b", F.greatest(*cut).cast("int"))
    marked = F.col("marked")
    parts = {
        "prefix": part_of(marked, DELIMITER, F.col("a")),
        "middle": part_of(part_of(marked, DELIMITER, F.col("b")), DELIMITER, F.col("a") - F.col("b")),
        "suffix": part_of(marked, DELIMITER, F.col("b") - F.col("n").cast("int") - 1),
    }
    whole = F.col("form") == "plain"
    rows = rows.select("doc_id", "text", "n", "form", *[F.when(~whole, unescaped(p)).alias(k) for k, p in parts.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(whole, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(load(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
     f AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
     p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
