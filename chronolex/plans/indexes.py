"""Registered queries over stored trigram indexes; each gives the rows of a scan of all units."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolex.functions.text import normalise
from chronolex.operators import chunk
from chronolex.operators.trigram_index import TrigramIndex, build_index
from chronolex.plans.queries import _sim, query
from chronolex.plans.structure import _CHUNKED, _NODES, _SCOPE, building, new_chunks
from chronolex.storage import load, new_path


def unit_index(spark, sf_dir) -> TrigramIndex:
    """The lines of all documents by the windows of their normalised text."""
    units = chunk.text_units(load(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("body", "text")
    return build_index(units, new_path(spark, "unit-index"), normalise("text"))


_UNITS = r"""WITH u AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS unit, trim(unnest(string_split(text, chr(10))), ' ') AS body FROM documents),
     n AS (SELECT doc_id, unit, trim(regexp_replace(body, '\s+', ' ', 'g'), ' ') AS body FROM u WHERE body <> '')"""
#: A notice, a name that many units have, one that none has, and one of two characters, which no window covers.
TERMS = ("under the MIT License", "License", "no unit holds this", "@e")


def _found(term: str) -> str:
    return f"(SELECT '{term}' AS term, doc_id, unit, {_sim('body', chr(39) + term + chr(39))} AS score FROM n WHERE contains(body, '{term}') ORDER BY score DESC, doc_id, unit LIMIT 50)"


@query(_UNITS + " " + " UNION ALL ".join(map(_found, TERMS)))
def indexed_lexical_search(spark, sf_dir):
    index = unit_index(spark, sf_dir)
    found = [index.lexical_search(t, ["doc_id", "unit"], 50).select(F.lit(t).alias("term"), "doc_id", "unit", "score") for t in TERMS]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query(_NODES + _CHUNKED + f", h AS (SELECT first_ord, chunk_id, {_sim('text', chr(39) + 'from supplier 7 of' + chr(39))} AS score FROM cd WHERE doc IN {_SCOPE} AND (contains(text, 'from supplier 7 of') OR contains(prefix, 'from supplier 7 of'))) SELECT * FROM h ORDER BY score DESC, first_ord, chunk_id LIMIT 50")
def indexed_chunk_search(spark, sf_dir):
    """The ranked, limited chunk search of a scope, over an index of all chunks' prefixes and texts."""
    chunks = new_chunks(spark, sf_dir)
    index = build_index(chunks, new_path(spark, "chunk-index"), F.concat(normalise("prefix"), F.lit("\n"), normalise("text")))
    return index.chunk_lexical_search("from supplier 7 of", ["first_ord", "chunk_id"], building(spark, sf_dir), ["doc"], 50)


@query(f"SELECT p_brand, p_name, score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_name DESC) AS rn FROM (SELECT p_brand, p_name, {_sim('p_name', chr(39) + 'econmy burnishd brass' + chr(39))} AS score FROM part) WHERE score >= 0.12) WHERE rn = 1 ORDER BY score DESC, p_brand LIMIT 5")
def indexed_suggest(spark, sf_dir):
    index = build_index(load(spark, sf_dir, "part").select("p_brand", "p_name"), new_path(spark, "name-index"), "p_name", kind="words")
    return index.suggest("econmy burnishd brass", "p_brand", "p_name")
