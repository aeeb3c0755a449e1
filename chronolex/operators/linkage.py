"""Links between collections: proposals by containment, assertion states, materials grouped by source, snapshots compared."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions.text import squeezed
from chronolex.storage import materialise


def effective_state(confirmed: Column, rejected: Column) -> Column:
    """Aggregate: conflicted, confirmed, rejected or candidate."""
    c, r = F.bool_or(confirmed), F.bool_or(rejected)
    return F.when(c & r, "conflicted").when(c, "confirmed").when(r, "rejected").otherwise("candidate")


def default_status(basis: Column) -> Column:
    """Status an assertion starts with, by its basis."""
    return F.when(basis == "official-link", "confirmed").otherwise("candidate")


def contained_mentions(texts: DataFrame, names: DataFrame, text_id: str, name_id: str, least: int = 3, most_chars: int = 16_000_000, width: int = 12, squeeze: bool = True) -> DataFrame:
    """(text_id, name_id) where the name, without white space (or, without squeeze, as it is), is contained in the text.

    A catalogue of up to most_chars characters becomes one automaton that reads each text once. A larger one is not
    shipped to tasks: each name is known by one of its substrings, the one that fewest names have, so that a beginning
    or end which all share pairs no text with all names. These meet the texts' substrings by an equi-join, equal texts
    as one, and no join sends a catalogue through the driver; names of width characters or more have substrings of width, shorter ones of a half, a quarter and so on.
    """
    plain = squeezed if squeeze else F.col
    n = names.select(F.col(name_id).cast("long").alias(name_id), plain("text").alias("name")).where(F.length("name") >= least)
    t = texts.select(F.col(text_id).cast("long").alias(text_id), plain("text").alias("body")).where(F.length("body") >= least)
    if (n.agg(F.sum(F.length("name"))).first()[0] or 0) > most_chars:
        keyed = materialise(rarest_grams(n, least, width), "name-grams")
        sizes = [r["size"] for r in keyed.select("size").distinct().collect()]  # a few
        bodies = t.select("body").distinct()
        found = F.explode(F.array_distinct(F.flatten(F.array(*[_grams("body", F.lit(s)) for s in sizes]))))
        hits = bodies.select("body", found.alias("gram")).join(keyed.select("gram", "name").hint("merge"), "gram").where(F.col("body").contains(F.col("name"))).select("body", "name")
        return hits.join(t.hint("merge"), "body").join(n.hint("merge"), "name").select(text_id, name_id).distinct()
    catalogue: dict[str, list[int]] = {}
    for r in n.collect():
        catalogue.setdefault(r["name"], []).append(r[name_id])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for name, ids in catalogue.items():
            automaton.add_word(name, ids)
        automaton.make_automaton()
        for b in batches:
            found = [(k, i) for k, body in zip(b[text_id], b["body"], strict=True) if catalogue for i in {i for _, ids in automaton.iter(body) for i in ids}]
            yield pd.DataFrame(found, columns=[text_id, name_id]).astype("int64")

    return t.mapInPandas(run, f"{text_id} long, {name_id} long")


def rarest_grams(names: DataFrame, least: int, width: int) -> DataFrame:
    """(name, size, gram): of each name the substring of size characters that fewest names have."""
    steps = [width >> i for i in range(width.bit_length()) if width >> i > least] + [least]
    size = F.coalesce(*[F.when(F.length("name") >= s, F.lit(s)) for s in steps])
    grams = names.select("name").distinct().select("name", size.alias("size"), F.explode(_grams("name", size)).alias("gram"))
    n = grams.groupBy("gram").agg(F.count("*").alias("n_names"))
    return grams.join(n.hint("merge"), "gram").groupBy("name", "size").agg(F.min_by("gram", F.struct("n_names", "gram")).alias("gram"))


def _grams(text: str, size: Column) -> Column:
    """The distinct substrings of size characters; none of a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(F.col(text), i, size)))


def snapshot_compare(left: DataFrame, right: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Keys of two snapshots as added, removed, changed or unchanged by digest; keys that repeat in one are left out."""
    once = lambda d, name: d.groupBy(*key).agg(F.count("*").alias("n"), F.max(digest).alias(name)).where("n = 1").drop("n")
    joined = once(left, "l").join(once(right, "r"), key, "full_outer")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.col("l") != F.col("r"), "changed").otherwise("unchanged")
    return joined.select(*key, change.alias("change"))
