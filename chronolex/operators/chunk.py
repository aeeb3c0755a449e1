"""Structure-aware chunks: consecutive text units packed greedily up to a soft limit, never split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions.identity import content_id


def text_units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each non-blank line: (key, unit from 1, body trimmed)."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    return lines.select(key, (F.col("pos") + 1).cast("long").alias("unit"), F.trim("line").alias("body")).where("body <> ''")


def chunk_documents(docs: DataFrame, key: str, text: str, most: int = 1200) -> DataFrame:
    """(key, chunk, first_unit, last_unit, n_units, n_chars, oversize): lines joined by a line break up to most characters.

    A document is one row here, so a map over rows needs no shuffle and holds one document at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, body in zip(b[key], b[text], strict=True):
                chunk, first, last, units, size = 0, 0, 0, 0, 0
                for i, line in enumerate((body or "").split("\n"), 1):
                    n = len(line.strip(" "))
                    if not n:
                        continue
                    if units and size + 1 + n > most:
                        rows.append((k, chunk, first, last, units, size, size > most))
                        chunk, units, size = chunk + 1, 0, 0
                    first = first if units else i
                    size += n + (1 if units else 0)
                    last, units = i, units + 1
                if units:
                    rows.append((k, chunk, first, last, units, size, size > most))
            yield pd.DataFrame(rows, columns=[key, "chunk", "first_unit", "last_unit", "n_units", "n_chars", "oversize"])

    return docs.select(key, text).mapInPandas(run, f"{key} long, chunk long, first_unit long, last_unit long, n_units long, n_chars long, oversize boolean")


def chunk_stats(chunks: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    joined = chunks.join(groups.select(key, group), key)
    return joined.groupBy(group).agg(F.count("*").alias("n_chunks"), F.count_if("oversize").alias("n_oversize"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def chunk_identity(version: str, most: int, *parts: Column | str) -> Column:
    """Id of a chunk under one configuration."""
    return content_id(F.lit(version), F.lit(f"soft_max_chars={most}"), *parts)
