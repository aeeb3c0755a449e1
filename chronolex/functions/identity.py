"""Deterministic identities: SHA-256 over parts joined by the unit separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def content_id(*parts: Column | str) -> Column:
    """Hex id of the parts. Null counts as empty, since concat_ws would skip it and let different parts collide."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), 256)


def manifest_hash(pairs: Column) -> Column:
    """Hash of id, tab, sha lines in order of id; pairs is an array of structs (id, sha)."""
    return F.sha2(F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["id"], F.lit("\t"), p["sha"], F.lit("\n"))), ""), 256)
