"""Text functions as Column expressions: normalisation, trigrams, dates in identifiers, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(text: Column | str) -> Column:
    """White space of any script collapsed to one blank and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", " "))


def squeezed(text: Column | str) -> Column:
    """All white space removed: the key for exact containment."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", "")


def ascii_digits(text: Column | str) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(_col(text), "０１２３４５６７８９", "0123456789")


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram arrays, 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def revision_date(revision_id: Column | str) -> Column:
    """The valid calendar date in an id of the form key_yyyymmdd_suffix, else null."""
    return F.try_to_date(F.nullif(F.regexp_extract(_col(revision_id), r"^[0-9A-Z]{15}_([0-9]{8})_[0-9A-Z]{15}$", 1), F.lit("")), "yyyyMMdd")


def first_iso_date(*values: Column | str) -> Column:
    """The first of the values that is a full ISO date."""
    return F.coalesce(*[F.when(_col(v).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(_col(v), "yyyy-MM-dd")) for v in values])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, cut to -1 .. 1; null if either is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def quote(text: Column | str, most: int = 1000) -> Column:
    """A text cut to most characters, with an ellipsis where something was cut."""
    c = _col(text)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def clamp(limit: int | None, default: int, most: int) -> int:
    """A row limit between 1 and most."""
    return max(1, min(default if limit is None else limit, most))


def checked_limit(limit: int | None, default: int, most: int) -> int:
    """A row limit between 1 and most; any other is refused."""
    found = default if limit is None else limit
    if not 1 <= found <= most:
        raise ValueError(f"the limit must be from 1 to {most}")
    return found
