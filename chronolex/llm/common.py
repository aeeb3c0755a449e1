"""Pieces that several operators share: the word pattern, folds and table helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.storage import small_batches

#: Words of the contracts: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Runs of letters of any script.
LETTERS = re.compile(r"[^\W\d_]+")
#: Lower-cases A-Z only.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def fold_of(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts: decides which rows a model may learn from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % parts


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text, so that no other column (however named) reaches an operator."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def hand_back() -> None:
    """At the end of a task: memory that its batches had goes back to the system, as the worker lives on for other work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Arrow types of the names used in schema strings.
ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def record_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of the schema string."""
    names, types = zip(*(c.strip().split(" ", 1) for c in schema.split(",")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=ARROW[t]) for c, t in zip(columns, types, strict=True)], list(names))
