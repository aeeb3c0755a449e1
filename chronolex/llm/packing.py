"""Best-fit packing by sum of squares.

Documents become token ids with an end token. A document longer than a sequence is cut into pieces of full
length, the first of which may be shorter. Pieces are spread evenly over groups of bounded size and every group
is packed by itself, longest first: of the open sequences with room, each piece goes where the sum, over residual
gaps, of the squared number of open sequences with that gap becomes smallest (ties: the tightest). Spreading ignores ids, so a document
repeated in a third of all rows is spread like any other; a group's last open sequences are all that is lost.

Defined results: null or empty text is one piece holding the end token. Repeated rows are packed each. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm.common import id_text, record_batch
from chronolex.llm.token_ids import encoder
from chronolex.storage import load, materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"


def pieces(docs: DataFrame, path: str, size: int, end: int) -> DataFrame:
    """One row per piece of each document; spread is an even number to group by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, task = encoder(path), np.array([end], dtype="<u4").tobytes(), TaskContext.get()
        n = (task.partitionId() if task else 0) * 7919
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + last
                total, start, piece = len(ids) // 4, 0, 0
                while start < total:
                    length = (total - start) % size or size if piece == 0 else size
                    n += 1
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
                    start, piece = start + length, piece + 1
            yield record_batch(rows, PIECES)

    return id_text(docs).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given."""
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by gap
    count = np.zeros(size + 1, dtype=np.int64)
    where, offset, bins = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # change of the sum if a bin of gap g = s, s + 1, ... takes it; a full bin counts no more
        change = 2 * (count[: size + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))
        if change[best] < np.iinfo(np.int64).max:  # a sequence is opened only when no open one has room
            gap = best + s
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = size, bins
            bins += 1
        where[i], offset[i] = b, size - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


def best_fit_packing(docs: DataFrame, path: str | None = None, size: int = 1024, end: int = 2, group_rows: int = 20_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    cut = materialise(pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), size, end), "pieces")
    groups = max(1, round(cut.count() / group_rows))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "spread"], ascending=[False, True], kind="stable")
        where, offset = sum_of_squares(part["length"].to_numpy(), size)
        return part.assign(sequence_id=where + (int(key[0]) << 32), offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("spread"), F.lit(groups)).cast("int"))
    return dealt.groupBy("pack_group").applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir, "documents"))
