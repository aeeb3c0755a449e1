"""Token-id output in training order.

Documents become token ids with an end token; each input partition's stream is cut into sequences of one length
(the last is filled up with the end token). Counting the partitions' sequences numbers them all, and a keyed Feistel
permutation over the next power of four, walked until it falls below their number, gives each its global slot: a
random order that needs no shuffle to know, can be inverted, and is the same for one key. Sequences are
partitioned by range of slots (slots are dense, so each partition gets exactly one shard's range) and sorted, so a
shard holds consecutive slots at one stride: reading from any slot on is one seek (read_shard). write_shards writes
such files, each whole or not at all, with a manifest of its own (key, length, end token, number of sequences,
vocabulary, checksum); a shard whose manifest and size are those to be written is left alone, any other is written anew.
The shards are written in waves, each a range of them shuffled by itself, so that the disks never hold all sequences
as a table, as shuffle files and as shards at once.

Defined results: null or empty text is one end token. Repeated rows are written each. An empty table gives no
sequence. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm.common import id_text, record_batch
from chronolex.llm.token_ids import encoder
from chronolex.storage import discard, load, materialise, shared_dir, short_shuffles

SEQUENCES = "part int, pos long, first_doc_id long, n_tokens int, ids binary"
ROUNDS = 4
WAVES = 3


def sequences(docs: DataFrame, path: str, length: int, end: int) -> DataFrame:
    """The partitions' sequences; ids are unsigned 16-bit little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        if max(encode.top, end) > 0xFFFF:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        last = np.array([end], dtype="<u2").tobytes()
        buffer, first, pos = bytearray(), None, 0
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not buffer:
                    first = doc_id
                for ids in encode.stretches(text or ""):
                    buffer += np.array(ids, dtype="<u2").tobytes()
                buffer += last
                while len(buffer) >= 2 * length:
                    rows.append((part, pos, first, length, bytes(buffer[: 2 * length])))
                    del buffer[: 2 * length]
                    first, pos = doc_id, pos + 1
                if len(rows) >= 512:
                    yield record_batch(rows, SEQUENCES)
                    rows = []
            if rows:
                yield record_batch(rows, SEQUENCES)
        if buffer:
            n = len(buffer) // 2
            filled = bytes(buffer) + np.full(length - n, end, dtype="<u2").tobytes()
            yield record_batch([(part, pos, first, n, filled)], SEQUENCES)

    return id_text(docs).mapInArrow(run, SEQUENCES)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, total: int, key: int) -> np.ndarray:
    """Slot of each index below total: Feistel rounds over 2k bits, repeated (cycle-walking) while not below total."""
    half = max(1, (max(1, int(total) - 1).bit_length() + 1) // 2)
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), key)]
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & low
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & low)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= total]
    return out.astype(np.int64)


def training_order(docs: DataFrame, path: str | None = None, length: int = 2048, end: int = 2, key: int = 20240501, shard_slots: int = 4096) -> DataFrame:
    """(slot, shard, byte_offset, first_doc_id, n_tokens, ids_crc32, ids), range-partitioned and sorted by slot."""
    placed, total = _placed(docs, path or public_tokenizers.path("byte_bpe_50k.json"), length, end, key)
    return _ranged(placed, 0, max(1, -(-total // shard_slots)), length, shard_slots)


def _placed(docs: DataFrame, path: str, length: int, end: int, key: int) -> tuple[DataFrame, int]:
    """The sequences, from a table, with their slots, and their number."""
    made = materialise(sequences(docs, path, length, end), "sequences", "zstd")
    counts = sorted((r.part, r["n"]) for r in made.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row an input partition
    total = sum(n for _, n in counts)
    before = np.zeros(max((p for p, _ in counts), default=0) + 1, dtype=np.int64)
    at = 0
    for p, n in counts:
        before[p], at = at, at + n

    @F.pandas_udf("long")
    def slot(part: pd.Series, pos: pd.Series) -> pd.Series:
        return pd.Series(permuted(before[part.to_numpy()] + pos.to_numpy(), total, key))

    return made.withColumn("slot", slot("part", "pos")), total


def _ranged(placed: DataFrame, first: int, past: int, length: int, shard_slots: int) -> DataFrame:
    """The rows of training_order in the shards from first on and before past."""
    own = placed.withColumn("shard", F.floor(F.col("slot") / shard_slots).cast("long")).where((F.col("shard") >= first) & (F.col("shard") < past))
    ranged = own.repartitionById(past - first, (F.col("shard") - first).cast("int")).sortWithinPartitions("slot")
    return ranged.select("slot", "shard", ((F.col("slot") % shard_slots) * 2 * length).alias("byte_offset"), "first_doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids")


WRITTEN = "slot long, shard long, byte_offset long, first_doc_id long, n_tokens int, ids_crc32 long, n_slots long, n_bytes long"


def write_shards(ordered: DataFrame, uri: str, made_of: dict) -> DataFrame:
    """Writes the shards as files shard-<number>.u16 under uri (anything pyarrow's file systems open).

    Returns the rows without their ids, each with n_slots and n_bytes of its shard. made_of says what the sequences
    were made with; with the shard's size and checksum it is the manifest, in manifest/shard-<number>.json. The
    file appears under its name only when it is whole, the manifest after it. A file of the size and checksum that
    its manifest says, equal to those to be written, isn't written again, so a stopped job goes on where it was.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(uri)
        files.create_dir(f"{root}/manifest", recursive=True)
        kept: list[pa.RecordBatch] = []
        current, parts = None, []

        def put(name: str, data: bytes) -> None:
            temporary = f"{name}.{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(temporary) as f:
                f.write(data)
            files.move(temporary, name)

        def close() -> pa.RecordBatch:
            data = b"".join(parts)
            name, manifest = f"{root}/shard-{current:08d}.u16", f"{root}/manifest/shard-{current:08d}.json"
            says = json.dumps(made_of | {"shard": current, "n_bytes": len(data), "crc32": zlib.crc32(data)}, sort_keys=True).encode()
            there, said = files.get_file_info([name, manifest])
            known = said.type == fs.FileType.File and said.size == len(says) and there.size == len(data)
            if known:
                with files.open_input_file(manifest) as f:
                    known = f.read() == says
            if not known:
                if said.type == fs.FileType.File:
                    files.delete_file(manifest)  # what it says no longer holds
                put(name, data)
                put(manifest, says)
            rows = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            sizes = [pa.array(np.full(rows.num_rows, n, dtype=np.int64)) for n in (len(parts), len(data))]
            return pa.RecordBatch.from_arrays([*rows.columns, *sizes], [*rows.schema.names, "n_slots", "n_bytes"])

        for b in batches:
            shards = b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if int(shards[lo]) != current and parts:
                    yield close()
                    parts, kept = [], []
                current = int(shards[lo])
                own = b.slice(lo, hi - lo)
                parts += own.column(6).to_pylist()
                kept.append(own.select(range(6)))
        if parts:
            yield close()

    return ordered.mapInArrow(run, WRITTEN)


def read_shard(uri: str, shard: int, length: int, first: int = 0, count: int = 1) -> np.ndarray:
    """count sequences of a shard from its first-th on: one seek, one read."""
    files, root = fs.FileSystem.from_uri(uri)
    with files.open_input_file(f"{root}/shard-{shard:08d}.u16") as f:
        f.seek(first * 2 * length)
        return np.frombuffer(f.read(count * 2 * length), dtype="<u2").reshape(-1, length)


def written_order(docs: DataFrame, uri: str, path: str | None = None, length: int = 2048, end: int = 2, key: int = 20240501, shard_slots: int = 4096) -> DataFrame:
    """(slot, shard, byte_offset, first_doc_id, n_tokens, ids_crc32, n_slots, n_bytes) after all shards were written under uri.

    The ids are in the shards: of each row at its byte_offset. Shards of an earlier, longer order are removed.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    placed, total = _placed(docs, path, length, end, key)
    with open(path, "rb") as f:
        vocabulary = hashlib.sha256(f.read()).hexdigest()
    made_of = {"key": key, "length": length, "end": end, "shard_slots": shard_slots, "total": total, "vocabulary_sha256": vocabulary}
    shards = max(1, -(-total // shard_slots))
    edges = sorted({shards * w // WAVES for w in range(WAVES + 1)})
    with short_shuffles(docs.sparkSession):
        waves = [materialise(write_shards(_ranged(placed, lo, hi, length, shard_slots), uri, made_of), "shards_written") for lo, hi in zip(edges, edges[1:], strict=False)]
    discard(placed)
    written = reduce(DataFrame.unionByName, waves)
    files, root = fs.FileSystem.from_uri(uri)
    if files.get_file_info(root).type == fs.FileType.Directory:
        for f in files.get_file_info(fs.FileSelector(root, recursive=True)):
            number = re.fullmatch(r"shard-(\d{8})\.(u16|json)", f.base_name)
            if number and int(number[1]) * shard_slots >= total:
                files.delete_file(f.path)
    return written


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_order(load(spark, sf_dir, "documents"), f"{shared_dir(spark)}/chronolex/shards-{uuid.uuid4().hex}")
