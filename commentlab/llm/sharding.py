"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable 64-bit key is hashed and walked through the jump sequence: no ring table, and a shard appended at
the end takes only the rows that move into it, 1 / (n + 1) of all. Key and shard count decide alone, so
equal keys share a shard and no partitioning of the input changes it.

``slot`` numbers the rows of a shard without gaps: every task counts its own rows per shard while it reads,
and the counts of earlier tasks are added from one small row per (task, shard). Rows are not shuffled.

Cases: a null key is hashed as such and has a shard; a null text has the bytes and the CRC of no text; an
empty table gives an empty result; equal rows get slots of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from commentlab.llm.common import starts_before
from commentlab.session import cut_lineage

SHARDS = 8
_LCG = np.uint64(2862933555777941757)  # fixed value: the multiplier of the published generator


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys stepped together until the last has landed."""
    key = keys.astype(np.uint64)
    shard = np.full(len(key), -1, dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * _LCG + np.uint64(1)  # wraps modulo 2**64
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        # a jump of 2**62 or more is past any shard count
        jump[live] = np.minimum((shard[live] + 1) * step, float(1 << 62)).astype(np.int64)
        live = live[jump[live] < n_shards]
    return shard


def _place(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(n_shards, dtype=np.int64)
        for batch in batches:
            keys = batch.column("key_hash").to_numpy(zero_copy_only=False).view(np.uint64)
            shard, grown = jump_hash(keys, n_shards), jump_hash(keys, n_shards + 1)
            texts = [(t or "").encode("utf-8") for t in batch.column("text").to_pylist()]
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=n_shards)
            local = np.empty(len(shard), dtype=np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            local += seen[shard]
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([len(t) + 1 for t in texts], pa.int64()),
                    pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                    pa.array(shard, pa.int32()),
                    pa.array(grown, pa.int32()),
                    pa.array(local),
                    pa.array(np.full(len(shard), part, dtype=np.int32)),
                    pa.array(np.ones(len(shard), dtype=np.int64)),
                ],
                names=["key", "size", "text_crc32", "shard", "grown_shard", "_local", "_part", "_one"],
            )

    return run


def shard_documents(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS) -> DataFrame:
    """``(key, size, text_crc32, shard, grown_shard, slot)`` for every row of ``docs``."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = docs.select(
        F.col(key_col).alias("key"), F.xxhash64(F.col(key_col)).alias("key_hash"), F.col(text_col).alias("text")
    )
    kind = rows.schema["key"].dataType.simpleString()
    placed = rows.mapInArrow(
        _place(n_shards),
        f"key {kind}, size bigint, text_crc32 bigint, shard int, grown_shard int, _local bigint, _part int, _one bigint",
    )
    placed = cut_lineage(placed, "shards")
    before = starts_before(placed, "_one", ["shard"], "_before")
    return placed.join(before, ["_part", "shard"]).select(
        "key", "size", "text_crc32", "shard", "grown_shard", (F.col("_local") + F.col("_before")).alias("slot")
    )
