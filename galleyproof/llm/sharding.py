"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import mix
from .cluster import cut

ROUNDS = 6


class Permutation:
    """A bijection on 0 .. n - 1 fixed by n and the seed, computable in both directions.

    A balanced Feistel network permutes the smallest range of an even number of bits that holds n; a value that
    falls outside 0 .. n - 1 is sent on (cycle walking) until it falls inside.
    """

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.half = np.uint64(max(1, -(-max(0, n - 1).bit_length() // 2)))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed % (1 << 64)))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        if back:
            left, right = right, left
        for key in self.keys[::-1] if back else self.keys:
            left, right = right, left ^ (mix(right ^ key) & self.mask)
        return right << self.half | left if back else left << self.half | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = np.asarray(x, np.uint64)
        if len(x) and int(x.max()) >= self.n:
            raise ValueError("a row number is out of range")
        x = self._once(x, back)
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def forward(self, rows) -> np.ndarray:
        return self._walk(rows, False)

    def inverse(self, places) -> np.ndarray:
        return self._walk(places, True)


def row_of(shard, slot, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The global row number of the row in each slot of each shard."""
    return Permutation(n, seed).inverse(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64))


def number_rows(df: DataFrame, *order: Column | str, name: str = "row") -> tuple[DataFrame, int]:
    """df with the place (from 0) of each row in the given order, and the number of rows.

    The order is dealt out by sampled ranges, sorted in each and written; then only a count for each
    partition is gathered. df should be narrow.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__at")))
    part = F.shiftrightunsigned("__at", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for p, c in counts:
        starts.append((p, total))
        total += c
    if not starts:
        return placed.select(*df.columns, F.lit(0).cast("long").alias(name)), 0
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    out = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return out.select(*df.columns, (F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias(name)), total


def shard_rows(numbered: DataFrame, total: int, shards: int, seed: int = 0, row_col: str = "row") -> DataFrame:
    """numbered (with row numbers 0 .. total - 1) and its place in the shuffle: shard and slot, by calculation alone."""
    at = numbered.columns.index(row_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Permutation(total, seed)
        for b in batches:
            place = permutation.forward(b.column(at).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], [*b.schema.names, "shard", "slot"])

    return numbered.mapInArrow(run, T.StructType([*numbered.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]))


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, size, text_crc32, row, shard, slot): documents shuffled into shards whose counts differ by at most one.

    Rows are numbered by id (nulls first), then by a hash, the size and the checksum of the text, so equal
    rows are interchangeable. The row numbers are permuted; a place modulo the number of shards is the
    shard, divided by it the slot. size is the text's UTF-8 bytes plus 16 (null: 16), text_crc32 the
    CRC-32 of these bytes (null: that of no bytes, 0). Texts never move; equal texts are spread like others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("__hash"))
    numbered, total = number_rows(cut(narrow), F.col("id"), F.col("__hash"), F.col("size"), F.col("text_crc32"))
    return shard_rows(numbered.drop("__hash"), total, shards, seed)
