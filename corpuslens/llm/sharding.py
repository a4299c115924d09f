"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. The light columns of the rows are written once, so that every later pass sees the same partitions.
2. The rows of each partition are counted. How many rows each partition sends to each shard is drawn exactly: the
   matrix of a uniformly random assignment with these row and column sums is multivariate hypergeometric.
3. Each partition permutes its rows and deals them out by its row of the matrix.
4. Rows are exchanged by shard and slice of a shard; a slice holds a random part of the shard and is permuted again.

Law: rows. Shard sizes differ by one at most. Equal texts are not kept together: a group of copies can be larger than
a shard. Draws come from a seed, the partition's number (its file's place among the stored files) and the row's place
in it: one seed gives one assignment for one partitioning of the rows.

Defined results: null texts have no bytes; null doc_ids and repeated rows are rows like others; an empty table gives
no rows. Other columns are kept by shuffle(), which prefixes its own columns; its input may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuslens.llm.common import Scratch, bound_batches

#: Rows of a slice on average; a slice is sorted by one task.
SLICE = 50_000
#: Rows that numpy's hypergeometric draws are made for.
NUMPY_MOST = 10**9


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Exact sizes, at most one apart, the larger ones first."""
    return rows // shards + (np.arange(shards) < rows % shards)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good: exact for any size, numpy's own up to a billion.

    Beyond, by rejection from a flat top with exponential tails, which bounds every log-concave distribution of known peak.
    Probabilities are taken relative to the mode's, as sums of logarithms of exact ratios of neighbours, so that nothing is lost to the size
    of the numbers; the peak itself is only needed roughly, and taken a tenth too low, which widens the bound.
    """
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    peak = 0.9 * math.exp(min(0.0, log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n)))

    def log_ratio(k: int) -> float:
        """Logarithm of the probability of k against that of the mode."""
        x = np.arange(min(k, mode), max(k, mode), dtype=np.float64)  # from x to x + 1
        up = np.log(good - x) + np.log(n - x) - np.log(x + 1) - np.log(bad - n + x + 1)
        return float(up.sum()) * (1 if k >= mode else -1)

    top = 1 + peak / 2
    while True:
        u, level = rng.random(), rng.random()
        y = rng.random() * top / peak if u <= top / (1 + top) else (top + rng.exponential()) / peak
        k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if low <= k <= high and math.log(max(level, 1e-300)) + min(0.0, top - peak * y) <= log_ratio(k):
            return k


def _split(rng: np.random.Generator, by_shard: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows, drawn without replacement, each shard gets of those that by_shard has room for."""
    out, room = np.zeros(len(by_shard), np.int64), int(by_shard.sum())
    for i, size in enumerate(by_shard.tolist()):
        room -= size
        out[i] = _hypergeometric(rng, size, room, n) if size else 0
        n -= int(out[i])
    return out


def matrix_row(before: np.ndarray, part: int, sizes: np.ndarray, seed: int) -> np.ndarray:
    """How many rows of a partition go to each shard. before: rows in front of each partition, and in all; sizes: rows by shard.

    The matrix is multivariate hypergeometric. It is split along a binary tree over the partitions, each node with draws of its own, so that
    a task finds its row from the sums of rows alone, in as many steps as the tree is deep; the matrix is nowhere held.
    """
    lo, hi, room = 0, len(before) - 1, np.array(sizes, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(np.random.Generator(np.random.PCG64([seed, lo, hi])), room, int(before[mid] - before[lo]))
        lo, hi, room = (lo, mid, left) if part < mid else (mid, hi, room - left)
    return room


def shuffle(df: DataFrame, shards: int, seed: int = 11, prefix: str = "") -> DataFrame:
    """df with columns <prefix>shard (int) and <prefix>slot (long, gapless from 0 in each shard)."""
    bound_batches(df.sparkSession)
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    here, key = "__part", "__key"
    stored = scratch.table(df)
    # a file is a partition or several; its name and the row's place in it do not change when a task is repeated
    stored = stored.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    counts = {(r[0], r[1]): r[2] for r in stored.groupBy("__file", "__block").count().collect()}  # a row per partition
    number = {k: i for i, k in enumerate(sorted(counts))}
    before = np.cumsum([0, *(counts[k] for k in sorted(counts))])
    sizes = shard_sizes(int(before[-1]), shards)
    schema = T.StructType([*df.schema.fields, T.StructField(here, T.IntegerType()), T.StructField("__shard", T.IntegerType()), T.StructField(key, T.LongType())])

    own, names = df.columns, schema.names

    def deal(batches):
        dealt: dict[int, list] = {}
        for batch in batches:
            files, blocks = batch.column("__file").dictionary_encode(), np.asarray(batch.column("__block"), np.int64)
            codes, known = np.asarray(files.indices, np.int64), files.dictionary.to_pylist()
            shard, keys, where = np.empty(len(codes), np.int32), np.empty(len(codes), np.int64), np.empty(len(codes), np.int32)
            cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), len(codes)] if len(codes) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):  # the rows of one partition
                p = number[known[codes[lo]], int(blocks[lo])]
                if p not in dealt:
                    rng = np.random.Generator(np.random.PCG64([seed, p]))
                    order = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), matrix_row(before, p, sizes, seed)))
                    dealt[p] = [order, rng.integers(0, 1 << 62, len(order)), 0]
                order, random, at = dealt[p]
                shard[lo:hi], keys[lo:hi], where[lo:hi] = order[at : at + hi - lo], random[at : at + hi - lo], p
                dealt[p][2] = at + hi - lo
                if dealt[p][2] == len(order):
                    del dealt[p]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(where), pa.array(shard), pa.array(keys)], names)

    dealt = stored.mapInArrow(deal, schema)
    slices = max(1, -(-int(before[-1]) // (shards * SLICE)))
    dealt = dealt.withColumn("__slice", F.floor(F.col(key) / F.lit((1 << 62) / slices)).cast("int"))
    dealt = scratch.table(dealt)
    filled = dealt.groupBy("__shard", "__slice").count()  # a row per slice, that is per SLICE rows
    first = filled.withColumn("__first", F.sum("count").over(Window.partitionBy("__shard").orderBy("__slice")) - F.col("count")).drop("count")
    inside = Window.partitionBy("__shard", "__slice").orderBy(key, here)
    x = dealt.withColumn("__n", F.row_number().over(inside) - 1).join(first, ["__shard", "__slice"])
    return x.select(*df.columns, F.col("__shard").alias(f"{prefix}shard"), (F.col("__first") + F.col("__n")).cast("long").alias(f"{prefix}slot"))
