"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

How many rows of each input partition go to each output block is drawn before any row
moves: block sizes are fixed in advance, so the matrix with given row and column sums is
multivariate hypergeometric. It is drawn as a binary tree over the input partitions in
which every node has its own seed, so a task derives its own row of the matrix from the
partition counts and no task and no driver ever holds the whole matrix. Each partition then
permutes its labels, the rows are exchanged once, and every block is permuted again.
A shard is a run of blocks, hence a row's slot is its block's start plus its place there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import settle

#: numpy draws hypergeometric numbers of populations below this.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` items taken from good + bad are good."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    lo, hi = max(0, drawn - bad), min(good, drawn)
    if lo == hi:
        return lo
    n = good + bad
    mean = drawn * (good / n)
    spread = math.sqrt(max(drawn * (good / n) * (bad / n) * ((n - drawn) / (n - 1)), 0.25))
    log = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(drawn - k + 1) + math.lgamma(bad - drawn + k + 1))
    mode = min(hi, max(lo, int((drawn + 1) * ((good + 1) / (n + 2)))))
    top = log(mode)
    while True:  # ratio of uniforms over a box that holds the whole region
        u, v = rng.random(), rng.uniform(-1.0, 1.0)
        if u > 0 and lo <= (k := math.floor(mean + 3.0 * spread * v / u + 0.5)) <= hi and 2 * math.log(u) <= log(k) - top:
            return k


def deal(rng: np.random.Generator, need: np.ndarray, drawn: int) -> np.ndarray:
    """Multivariate hypergeometric: `drawn` items out of the boxes `need`."""
    if int(need.sum()) < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(need, drawn, method="marginals")
    out, rest, left = np.zeros_like(need), int(need.sum()), drawn
    for i, size in enumerate(map(int, need)):
        out[i] = took = hypergeometric(rng, size, rest - size, left)
        rest, left = rest - size, left - took
    return out


def matrix_row(counts: np.ndarray, sizes: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """Row `partition` of the communication matrix with row sums `counts` and column sums `sizes`."""
    before = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, need = 0, len(counts), sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = deal(rng, need, int(before[mid] - before[lo]))
        lo, hi, need = (lo, mid, left) if partition < mid else (mid, hi, need - left)
    return need


def block_plan(rows: int, shards: int, block_rows: int, most_blocks: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, shard, first slot) of every block; shard sizes differ by one row at most."""
    sizes, owner, start = [], [], []
    block_rows = max(block_rows, -(-rows // most_blocks))
    for s in range(shards):
        size = rows // shards + (s < rows % shards)
        parts = max(1, -(-size // block_rows))
        cuts = [size * i // parts for i in range(parts + 1)]
        sizes += [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        start += cuts[:-1]
        owner += [s] * parts
    return np.array(sizes, np.int64), np.array(owner, np.int64), np.array(start, np.int64)


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 1, block_rows: int = 4096, plain_scan: bool = False) -> DataFrame:
    """All rows and columns of df plus shard (int) and slot (long, gapless from 0 in each shard).

    Shard sizes differ by one at most and every assignment that keeps them is equally
    likely. Rows are told apart by where they lie, not by their values: null keys, empty
    texts, ties and repeated rows each take a slot of their own, an empty table gives an
    empty result, and input columns named shard or slot are replaced. df is written to the
    shared folder first, as its partitions must hold the same rows in every run;
    plain_scan=True says that df only reads files and saves that. A task that meets other
    rows than were counted fails rather than deal wrongly.
    """
    df = df.drop("shard", "slot")
    if not plain_scan:
        df = settle(df)
    found = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()  # a row for each input partition
    counts = np.zeros(max((r.p for r in found), default=-1) + 1, np.int64)
    for r in found:
        counts[r.p] = r["count"]
    sizes, owner, start = block_plan(int(counts.sum()), shards, block_rows)
    names = [f"__{n}" for n in ("block", "shard", "start", "tick")]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at, mine, rng = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            if mine is None:
                rng = np.random.default_rng([seed, len(counts), p])
                row = matrix_row(counts, sizes, p, seed) if p < len(counts) else np.zeros(0, np.int64)
                mine = rng.permutation(np.repeat(np.arange(len(row)), row))
            to = mine[at : at + batch.num_rows]
            if len(to) < batch.num_rows:
                raise RuntimeError(f"partition {p} holds more rows than were counted")
            at += batch.num_rows
            extra = (to, owner[to], start[to], rng.integers(0, 1 << 62, len(to)))
            for name, values in zip(names, extra, strict=True):
                batch = batch.append_column(name, pa.array(values, pa.int64()))
            yield batch
        if mine is not None and at < len(mine):
            raise RuntimeError(f"partition {p} holds fewer rows than were counted")

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    place = F.row_number().over(Window.partitionBy("__block").orderBy("__tick")).cast("long") - 1
    return df.mapInArrow(label, schema).withColumns({"shard": F.col("__shard").cast("int"), "slot": F.col("__start") + place}).drop(*names)


def op7_query(spark, sf_dir: str) -> DataFrame:
    """Digest of the sharded documents: sizes and checksums beside shard and slot."""
    dealt = shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=16, seed=20240, plain_scan=True)
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
