"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to floor((a.v + b) / width) for a few Gaussian directions a. A query
visits its own bucket and then neighbouring ones in ascending order of the squared distances
to the boundaries that must be crossed, which is the order of estimated success. Candidates
of all tables are merged and ranked by their exact distance in double precision. Widths are
in units of the vectors' own spread, and queries whose probes find fewer than k candidates
are compared with all vectors.

How many tables, functions and probes, and how wide the cells, depends on the vectors: some
queries are searched exactly, in one scan, and of a few settings the one with the fewest
candidates that finds enough of their true neighbours is taken.

Buckets and the probes that visit them meet in groups of bounded size: a bucket with many
vectors or many visitors is dealt in blocks, so no bucket is ever in one task as a whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import mix, settle


@dataclass(frozen=True)
class Hashing:
    """tables x functions hash functions of cells `width` spreads wide; probes buckets visited in each table."""

    tables: int = 4
    functions: int = 6
    width: float = 2.0
    probes: int = 60
    seed: int = 5
    vectors: int = 4096
    visitors: int = 4096


#: Settings that are tried, and the recall that one must reach on the queries searched exactly.
SETTINGS = tuple(Hashing(tables=t, functions=f, width=w, probes=p) for t, f, w, p in ((4, 12, 1.0, 60), (8, 12, 1.0, 60), (8, 10, 1.0, 60), (8, 12, 1.5, 100), (4, 10, 1.5, 60), (8, 10, 1.5, 100), (8, 10, 2.0, 100), (8, 8, 2.0, 60), (4, 8, 2.0, 60), (4, 6, 2.0, 60)))
ENOUGH = 0.95
#: Most queries that are searched exactly, and most vectors and numbers of the sample that tells how many candidates a setting has.
FIT_QUERIES, FIT_ROWS, FIT_NUMBERS = 96, 4096, 1 << 22


def directions(h: Hashing, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections (dims x tables*functions) and offsets."""
    rng = np.random.default_rng(h.seed)
    return rng.standard_normal((dims, h.tables * h.functions)), rng.uniform(0, h.width, h.tables * h.functions)


def probe_sets(inside: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The first `probes` sets of (function, step) by estimated success, the empty set first.

    inside: where the vector lies in its cell, 0 to 1, for each function. A set's cost is
    the sum of squared distances to the boundaries that it crosses; sets come from a heap
    that grows by shifting or adding the last element.
    """
    steps = sorted([(x * x, k, -1) for k, x in enumerate(inside)] + [((1 - x) ** 2, k, 1) for k, x in enumerate(inside)])
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(steps[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({steps[j][1] for j in chosen}) == len(chosen):
            out.append([steps[j][1:] for j in chosen])
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + steps[last + 1][0], (*chosen, last + 1)))
    return out


def _bucket(table: int, cells: np.ndarray) -> np.ndarray:
    """A 64-bit key of integer cells (rows) of one table."""
    key = np.full(len(cells), table + 1, np.uint64)
    for k in range(cells.shape[1]):
        key = mix(key ^ cells[:, k].astype(np.int64).view(np.uint64)) + np.uint64(k)
    return key.view(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dims)


def usable(vec: str) -> Column:
    """Vectors that take part: not null, not zero, all components finite."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & ~odd & F.exists(vec, lambda x: x != 0)


def spread(vectors: DataFrame, dims: int) -> float:
    """Median distance of all rows' vectors (vec) from the middle one; their mean distance if that is 0, and 1 if both are."""
    middle = vectors.agg(*(F.percentile_approx(F.get("vec", F.lit(i)), 0.5).alias(f"c{i}") for i in range(dims))).first()
    if middle is None or middle[0] is None:
        return 1.0
    off = F.zip_with("vec", F.array(*map(F.lit, middle)), lambda x, c: (x - c) * (x - c))
    away = F.sqrt(F.aggregate(off, F.lit(0.0), lambda a, x: a + x))
    return next((float(x) for x in vectors.agg(F.percentile_approx(away, 0.5), F.avg(away)).first() if x), 1.0)


def placed(vectors: np.ndarray, how: Hashing, unit: float) -> np.ndarray:
    """Where vectors lie, in cells, under every function of every table."""
    a, b = directions(how, vectors.shape[1])
    return (vectors / unit @ a + b) / how.width


def probed(at: np.ndarray, how: Hashing, table: int, probes: int) -> np.ndarray:
    """Buckets (vectors x up to probes) that vectors at these places visit in a table, their own first; a short list repeats its own."""
    mine = slice(table * how.functions, (table + 1) * how.functions)
    cells = np.floor(at[:, mine]).astype(np.int64)
    near = np.repeat(cells[:, None], probes, axis=1)
    for i in range(len(cells) if probes > 1 else 0):
        for j, steps in enumerate(probe_sets(at[i, mine] - cells[i], probes)):
            for f, step in steps:
                near[i, j, f] += step
    return _bucket(table, near.reshape(-1, how.functions)).reshape(len(cells), probes)


def exact(own: DataFrame, ids: list, vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of (id, vec) of each vector but the one with its id, in one scan: (vector, neighbour, component), nan where there are fewer."""
    sent, dims = own.sparkSession.sparkContext.broadcast((np.array(ids), vectors)), vectors.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, aims = sent.value
        far, best = np.full((len(aims), k), np.inf), np.zeros((len(aims), k, dims))
        for batch in batches:
            rows, mine = _matrix(batch.column(1), dims), batch.column(0).to_numpy(zero_copy_only=False)
            away = (aims**2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * aims @ rows.T
            away[asked[:, None] == mine[None]] = np.inf
            order = np.argsort(away, axis=1)[:, :k]
            both = np.concatenate([far, np.take_along_axis(away, order, axis=1)], axis=1)
            keep = np.argsort(both, axis=1)[:, :k]
            best = np.take_along_axis(np.concatenate([best, rows[order]], axis=1), keep[:, :, None], axis=1)
            far = np.take_along_axis(both, keep, axis=1)
        q, j = np.nonzero(np.isfinite(far))
        yield pa.record_batch([pa.array(q), pa.array(far[q, j]), pa.array(list(best[q, j]), pa.list_(pa.float64()))], ["q", "away", "vec"])

    place = F.row_number().over(Window.partitionBy("q").orderBy("away"))
    found = own.mapInArrow(scan, "q long, away double, vec array<double>").withColumn("place", place).where(F.col("place") <= k).collect()  # k rows a vector
    out = np.full((len(vectors), k, dims), np.nan)
    for r in found:
        out[r.q, r.place - 1] = r.vec
    return out


def fitted(own: DataFrame, ask: DataFrame, dims: int, unit: float, k: int) -> Hashing:
    """The one of SETTINGS with the fewest candidates that finds ENOUGH of the true neighbours, or the one that finds most.

    Neighbours are those of up to FIT_QUERIES of the queries, drawn by hashed id and searched
    exactly among all rows; candidates are counted on a sample of the rows, which FIT_ROWS and
    FIT_NUMBERS bound. So the recall on other queries is an estimate from some hundred
    neighbours, while the index itself holds every row.
    """
    rows = max(1, min(FIT_ROWS, FIT_NUMBERS // dims))

    def drawn(df: DataFrame, most: int) -> list:
        step = -(-df.count() // most) if most else 1
        some = df.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(max(step, 1))) == 0) if step > 1 else df
        return some.orderBy(F.xxhash64(F.lit(8), "id")).limit(most).collect()

    asked, sample = drawn(ask.distinct(), max(1, min(FIT_QUERIES, FIT_NUMBERS // (dims * (k + 1))))), drawn(own, rows)
    if not asked or not sample:
        return Hashing()
    aims, others = (np.array([r.vec for r in found], np.float64) for found in (asked, sample))
    near = exact(own, [r.id for r in asked], aims, k)
    known = ~np.isnan(near[:, :, 0])
    best = None
    for how in SETTINGS:
        at = [placed(x, how, unit) for x in (aims, np.nan_to_num(near).reshape(-1, dims), others)]
        hit, met = np.zeros(known.shape, bool), np.zeros((len(aims), len(others)), bool)
        for t in range(how.tables):
            visits = probed(at[0], how, t, how.probes)
            homes = probed(at[1], how, t, 1).reshape(known.shape)
            rest = probed(at[2], how, t, 1)[:, 0]
            for i in range(len(aims)):
                hit[i] |= np.isin(homes[i], visits[i])
                met[i] |= np.isin(rest, visits[i])
        recall, share = (hit & known).sum() / max(known.sum(), 1), met.mean()
        rank = (recall >= ENOUGH, -share if recall >= ENOUGH else recall)
        if best is None or rank > best[0]:
            best = rank, how
    return best[1]


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, how: Hashing | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found among the rows of df for each row of queries.

    Both frames have id_col and vec_col. A candidate with the query's own id is left out.
    Vectors that are null, zero, hold null or non-finite components or have another length
    than most take no part, nor do rows without id. Ties go to smaller ids. Equal vectors
    are searched once: of each only the k + 1 smallest ids are candidates, as no query can
    rank more. Repeated rows count once; other columns are not read; an empty frame on
    either side gives no rows. Without how the parameters are fitted to the vectors, see
    `fitted`.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("id is not null").where(usable("vec"))
    ask = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("id is not null").where(usable("vec"))
    most = own.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = most.dims if most else 1
    own, ask = (x.where(F.size("vec") == dims).select("id", F.col("vec").cast("array<double>").alias("vec")) for x in (own, ask))
    alike = Window.partitionBy("vec").orderBy("id")
    own = settle(own.distinct().withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1).drop("place"))
    unit = spread(own, dims)
    how = how or fitted(own, ask, dims, unit, k)

    def hashed(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = placed(_matrix(batch.column(1), dims), how, unit)
            keys = [probed(at, how, t, probes) for t in range(how.tables)]
            new = [np.concatenate([np.ones((len(at), 1), bool), x[:, 1:] != x[:, :1]], axis=1) for x in keys]
            take = pa.array(np.concatenate([np.nonzero(x)[0] for x in new]))
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate([x[y] for x, y in zip(keys, new, strict=True)]))], ["id", "vec", "bucket"])

    kind = df.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, vec array<double>, bucket long"
    index = settle(own.mapInArrow(lambda x: hashed(x, 1), shape))
    asked = settle(ask.mapInArrow(lambda x: hashed(x, how.probes), shape))

    def meet(mine: pa.Table, visiting: pa.Table) -> pa.Table:
        ids, vecs = mine.column("id").combine_chunks(), _matrix(mine.column("vec").combine_chunks(), dims)
        asks, aims = visiting.column("id").combine_chunks(), _matrix(visiting.column("vec").combine_chunks(), dims)
        blocks, wanted = mine.column("block").to_numpy(), visiting.column("block").to_numpy()
        order, asked_order = np.argsort(blocks, kind="stable"), np.argsort(wanted, kind="stable")
        q_at, v_at, d_at = [], [], []
        for block in np.unique(blocks):
            v = order[slice(*np.searchsorted(blocks[order], [block, block + 1]))]
            q = asked_order[slice(*np.searchsorted(wanted[asked_order], [block, block + 1]))]
            if not len(q):
                continue
            rough = (aims[q] ** 2).sum(1)[:, None] + (vecs[v] ** 2).sum(1)[None] - 2 * aims[q] @ vecs[v].T
            cut = np.partition(rough, min(k, len(v) - 1), axis=1)[:, min(k, len(v) - 1)]
            i, j = np.nonzero(rough <= (cut + 1e-9 * (1 + np.abs(cut)))[:, None])  # k + 1, as one may be the query's own
            q_at.append(q[i])
            v_at.append(v[j])
            d_at.append(np.sqrt(((aims[q[i]] - vecs[v[j]]) ** 2).sum(1)))
        none = np.zeros(0, np.int64)
        q_at, v_at, d_at = (np.concatenate([none, *x]).astype(t) for x, t in ((q_at, int), (v_at, int), (d_at, float)))
        found = pa.table([asks.take(pa.array(q_at)), ids.take(pa.array(v_at)), pa.array(d_at)], ["query_id", "vec_id", "score"])
        frame = found.to_pandas().drop_duplicates()
        frame = frame[frame.query_id != frame.vec_id].sort_values(["query_id", "score", "vec_id"])
        return pa.Table.from_pandas(frame[frame.groupby("query_id").cumcount() < k], preserve_index=False)

    def matched(index: DataFrame, asked: DataFrame) -> DataFrame:
        """Candidates of all asked rows, of one bucket: (vector block, visitor block) pairs, hashed to groups of about how.vectors vectors."""
        sizes = index.groupBy("bucket").agg(F.ceil(F.count("*") / how.vectors).cast("int").alias("vs"))
        visits = asked.groupBy("bucket").agg(F.ceil(F.count("*") / how.visitors).cast("int").alias("qs"))
        plan = settle(sizes.join(visits, "bucket"))
        groups = max(1, -(-index.count() // how.vectors))
        group = F.pmod(F.xxhash64("bucket", "v", "q"), F.lit(groups))
        left = index.join(plan, "bucket").select("*", F.pmod(F.xxhash64("id"), "vs").cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"))
        right = asked.join(plan, "bucket").select("*", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("v"), F.pmod(F.xxhash64("id"), "qs").cast("int").alias("q"))
        left, right = (x.select("id", "vec", F.xxhash64("bucket", "v", "q").alias("block"), group.alias("g")) for x in (left, right))
        return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(meet, f"query_id {kind}, vec_id {kind}, score double")

    found = settle(matched(index, asked).distinct())
    served = found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= k)
    short = settle(ask.distinct().join(served, "id", "left_anti").withColumn("bucket", F.lit(0).cast("long")))
    if not short.isEmpty():
        found = found.union(matched(own.withColumn("bucket", F.lit(0).cast("long")), short))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_query(spark, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(embeddings, embeddings.where("vec_id % 100 = 0"), k=10)
