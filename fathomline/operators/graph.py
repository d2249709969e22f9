"""Connected components, and an ordered greedy choice of vertices without neighbours among them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.sources.store import forget, settle

#: Most edges of a component that one task folds; larger components are decided in rounds over the whole cluster.
FOLDED_EDGES = 1 << 16


def _state(edges: DataFrame) -> tuple:
    """What tells a table of (u, v) from another: its size and the sums of two hashes."""
    sums = (F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(38,0)")) for i in (1, 2))
    return tuple(edges.agg(F.count("*"), *sums).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of edges (a, b): every vertex with the smallest one that it can reach.

    Each round points a vertex's larger neighbours, then its smaller ones, at its smallest,
    until a round changes nothing; the number of rounds grows with the logarithm of the
    longest path. Only minima are aggregated, so a vertex of any degree is fine.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lowest.select("u", F.col("m").alias("v")).union(large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = settle(small)
        forget(now)
        now, last, before = after, before, _state(after)
        if before == last:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _dropped_in_rounds(edges: DataFrame) -> DataFrame:
    """(id) of the vertices that the greedy walk drops: each round decides those whose earlier neighbours allow it."""
    state = settle(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept IS NULL").isEmpty():
        of = state.select(F.col("id").alias("a"), F.col("kept").alias("ka"))
        earlier = edges.join(of, "a").groupBy("b").agg(F.bool_or(F.col("ka").eqNullSafe(True)).alias("hit"), F.bool_or(F.col("ka").isNull()).alias("open"))
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        after = settle(state.join(earlier, state["id"] == earlier["b"], "left").select("id", decided.alias("kept")))
        forget(state)
        state = after
    return state.where("NOT kept").select("id")


def _folded(table: pa.Table) -> pa.Table:
    """(id) that one component's walk drops; edges sorted by their later end, so every earlier end is decided when it is read."""
    ends = [[tuple(x.values()) if isinstance(x, dict) else x for x in table.column(c).to_pylist()] for c in ("a", "b")]
    dropped, rows = set(), []
    for i in sorted(range(len(table)), key=lambda i: ends[1][i]):
        a, b = ends[0][i], ends[1][i]
        if a not in dropped and b not in dropped:
            dropped.add(b)
            rows.append(i)
    return pa.table([table.column("b").take(pa.array(rows, pa.int64()))], ["id"])


def greedy_kept(ids: DataFrame, edges: DataFrame, folded: int = FOLDED_EDGES) -> DataFrame:
    """(id, kept): walking ids upwards, keep those without an edge to an earlier kept one.

    ids: (id); edges: (a, b) with a < b. Components do not touch each other, so each that has
    at most `folded` edges is walked in one task; larger ones are decided in as many rounds as
    their longest chain of decisions has links.
    """
    edges = settle(edges.select("a", "b"))
    placed = edges.join(components(edges).withColumnRenamed("id", "a"), "a")
    sizes = settle(placed.groupBy("component").agg((F.count("*") <= folded).alias("small")))
    near = placed.join(sizes.where("small"), "component")
    kind = edges.schema["b"].dataType.simpleString()
    dropped = near.groupBy("component").applyInArrow(lambda t: _folded(t.select(["a", "b"])), f"id {kind}")
    if not sizes.where("NOT small").isEmpty():
        far = settle(placed.join(sizes.where("NOT small"), "component").select("a", "b"))
        dropped = dropped.union(_dropped_in_rounds(far))
    gone = dropped.withColumn("gone", F.lit(True))
    return ids.join(gone, "id", "left").select("id", F.col("gone").isNull().alias("kept"))
