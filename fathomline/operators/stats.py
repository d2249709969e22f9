"""Resampling statistics over score vectors keyed by example.

The portable draws come from integer arithmetic, so any SQL engine repeats them;
`numpy_interval` uses numpy's generator instead and equals what a numpy program with the same
seed prints. A key of up to MOST_VALUES scores goes to tasks as one array, and each task draws
a block of rounds; larger ones are drawn as rows, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most scores of a key that are sent as one array (32 MB), rounds of a block, and draws made at once.
MOST_VALUES, BLOCK, DRAWS = 1 << 22, 250, 1 << 20
#: Draws are integers below this prime.
MODULUS = (1 << 31) - 1


def _draw(round_, i, seed: int, folded: Callable):
    """A pseudo-random integer below MODULUS for each round and place; folded(v, k): v xor (v >> k)."""
    x = (round_ * 48271 + seed) % MODULUS
    y = (x * 69621 + i * 16807 + 12345) % MODULUS
    z = (folded(y, 13) * 39373) % MODULUS
    return folded((folded(z, 7) * 62089911) % MODULUS, 11)


def _draw_column(round_: Column, i: Column, seed: int) -> Column:
    return _draw(round_.cast("bigint"), i, seed, lambda v, k: v.bitwiseXOR(F.shiftright(v, k)))


def facts(df: DataFrame, condition: str, example: str, values: dict[str, Column]) -> DataFrame:
    """(condition, example, field, value): one row for each score; null and NaN values are left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), v.cast("double").alias("value")) for k, v in values.items()))
    rows = df.select(F.col(condition).alias("condition"), F.col(example).alias("example"), F.inline(pairs))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _placed(scores: DataFrame, key: list[str]) -> DataFrame:
    """Scores with their place i from 0 in example order, and n, within the key."""
    own = Window.partitionBy(*key)
    return scores.withColumns({"i": (F.row_number().over(own.orderBy("example")) - 1).cast("bigint"), "n": F.count("*").over(own)})


def _round_means(scores: DataFrame, key: list[str], value: str, rounds: int, seed: int, flip: bool) -> DataFrame:
    """key, round, mean to six digits: of n draws with replacement, or (flip) of all values under random signs."""
    largest = scores.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    if largest > MOST_VALUES:
        placed = _placed(scores, key)
        draws = placed.select(*key, "i", "n", F.col(value).alias("own"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
        drawn = draws.withColumn("pick", _draw_column(F.col("round"), F.col("i"), seed) % (F.lit(2) if flip else F.col("n")))
        if flip:
            drawn = drawn.withColumn("v", F.when(F.col("pick") == 0, F.col("own")).otherwise(-F.col("own")))
        else:
            drawn = drawn.join(placed.select(*key, F.col("i").alias("pick"), F.col(value).alias("v")), [*key, "pick"])
        return drawn.groupBy(*key, "round").agg(F.round(F.avg("v"), 6).alias("mean"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                v = batch.column("v")[row].values.to_numpy(zero_copy_only=False)
                first, i, out = batch.column("block")[row].as_py() * BLOCK + 1, np.arange(len(v), dtype=np.int64), []
                each = np.arange(first, min(first + BLOCK, rounds + 1), dtype=np.int64)
                for low in range(0, len(each), at_once := max(1, DRAWS // len(v))):
                    drawn = _draw(each[low : low + at_once, None], i, seed, lambda v, k: v ^ (v >> k))
                    out.append(np.where(drawn % 2 == 0, v, -v).mean(axis=1) if flip else v[drawn % len(v)].mean(axis=1))
                own = [pa.repeat(batch.column(c)[row], len(each)) for c in key]
                yield pa.record_batch([*own, pa.array(each), pa.array(np.concatenate(out))], [*key, "round", "mean"])

    lists = scores.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("example", F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("v"))
    blocks = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // BLOCK))).alias("block")).repartition(*key, "block")
    shape = T.StructType([*scores.select(*key).schema.fields, T.StructField("round", T.LongType()), T.StructField("mean", T.DoubleType())])
    return blocks.mapInArrow(draw, shape).withColumn("mean", F.round("mean", 6))


def resampled(scores: DataFrame, key: list[str], value: str, rounds: int, seed: int) -> DataFrame:
    """key, round, mean: the mean of n draws with replacement in each round, to six digits."""
    return _round_means(scores, key, value, rounds, seed, flip=False)


def interval(scores: DataFrame, key: list[str], value: str = "value", rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """key, mean, low, high: the 95 % bootstrap interval of the mean."""
    ends = resampled(scores, key, value, rounds, seed).groupBy(*key).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return scores.groupBy(*key).agg(F.avg(value).alias("mean")).join(ends, key)


def differences(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, example, value): paired differences of two conditions; a missing partner is an error.

    The two conditions must hold the same examples.
    """
    one, two = (scores.where(F.col("condition") == c).select("example", F.col("value").alias(n)) for c, n in ((a, "x"), (b, "y")))
    both = one.join(two, "example", "full")
    if not both.where("x IS NULL OR y IS NULL").isEmpty():
        raise ValueError(f"{a} and {b} do not hold the same examples")
    return both.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "example", (F.col("x") - F.col("y")).alias("value"))


def all_differences(scores: DataFrame) -> DataFrame:
    """(a, b, example, value) for all pairs of conditions a < b that hold the same examples; others are skipped."""
    x, y = scores.alias("x"), scores.alias("y")
    met = x.join(y, (F.col("x.example") == F.col("y.example")) & (F.col("x.condition") < F.col("y.condition")))
    pairs = met.select(F.col("x.condition").alias("a"), F.col("y.condition").alias("b"), F.col("x.example").alias("example"), (F.col("x.value") - F.col("y.value")).alias("value"))
    sizes = scores.groupBy("condition").agg(F.count("*").alias("n"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("m"))
    full = counts.join(sizes.select(F.col("condition").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("condition").alias("b"), F.col("n").alias("nb")), "b").where("m = na AND m = nb")
    return pairs.join(full.select("a", "b"), ["a", "b"])


def sign_flip(scores: DataFrame, key: list[str], value: str = "value", rounds: int = 10_000, seed: int = 42, observed: bool = True) -> DataFrame:
    """key, mean, p: the share of rounds with random signs whose mean is as far from 0, counting the observed one unless told not to."""
    means = _round_means(scores, key, value, rounds, seed + 1, flip=True).withColumnRenamed("mean", "m")
    seen = scores.groupBy(*key).agg(F.round(F.avg(value), 6).alias("mean"))
    extreme = F.count_if(F.abs("m") >= F.abs("mean"))
    return means.join(seen, key).groupBy(*key, "mean").agg(((extreme + int(observed)) / (F.count("*") + int(observed))).alias("p"))


def contrasts(scores: DataFrame, wanted: Sequence[tuple[str, str, str, float]], rounds: int = 10_000, seed: int = 42, observed: bool = True) -> DataFrame:
    """a, b, field, delta, low, high, p, significant of the wanted (a, b, field, scale) rows, one each, in no order.

    delta is a's mean less b's, with its paired bootstrap interval, times scale. Conditions
    that are missing or do not hold the same examples give nulls and are not significant.
    significant: the interval leaves out 0 and p is under 0.05.
    """
    spark = scores.sparkSession
    asked = spark.createDataFrame([(a, b, f, float(s)) for a, b, f, s in wanted], "a string, b string, field string, scale double")
    side = lambda c, v: scores.select(F.col("condition").alias(c), "field", "example", F.col("value").alias(v))
    keys = asked.select("a", "b", "field").distinct()
    both = F.broadcast(keys).join(side("a", "x"), ["a", "field"]).join(side("b", "y"), ["b", "field", "example"])
    sizes = scores.groupBy("condition", "field").agg(F.count("*").alias("n"))
    size = lambda c, n: sizes.select(F.col("condition").alias(c), "field", F.col("n").alias(n))
    full = both.groupBy("a", "b", "field").agg(F.count("*").alias("m")).join(size("a", "na"), ["a", "field"]).join(size("b", "nb"), ["b", "field"]).where("m = na AND m = nb")
    diffs = both.join(full.select("a", "b", "field"), ["a", "b", "field"]).select("a", "b", "field", "example", (F.col("x") - F.col("y")).alias("value"))
    key = ["a", "b", "field"]
    found = interval(diffs, key, rounds=rounds, seed=seed).join(sign_flip(diffs, key, rounds=rounds, seed=seed, observed=observed).select(*key, "p"), key)
    out = asked.join(found, key, "left")
    scaled = ((F.col(c) * F.col("scale")).alias(n) for c, n in (("mean", "delta"), ("low", "low"), ("high", "high")))
    apart = ((F.col("low") > 0) | (F.col("high") < 0)) & (F.col("p") < 0.05)
    return out.select(*key, *scaled, "p", F.coalesce(apart, F.lit(False)).alias("significant"))


def aggregate(rows: DataFrame, condition: str, example: str, fields: Sequence[str], rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """condition, and for each field its mean and the ends of its 95 % bootstrap interval, as <field>_mean, <field>_ci_low, <field>_ci_high."""
    each = interval(facts(rows, condition, example, {f: F.col(f) for f in fields}), ["condition", "field"], rounds=rounds, seed=seed)
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    return each.groupBy("condition").agg(*(pick(f, c).alias(f"{f}_{n}") for f in fields for c, n in (("mean", "mean"), ("low", "ci_low"), ("high", "ci_high"))))


def numpy_interval(scores: DataFrame, key: list[str], value: str = "value", rounds: int = 10_000, seed: int = 42) -> DataFrame:
    """key, mean, low, high with numpy's generator, examples in order; a group's vector must fit in one task."""
    fields = scores.select(*key).schema

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values("example")[value].to_numpy()
        rng = np.random.default_rng(seed)
        means = v[rng.integers(0, len(v), size=(rounds, len(v)))].mean(axis=1)
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in key}, "mean": [v.mean()], "low": [low], "high": [high]})

    shape = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "mean double, low double, high double"])
    return scores.groupBy(*key).applyInPandas(one, shape)
