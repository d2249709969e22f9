"""Overlap, set, matching, speed and length metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from fathomline.functions.stemming import stem
from fathomline.functions.text import harmonic, ratio, runs, terms, words
from fathomline.sources.store import settle


def set_scores(predicted: Column, gold: Column, empty_is_perfect: bool = True) -> Column:
    """struct(precision, recall, f1) of two sets; both empty gives 1 (or 0), one empty gives 0."""
    a, b = F.array_distinct(predicted), F.array_distinct(gold)
    hit = F.size(F.array_intersect(a, b))
    p, r = ratio(hit, F.size(a)), ratio(hit, F.size(b))
    blank = (F.size(a) == 0) & (F.size(b) == 0)
    one = F.lit(1.0 if empty_is_perfect else 0.0)
    pick = lambda x: F.when(blank, one).otherwise(x)
    return F.struct(pick(p).alias("precision"), pick(r).alias("recall"), pick(harmonic(p, r)).alias("f1"))


def set_differences(predicted: Column, gold: Column) -> Column:
    """struct(hits, false_positives, false_negatives) of two sets, each in the order of its side."""
    return F.struct(F.array_intersect(predicted, gold).alias("hits"), F.array_except(predicted, gold).alias("false_positives"), F.array_except(gold, predicted).alias("false_negatives"))


@F.pandas_udf(ST.StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stemmed(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """df with the text columns as arrays of stemmed terms; terms of up to three letters stay. key tells rows apart.

    Each distinct term is stemmed once and joined back. Short terms, which are the commonest,
    are in no join.
    """
    listed = F.inline(F.array(*(F.struct(F.lit(c).alias("side"), terms(F.col(c)).alias("terms")) for c in columns)))
    each = df.select(*key, listed).select(*key, "side", F.posexplode("terms").alias("pos", "term"))
    long = each.where(F.length("term") > 3)
    stems = settle(long.select("term").distinct().select("term", _stems("term").alias("stem")))
    both = each.where(F.length("term") <= 3).union(long.join(stems, "term").select(*key, "side", "pos", F.col("stem").alias("term")))
    made = both.groupBy(*key).agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == c, F.struct("pos", "term")))), lambda x: x["term"]).alias(c) for c in columns))
    none = F.array().cast("array<string>")
    return df.drop(*columns).join(made, key, "left").withColumns({c: F.coalesce(c, none) for c in columns})


def ngram_overlap(pairs: DataFrame, key: list[str], candidate: str, reference: str, n: int, stem_terms: bool = False) -> DataFrame:
    """key, precision, recall, f1 of clipped n-gram overlap, of stems if asked; 0 where a side has none."""
    if stem_terms:
        pairs = stemmed(pairs.select(*key, candidate, reference), key, [candidate, reference])
    listed = (lambda c: F.col(c)) if stem_terms else (lambda c: terms(F.col(c)))

    def grams(text: str) -> DataFrame:
        return pairs.select(*key, F.explode(runs(listed(text), n)).alias("gram")).groupBy(*key, "gram").count()

    both = grams(candidate).withColumnRenamed("count", "c").join(grams(reference).withColumnRenamed("count", "r"), [*key, "gram"], "full")
    zero = F.lit(0).cast("bigint")
    sums = both.groupBy(*key).agg(F.sum(F.least(F.coalesce("c", zero), F.coalesce("r", zero))).alias("hit"), F.sum(F.coalesce("c", zero)).alias("nc"), F.sum(F.coalesce("r", zero)).alias("nr"))
    p, r = ratio(F.col("hit"), F.col("nc")), ratio(F.col("hit"), F.col("nr"))
    out = pairs.select(*key).join(sums.select(*key, p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1")), key, "left")
    return out.select(*key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")))


def _common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def subsequence_f1(candidate: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of two arrays of terms, in Arrow batches."""

    @F.pandas_udf("double")
    def f1(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for cs, rs in pairs:
            out = []
            for c, r in zip(cs, rs, strict=True):
                hit = _common_length(list(c), list(r))
                out.append(2.0 * hit / (len(c) + len(r)) if hit else 0.0)
            yield pd.Series(out, dtype="float64")

    return f1(candidate, reference)


#: Rows of one text's token vectors that are multiplied at once with all of the other's.
MATCHED_AT_ONCE = 1024


def greedy_match(tokens: DataFrame, pairs: DataFrame, text: str, vec: str) -> DataFrame:
    """(candidate, reference, precision, recall, f1): each token vector takes its best partner in the other text.

    tokens: (text, vec) rows; pairs: (candidate, reference) texts. A text's vectors are one
    array, and a pair is a product of two matrices, in blocks, so no row is made for a pair
    of tokens. Pairs with a text that has no tokens are left out.
    """
    whole = tokens.where(F.col(vec).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.collect_list(F.col(vec).cast("array<double>")).alias("rows"))
    side = lambda c: whole.select(F.col("text").alias(c), F.col("rows").alias(f"{c}_rows"))

    def matrices(column: pa.Array) -> Iterator[np.ndarray]:
        for rows in column:
            yield np.array(rows.values.flatten().to_numpy(zero_copy_only=False)).reshape(len(rows.values), -1)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            precision, recall = [], []
            for a, b in zip(matrices(batch.column(2)), matrices(batch.column(3)), strict=True):
                best_a, best_b = [], np.full(len(b), -np.inf)
                for i in range(0, len(a), MATCHED_AT_ONCE):
                    similar = a[i : i + MATCHED_AT_ONCE] @ b.T
                    best_a.append(similar.max(axis=1))
                    np.maximum(best_b, similar.max(axis=0), out=best_b)
                precision.append(float(np.concatenate(best_a).mean()))
                recall.append(float(best_b.mean()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(precision, pa.float64()), pa.array(recall, pa.float64())], ["candidate", "reference", "precision", "recall"])

    met = pairs.select("candidate", "reference").join(side("candidate"), "candidate").join(side("reference"), "reference").select("candidate", "reference", "candidate_rows", "reference_rows")
    kinds = [pairs.schema[c] for c in ("candidate", "reference")]
    out = met.mapInArrow(match, ST.StructType([*kinds, ST.StructField("precision", ST.DoubleType()), ST.StructField("recall", ST.DoubleType())]))
    return out.withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def rate(tokens: Column, seconds: Column) -> Column:
    """tokens / seconds; 0 for no time."""
    return F.when(seconds > 0, tokens.cast("double") / seconds).otherwise(F.lit(0.0))


def speed_summary(samples: DataFrame, by: str, tokens: Column, seconds: Column) -> DataFrame:
    """Mean and population deviation of the samples' own rates, mean seconds and count."""
    r = rate(tokens, seconds)
    return samples.groupBy(by).agg(F.avg(r).alias("rate_mean"), F.stddev_pop(r).alias("rate_std"), F.avg(seconds).alias("seconds_mean"), F.count("*").alias("n"))


def length_profile(texts: DataFrame, by: str, text: str, limit: int = 150) -> DataFrame:
    """Words of the texts: mean, longest, percent over the limit and mean percent cut off by it."""
    n = F.size(words(F.col(text))).cast("double")
    cut = F.when(n > limit, (n - limit) / n * 100).otherwise(0.0)
    return texts.groupBy(by).agg(F.count("*").alias("n"), F.avg(n).alias("words_mean"), F.max(n).cast("bigint").alias("words_max"), F.avg(F.when(n > limit, 100.0).otherwise(0.0)).alias("pct_over"), F.avg(cut).alias("pct_cut"))


def trigger_summary(rows: DataFrame, by: str, subtotal: bool = False, labels: Sequence[str] = ()) -> DataFrame:
    """Triggered, regenerated and recovered counts by track, with rates; subtotal adds a row over all tracks (null).

    labels: for each the totals of pre_<label> and post_<label>, the label counts before and
    after a second answer; missing counts are none.
    """
    grouped = rows.rollup(by) if subtotal else rows.groupBy(by)
    n = F.count("*")
    hit, again, back = (F.count_if(c) for c in ("triggered", "regenerated", "recovered"))
    totals = (F.coalesce(F.sum(f"{when}_{c}"), F.lit(0)).cast("bigint").alias(f"{when}_{c}") for when in ("pre", "post") for c in labels)
    return grouped.agg(n.alias("n"), hit.alias("n_triggered"), (hit / n).alias("trigger_rate"), again.alias("n_regenerated"), back.alias("n_recovered"), F.try_divide(back, hit).alias("recovery_rate"), *totals)


def micro(rows: DataFrame, key: list[str], cls: str, predicted: str, gold: str) -> DataFrame:
    """Set scores over the union of class::term items of all classes of a key."""
    tagged = lambda c: F.transform(c, lambda x: F.concat(F.col(cls), F.lit("::"), x))
    both = rows.groupBy(*key).agg(F.flatten(F.collect_list(tagged(F.col(predicted)))).alias("p"), F.flatten(F.collect_list(tagged(F.col(gold)))).alias("g"))
    return both.select(*key, set_scores(F.col("p"), F.col("g")).alias("s")).select(*key, "s.*")


def previous(df: DataFrame, part: str, order: str, col: str) -> Column:
    return F.lag(col).over(Window.partitionBy(part).orderBy(order))
