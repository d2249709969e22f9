"""Frames behind report tables and figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import PLACEHOLDER, fixed, mean_interval, sign, words


def pivoted(scores: DataFrame, row: str, cls: str, classes: Sequence[str], value: str) -> DataFrame:
    """One row for each `row` value with the mean of value in each class."""
    return scores.groupBy(row).pivot(cls, list(classes)).agg(F.avg(value))


def distribution(counts: DataFrame, by: str, labels: Sequence[str]) -> DataFrame:
    """(by, label, total, share) of label count columns; no labels at all gives null shares."""
    sums = counts.groupBy(by).agg(*(F.sum(c).cast("bigint").alias(c) for c in labels))
    whole = sum((F.col(c) for c in labels[1:]), F.col(labels[0]))
    each = F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("total")) for c in labels))
    rows = sums.select(by, whole.alias("__all"), F.inline(each))
    return rows.select(by, "label", "total", F.try_divide("total", F.col("__all")).alias("share"))


def failure_rate(rows: DataFrame, by: str, flag: str) -> DataFrame:
    """(by, n, rate): share of flagged rows; null where the flag is missing everywhere."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.try_divide(F.count_if(flag), F.count(flag)).alias("rate"))


def deltas(one: DataFrame, other: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """key, and for each value both sides and second minus first; keys of one side only keep nulls."""
    a = one.select(key, *(F.col(v).alias(f"{v}_a") for v in values))
    b = other.select(key, *(F.col(v).alias(f"{v}_b") for v in values))
    return a.join(b, key, "full").select(key, *(c for v in values for c in (F.col(f"{v}_a"), F.col(f"{v}_b"), (F.col(f"{v}_b") - F.col(f"{v}_a")).alias(f"{v}_delta"))))


def quantiles(rows: DataFrame, by: str, value: str, at: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Interpolated quantiles by group, as q25, q50, ..."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), *(F.percentile(value, F.lit(q)).alias(f"q{round(q * 100)}") for q in at))


def scaled(value: Column, low: Column, high: Column, pad: float = 0.01) -> Column:
    """Position between low - pad and high + pad; a constant column is at 0.5."""
    return (value - (low - pad)) / ((high + pad) - (low - pad))


def min_max(summary: DataFrame, values: Sequence[str]) -> DataFrame:
    """A summary's values scaled over its rows; a summary has a row for each condition."""
    ends = summary.agg(*(F.min(v).alias(f"{v}__l") for v in values), *(F.max(v).alias(f"{v}__h") for v in values))
    rest = [c for c in summary.columns if c not in values]
    return summary.crossJoin(F.broadcast(ends)).select(*rest, *(scaled(F.col(v), F.col(f"{v}__l"), F.col(f"{v}__h")).alias(v) for v in values))


def frontier(summary: DataFrame, order: str, value: str, tie: str) -> DataFrame:
    """Rows whose value is a strict new minimum when read by ascending order; a summary has a row for each condition."""
    before = Window.orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(value).over(before)
    return summary.withColumn("__least", least).where(F.col("__least").isNull() | (F.col(value) < F.col("__least"))).drop("__least")


def skyline(summary: DataFrame, more: str, less: str, tie: str) -> DataFrame:
    """Rows that no other row beats on both columns: more of the first, less of the second."""
    after = Window.orderBy(F.desc(more), less, tie).rowsBetween(Window.unboundedPreceding, -1)
    return summary.withColumn("__least", F.min(less).over(after)).where(F.col("__least").isNull() | (F.col(less) < F.col("__least"))).drop("__least")


def marked(summary: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """summary with mark: "*" where the interval leaves out 0, else nothing."""
    return summary.withColumn("mark", F.when((F.col(low) > 0) | (F.col(high) < 0), "*").otherwise(""))


def scatter(rows: DataFrame, condition: str, text: str, score: str, limit: int = 150) -> DataFrame:
    """rows with words, over (more words than the limit), and the means of words and score of their condition."""
    points = rows.withColumn("words", F.size(words(F.col(text))).cast("bigint")).withColumn("over", F.col("words") > limit)
    means = points.groupBy(condition).agg(F.avg("words").alias("words_mean"), F.avg(score).alias("score_mean"))
    return points.join(means, condition)


def checks(results: Sequence[DataFrame]) -> DataFrame:
    """name, status, n_bad: one row for each data-quality assertion frame of (name, n_bad, fatal)."""
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    status = F.when(F.col("n_bad") == 0, "PASS").when(F.col("fatal"), "FAIL").otherwise("WARN")
    return out.select("name", status.alias("status"), "n_bad")


def assertion(df: DataFrame, name: str, bad: Column, fatal: bool = True) -> DataFrame:
    """(name, n_bad, fatal): how many rows break a rule."""
    return df.agg(F.count_if(bad).alias("n_bad")).select(F.lit(name).alias("name"), "n_bad", F.lit(fatal).alias("fatal"))


#: What stands in a report for a figure that a condition can't have.
UNDEFINED = "---"


def qa_rows(registry: DataFrame, summary: DataFrame, fields: Sequence[str], grounded: Sequence[str] = (), percent: Sequence[str] = ()) -> DataFrame:
    """condition and a cell "mean [low, high]" for each field, in a row for each condition of the registry.

    registry: (condition, has_context); summary: condition with <field>_mean, _low and _high.
    Fields in grounded are undefined for conditions without context; what was not run has
    placeholders.
    """

    def cell(field: str) -> Column:
        shown = mean_interval(F.col(f"{field}_mean"), F.col(f"{field}_low"), F.col(f"{field}_high"), percent=field in percent)
        blank = ~F.col("has_context") & F.col("__ran").isNotNull() & F.lit(field in grounded)
        return F.when(blank, UNDEFINED).otherwise(shown).alias(field)

    return registry.join(summary.withColumn("__ran", F.lit(True)), "condition", "left").select("condition", *(cell(f) for f in fields))


def contrast_rows(native: DataFrame, constrained: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """key, kind (native, constrained, delta) and a cell with three places for each value; a side that lacks a key has placeholders.

    The delta is constrained minus native, with its sign; a missing side counts as 0 in it,
    unless both are missing.
    """
    both = deltas(native, constrained, key, values)
    side = lambda kind, s: F.struct(F.lit(kind).alias("kind"), *(fixed(F.col(f"{v}_{s}"), 3).alias(v) for v in values))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    change = lambda v: zero(F.col(f"{v}_b")) - zero(F.col(f"{v}_a"))
    delta = F.struct(F.lit("delta").alias("kind"), *(F.when(F.coalesce(f"{v}_a", f"{v}_b").isNotNull(), F.concat(sign(change(v)), fixed(change(v), 3))).otherwise(PLACEHOLDER).alias(v) for v in values))
    return both.select(key, F.inline(F.array(side("native", "a"), side("constrained", "b"), delta)))
