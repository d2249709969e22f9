"""Claim support: votes, grounding rates, verdicts and the bounded second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import json_array, json_object, sentences, stripped

#: Labels of the two verdict schemes, mildest first.
LABELS3 = ("supported", "partial", "unsupported")
LABELS4 = ("supported", "weak_entailment", "citation_noncompliance", "unsupported")
#: Verifier modes and their labels.
MODES = {"standard": LABELS3, "split-partial": LABELS4}


def labels_of(mode: str) -> tuple[str, ...]:
    """The labels of a verifier mode; an unknown one is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown verifier mode {mode}")
    return MODES[mode]


def majority(votes: DataFrame, key: list[str], entails: str = "is_entail") -> DataFrame:
    """key, n_votes, supported: more than half (rounded down) of a pair's models say that it entails."""
    yes = F.sum(F.col(entails).cast("int"))
    return votes.groupBy(*key).agg(F.count("*").alias("n_votes"), (yes > F.floor(F.count("*") / 2)).alias("supported"))


def representative(pairs: DataFrame, key: list[str], score: str | None = None) -> DataFrame:
    """key, supported, chunk_pos, n_chunks: the first supporting chunk of a claim, else the one at the smallest position.

    score: a single model's degree of support, where there are no votes; then it is the chunk
    of the highest score, whether it supports the claim or not, and of equal ones the first.
    """
    first = F.coalesce(F.min(F.when(F.col("supported"), F.col("chunk_pos"))), F.min("chunk_pos"))
    best = first if score is None else F.min(F.struct((-F.col(score)).alias("s"), F.col("chunk_pos").alias("p")))["p"]
    return pairs.groupBy(*key).agg(F.bool_or("supported").alias("supported"), best.alias("chunk_pos"), F.count("*").alias("n_chunks"))


def unsupported_rate(queries: DataFrame, claims: DataFrame, judged: DataFrame, query: str = "query", referenced: DataFrame | None = None) -> DataFrame:
    """query, n_claims, n_unsupported, rate: a claim without any judged pair is unsupported; no claims gives rate 1 and none unsupported.

    referenced: the queries (query) that have a reference; others have no claims and a null
    rate, which aggregates leave out.

    claims: (query, claim); judged: (query, claim, supported), one row for each claim with chunks.
    """
    each = claims.join(judged.select(query, "claim", "supported"), [query, "claim"], "left")
    counts = each.groupBy(query).agg(F.count("*").alias("n_claims"), F.count_if(~F.coalesce("supported", F.lit(False))).alias("n_unsupported"))
    zero = F.lit(0).cast("bigint")
    out = queries.select(query).join(counts, query, "left").select(query, F.coalesce("n_claims", zero).alias("n_claims"), F.coalesce("n_unsupported", zero).alias("n_unsupported"), F.coalesce(F.col("n_unsupported") / F.col("n_claims"), F.lit(1.0)).alias("rate"))
    if referenced is None:
        return out
    known = referenced.select(query).distinct().withColumn("__known", F.lit(True))
    keep = lambda c, other: F.when(F.col("__known"), F.col(c)).otherwise(other).alias(c)
    return out.join(known, query, "left").select(query, keep("n_claims", zero), keep("n_unsupported", zero), keep("rate", F.lit(None).cast("double")))


def claims_of(text: Column, extracted: Column | None = None) -> Column:
    """struct(claims, parse_failed): a JSON array of strings from an extractor, else the text's sentences.

    An empty array counts as a failure. Empty text has no claims and has not failed.
    """
    blank = stripped(F.coalesce(text, F.lit(""))) == ""
    split = sentences(text)
    none = F.array().cast("array<string>")
    if extracted is None:
        return F.struct(F.when(blank, none).otherwise(split).alias("claims"), F.lit(False).alias("parse_failed"))
    parsed = F.filter(F.from_json(json_array(extracted), "array<string>"), lambda c: stripped(c) != "")
    good = F.coalesce(F.size(parsed) > 0, F.lit(False))
    return F.struct(F.when(blank, none).when(good, parsed).otherwise(split).alias("claims"), (~blank & ~good).alias("parse_failed"))


def verdict(raw: Column, labels: tuple[str, ...] = LABELS3) -> Column:
    """struct(n_claims, n_<label>..., overall, worst_claims) of a verifier's JSON answer.

    Labels are read in lower case; worst_claims are the texts of the claims with the worst one.
    Unknown labels and an unknown overall count as the worst. With three labels an overall of
    the worst that no claim bears is softened to the middle label if a claim bears one, else
    to the best; with four it stands. Malformed answers and null claims have no claims and the worst overall.
    """
    parsed = F.from_json(json_object(raw), "claims array<struct<text:string,label:string>>, overall string")
    worst, middle = labels[-1], labels[1:-1]
    known = lambda x: F.when(F.lower(x).isin(*labels), F.lower(x)).otherwise(F.lit(worst))
    texts = F.transform(F.filter(parsed["claims"], lambda c: known(c["label"]) == worst), lambda c: stripped(F.coalesce(c["text"], F.lit(""))))
    claims = F.coalesce(F.transform(parsed["claims"], lambda c: known(c["label"])), F.array().cast("array<string>"))
    count = lambda label: F.size(F.filter(claims, lambda x: x == label)).cast("bigint")
    some_middle = F.exists(claims, lambda x: x.isin(*middle))
    overall = known(parsed["overall"])
    softened = F.when(some_middle, F.lit(middle[0])).otherwise(F.lit(labels[0]))
    final = F.coalesce(overall, F.lit(worst)) if len(middle) > 1 else F.when((overall == worst) & (F.size(claims) > 0) & ~F.array_contains(claims, worst), softened).otherwise(F.coalesce(overall, F.lit(worst)))
    return F.struct(F.size(claims).cast("bigint").alias("n_claims"), *(count(label).alias(f"n_{label}") for label in labels), final.alias("overall"), F.coalesce(texts, F.array().cast("array<string>")).alias("worst_claims"))


def poisoned(context: Column, sentence: Column) -> Column:
    """A context with a planted first document."""
    return F.concat(F.lit("[Doc 0] "), sentence, F.lit("\n\n"), context)


def second_pass(rows: DataFrame, n_unsupported: str = "n_unsupported", enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows to answer again, rows that stand): again only if enabled and something is unsupported; a null count stands."""
    again = F.lit(enabled) & (F.coalesce(F.col(n_unsupported), F.lit(0)) > 0)
    return rows.where(again), rows.where(~again)


def retry_prompt(prompt: Column, unsupported: Column) -> Column:
    """The prompt with a list of claims to drop or support."""
    return F.concat(prompt, F.lit("\n\nLeave out or support with the context:\n"), F.array_join(F.transform(unsupported, lambda c: F.concat(F.lit("- "), c)), "\n"))
