"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: naive Bayes over hashed byte trigrams, trained on the rows' own declared languages
  by one grouped count over all rows; the likelihood is tempered, as neighbouring trigrams
  are far from independent. A background class, uniform but for a share of all languages
  pooled, stands for all other languages and for junk.
* Declared language: how often rows of each (text-judged) language declare each tag.
* Address suffix: how often rows of each language stand under each suffix.
* Host: how languages are spread over the host's other rows, smoothed towards the host's
  parent, which is smoothed towards the whole corpus. A row's own weight is left out.

The last three come from grouped sums of the text posteriors; the model on the driver has
a fixed size (languages times trigram buckets). The background class takes part in them like
a language, so a declared tag, suffix or host of such rows becomes evidence for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import LOWER, SEPARATOR, byte_runs, settle, utf8
from fathomline.llm.urls import CAPITALS, SMALL, host_of

BUCKETS = 1 << 15
#: Trigram log-likelihoods are divided by this.
TEMPER = 4.0
#: Share of the pooled languages in the background; the rest is uniform.
POOLED = 0.25
#: What lang is where none of the known languages is likelier than the background.
OTHER = "other"


@dataclass(frozen=True)
class Languages:
    known: tuple[str, ...] = ("de", "en", "es", "fr")
    smoothing: float = 5.0  # weight of the parent in a host's prior
    least_trigrams: int = 8  # of letters; shorter texts have no text evidence
    accept: float = 0.5  # least posterior


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every trigram inside a text, first trigram of each text and the end)."""
    offsets, data = utf8(column)
    data = LOWER[data]
    data = np.where(SEPARATOR[data], np.uint8(32), data).astype(np.uint32)
    count = np.maximum(np.diff(offsets) - 2, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    if len(data) < 3:
        return np.zeros(0, np.int64), first
    gram = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    inside = np.ones(len(gram), bool)
    for back in (1, 2):  # trigrams that would reach over the end of a text
        edge = offsets[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(gram))]] = False
    at = np.searchsorted(np.flatnonzero(inside), offsets)
    return ((gram[inside] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), at


def trained(df: DataFrame, text_col: str, label_col: str, how: Languages) -> np.ndarray:
    """Log-probabilities (languages and background x BUCKETS) from all rows that carry a known label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(how.known) * BUCKETS, np.int64)
        for batch in batches:
            for i, j in byte_runs(batch.column(0)):
                gram, first = _trigrams(batch.column(0).slice(i, j - i))
                label = np.array([how.known.index(x) for x in batch.column(1).slice(i, j - i).to_pylist()], np.int64)
                total += np.bincount(gram + np.repeat(label, np.diff(first)) * BUCKETS, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = df.select(text_col, label_col).where(F.col(label_col).isin(*how.known) & F.col(text_col).isNotNull())
    sums = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most languages x BUCKETS rows
    table = np.full(len(how.known) * BUCKETS, 0.5)
    table[sums["at"].to_numpy()] += sums["n"].to_numpy()
    table = table.reshape(len(how.known), BUCKETS)
    table /= table.sum(axis=1, keepdims=True)
    return np.log(np.vstack([table, POOLED * table.mean(axis=0) + (1 - POOLED) / BUCKETS]))


def scored(df: DataFrame, text_col: str, model: np.ndarray, how: Languages) -> DataFrame:
    """df without the text, with __text: tempered log-likelihood of each language, less the largest (all 0 without evidence)."""
    others = [c for c in df.columns if c != text_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model - model.mean(axis=0)
        for batch in batches:
            texts, out = batch.column(batch.schema.get_field_index(text_col)), np.zeros((batch.num_rows, len(model)))
            for i, j in byte_runs(texts):
                gram, first = _trigrams(texts.slice(i, j - i))
                n = np.diff(first)
                for k in range(len(model)):
                    sums = np.concatenate([[0.0], np.cumsum(weights[k][gram])])
                    out[i:j, k] = sums[first[1:]] - sums[first[:-1]]
                out[i:j] *= np.where(n >= how.least_trigrams, 1 / TEMPER, 0.0)[:, None]
            out -= out.max(axis=1, keepdims=True) if len(out) else 0
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(list(out), pa.list_(pa.float64()))], [*others, "__text"])

    schema = T.StructType([*(df.schema[c] for c in others), T.StructField("__text", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(score, schema)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _normal(logs: Column) -> Column:
    """Probabilities in proportion to exp(logs)."""
    shares = lambda x: _let(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(x, lambda y: y / total))
    raised = lambda x: _let(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp(y - top)))
    return _let(logs, lambda x: _let(raised(x), shares))


def fused(df: DataFrame, key: Sequence[str], how: Languages) -> DataFrame:
    """key columns, lang, p, text_lang: the posterior from __text, __declared, __suffix, __host and __parent."""
    n = len(how.known) + 1
    each = range(n)
    # The tables below are grouped sums of the text posteriors; rows without text evidence are spread evenly.
    rows = settle(df.withColumn("__q", _normal(F.col("__text"))).withColumns({f"q{i}": F.get("__q", F.lit(i)) for i in each}).drop("__q"))
    sums = lambda by: rows.groupBy(by).agg(*(F.sum(f"q{i}").alias(f"{by}{i}") for i in each))
    whole = rows.agg(*(F.coalesce(F.sum(f"q{i}"), F.lit(0.0)).alias(f"q{i}") for i in each)).first()
    totals = [float(x) for x in whole]
    base = [(x + 1) / (sum(totals) + n) for x in totals]
    for by in ("__declared", "__suffix", "__host", "__parent"):
        rows = rows.join(sums(by), by, "left")
    own, of = (lambda i: F.col(f"q{i}")), (lambda by, i: F.greatest(F.coalesce(f"{by}{i}", f"q{i}") - F.col(f"q{i}"), F.lit(0.0)))
    size = lambda by: sum((of(by, i) for i in each), F.lit(0.0))
    s = F.lit(how.smoothing)

    def prior(i: int) -> Column:
        parent = (of("__parent", i) + s * F.lit(base[i])) / (size("__parent") + s)
        return F.when(F.col("__host").isNull(), F.lit(base[i])).otherwise((of("__host", i) + s * parent) / (size("__host") + s))

    def likelihood(by: str, i: int) -> Column:
        """P(value | language), smoothed towards P(value); no evidence where the value is missing or stands alone."""
        overall = size(by) / F.lit(max(sum(totals), 1.0))
        given = (of(by, i) + s * overall) / (F.greatest(F.lit(totals[i]) - own(i), F.lit(0.0)) + s)
        return F.when(F.col(by).isNull() | (size(by) <= 0), F.lit(0.0)).otherwise(F.log(F.greatest(given, F.lit(1e-12))))

    logs = F.array(*(F.get("__text", F.lit(i)) + F.log(prior(i)) + likelihood("__declared", i) + likelihood("__suffix", i) for i in each))
    names = F.array(*map(F.lit, (*how.known, OTHER)))
    best = lambda a: F.get(names, F.array_position(a, F.array_max(a)).cast("int") - 1)
    out = rows.withColumn("__p", _normal(logs))
    spoken = F.exists("__text", lambda x: x != 0)
    return out.select(*key, best(F.col("__p")).alias("lang"), F.array_max("__p").alias("p"), F.when(spoken, best(F.col("__text"))).alias("text_lang"))


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """page_id, text and the evidence columns of raw web pages."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    declared = F.translate(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1), CAPITALS, SMALL)
    host = F.regexp_replace(host_of(F.col("url")), r":\d*$|^.*@", "")
    filled = lambda c: F.when(c != "", c)
    return pages.select(
        "page_id",
        text.alias("text"),
        filled(declared).alias("__declared"),
        filled(F.regexp_extract(host, r"([^.]+)$", 1)).alias("__suffix"),
        filled(host).alias("__host"),
        filled(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("__parent"),
    )


def identify(df: DataFrame, text_col: str, key: Sequence[str], label_col: str = "__declared", how: Languages | None = None) -> DataFrame:
    """key columns, lang, p, text_lang and accepted of every row.

    df has text_col, the key columns and __declared, __suffix, __host, __parent (string, null
    where there is none). Languages are those known and OTHER; without any evidence lang is the
    commonest and p its share. accepted: the text has evidence of its own, lang is known and p
    is large enough, so null, empty and very short texts are not accepted, nor are junk and
    other languages. Ties go to the first known language. Repeated rows are told apart by nothing
    and get equal answers; of a host that repeats in bulk only a grouped sum is looked up. Texts
    are read whole; an empty table is fine.
    """
    how = how or Languages()
    model = trained(df, text_col, label_col, how)
    small = scored(df.select(*key, text_col, *(c for c in ("__declared", "__suffix", "__host", "__parent") if c not in key)), text_col, model, how)
    out = fused(small, key, how)
    return out.withColumn("accepted", F.col("text_lang").isNotNull() & (F.col("lang") != OTHER) & (F.col("p") >= how.accept))


def op4_query(spark, sf_dir: str) -> DataFrame:
    pages = evidence_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return identify(pages, "text", ["page_id"]).select("page_id", "lang", "text_lang", F.round("p", 6).alias("p"), "accepted")
