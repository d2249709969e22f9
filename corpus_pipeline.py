"""The corpus pipeline: language, quality, near-duplicates, packing, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as
Parquet and read again as the next stage's docs. The first three return the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import settle
from fathomline.llm.language import Languages, identify
from fathomline.llm.neardup import Likeness, near_duplicates
from fathomline.llm.packing import pack
from fathomline.llm.quality import quality
from fathomline.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A row's number: where it lay when it was written together with its number.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with numbers in their order, written once: a later scan that is split otherwise reads the same numbers."""
    return settle(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), level=9)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the known ones.

    The lang column is the declared language and the source plays the host. A document goes
    if its text gives no evidence (null, empty, under eight trigrams) or no known language
    reaches half of the posterior. Ties and repeated rows are judged alike, null lang and
    source count as undeclared, other columns are dropped.
    """
    ship(spark)
    docs = _numbered(docs)
    missing = F.lit(None).cast("string")
    rows = docs.select(ROW, "text", F.lower("lang").alias("__declared"), missing.alias("__suffix"), F.col("source").alias("__host"), missing.alias("__parent"))
    found = identify(rows, "text", [ROW], how=Languages()).where("accepted").select(ROW)
    return docs.join(found, ROW, "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior of being good is a half or more; null texts go."""
    return quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the first row in the stage's input.

    Five-word shingles, Jaccard similarity of 0.8 or more, groups closed over links. Rows are
    told apart by where they lie, so null and repeated ids do no harm. Texts without words
    stand alone and stay.
    """
    ship(spark)
    docs = _numbered(docs)
    groups = near_duplicates(docs, id_col=ROW, like=Likeness(words=5, num=80, den=100))
    first = groups.where("id = component_id").select(F.col("id").alias(ROW))
    return docs.join(first, ROW, "left_semi").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens along the Hilbert curve."""
    ship(spark)
    pieces = pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language_stage),
    ("quality rules", quality_stage),
    ("near-dedup", dedup_stage),
    ("packing", packing_stage),
]

#: Language likelihoods, estimated rule accuracies and curve order can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
