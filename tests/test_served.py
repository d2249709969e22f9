"""The stored lexical index against exhaustive scoring."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import search, served


def texts(n, seed=2):
    """Zipf-like words, and topics that come in runs of neighbouring chunks."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    return [" ".join(rng.choices(common, weights=[1 / (i + 1) for i in range(30)], k=rng.randint(0, 30)) + [f"t{i // 40}"] * rng.randint(0, 3)) for i in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(texts(1200))), "id long, text string").coalesce(2)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "t3 c1 c20"), (2, "t7 t7 c0"), (3, "c0 c1"), (4, "nowhere"), (5, ""), (6, None), (7, "t29 t2")], "q int, text string")


@pytest.mark.parametrize("segments", [1, 3])
def test_search_equals_exhaustive_ranking_and_reads_less(spark, tmp_path, monkeypatch, corpus, queries, segments):
    monkeypatch.setattr(served, "BLOCK", 32)
    path = f"file://{tmp_path}/index"
    for i in range(segments):
        served.add(corpus.where(F.col("id") % segments == i), "id", "text", path)
    want = search.top(search.bm25(search.lexical_index(corpus, "id", "text"), queries, "q", "text"), 10)
    index = served.Served(spark, path)
    found, read = index.search(queries, "q", "text", 10, probed=3)
    rows = lambda df: sorted((r.query, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    assert rows(found) == rows(want)
    counted = {r.query: r.n for r in read.groupBy("query").agg(F.sum("n").alias("n")).collect()}
    whole = {r.query: r.n for r in index.bounds(*index.asked(queries, "q", "text")).groupBy("query").agg(F.sum("n").alias("n")).collect()}
    assert sum(counted[q] for q in (1, 2, 7)) < sum(whole[q] for q in (1, 2, 7)) / 3
    assert all(counted[q] <= whole[q] for q in whole)


def test_bounds_hold_after_lengths_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(served, "BLOCK", 4)
    path, rng = f"file://{tmp_path}/index", random.Random(5)
    parts = [[(i, " ".join(rng.choices("abcdef", k=rng.randint(1, 6)))) for i in range(40)], [(100 + i, " ".join(rng.choices("abcdefghij", k=60))) for i in range(40)]]
    for part in parts:
        served.add(spark.createDataFrame(part, "id long, text string"), "id", "text", path)
    asked = spark.createDataFrame([(1, "a b"), (2, "c j")], "q int, text string")
    index = served.Served(spark, path)
    terms, buckets = index.asked(asked, "q", "text")
    bounds = index.bounds(terms, buckets)
    everywhere = index._scored(bounds.select("query", "segment", "block"), terms, buckets)
    whole = search.bm25(search.lexical_index(spark.createDataFrame(sum(parts, []), "id long, text string"), "id", "text"), asked, "q", "text")
    assert {(r.query, r.id): round(r.score, 9) for r in everywhere.collect()} == {(r.query, r.id): round(r.score, 9) for r in whole.collect()}
    assert everywhere.agg(F.max("score")).first()[0] <= bounds.agg(F.max("bound")).first()[0]
    found, _ = index.search(asked, "q", "text", 5, probed=1)
    assert sorted((r.query, r["rank"], r.id) for r in found.collect()) == sorted((r.query, r["rank"], r.id) for r in search.top(whole, 5).collect())


def test_empty_chunks_and_missing_index(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(ValueError, match="no index"):
        served.Served(spark, path)
    served.add(spark.createDataFrame([(1, ""), (2, None)], "id long, text string"), "id", "text", path)
    asked = spark.createDataFrame([(1, "a")], "q int, text string")
    assert served.Served(spark, path).search(asked, "q", "text", 3)[0].count() == 0


def test_blocks_that_batches_cut_are_stored_whole(spark, tmp_path, monkeypatch, corpus):
    monkeypatch.setattr(served, "BLOCK", 32)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "45")
    try:
        served.add(corpus, "id", "text", f"file://{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    stored = spark.read.parquet(f"{tmp_path}/index/segment=0/postings")
    assert stored.groupBy("term", "block").count().where("count > 1").isEmpty()
    want = search.lexical_index(corpus, "id", "text")["postings"]
    got = stored.select("term", F.inline("hits")).select("term", "id", F.col("tf").cast("bigint").alias("tf"), F.col("len").cast("bigint").alias("len"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_no_row_for_a_query_and_posting_is_exchanged(spark, tmp_path, monkeypatch, corpus):
    """Many queries ask for the same terms: what is exchanged does not grow with queries times postings."""
    path = f"file://{tmp_path}/index"
    monkeypatch.setattr(served, "SENT_TERMS", 100)  # in several parts
    served.add(corpus, "id", "text", path)
    asked = spark.createDataFrame([(i, "c0 c1 c2 c3 c4") for i in range(60)], "q int, text string")
    index = served.Served(spark, path)
    best = index._scored(index.bounds(*index.asked(asked, "q", "text")).select("query", "segment", "block"), *index.asked(asked, "q", "text"), 3)
    whole = search.bm25(search.lexical_index(corpus, "id", "text"), asked, "q", "text")
    rows = lambda df: sorted((r.query, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    assert rows(search.top(best, 3)) == rows(search.top(whole, 3))
    assert best.count() < whole.count() / 4
