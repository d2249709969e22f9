"""Fusion in scans of the chunks against rankings of whole score lists."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.functions import vectors as V
from fathomline.operators import fusion, search
from fathomline.plans import retrieval

NAMES = {"id_col": "id", "text_col": "text", "vec_col": "v", "query_id": "q", "query_text": "text", "query_vec": "v"}


def brute(chunks, queries, pool, offset=60):
    words = {i: (t or "").lower().split() for i, t, _ in chunks}
    n, avg = len(chunks), sum(map(len, words.values())) / max(len(chunks), 1)
    df = Counter(t for w in words.values() for t in set(w))
    out = {}
    for q, text, v in queries:
        rows = []
        for i, _, x in chunks:
            w = words[i]
            sparse = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in (text or "").lower().split() if t in w)
            rows.append((i, sum(a * b for a, b in zip(x, v, strict=True)), sparse))
        rank = lambda c: {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (round(r[c], 6), r[0]), reverse=True))}  # noqa: E731,B023
        rd, rs = rank(1), rank(2)
        fused = sorted(((round(1 / (offset + rd[i]) + 1 / (offset + rs[i]), 9), i) for i, _, _ in rows), reverse=True)[:pool]
        out |= {(q, k): (i, rd[i], rs[i]) for k, (_, i) in enumerate(fused)}
    return out


def made(seed, n_chunks=120, n_queries=9):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]  # noqa: E731  many ties
    chunks = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 8))), vector()) for i in rng.sample(range(1000), n_chunks)]
    queries = [(f"q{i}", " ".join(rng.choices("abcz", k=rng.randint(0, 4))), vector()) for i in range(n_queries)]
    return [*chunks, (2000, None, [0.0] * 4)], queries


@pytest.mark.parametrize(("pool", "block"), [(5, 4096), (200, 4096), (5, 2)])
def test_hybrid(spark, monkeypatch, pool, block):
    monkeypatch.setattr(fusion, "QUERY_BLOCK", block)
    monkeypatch.setattr(fusion, "SCORES_AT_ONCE", 100)
    chunks, queries = made(pool)
    rows = spark.createDataFrame(chunks, "id long, text string, v array<double>").repartition(5)
    got = fusion.hybrid(rows, spark.createDataFrame(queries, "q string, text string, v array<double>"), pool=pool, offset=3, **NAMES).collect()
    assert {(r.query, r["rank"]): (r.id, r.rd, r.rs) for r in got} == brute(chunks, queries, pool, 3)


def test_string_ids_and_empty_sides(spark):
    chunks, queries = made(3, 30, 3)
    named = [(f"c{i:05d}", t, v) for i, t, v in chunks]
    rows = spark.createDataFrame(named, "id string, text string, v array<double>")
    asked = spark.createDataFrame(queries, "q string, text string, v array<double>")
    got = fusion.hybrid(rows, asked, pool=4, **NAMES).collect()
    assert {(r.query, r["rank"]): (r.id, r.rd, r.rs) for r in got} == brute(named, queries, 4)
    assert fusion.hybrid(rows.limit(0), asked, pool=4, **NAMES).count() == 0
    assert fusion.hybrid(rows, asked.limit(0), pool=4, **NAMES).count() == 0


def test_no_row_for_each_query_and_chunk_is_exchanged(spark):
    chunks, queries = made(8)
    rows = spark.createDataFrame(chunks, "id long, text string, v array<double>")
    found = fusion.hybrid(rows, spark.createDataFrame(queries, "q string, text string, v array<double>"), pool=5, **NAMES)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    assert not any(line.strip(" +-:").startswith("Join") and "text" in line for line in plan.splitlines())


@pytest.mark.parametrize(("block", "pairs"), [(4096, 1 << 20), (2, 1), (4096, 7)])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_lexical_equals_ranking_of_all_scores(spark, rows, monkeypatch, block, pairs, kind):
    monkeypatch.setattr(fusion, "QUERY_BLOCK", block)
    monkeypatch.setattr(fusion, "PAIRS_AT_ONCE", pairs)
    chunks, queries = made(11)
    docs = spark.createDataFrame([(i, t) for i, t, _ in chunks] + [(3000 + i, "a b c") for i in range(40)] + [(4000, "")], "id long, text string").withColumn("id", F.lpad(F.col("id").cast("string"), 5, "0").cast(kind))
    asked = spark.createDataFrame([(q, t) for q, t, _ in queries] + [("none", None), ("odd", "zzz"), (None, "a")], "q string, text string")
    want = search.top(search.bm25(search.lexical_index(docs, "id", "text"), asked.where("q IS NOT NULL"), "q", "text"), 7)
    got = fusion.lexical(docs.repartition(5), asked, id_col="id", text_col="text", query_id="q", query_text="text", k=7)
    digits = lambda df: df.withColumn("score", F.round("score", 9))
    assert rows(digits(got), "query", "id", "rank", "score") == rows(digits(want), "query", "id", "rank", "score")


def test_lexical_counts_chunks_without_id_in_statistics_alone(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b"), (None, "a")], "id long, text string")
    asked = spark.createDataFrame([("q", "a")], "q string, text string")
    found = fusion.lexical(docs, asked, id_col="id", text_col="text", query_id="q", query_text="text", k=5).collect()
    assert [r.id for r in found] == [1]
    assert math.isclose(found[0].score, math.log((3 - 2 + 0.5) / 2.5 + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (4 / 3))))


def _stages(spark):
    """Bytes that each stage so far has shuffled."""
    jvm = spark.sparkContext._jvm
    listed = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(listed.apply(i).stageId(), listed.apply(i).attemptId()): listed.apply(i).shuffleWriteBytes() for i in range(listed.size())}


@pytest.mark.parametrize("query", ["context_block", "litm_order", "bm25_search"])
def test_lexical_queries_shuffle_no_postings(spark, query):
    before = _stages(spark)
    retrieval.QUERIES[query](spark, "/root/testdata/sf0.01").collect()
    moved = sum(n for k, n in _stages(spark).items() if k not in before)
    assert moved < 2_000_000  # with all postings exchanged these queries shuffled some 10 MB here


def test_pairs_held_at_once_are_bounded(monkeypatch):
    """Chunks that hold many terms of many queries: the products behind the scores are cut, whatever the batch."""
    monkeypatch.setattr(fusion, "PAIRS_AT_ONCE", 1000)
    terms, queries = [f"t{i}" for i in range(20)], [f"q{i}" for i in range(30)]
    asked = fusion.asked_of(pa.table({"query": queries, "terms": [terms] * 30, "v": [[1.0]] * 30}))._replace(average=20.0)
    rows = pa.record_batch([pa.array(range(50)), pa.array([20] * 50), pa.array([list(range(20))] * 50, pa.list_(pa.int32())), pa.array([[1] * 20] * 50, pa.list_(pa.int32())), pa.array([[1.0]] * 50)], ["num", "len", "at", "tf", "v"])
    parts = list(fusion._parts(iter([rows]), asked, 1.5, 0.75))
    assert max(len(num) for num, _, _ in parts) == 1  # 600 pairs a chunk
    assert [n for num, _, _ in parts for n in num] == list(range(50))


def test_stand_in_vectors_of_batches_equal_the_column(spark):
    docs = spark.createDataFrame([(1, "a b A, ü x_1"), (2, ""), (3, None), (4, "a " * 50 + "b")], "id long, text string")
    both = V.with_stand_in(docs, "text", "v").select("v", V.stand_in_vector(F.col("text")).alias("w")).collect()
    assert all(r.v == r.w for r in both) and len(both) == 4
