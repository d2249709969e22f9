"""Mixing: targets by hand, sums near them, odd rows, both ways of joining rates."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomline.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string"


def filled(sizes, weights, share, most):
    """Targets by pouring: full sources are set aside one at a time."""
    open_, held = dict(sizes), 0
    total = share * sum(sizes.values())
    while open_:
        level = (total - held) / sum(weights[s] for s in open_)
        over = [s for s in open_ if level * weights[s] > most * sizes[s]]
        if not over:
            return {s: level * weights[s] if s in open_ else most * sizes[s] for s in sizes}
        s = min(over, key=lambda s: sizes[s] / weights[s])
        held += most * open_.pop(s)
    return {s: most * n for s, n in sizes.items()}


@pytest.mark.parametrize(("sizes", "share"), [({"a": 100, "b": 100, "c": 1000, None: 40}, 1.5), ({"a": 5, "b": 0, "c": 7}, 1.9), ({"a": 10}, 1.5), ({"a": 1, "b": 1, "c": 1}, 9.0)])
def test_targets(spark, sizes, share):
    weights = dict(zip(sizes, (5.0, 2.0, 1.0, 5.0), strict=False))
    rows = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.targets(rows, share, 2.0).collect()}
    want = filled(sizes, weights, share, 2.0)
    assert got == pytest.approx(want)
    assert all(got[s] <= 2 * n for s, n in sizes.items())


def test_sources_without_weight_take_nothing(spark):
    rows = spark.createDataFrame([("a", 10, 0.0), ("b", 10, 1.0)], "source string, source_size long, weight double")
    assert {r.source: r.target for r in mixing.targets(rows, 1.5, 2.0).collect()} == {"a": 0.0, "b": 20.0}


def test_mix_comes_near_its_targets_and_reruns_agree(spark, monkeypatch):
    docs = [(i, "w " * (1 + (i * 37) % 90), "hot" if i % 3 else f"s{i % 5}", "old") for i in range(900)]
    df = spark.createDataFrame(docs, SCHEMA)
    weighted = mixing.in_turn(df)
    assert {r.source: r.weight for r in weighted.collect()} == {"hot": 5, "s0": 2, "s1": 1, "s2": 5, "s3": 2, "s4": 1}
    counts = Counter(r.doc_id for r in mixing.mix(df, weighted).collect())
    assert max(counts.values()) <= 2
    size, target, taken = Counter(), {}, Counter()
    for i, t, s, _ in docs:
        size[s] += len(t.split())
        taken[s] += len(t.split()) * counts[i]
    target = filled(size, {r.source: float(r.weight) for r in weighted.collect()}, 1.5, 2.0)
    assert all(abs(taken[s] - target[s]) <= max(30, 0.01 * target[s]) for s in size)
    monkeypatch.setattr(mixing, "SENT_SOURCES", 0)  # rates joined by salted source
    again = Counter(r.doc_id for r in mixing.mix(df.repartition(7), weighted).collect())
    assert again == counts


def test_copies_are_numbered_and_columns_kept(spark):
    df = spark.createDataFrame([(1, "a b c", "x", "old")], SCHEMA)
    weighted = spark.createDataFrame([("x", 1)], "source string, weight int")
    rows = mixing.mix(df, weighted, share=2.0).orderBy("copy").collect()
    assert [r.asDict() for r in rows] == [{"doc_id": 1, "text": "a b c", "source": "x", "copy": i} for i in (0, 1)]


def test_odd_rows(spark):
    rows = [(None, None, None, ""), (None, "", "x", ""), (None, "a b", None, ""), (3, "a b", "x", ""), (3, "a b", "x", ""), (4, " \t\x0b ", "y", ""), (5, "w " * 200_000, "x", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(df, mixing.in_turn(df))
    counts = Counter((r.doc_id, r.text) for r in found.collect())
    assert counts[(3, "a b")] % 2 == 0
    assert max(counts.values()) <= 4
    assert mixing.mix(df.limit(0), mixing.in_turn(df.limit(0))).count() == 0
    sizes = df.select(mixing.n_words(F.col("text")).alias("n")).collect()
    assert sorted(r.n for r in sizes) == [0, 0, 0, 2, 2, 2, 200_000]
