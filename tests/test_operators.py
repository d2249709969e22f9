"""Hand-computed cases and small reference models of the engine's operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.functions import vectors as V
from fathomline.operators import dedup, ingest, metrics, report, search, stats, verify


def one(spark, expr, **values):
    """The value of an expression over literals."""
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("n", "starts"), [(0, []), (256, [0]), (257, [0, 224]), (480, [0, 224]), (481, [0, 224, 448])])
def test_chunk_windows(spark, n, starts):
    words = [f"w{i}" for i in range(n)]
    got = ingest.chunks(spark.createDataFrame([(1, " ".join(words))], "id int, text string")).orderBy("chunk_idx").collect()
    assert [r.chunk_text.split(" ")[0] for r in got] == [f"w{s}" for s in starts]
    assert [r.token_count for r in got] == [min(256, n - s) for s in starts]
    assert [r.chunk_idx for r in got] == list(range(len(starts)))


def test_chunk_bounds(spark):
    with pytest.raises(ValueError, match="overlap"):
        ingest.chunks(spark.createDataFrame([("a",)], "text string"), window=4, overlap=4)


def test_mapped_and_sections(spark, rows):
    df = spark.createDataFrame([(1, None, " body "), (2, "t", "")], "id int, head string, full string")
    got = ingest.mapped(df, {"id": "uid", "head": "title", "gone": "abstract", "full": "body"})
    assert rows(got) == [("1", "", "", " body "), ("2", "t", "", "")]
    assert rows(ingest.sections(got), "uid", "section_ord", "section") == [("1", 2, "body"), ("2", 0, "title")]


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a b c", 1), ("a b c d e", 1), ("a b c d e f", 2), ("a a a a a a", 1)])
def test_shingles(spark, text, n):
    assert len(one(spark, T.shingles(T.words(F.col("t")), 5), t=text)) == n


def test_sentences(spark):
    text = "One. Two!  three? Four 5. 6 ok.\nNo split. here. A"
    assert one(spark, T.sentences(F.col("t")), t=text) == ["One.", "Two!  three?", "Four 5.", "6 ok.", "No split. here.", "A"]
    assert one(spark, T.sentences(F.col("t")), t="  ") == []


@pytest.mark.parametrize(("raw", "found"), [('{"K": ["a", " ", " b "]}', ["a", "b"]), ('x {"K": "a, b"} y', ["a", "b"]), ('{"K": 3}', []), ("none", []), ("[1]", []), (None, [])])
def test_keywords(spark, raw, found):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(T.keywords(F.col("t"), "K").alias("k")).first().k == found


@pytest.mark.parametrize(
    ("raw", "n", "overall"),
    [
        ("broken {", (0, 0, 0, 0), "unsupported"),
        ('{"claims": null, "overall": "supported"}', (0, 0, 0, 0), "supported"),
        ('{"claims":[{"label":"supported"},{"label":"supported"},{"label":"partial"}],"overall":"unsupported"}', (3, 2, 1, 0), "partial"),
        ('{"claims":[{"label":"supported"}],"overall":"unsupported"}', (1, 1, 0, 0), "supported"),
        ('{"claims":[{"label":"what"}],"overall":"what"}', (1, 0, 0, 1), "unsupported"),
    ],
)
def test_verdict(spark, raw, n, overall):
    got = one(spark, verify.verdict(F.col("t")), t=raw)
    assert ((got.n_claims, got.n_supported, got.n_partial, got.n_unsupported), got.overall) == (n, overall)


def test_claims(spark):
    df = spark.createDataFrame([("A b. C d.", '["x", " "]'), ("A b. C d.", "[]"), ("", "[]"), (None, None)], "t string, e string")
    got = [r.c for r in df.select(verify.claims_of(F.col("t"), F.col("e")).alias("c")).collect()]
    assert [(c.claims, c.parse_failed) for c in got] == [(["x"], False), (["A b.", "C d."], True), ([], False), ([], False)]


def test_majority(spark, rows):
    votes = spark.createDataFrame([("three", True), ("three", True), ("three", False), ("two", True), ("two", False), ("one", True)], "k string, is_entail boolean")
    assert rows(verify.majority(votes, ["k"]), "k", "supported") == [("one", True), ("three", True), ("two", False)]


def test_unsupported_rate(spark, rows):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query int")
    claims = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "query int, claim int")
    judged = spark.createDataFrame([(1, 0, True), (1, 1, False)], "query int, claim int, supported boolean")
    assert rows(verify.unsupported_rate(queries, claims, judged)) == [(1, 2, 1, 0.5), (2, 1, 1, 1.0), (3, 0, 0, 1.0)]


def test_second_pass(spark):
    df = spark.createDataFrame([(0,), (2,), (None,)], "n_unsupported int")
    assert [x.count() for x in verify.second_pass(df)] == [1, 2]
    assert [x.count() for x in verify.second_pass(df, enabled=False)] == [0, 3]


@pytest.mark.parametrize(("a", "b", "perfect", "f1"), [([], [], True, 1.0), ([], [], False, 0.0), (["x"], [], True, 0.0), (["x", "x", "y"], ["x"], True, 2 / 3)])
def test_set_scores(spark, a, b, perfect, f1):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(metrics.set_scores(F.col("a"), F.col("b"), perfect).alias("s")).first().s.f1 == pytest.approx(f1)


def test_speed(spark):
    df = spark.createDataFrame([("a", 10, 0.0), ("b", 10, 2.0)], "k string, n int, s double")
    got = {r.k: r for r in metrics.speed_summary(df, "k", F.col("n"), F.col("s")).collect()}
    assert (got["a"].rate_mean, got["b"].rate_mean, got["b"].rate_std) == (0.0, 5.0, 0.0)


def test_triggers_without_hits(spark):
    df = spark.createDataFrame([("a", False, False, False)], "k string, triggered boolean, regenerated boolean, recovered boolean")
    assert metrics.trigger_summary(df, "k").first().recovery_rate is None


@pytest.mark.parametrize(("n", "order"), [(5, [0, 2, 4, 3, 1]), (4, [0, 2, 3, 1]), (1, [0])])
def test_best_outside(spark, n, order):
    df = spark.createDataFrame([(1, i) for i in range(n)], "query int, rank long")
    assert [r["rank"] for r in search.best_outside(df).orderBy("position").collect()] == order


def test_bm25_against_plain_python(spark):
    rng = random.Random(3)
    docs = {i: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for i in range(25)}
    query = ["a", "a", "c", "zz"]
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in "abcdefgh"}
    want = {}
    for i, d in docs.items():
        score = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query if t in df and t in d)
        if any(t in d for t in query):
            want[i] = score
    chunks = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "id int, text string")
    asked = spark.createDataFrame([(9, " ".join(query))], "q int, text string")
    got = {r.id: r.score for r in search.bm25(search.lexical_index(chunks, "id", "text"), asked, "q", "text").collect()}
    assert got == pytest.approx(want)


def test_fusion_bounds_and_ties(spark):
    dense = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8)], "query int, id int, score double")
    sparse = spark.createDataFrame([(1, 2, 3.0)], "query int, id int, score double")
    got = search.fused(dense, sparse, 5).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1]  # ranks (1,0) and (0,1) tie exactly; the larger id goes first
    assert got[0].rrf == got[1].rrf == 1 / 60 + 1 / 61


def test_redundancy_is_strict_and_may_return_less(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    pool = spark.createDataFrame([(1, i, i, x) for i, x in enumerate(v)], "query int, id int, rank long, v array<double>")
    assert [r.id for r in search.diverse(pool, "v", 0.85, 5).orderBy("rank").collect()] == [0, 2]
    assert [r.id for r in search.diverse(pool, "v", 1.0, 5).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.id for r in search.diverse(pool, "v", 0.85, 1).collect()] == [0]


def test_context(spark):
    q = spark.createDataFrame([(1,), (2,)], "q int")
    hits = spark.createDataFrame([(1, 1, " b ", 8), (1, 0, "a", 7)], "query int, position long, text string, id int")
    got = {r.query: r.context for r in search.context(hits, q, "q", "text", "id").collect()}
    assert got == {1: "[Doc 1 | id=7]\na\n\n[Doc 2 | id=8]\nb\n", 2: search.NO_HITS}
    assert search.context(hits, q, "q", "text", "id", retrieval=False).first().context == search.RETRIEVAL_OFF


def _greedy(sets, threshold):
    kept = []
    for i, s in enumerate(sets):
        if s and all(len(s & sets[j]) / len(s | sets[j]) < threshold for j in kept):
            kept.append(i)
    return kept


def test_greedy_dedup_matches_plain_python(spark):
    rng = random.Random(11)
    base = [rng.choices("abcdefghij", k=30) for _ in range(6)]
    texts = []
    for _ in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(30)] = rng.choice("xyz")
        texts.append(" ".join(words))
    texts += ["", texts[0]]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for threshold in (0.5, 0.7, 0.85):
        got = sorted(r.ord for r in dedup.accepted(df, "i", "t", threshold).where("kept").collect())
        assert got == _greedy(sets, threshold)


def test_greedy_keeps_both_ends_of_a_chain(spark, rows):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    assert rows(dedup.greedy_kept(ids, edges)) == [(1, True), (2, False), (3, True), (4, True)]


def test_jaccard_at_the_threshold_links(spark, rows):
    sigs = spark.createDataFrame([(1, list(range(20))), (2, list(range(17))), (3, list(range(16)))], "ord int, set array<long>")
    assert rows(dedup.similar_pairs(dedup.classes(sigs), 0.85), "a", "b") == [(1, 2), (2, 3)]


def test_subsequence(spark):
    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(5)
    for _ in range(50):
        a, b = (rng.choices("abc", k=rng.randint(0, 40)) for _ in range(2))
        assert metrics._common_length(a, b) == lcs(a, b)


def test_resampling(spark):
    same = spark.createDataFrame([("c", i, 0.0) for i in range(6)], "condition string, example int, value double")
    assert stats.sign_flip(same, ["condition"], rounds=50).first().p == 1.0
    row = stats.numpy_interval(spark.createDataFrame([("c", i, float(i)) for i in range(10)], "condition string, example int, value double"), ["condition"], rounds=500).first()
    assert row.low < row.mean == 4.5 < row.high


def test_unpaired_conditions(spark):
    scores = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 0.0), ("c", 1, 2.0)], "condition string, example int, value double")
    with pytest.raises(ValueError, match="same examples"):
        stats.differences(scores, "a", "b")
    assert {(r.a, r.b) for r in stats.all_differences(scores).collect()} == {("b", "c")}


def test_nan_scores_are_left_out(spark):
    df = spark.createDataFrame([("a", 1, float("nan")), ("a", 2, None), ("a", 3, 1.0)], "c string, e int, v double")
    assert stats.facts(df, "c", "e", {"v": F.col("v")}).count() == 1


def test_reports(spark, rows):
    s = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 3.0), ("c", 3.0, 2.0)], "k string, x double, y double")
    assert rows(report.frontier(s, "x", "y", "k"), "k") == [("a",), ("c",)]
    assert rows(report.skyline(s, "x", "y", "k"), "k") == [("c",)]
    flat = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "k string, x double")
    assert [r.x for r in report.min_max(flat, ["x"]).collect()] == pytest.approx([0.5, 0.5])
    flags = spark.createDataFrame([("a", None), ("b", True), ("b", False)], "k string, f boolean")
    assert rows(report.failure_rate(flags, "k", "f"), "k", "rate") == [("a", None), ("b", 0.5)]
    none = spark.createDataFrame([("a", 0, 0)], "k string, p int, q int")
    assert [r.share for r in report.distribution(none, "k", ["p", "q"]).collect()] == [None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "v array<array<double>>, m array<double>")
    assert df.select(V.pooled(F.col("v"), F.col("m")).alias("p")).first().p == [2.0, 3.0]
    assert one(spark, V.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


def test_draws_as_arrays_and_as_rows_agree(spark, monkeypatch):
    scores = spark.createDataFrame([(c, i, float((i * 37 + len(c)) % 11)) for c in ("a", "bb") for i in range(40)], "condition string, example int, value double")
    got = []
    for most in (1 << 22, 1):
        monkeypatch.setattr(stats, "MOST_VALUES", most)
        both = stats.interval(scores, ["condition"], rounds=600).join(stats.sign_flip(scores, ["condition"], rounds=600).select("condition", "p"), "condition")
        got.append(sorted(map(tuple, both.collect())))
    assert got[0] == [pytest.approx(r) for r in got[1]]


def test_portable_draws_give_numpys_interval(spark):
    scores = spark.createDataFrame([("c", i, float(i * i % 101)) for i in range(300)], "condition string, example int, value double")
    ours, theirs = (f(scores, ["condition"]).first() for f in (stats.interval, stats.numpy_interval))
    width = theirs.high - theirs.low
    assert abs(ours.low - theirs.low) < 0.05 * width and abs(ours.high - theirs.high) < 0.05 * width


def test_white_space_of_any_script_is_stripped(spark):
    text = " \tOne two. Three　four. \n"
    got = spark.createDataFrame([(text, "\n\n", " Foo  \n bar\t")], "t string, b string, n string").select(T.sentences(F.col("t")).alias("s"), T.sentences(F.col("b")).alias("none"), T.normal_term(F.col("n")).alias("n"), T.words(F.col("t")).alias("w")).first()
    assert got.s == ["One two.", "Three　four."] and got.none == [] and got.n == "foo bar" and got.w == text.split()


def test_rates_without_a_reference_are_null(spark, rows):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query int")
    claims = spark.createDataFrame([(1, 0), (2, 0)], "query int, claim int")
    judged = spark.createDataFrame([(1, 0, True), (2, 0, True)], "query int, claim int, supported boolean")
    known = spark.createDataFrame([(1,), (3,), (3,)], "query int")
    assert rows(verify.unsupported_rate(queries, claims, judged, referenced=known)) == [(1, 1, 0, 0.0), (2, 0, 0, None), (3, 0, 0, 1.0)]


def test_search_mode_is_checked(spark):
    df = spark.createDataFrame([(1, "a", [1.0])], "id int, text string, v array<double>")
    with pytest.raises(ValueError, match="mode"):
        search.search(df, df, df, chunk_id="id", chunk_text="text", vec="v", query_id="id", query_text="text", query_vec="v", mode="sparse")


def test_numbers_in_reports(spark):
    df = spark.createDataFrame([(0.12345, 0.1, 0.2), (None, None, None)], "m double, l double, h double")
    m, lo, hi = (F.col(c) for c in "mlh")
    shown = df.select(T.mean_interval(m, lo, hi), T.mean_interval(m, lo, hi, percent=True), T.plus_minus(m, lo), T.fixed(m, 1), T.sign(m)).collect()
    assert list(map(tuple, shown)) == [("0.1235 [0.1000, 0.2000]", "12.35 [10.00, 20.00]", "0.12 ± 0.10", "0.1", "+"), ("--", "--", "-- ± --", "--", "")]


def test_verdict_of_four_labels(spark):
    raw = '{"claims":[{"text":"a","label":"weak_entailment"},{"text":"b","label":"Citation_Noncompliance"},{"text":" c ","label":"?"}],"overall":"weak_entailment"}'
    got = spark.createDataFrame([(raw,)], "t string").select(verify.verdict(F.col("t"), verify.LABELS4).alias("v")).first().v
    assert (got.n_claims, got.n_supported, got.n_weak_entailment, got.n_citation_noncompliance, got.n_unsupported, got.overall, got.worst_claims) == (3, 0, 1, 1, 1, "weak_entailment", ["c"])


def test_trigger_summary_with_label_totals(spark):
    df = spark.createDataFrame([("a", True, True, False, 2, 3), ("a", False, False, None, 1, None)], "t string, triggered boolean, regenerated boolean, recovered boolean, pre_x long, post_x long")
    got = metrics.trigger_summary(df, "t", labels=("x",)).first()
    assert (got.n, got.n_triggered, got.n_recovered, got.pre_x, got.post_x) == (2, 1, 0, 3, 3)


def test_fusion_equals_full_rankings(spark):
    """More rows than the candidates of both rankings, many ties, and chunks that no query term touches."""
    rng = random.Random(12)
    n, pool = 400, 6
    dense = {q: {i: round(rng.uniform(-1, 1), 1 if q else 6) for i in range(n)} for q in (0, 1)}
    sparse = {q: {i: float(rng.randint(0, 9)) for i in rng.sample(range(n), 40 if q else n)} for q in (0, 1)}
    frame = lambda s: spark.createDataFrame([(q, i, v) for q in s for i, v in s[q].items()], "query int, id long, score double")
    got = {(r.query, r["rank"]): (r.id, r.rd, r.rs) for r in search.fused(frame(dense), frame(sparse), pool).collect()}
    assert len(got) == 2 * pool
    for q in (0, 1):
        place = lambda s: {i: at for at, i in enumerate(sorted(range(n), key=lambda i: (s.get(i, 0.0), i), reverse=True))}
        rd, rs = place(dense[q]), place(sparse[q])
        best = sorted(range(n), key=lambda i: (round(1 / (60 + rd[i]) + 1 / (60 + rs[i]), 9), i), reverse=True)[:pool]
        assert [got[q, r] for r in range(pool)] == [(i, rd[i], rs[i]) for i in best]
    assert search.fused(frame(dense).limit(0), frame(sparse).limit(0), pool).count() == 0
