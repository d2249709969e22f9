"""Near-duplicates, neighbours and language-model scores against brute force, and their odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fathomline.llm import neardup, neighbours
from fathomline.llm.common import shingle_sets, span_hashes, utf8, word_spans
from fathomline.llm.components import components
from fathomline.llm.lmscore import backoff_scores
from fathomline.llm.neardup import Likeness, near_duplicates
from fathomline.llm.neighbours import Hashing, nearest, probe_sets

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))


def sets_of(texts, k):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def groups(ids, sets, num, den):
    """Smallest id that each reaches over all linked pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * len(sets[a] | sets[b]):
                    x, y = sorted((find(ids[a]), find(ids[b])))
                    root[y] = x
    return {i: find(i) for i in ids}


def copies(rng, count, size, edits, base=8):
    """Texts that are edited copies of a few others, of very different lengths."""
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(1, size))] for _ in range(base)]
    for _ in range(count):
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_groups_match_all_pairs(spark, k, num, den):
    rng = random.Random(k)
    texts = copies(rng, 250, 120, 4) + copies(rng, 60, 12, 1) + ["", "  \n", "one", "ONE", "one two", None]
    rng.shuffle(texts)
    ids = list(range(100, 100 + len(texts)))
    want = groups(ids, sets_of(texts, k), num, den)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.id: r.component_id for r in near_duplicates(df, like=Likeness(k, num, den)).collect()}
    assert got == want


def test_crowded_buckets_match_all_pairs(spark, monkeypatch):
    """A dense crowd of copies of copies and a passage that many short texts share."""
    monkeypatch.setattr(neardup, "FEW", 2)
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    crowd = [[rng.choice(vocabulary) for _ in range(100)]]
    for _ in range(150):
        t = list(rng.choice(crowd[-40:]))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(100)] = rng.choice(vocabulary)
        crowd.append(t)
    passage = [rng.choice(vocabulary) for _ in range(12)]
    shared = [passage + [rng.choice(vocabulary) for _ in range(rng.randint(4, 40))] for _ in range(150)]
    texts = [" ".join(t) for t in crowd + shared]
    ids = list(range(len(texts)))
    want = groups(ids, sets_of(texts, 3), 85, 100)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.id: r.component_id for r in near_duplicates(df, like=Likeness(3, 85, 100)).collect()}
    assert got == want


def test_single_meetings_in_a_crowded_bucket_are_compared(spark):
    """A text and many copies with a last word of their own: each copy meets it once and none links to another."""
    rows, want = [], {}
    for case in range(6):
        base, at = " ".join(f"c{case}w{i}" for i in range(10)), 1000 * case
        rows += [(at + 500, base)] + [(at + i, f"{base} own{i}") for i in range(40)]
        want |= {i: at for i in (at + 500, *range(at, at + 40))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in near_duplicates(df, like=Likeness(3, 85, 100)).collect()}
    assert got == want


def test_all_rows_against_all_rows_are_as_likely_as_in_pairs():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(rng.permutation(pool[:size])[: max(1, int(size * share))]) for size in (3, 12, 60, 400) for share in (0.7, 0.9, 1)]
    sig, n = np.stack([neardup.registers(s) for s in sets]), np.array([len(s) for s in sets])
    like, least = Likeness(3, 85, 100), 0.85
    got = neardup.alike(sig, sig, n, n, like)
    for i in range(len(sets)):
        close, used = neardup.estimate(np.repeat(sig[i : i + 1], len(sets), axis=0), sig, np.repeat(n[i], len(sets)), n)
        sized = np.minimum(n[i], n) * 100 >= np.maximum(n[i], n) * 85
        assert (got[i] == (sized & (close >= least - 5 * np.sqrt(least * (1 - least) / np.maximum(used, 1))))).all()


def test_neardup_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, long, "a"), (2, long + " y", "b"), (None, long, "c"), (None, "alone here", "d"), (3, None, "e"), (3, None, "e"), (4, "same text", "f"), (4, "same text", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in near_duplicates(df, like=Likeness(3, 85, 100)).collect()), key=repr)
    assert got == sorted([(1, 29_998, 1), (2, 29_999, 1), (None, 29_998, 1), (None, 1, None), (3, 0, 3), (3, 0, 3), (4, 1, 4), (4, 1, 4)], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0


def test_levels_leave_a_band_untouched():
    """At a bounded level a linked pair has fewer differing elements than bands."""
    for like in (Likeness(3, 85, 100), Likeness(5, 80, 100)):
        found = neardup.levels(like)
        assert found[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(found, found[1:], strict=False))
        for _, high, bands in found[:-1]:
            union = high * like.den // like.num
            assert (like.den - like.num) * union // like.den < bands


@pytest.mark.parametrize("like", [Likeness(5, 80, 100), Likeness(3, 85, 100), Likeness(3, 50, 100)])
def test_linked_sets_of_any_size_share_a_key(like):
    rng = np.random.default_rng(8)
    large = neardup.levels(like)[-1][2]
    assert (1 - (like.num / like.den) ** (256 / large)) ** large < 0.0005
    missed = tried = 0
    for size in [*range(1, 24)] * 40 + [200, 2000] * 40:
        more = size * like.den // like.num - size
        hashes = rng.integers(0, 1 << 64, size + more, dtype=np.uint64)
        sets = [np.unique(hashes[:size]), np.unique(hashes)]
        keys = neardup.band_keys(np.stack([neardup.registers(s) for s in sets]), np.array([len(s) for s in sets]), like)
        tried, missed = tried + 1, missed + (not len(np.intersect1d(*keys)))
    assert missed <= 3  # of 1000


def test_estimates_are_close():
    import pyarrow as pa

    rng = random.Random(2)
    errors = []
    for _ in range(40):
        common, own = rng.randint(50, 900), rng.randint(1, 200)
        a = [f"c{i}" for i in range(common)] + [f"a{i}" for i in range(own)]
        b = [f"c{i}" for i in range(common)] + [f"b{i}" for i in range(own)]
        s, t = shingle_sets(pa.array([" ".join(a), " ".join(b)]), 1)
        true = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
        close, used = neardup.estimate(neardup.registers(s)[None], neardup.registers(t)[None], np.array([len(s)]), np.array([len(t)]))
        errors.append(abs(close[0] - true) / math.sqrt(true * (1 - true) / used[0]))
    assert max(errors) < 5


def test_word_hashing_matches_a_regular_expression():
    import pyarrow as pa

    texts = ["", None, " a\tb\x0bc\x0cd\re\n", "é ü\u00a0x", "A a", "a"]
    offsets, data = utf8(pa.array(texts).slice(0))
    starts, ends, first = word_spans(offsets, data)
    found = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
    assert found == [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    hashes = span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len({w for f in found for w in f})


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}}


def brute_nearest(rows, asks, k):
    out = {}
    for q, v in asks:
        found = sorted({(math.dist(v, w), i) for i, w in rows if i != q})[:k]
        out[q] = found
    return out


def test_neighbours_with_wide_cells_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = [r for r in rows if r[0] % 50 == 0]
    got = {}
    for r in nearest(df, df.where("vec_id % 50 = 0"), how=Hashing(width=1e6, functions=2, vectors=64, visitors=4)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute_nearest(rows, asks, 10)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_neighbours_recall_with_production_parameters(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_nearest([(i, np.float32(x).astype(float).tolist()) for i, x in rows], [(i, np.float32(x).astype(float).tolist()) for i, x in rows if i % 100 == 0], 10)
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in nearest(df, df.where("vec_id % 100 = 0")).collect())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_neighbours_of_clusters_have_few_candidates(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 64))[rng.integers(0, 60, 6000)] + 0.1 * rng.normal(size=(6000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    own = df.selectExpr("vec_id AS id", "embedding AS vec")
    unit = neighbours.spread(own, 64)
    how = neighbours.fitted(own, own.where("id % 100 = 0"), 64, unit, 10)
    at = neighbours.placed(v, how, unit)
    met = np.zeros((60, 6000), bool)
    for t in range(how.tables):
        homes, visits = neighbours.probed(at, how, t, 1)[:, 0], neighbours.probed(at[::100], how, t, how.probes)
        met |= (homes[None, None] == visits[:, :, None]).any(axis=1)
    assert met.mean() < 0.05
    away = np.linalg.norm(v[::100, None] - v[None], axis=2)
    away[np.arange(60), np.arange(0, 6000, 100)] = np.inf
    want = {100 * q: set(np.argsort(x)[:10].tolist()) for q, x in enumerate(away)}
    hits = sum(r.vec_id in want[r.query_id] for r in nearest(df, df.where("vec_id % 100 = 0")).collect())
    assert hits >= 0.9 * 600


def test_exact_search_of_the_fitting_queries(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 3))
    own = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").repartition(3)
    near = neighbours.exact(own, [0, 7], v[[0, 7]], 5)
    for q, got in zip((0, 7), near, strict=True):
        order = [j for j in np.argsort(np.linalg.norm(v - v[q], axis=1)) if j != q][:5]
        assert np.allclose(got, v[order])
    assert np.isnan(neighbours.exact(own.limit(2), [0], v[[0]], 5)[0, 1:]).all()


@pytest.mark.parametrize("norm", [0.01, 10.0])
def test_neighbours_at_any_scale(spark, norm):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 64))
    v *= norm / np.linalg.norm(v, axis=1)[:, None]
    v[700] *= 300  # an outlier that no probe finds neighbours of
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(got[q]) == 10 for q in want)
    assert got[700] == {i for _, i in want[700]}
    assert sum(len(got[q] & {i for _, i in found}) for q, found in want.items()) / sum(map(len, want.values())) >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest(df, df, how=Hashing(width=100.0)).collect())
    assert got == [(0, 1, 1), (1, 1, 0)]
    assert nearest(df.limit(0), df).count() == 0
    assert nearest(df, df.limit(0)).count() == 0


def test_probes_come_in_order_of_cost():
    inside = np.array([0.1, 0.7, 0.45])
    sets = probe_sets(inside, 27)
    cost = [sum((inside[f] if s < 0 else 1 - inside[f]) ** 2 for f, s in chosen) for chosen in sets]
    assert sets[0] == [] and cost == sorted(cost)
    assert len({tuple(sorted(s)) for s in sets}) == len(sets) == 27


def brute_scores(texts, order, alpha):
    all_words = [words(t) for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total, size = sum(map(grams, all_words), Counter()), sum(map(len, all_words))
    out = []
    for w in all_words:
        own, score = grams(w), 0.0
        left = max(size - len(w), 1)
        for i in range(len(w)):
            weight, value = 1.0, None
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if total[g] - own[g] > 0:
                    value = weight * (total[g] - own[g]) / (total[g[:-1]] - own[g[:-1]] if k > 1 else left)
                    break
                weight *= alpha
            score += math.log(value if value is not None else weight / left)
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_matches_plain_python(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "unseen Words", "a b c", "a b c", "z " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_words, r.log_score) for r in backoff_scores(df, order=order, block_bytes=200, partition_bytes=300).collect()}
    for i, (n, score) in enumerate(brute_scores(texts, order, 0.4)):
        assert got[i][0] == n and got[i][1] == pytest.approx(score, abs=1e-6)


def test_backoff_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (5, "a b", 2)], "doc_id long, text string, n_words int")
    assert sorted(r.n_words for r in backoff_scores(df).collect()) == [2, 2, 2]
    assert backoff_scores(df.limit(0)).count() == 0
