"""Spelling variants against pairwise comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import spelling
from fathomline.llm.spelling import WHOLE, deletion_keys, letter_runs, op11_query, roots, variants, word_counts


def runs(text, i, slip=97, shortest=5):
    for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
        run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
        h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
        if slip and h % slip == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= shortest:
            yield run


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(n, times=2):
    """Every pair of words compared."""
    form, count = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w], count[w] = best if best is not None and n[best] >= times * n[w] else None, len(close)

    def root(w):
        return root(form[w]) if form[w] is not None else w

    return sorted(((w, n[w], count[w], form[w], n.get(form[w]), root(w)) for w in n), key=repr)


def test_runs_and_slips():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abZÀéÿß×÷ .,1\u0100漢-'", k=rng.randint(0, 200))) for _ in range(300)] + ["", "é" * 300, "A" * 100 + "é" * 100, "xé"]
    for slip in (None, 1, 2, 97):
        got = letter_runs(pa.array([*texts, None]), [str(i) for i in range(len(texts) + 1)], slip, 3).to_pylist()
        assert got == [run for i, t in enumerate(texts) for run in runs(t, i, slip, 3)]


def test_deletion_keys_are_equal_for_equal_deletions():
    words = ["abcde", "abde", "éabcd", "x", "aaaa", "abcdé"]
    row, place, key = deletion_keys(pa.array(words))
    seen = {}
    for r, p, k in zip(row, place, key, strict=True):
        text = words[r] if p == WHOLE else words[r][:p] + words[r][p + 1 :]
        assert seen.setdefault(text, k) == k
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefgh"])
def test_variants_match_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    n = {"".join(rng.choices(letters, k=rng.randint(1, 6))): rng.choice([1, 2, 3, 3, 4, 6, 7, 12, 13, 26, 50]) for _ in range(300)}
    got = variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(5), at_least=3).collect()
    assert sorted(map(tuple, got), key=repr) == brute({w: k for w, k in n.items() if k >= 3})


def test_colliding_keys_join_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "shared_keys", lambda words: words.selectExpr("id", "explode(sequence(-1, length(word) - 1)) AS place"))  # every key nominates
    n = {"house": 9, "hause": 3, "mouse": 4, "houses": 20, "tree": 5}
    got = variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(n)


def test_batches_that_split_a_key():
    key, of, place = np.array([1, 1, 2, 3, 3, 3]), np.array([7, 7, 8, 1, 1, 2]), np.arange(6)
    assert spelling._met(key, of, place).column("place").to_pylist() == [3, 4, 5]


def test_roots_of_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 5)], "id long, form long")
    assert {r.id: r.root for r in roots(chain).collect()} == {**dict.fromkeys(range(40), 40), 100: 40}


def test_odd_rows(spark):
    rows = [(None, "Straße straße STRASSE"), (1, None), (2, ""), (3, "straße strase " * 3), (3, "straße"), (4, "q" * 70_000 + " " + "q" * 70_001), (5, "123 …")]
    df = spark.createDataFrame([(*r, 0) for r in rows * 3], "doc_id long, text string, n int")
    counts = Counter(x for i, t in rows * 3 for x in runs(t, i))
    got = variants(word_counts(df, "doc_id", "text", slip=97)).collect()
    assert sorted(map(tuple, got), key=repr) == brute({w: k for w, k in counts.items() if k >= 3})
    assert variants(word_counts(df.limit(0), "doc_id", "text")).count() == 0


def test_query_matches_all_words_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    counts = Counter(x for i, t in docs for x in runs(t, i))
    got = op11_query(spark, sf).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got), key=repr) == brute({w: k for w, k in counts.items() if k >= 3})
