"""Values of the registered queries that no SQL checks, on the smallest tables, against plain Python and libraries."""

import hashlib
import re
import struct
from collections import Counter

import numpy as np
import pytest

from fathomline.llm.queries import QUERIES
from fathomline.llm.tokens import default_ranks, fast_encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_neighbours(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {}
    for r in QUERIES["op3_neighbours"](spark, SF).collect():
        assert r.score == pytest.approx(np.linalg.norm(rows[r.query_id] - rows[r.vec_id]), rel=1e-12)
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == {i for i in rows if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        want = sorted((np.linalg.norm(rows[q] - v), i) for i, v in rows.items() if i != q)[:10]
        assert sorted(found) == list(range(1, 11))
        assert [found[k] for k in sorted(found)] == [i for _, i in sorted((np.linalg.norm(rows[q] - rows[i]), i) for i in found.values())]
        hits += len({i for _, i in want} & set(found.values()))
    assert hits >= 0.9 * 10 * len(got)


def test_encoding(spark, documents):
    encoder = fast_encoder(default_ranks())
    for r in QUERIES["op5_bytepair"](spark, SF).collect():
        ids = encoder.encode_ordinary(documents[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(documents[r.doc_id].encode()).hexdigest()


def test_quality_counts(spark, documents):
    rows = QUERIES["op8_quality"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(documents)
    for r in rows:
        text = documents[r.doc_id]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(runs)
        repeated = {i + k for i, run in enumerate(runs) if often[run] > 1 for k in range(5)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(repeated) > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert 0.5 < sum(r.kept for r in rows) / len(rows) < 1


def test_language_of_pages(spark):
    """The address names a page's language, but for the query it is only part of the host evidence."""
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op4_language"](spark, SF).collect()
    assert Counter(r.page_id for r in rows) == Counter(list(urls))
    told = {i: m[1] for i, u in urls.items() if u and (m := re.search(r"://[^/]+/(de|en|es|fr)/", u))}
    sure = [r for r in rows if r.accepted and r.page_id in told]
    assert sure and all(0.5 <= r.p <= 1 for r in sure)
    assert sum(r.lang == told[r.page_id] for r in sure) >= 0.9 * len(sure)


def test_url_verdicts(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op10_urls"](spark, SF).collect():
        found = re.search(r"://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fits = [p for p in rules if ("." + host).endswith("." + p.partition("/")[0]) and path.startswith("/" + p.partition("/")[2])]
        best = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best)
        assert r.verdict == (rules[best] if best else "block" if r.distrust > r.trust else "allow")
