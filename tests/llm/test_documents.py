"""Tokens, packing, sharding, quality, language, fixity and URL verdicts, and their odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import bytepair, fixity, language, packing, quality, sharding, urls
from fathomline.llm.tokens import default_ranks, default_tokenizer, fast_encoder, special_tokens, tokenizer_of

ODD = ["", None, "a", "don't we'll 'tis it's", "  two  spaces \n\n\tand\ttabs \u00a0\u2003x", "ünïcode 漢字 🙂🙂 é\u0301", "<|endoftext|> as text", "123 4567 a1b2", "x" * 300, "word " * 3000, "\u200b\ufeff!?…", "ß SS ÀÉ"]


def test_encoding_and_decoding_match_the_library(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("abcdefghij  '\n.ü漢", k=rng.randint(0, 60))) for _ in range(60)] + ["a", "a"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoder = fast_encoder(default_ranks())
    for most in (1 << 19, 3):  # with and without a table of frequent words
        out = bytepair.decode(bytepair.encode(df, most_words=most)).withColumn("digest", F.sha2("ids", 256))
        got = {r.doc_id: r for r in out.collect()}
        for i, t in enumerate(texts):
            want = encoder.encode_ordinary(t or "")
            assert np.frombuffer(got[i].ids, "<u4").tolist() == want
            assert bytes(got[i].raw) == (t or "").encode()
            assert got[i].digest == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bytepair.encode(df.limit(0)).count() == 0


def test_pieces_are_cut_where_matches_end():
    import regex

    matches, rng = regex.compile(public_tokenizers.PATTERN).findall, random.Random(8)
    texts = ODD + ["".join(rng.choices(["a", "B", " ", "  ", "\n", "\t", ".", "'s", "1", "é", "漢", "🙂", "\x1c", "\x85", "\u00a0", "\u3000", "\x01"], k=rng.randint(0, 30))) for _ in range(3000)]
    for t in texts:
        assert [w for piece in bytepair.pieces_of(t) for w in matches(piece)] == matches(t or "")
    assert bytepair.pieces_of("one, two\nthree") == ["one,", " two", "\nthree"]


def test_units_hold_pieces_and_their_words(spark):
    df = spark.createDataFrame([("a b, b, c",), ("b, d",), (None,)], "text string").coalesce(1)
    assert {r.word: r.n for r in bytepair.unit_counts(df, "text").collect()} == {" b,": 2, ",": 3, " b": 2}  # "b," at the start is another piece
    parts = bytepair.unit_words(spark.createDataFrame([(" b,",), ("é",)], "word string")).collect()
    assert {r.word: r.parts for r in parts} == {" b,": [[32, 98], [44]], "é": [[195, 169]]}


def test_fold_binds_without_working_out_types_at_each_call(spark):
    plan = spark.createDataFrame([([[104, 101]],)], "w array<array<int>>").select(bytepair.merged(F.col("w"), default_ranks()).alias("ids"))
    shown = plan._jdf.queryExecution().analyzed().toString()
    assert "aggregate(array(" in shown or "aggregate(cast(array(" in shown
    assert "transform(array(" not in shown and "array_position" not in shown
    assert plan.first().ids == [fast_encoder(default_ranks()).encode_ordinary("he")]


def test_fold_starts_from_ready_parts_without_copies_of_slices(spark):
    words = [b"hello", b"a", "\u00fcnlikely".encode(), b"aaaaaaa", b"\xff\x00"]
    parts = bytepair._first(words, [0, 2, 2, 5], bytepair.first_parts(default_ranks()))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(parts.to_pylist())], "k int, w array<array<bigint>>")
    plan = df.select("k", bytepair.merged_parts(F.col("w"), default_ranks()).alias("w"))
    shown = plan._jdf.queryExecution().analyzed().toString()
    assert "slice(" not in shown and "concat(" not in shown
    got = [[x & bytepair.NO_ID for x in word] for r in plan.orderBy("k").collect() for word in r.w]
    assert got == [fast_encoder(default_ranks())._core_bpe.encode_single_piece(w) for w in words]
    assert bytepair._first([], [0, 0], bytepair.first_parts(default_ranks())).to_pylist() == [[]]


def test_plain_pieces_have_the_matches_of_the_pattern():
    import regex

    matches, rng = regex.compile(public_tokenizers.PATTERN).findall, random.Random(9)
    pieces = [*(t for t in ODD if t is not None), " ", "a", " b,", "b,,", " ,", "b'", "it's.", "\nx", "  x", "\u00d7", "\u00aa\u00b5", "x\u0301.", "a1,"]
    pieces += ["".join(rng.choices(["a", "B", " ", "\n", ".", ",", "!", "'s", "1", "\u00e9", "\u00df", "\u00d7", "\u024f", "\u0250", "\u6f22", "\u0301"], k=rng.randint(1, 6))) for _ in range(5000)]
    pieces += [a + chr(c) + b for c in range(1, 0x300) for a in ("", " ", "x") for b in ("", "x", ",")]
    for piece in pieces:
        assert bytepair.words_of(piece, matches) == matches(piece)
    searched = []
    assert [bytepair.words_of(piece, searched.append) for piece in (" word", "Stra\u00dfe,", "\u6f22")] == [[" word"], ["Stra\u00dfe", ","], ["\u6f22"]] and not searched
    letters = "".join(c for c in map(chr, range(0x110000)) if c.isalpha())
    assert matches(letters) == [letters]  # what Python takes for letters are letters of the pattern


def test_pieces_that_come_once_among_many_are_not_searched(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(bytepair, "COUNTED_AT_ONCE", 4)
    monkeypatch.setattr(bytepair, "words_of", lambda piece, matches: searched.append(piece) or [piece])

    class Frame:  # runs the counting here
        select = groupBy = agg = lambda self, *_: self

        def mapInArrow(self, count, _):
            column = pa.array(["a b a c d e", "f g"])
            self.found = [r for batch in count([pa.record_batch([column], ["text"])]) for r in batch.to_pylist()]
            return self

    assert bytepair.unit_counts(Frame(), "text").found == []  # "a" at the start is another piece
    assert searched == ["f", " g"]


def test_words_are_known_before_pieces_of_several_words(spark):
    texts = ["so, so, so, so,"] * 3 + ["very rare word"] * 2 + [" rare"] * 4
    counts = bytepair.unit_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text")
    assert {(r.word, r.several): r.n for r in counts.collect() if r.word in (" so,", " rare")} == {(" so,", True): 9, (" rare", False): 6}
    assert bytepair.common_units(counts, 4, 1 << 20).where("word = ' so,'").count() == 0
    assert bytepair.common_units(counts, 1 << 10, 1 << 20).where("word = ' so,'").count() == 1


def test_decoding_takes_null_ids_and_refuses_unknown_ones(spark):
    ids = fast_encoder(default_ranks()).encode_ordinary("some text ü")
    df = spark.createDataFrame([(1, np.array(ids, "<u4").tobytes()), (2, None), (3, b""), (4, np.array(ids[:1], "<u4").tobytes())], "k long, ids binary")
    want = fast_encoder(default_ranks()).decode_bytes(ids[:1])
    assert {r.k: bytes(r.raw) for r in bytepair.decode(df).collect()} == {1: "some text ü".encode(), 2: b"", 3: b"", 4: want}
    with pytest.raises(Exception, match="does not have"):
        bytepair.decode(spark.createDataFrame([(np.array([4_000_000], "<u4").tobytes(),)], "ids binary")).collect()


def test_rank_map_finds_every_pair():
    known, low = bytepair.rank_map(default_ranks()), (1 << bytepair.SHIFT) - 1
    ranks = bytepair.ranks_of(default_ranks())
    for token in random.Random(3).sample(sorted(ranks), 2000):
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                assert known.table[known.shifts[known.slots[a] + b % bytepair.LANES] + b] == (ranks[token] << bytepair.SHIFT) + (a << 16) + b
    pieces, rng = {v: k for k, v in ranks.items()}, random.Random(4)
    for _ in range(20000):  # and no pair that is none
        x, y = rng.randrange(500), rng.randrange(50000)
        entry = known.table[known.shifts[known.slots[x] + y % bytepair.LANES] + y]
        if entry & low == (x << 16) + y:
            assert ranks[pieces[x] + pieces[y]] == entry >> bytepair.SHIFT
    for x, y in ((104, 101), (0, 255), (255, 256), (97, 256)):
        entry = known.first[257 * x + y]
        assert entry & low == ranks[bytes([x])]
        assert entry >> bytepair.SHIFT == (ranks.get(bytes([x, y]), bytepair.NO_RANK) if y < 256 else bytepair.NO_RANK)


def test_both_libraries_agree():
    model, encoder = tokenizer_of(default_tokenizer()), fast_encoder(default_ranks(), special_tokens(default_tokenizer()))
    for t in [*ODD, "<|endoftext|><|endoftext|> x  <|endoftext|>\n<|endoftext|", " <|endoftext|>'s"]:
        assert model.encode(t or "", add_special_tokens=False).ids == encoder.encode(t or "", allowed_special="all")


def test_packing_query_gives_the_plain_ids(spark, tmp_path):
    texts = [*ODD, "one <|endoftext|> two", "<|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model = tokenizer_of(default_tokenizer())
    for r in packing.op6_query(spark, str(tmp_path)).collect():
        ids = model.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


@pytest.mark.parametrize("length", [7, 64])
def test_packing_is_complete_and_gapless(spark, length):
    rng = random.Random(length)
    texts = ODD + [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(0, 90))) for _ in range(60)] + ["same"] * 20
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(5)
    pieces = packing.pack(df, length=length, range_tokens=500).collect()
    encoder = fast_encoder(default_ranks())
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in enumerate(texts):
        want = encoder.encode_ordinary(t or "") + [1]
        mine = sorted(by_doc[i], key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in mine]).tolist() == want
        assert [p.start for p in mine] == np.cumsum([0] + [p.length for p in mine])[:-1].tolist()
        assert all(p.doc_tokens == len(want) for p in mine)
    for s, mine in by_sequence.items():
        mine.sort(key=lambda p: p.offset)
        assert [p.offset for p in mine] == np.cumsum([0] + [p.length for p in mine])[:-1].tolist()
        assert sum(p.length for p in mine) == length or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack(df.limit(0)).count() == 0


def test_hilbert_curve_visits_neighbours():
    side = 8
    points = np.array([(x, y) for x in range(side) for y in range(side)])
    order = points[np.argsort(packing.hilbert_key(points, 3))]
    assert sorted(packing.hilbert_key(points, 3).tolist()) == list(range(side * side))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_exact_and_keep_all_rows(spark):
    rows = [(i % 40, None if i % 7 == 0 else f"t{i % 5}", "x") for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(6)
    got = sharding.shuffle_into_shards(df, shards=8, seed=3, block_rows=7).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes.values()) == {25, 26} and len(sizes) == 8
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _ in rows)
    assert sharding.shuffle_into_shards(df.limit(0)).count() == 0
    assert sharding.shuffle_into_shards(df.limit(3), shards=8).count() == 3


def test_communication_matrix_has_its_sums_and_mean():
    counts, sizes = np.array([5, 0, 12, 3]), np.array([4, 4, 6, 6])
    total = np.zeros((4, 4))
    for seed in range(400):
        m = np.stack([sharding.matrix_row(counts, sizes, p, seed) for p in range(4)])
        assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == sizes).all()
        total += m
    assert np.abs(total / 400 - np.outer(counts, sizes) / 20).max() < 0.3


def test_hypergeometric_of_large_populations(monkeypatch):
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 1)
    rng = np.random.default_rng(0)
    ours = [sharding.hypergeometric(rng, 60, 40, 30) for _ in range(4000)]
    theirs = rng.hypergeometric(60, 40, 30, 4000)
    assert abs(np.mean(ours) - theirs.mean()) < 0.2 and abs(np.std(ours) - theirs.std()) < 0.15
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3


def base_counts(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if times[r] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(6)
    texts = ODD + [" ".join(rng.choices("abcd", k=rng.randint(0, 60))) for _ in range(80)] + ["a b\n\na b\n c\na b \n", "one two three four five " * 4, "x\ty\x0bz"]
    good = [" ".join(rng.choice(["river", "stone", "window", "garden", "letter"]) + str(rng.randrange(900)) for _ in range(60)) + "." for _ in range(60)]
    junk = [re.sub(" ", "### ", g) for g in good[:30]]
    every = texts + good + junk
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(every)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    for i, t in enumerate(every):
        n = base_counts(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == n
        assert got[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (got[i].kept and got[i].base_failed)
    at = len(texts)
    assert all(got[at + i].kept for i in range(len(good)))
    assert not any(got[at + len(good) + i].kept for i in range(len(junk)))
    assert quality.quality(df.limit(0)).count() == 0


def plain_em(patterns):
    """The quality model of {votes: count} in plain Python."""
    n = len(quality.rules())
    false, found, share = [quality.START_FALSE] * n, [quality.START_FOUND] * n, quality.START_SHARE

    def good(v):
        odds = math.log(share / (1 - share)) + sum(math.log((1 - false[j]) / (1 - found[j])) if x == 1 else math.log(false[j] / found[j]) if x == -1 else 0 for j, x in enumerate(v))
        return 1 / (1 + math.exp(-odds))

    for _ in range(quality.ROUNDS):
        q = {v: good(v) for v in patterns}
        for j in range(n):
            cast = [(c * q[v], c * (1 - q[v]), v[j] == -1) for v, c in patterns.items() if v[j]]
            ng, nb = sum(a for a, _, _ in cast), sum(b for _, b, _ in cast)
            xg, xb = sum(a for a, _, bad in cast if bad), sum(b for _, b, bad in cast if bad)
            prior = quality.PRIOR * (ng + nb) + 1
            f, b = (xg + prior * quality.START_FALSE) / (ng + prior), (xb + prior * quality.START_FOUND) / (nb + prior)
            if b < quality.ODDS * f:
                f = (xg + xb + prior * (quality.START_FALSE + quality.START_FOUND)) / (ng + prior + quality.ODDS * (nb + prior))
                b = quality.ODDS * f
            found[j] = min(b, quality.MOST_FOUND)
            false[j] = max(min(f, found[j] / quality.ODDS), quality.LEAST_FALSE)
        share = max((sum(c * q[v] for v, c in patterns.items()) + quality.START_SHARE) / (sum(patterns.values()) + 1), quality.LEAST_SHARE)
    return [*false, *found, share]


def test_quality_model_matches_plain_python(spark):
    rng = random.Random(3)
    votes = [tuple(rng.choices((-1, 0, 1), weights=(1, 2, 4), k=9)) for _ in range(400)]
    df = spark.createDataFrame([(list(v),) for v in votes], "__votes array<tinyint>")
    assert quality.estimated(df) == pytest.approx(plain_em(Counter(votes)))
    assert quality.estimated(df.limit(0)) == pytest.approx(plain_em(Counter()))


def test_bad_votes_speak_against_a_document(spark):
    table = quality.voted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    model = quality.estimated(table)
    n = len(quality.rules())
    assert all(found >= quality.ODDS * false > 0 for false, found in zip(model[:n], model[n : 2 * n], strict=True))


def test_languages(spark):
    seed = {"de": "der die und das ist nicht ein zu mit wir haben schon", "en": "the and that is not with we have been this there", "es": "el la los que no una con para esto tiene muy", "fr": "le les que ne pas une avec pour cette nous est"}
    rng = random.Random(2)
    rows = []
    for i in range(240):
        tongue = rng.choice(sorted(seed))
        text = " ".join(rng.choices(seed[tongue].split(), k=40))
        declared = rng.choice([tongue, tongue, tongue, None, "xx"])
        rows.append((i, text, declared, rng.choice(["com", None]), f"{tongue}.example.com" if rng.random() < 0.7 else None, tongue))
    rows += [(900, None, None, None, "de.example.com", "-"), (901, "", "fr", None, None, "-"), (902, "ok", None, None, None, "-")]
    df = spark.createDataFrame(rows, "page_id long, text string, __declared string, __suffix string, __host string, true string").withColumn("__parent", F.lit("example.com"))
    got = {r.page_id: r for r in language.identify(df, "text", ["page_id"]).collect()}
    assert len(got) == len(rows)
    right = [got[r[0]].lang == r[5] for r in rows[:240]]
    assert sum(right) / len(right) > 0.98
    assert not any(got[i].accepted or got[i].text_lang for i in (900, 901, 902))
    assert got[900].lang == "de"  # its host says so
    assert language.identify(df.limit(0), "text", ["page_id"]).count() == 0


def plain_posteriors(rows, how):
    """{key: (lang, p)} of (key, text, declared, suffix, host, parent) rows, from the formulas in plain Python."""
    known, classes = how.known, len(how.known) + 1
    fold = lambda t: bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    bucket = lambda g: ((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % (1 << 32)) >> 17
    grams = {r[0]: [bucket(x[i : i + 3]) for i in range(len(x) - 2)] for r in rows for x in [fold(r[1])]}
    counts = [[0.5] * language.BUCKETS for _ in known]
    for key, text, declared, *_ in rows:
        if declared in known and text is not None:
            for g in grams[key]:
                counts[known.index(declared)][g] += 1
    shares = [[c / sum(row) for c in row] for row in counts]
    shares.append([language.POOLED * sum(col) / len(known) + (1 - language.POOLED) / language.BUCKETS for col in zip(*shares, strict=True)])
    logs = {k: [sum(math.log(s[g]) for g in gs) / language.TEMPER if len(gs) >= how.least_trigrams else 0.0 for s in shares] for k, gs in grams.items()}
    normal = lambda x: [math.exp(v - max(x)) / sum(math.exp(w - max(x)) for w in x) for v in x]
    q = {k: normal(v) for k, v in logs.items()}
    total = [sum(v[i] for v in q.values()) for i in range(classes)]
    base = [(x + 1) / (sum(total) + classes) for x in total]
    out = {}
    for key, _, declared, suffix, host, parent in rows:
        others = lambda at, value: [sum(q[r[0]][i] for r in rows if r[at] == value and r[0] != key) if value is not None else 0.0 for i in range(classes)]
        up = [(x + how.smoothing * b) / (sum(others(5, parent)) + how.smoothing) for x, b in zip(others(5, parent), base, strict=True)]
        here = others(4, host)
        prior = base if host is None else [(x + how.smoothing * u) / (sum(here) + how.smoothing) for x, u in zip(here, up, strict=True)]
        score = [a + math.log(b) for a, b in zip(logs[key], prior, strict=True)]
        for at, value in ((2, declared), (3, suffix)):
            seen = others(at, value)
            if value is not None and sum(seen) > 1e-12:
                overall = sum(seen) / sum(total)
                score = [s + math.log((x + how.smoothing * overall) / (t - own + how.smoothing)) for s, x, t, own in zip(score, seen, total, q[key], strict=True)]
        p = normal(score)
        out[key] = ([*known, language.OTHER][p.index(max(p))], max(p))
    return out


def test_posteriors_match_plain_python(spark):
    seed = {"de": "der die und das ist nicht ein zu", "en": "the and that is not with we have", "es": "el la los que no una con para", "fr": "le les que ne pas une avec pour"}
    rng = random.Random(5)
    rows = []
    for i in range(60):
        tongue = rng.choice(sorted(seed))
        rows.append((i, " ".join(rng.choices(seed[tongue].split(), k=rng.randint(1, 12))), rng.choice([tongue, None, "xx"]), rng.choice(["com", "de", None]), rng.choice([f"{tongue}.a.com", "b.a.com", None]), rng.choice(["a.com", None])))
    rows += [(100, None, "de", None, "de.a.com", "a.com"), (101, "", None, None, None, None), (102, rows[0][1], *rows[0][2:])]
    df = spark.createDataFrame(rows, "page_id long, text string, __declared string, __suffix string, __host string, __parent string")
    want = plain_posteriors(rows, language.Languages())
    for r in language.identify(df, "text", ["page_id"]).collect():
        assert r.p == pytest.approx(want[r.page_id][1], rel=1e-6)
        assert r.lang == want[r.page_id][0]


def test_other_languages_and_junk_are_not_accepted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.col("lang").alias("__declared"), F.col("source").alias("__host"))
    odd = {
        -1: "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita.",
        -2: "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
        -3: "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
        -4: "xq7#kz vv93jw pqlx0z%w gk2yt jjq8 zxwv4 qqkd7h wpz&1x vkjq",
    }
    rows = docs.union(spark.createDataFrame([(i, t, None, None) for i, t in odd.items()], "doc_id long, text string, __declared string, __host string"))
    rows = rows.withColumn("__suffix", F.lit(None).cast("string")).withColumn("__parent", F.lit(None).cast("string"))
    got = {r.doc_id: r for r in language.identify(rows, "text", ["doc_id"]).collect()}
    assert not any(got[i].accepted for i in odd)
    assert sum(r.accepted for i, r in got.items() if i >= 0) > 0.95 * (len(got) - len(odd))


def test_evidence_of_pages(spark):
    html = '<!DOCTYPE html><HTML class="x" LANG=DE-at><script>var a = "<b>";</script><style>p{}</style><!-- c --><p>Hallo <b>du</b></p>'
    df = spark.createDataFrame([(1, "https://a@www.Shop.example.CO:80/x", html), (2, None, None)], "page_id long, url string, html string")
    one, two = sorted(language.evidence_of_pages(df).collect(), key=lambda r: r.page_id)
    assert one.text.split() == ["Hallo", "du"]
    assert tuple(one)[2:] == ("de", "co", "www.shop.example.co", "example.co")
    assert tuple(two)[2:] == (None, None, None, None)


def test_fixity_finds_all_damage_and_descends_only_there(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 9)) for i in range(400)]
    damage = {5: (5, "http://h/5", "other"), 77: None, 399: (399, "http://h/399", "")}
    other = [damage.get(r[0], r) for r in rows if damage.get(r[0], r)] + [(1000, "u", "new"), (1000, "u", "newer")]
    shape = "page_id long, url string, html string"
    one, two = (spark.createDataFrame(r, shape).repartition(3) for r in (rows, other))
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    a, b = (fixity.archived(x, "page_id", record, 64) for x in (one, two))
    got = fixity.audit(a, b, 64, 4)
    odd = sorted((r.id, r.status) for r in got.where("status <> 'sound'").collect())
    assert odd == [(5, "corrupt"), (77, "missing"), (399, "corrupt"), (1000, "extra"), (1000, "extra")]
    assert got.where("status = 'sound'").count() == 397
    _, seen = fixity.differing(fixity.tree(a, 64, 4), fixity.tree(b, 64, 4), 4)
    assert seen[0] == 4 and max(seen) == 4
    same = fixity.audit(a, a, 64, 4)
    assert same.where("status <> 'sound'").count() == 0 and same.count() == 400
    assert fixity.audit(a.limit(0), b.limit(0), 64, 4).count() == 0


def test_warc_records(spark):
    df = spark.createDataFrame([(1, "http://h/\r\nx", "é"), (None, None, None)], "page_id long, url string, html string")
    one, two = (bytes(r.w) for r in df.select(fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("w")).collect())
    head, _, rest = one.partition(b"\r\n\r\n")
    assert b"Content-Length: 2" in head and b"http://h/x" in head and rest == "é\r\n\r\n".encode()
    assert two.endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    offsets = fixity.archived(df, "page_id", fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))).collect()
    assert sorted(((r.id, r.offset, r.length) for r in offsets), key=repr) == [(1, 0, len(one)), (None, 0, len(two))]


def test_fixity_audits_records_without_id(spark):
    shape = "page_id long, url string, html string"
    rows = [(None, "u", f"page {i}") for i in range(40)] + [(None, "u", "page 3")] * 2 + [(7, "u", "x"), (7, "u", "x"), (None, None, None)]
    other = [r for r in rows if r[2] != "page 5"] + [(None, "u", "page five"), (None, "u", "page 8")]
    other.remove((None, "u", "page 3"))
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    a, b = (fixity.archived(spark.createDataFrame(r, shape).repartition(3), "page_id", record, 64) for r in (rows, other))
    got = fixity.audit(a, b, 64, 4)
    assert Counter((r.id, r.status) for r in got.collect()) == {(None, "sound"): 41, (7, "sound"): 2, (None, "missing"): 2, (None, "extra"): 2}
    assert fixity.audit(a, a, 64, 4).where("status <> 'sound'").count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows + [(i, "h", f"<p>{i}</p>") for i in range(1, 1100, 6)])
    pages = spark.createDataFrame(con.execute("SELECT * FROM pages").fetchall(), shape)
    a, b = (fixity.archived(x, "page_id", record) for x in (pages, fixity.damaged_copy(pages)))
    columns = ["id", "archive", "offset", "length", "digest", "other_digest", "status"]
    want = con.execute(f"SELECT {', '.join(columns).replace('id', 'page_id', 1).replace('offset', chr(34) + 'offset' + chr(34))} FROM ({fixity.OP9_SQL})").fetchall()
    assert sorted(map(tuple, fixity.audit(a, b).select(*columns).collect()), key=repr) == sorted(want, key=repr)


def fitting(host, path):
    best = None
    for action, pattern in urls.RULES:
        h, _, p = pattern.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(pattern) > len(best[1])):
            best = (action, pattern)
    return best or (None, None)


def test_url_rules(spark):
    cases = ["http://EXAMPLE.com/en/71?x", "https://a.b.example.com/en/8", "x://com/en/", "http://notcom/en/", "http://de.net/de/8", "http://example.net/de/81#f", "http://q.example.net/de/9", "http://a.org/es/", "a.org/es/", None, "", "http://h.org?/es/", "http://h.com#/en/", "a://b.net/de/c://d.com/en/"]
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(cases)], "page_id long, url string, html string, rule string")
    for r in urls.judged(df).collect():
        u = cases[r.page_id] or ""
        rest = u.partition("://")[2] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        action, pattern = fitting(host, path)
        assert (r.host, r.path, r.rule) == (host, path, pattern)
        assert action is None or r.verdict == action
        assert r.verdict in ("allow", "block")


def test_trust_spreads_forwards_and_distrust_backwards(spark):
    link = lambda *to: "".join(f'<a href="{t}">' for t in to)
    pages = [
        (1, "http://good.net/de/1", link("http://friend.info/a", "/own")),
        (2, "http://friend.info/a", link("//Second.info/")),
        (3, "http://second.info/", None),
        (4, "http://farm.info/", link("http://bad.org/es/1")),
        (5, "http://bad.org/es/1", None),
        (6, "http://bad.org/other", None),
        (7, "http://lone.info/", "<p>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judged(df).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow"}
    assert got[1].trust > got[2].trust > got[3].trust > 0 == got[7].trust
    assert got[5].distrust > got[4].distrust > 0
    # plain power iteration
    trust = {"good.net": 0.15, "friend.info": 0.15 * 0.85, "second.info": 0.15 * 0.85**2}
    assert [got[i].trust for i in (1, 2, 3)] == pytest.approx(list(trust.values()))
    assert urls.judged(df.limit(0)).count() == 0


def test_ranks_on_a_cycle_match_power_iteration(spark, monkeypatch):
    monkeypatch.setattr(urls, "SETTLED", 1e-4)
    names, links = "abcde", [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "d", 3), ("d", "c", 1), ("e", "a", 1)]
    out, into = Counter(), Counter()
    for s, d, n in links:
        out[s] += n
        into[d] += 1
    edges = spark.createDataFrame([(s, d, n / out[s]) for s, d, n in links], "src string, dst string, share double")
    seeds = spark.createDataFrame([("a", 3, 0), ("d", 1, 2), ("e", 0, 2)], "host string, allowed long, blocked long")
    got = {r.host: r for r in urls.propagated(seeds, edges).collect()}
    for column, start, step in (("trust", {"a": 0.75, "d": 0.25}, [(s, d, n / out[s]) for s, d, n in links]), ("distrust", {"d": 0.5, "e": 0.5}, [(d, s, 1 / into[d]) for s, d, n in links])):
        rank = {h: 0.15 * start.get(h, 0) for h in names}
        for _ in range(300):
            rank = {h: 0.15 * start.get(h, 0) + 0.85 * sum(rank[s] * w for s, d, w in step if d == h) for h in names}
        for h in names:
            assert (got[h][column] if h in got else 0) == pytest.approx(rank[h], abs=5e-4)


def test_digest_columns_of_the_sharding_query(spark, tmp_path):
    spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sharding.op7_query(spark, str(tmp_path)).collect()}
    assert (got[1].size, got[1].text_crc32) == (3, zlib.crc32("é".encode()))
    assert (got[2].size, got[2].text_crc32, got[2].grown_shard) == (1, 0, None)


def test_pattern_is_the_published_one():
    assert public_tokenizers.PATTERN
