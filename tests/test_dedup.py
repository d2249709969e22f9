"""The prefix join, the greedy choice and the stored index of a stream against plain Python."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fathomline.operators import dedup, graph, ingest
from fathomline.sources import store
from fathomline.streaming import ingest as streaming
from fathomline.streaming.kept import KeptIndex


def corpus(n, seed=1, licence=0):
    """Texts in families of near copies, a third of them behind a licence of so many words."""
    rng = random.Random(seed)
    head = [f"l{i}" for i in range(licence)]
    base = [[f"{i}w{j}" for j in range(rng.randint(12, 60))] for i in range(n // 5)]
    texts = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", "z"])
        texts.append(" ".join((head if i % 3 == 0 else []) + words))
    return texts


def sets_of(texts, k=5):
    words = [t.split() for t in texts]
    return [frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, bool(w)))) for w in words]


def brute_pairs(texts, threshold):
    sets = sets_of(texts)
    first = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(s, i)
    reps = sorted(first.values())
    return [(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]


@pytest.mark.parametrize("threshold", [0.5, 0.85])
@pytest.mark.parametrize(("known", "block_rows"), [(1 << 20, 512), (0, 3), (7, 2)])
def test_pairs(spark, monkeypatch, threshold, known, block_rows):
    monkeypatch.setattr(dedup, "KNOWN_SHINGLES", known)
    texts = [*corpus(150, licence=20), "", "short one", "short one", "short two"]
    classed = dedup.classes(dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t"))
    got = sorted((r.a, r.b) for r in dedup.similar_pairs(classed, threshold, block_rows).collect())
    assert got == brute_pairs(texts, threshold)


def test_shared_licence_makes_no_crowded_shingle(spark):
    texts = [f"{' '.join(f'l{i}' for i in range(30)) if i % 3 == 0 else ''} {' '.join(f'{i}w{j}' for j in range(60))}" for i in range(900)]
    reps = dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").withColumnRenamed("ord", "id")
    known = dedup.most_repeated(dedup.repeated(reps), dedup.KNOWN_SHINGLES)
    assert len(known) == 26
    most = dedup.prefixes(reps, 0.85, known).groupBy("s").count().agg(F.max("count")).first()[0]
    assert most == 1  # no class meets another on the licence


@pytest.mark.parametrize("folded", [1 << 16, 30, 0])
def test_greedy_choice(spark, folded):
    rng = random.Random(4)
    edges = {(i, i + 1) for i in range(200)}  # a chain
    edges |= {tuple(sorted(rng.sample(range(300, 340), 2))) for _ in range(80)} | {(400, i) for i in range(401, 440)}
    if folded < 1 << 16:
        edges = {e for e in edges if e[0] > 180}  # rounds as long as the chain would take minutes
    ids = sorted({x for e in edges for x in e} | {900, 901})
    kept = set()
    for i in ids:
        if not any((j, i) in edges for j in kept):
            kept.add(i)
    got = graph.greedy_kept(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(sorted(edges), "a long, b long"), folded)
    assert {r.id for r in got.where("kept").collect()} == kept


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, i) for i in range(501, 540)]
    group = {x: x for e in edges for x in e}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        low, high = sorted((top(a), top(b)))
        group[high] = low
    got = graph.components(spark.createDataFrame(edges, "a int, b int")).collect()
    assert {r.id: r.component for r in got} == {x: top(x) for e in edges if e[0] != e[1] for x in e}


def stream(spark, path, batches, threshold=0.85):
    for i, texts in enumerate(batches):
        rows = spark.createDataFrame([(1000 * i + j, t) for j, t in enumerate(texts)], "id long, text string")
        streaming.ingest_batch(rows, i, path, "id", "text", threshold)
    return sorted(r.doc for r in spark.read.parquet(f"{path}/chunks").collect())


def test_stream_equals_one_walk_over_all_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeptIndex.__init__, "__defaults__", (16, 2))  # few buckets, a merge after every second batch
    texts = corpus(100, seed=3, licence=12)
    batches = [texts[i : i + 20] for i in range(0, 100, 20)]
    sets, kept = sets_of(texts), []
    for i, s in enumerate(sets):
        if s and all(len(s & sets[j]) / len(s | sets[j]) < 0.85 for j in kept):
            kept.append(i)
    got = stream(spark, f"file://{tmp_path}/out", batches)
    assert got == [1000 * (i // 20) + i % 20 for i in kept]
    done = {p.name for p in (tmp_path / "out/kept/done").iterdir() if not p.name.startswith(".")}
    assert done == {"base=0", "base=2", "base=4", *(f"batch={i}" for i in range(5))}


def contents(path: Path):
    return {str(p.relative_to(path)).split("/part-")[0]: p.read_bytes()[-200:] and p.stat().st_size for p in sorted(path.rglob("*.parquet"))}


def test_batch_that_is_run_again_writes_the_same(spark, tmp_path):
    texts = corpus(30, seed=5)
    path = f"file://{tmp_path}/out"
    stream(spark, path, [texts[:20], texts[20:]])
    before = contents(tmp_path / "out/kept/batch=1")
    rows = spark.createDataFrame([(1000 + j, t) for j, t in enumerate(texts[20:])], "id long, text string")
    streaming.ingest_batch(rows, 1, path, "id", "text")
    assert before and contents(tmp_path / "out/kept/batch=1") == before


def test_batch_reads_only_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    stream(spark, path, [corpus(40, seed=6)])
    index = KeptIndex(spark, f"{path}/kept", 0.85)
    sigs = dedup.signatures(spark.createDataFrame([(1, "one small text of a few words")], "i int, t string"), "i", "t")
    index.open(1, sigs)
    keys = index._prefixes(sigs.withColumnRenamed("ord", "id"))
    found = index._of("prefix", keys, "s")
    touched = keys.selectExpr("pmod(s, 256) AS b").distinct().count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert touched < 5
    assert plan.count("PartitionFilters: [bucket") >= 1 or "PartitionFilters: [isnotnull(bucket" in plan
    assert index.repeats(sigs).count() == 0


def test_rounds_leave_one_table_behind(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a int, b int")
    folder = Path(store.shared_folder(spark).removeprefix("file:")) / "settled"
    before = set(folder.iterdir()) if folder.exists() else set()
    assert graph.components(edges).count() == 31
    assert len(set(folder.iterdir()) - before) == 1


def test_sets_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([(i, f"a text of some words {i % 7} and some more") for i in range(40)], "i int, t string").mapInArrow(counted, "i int, t string")
    assert dedup.accepted(texts, "i", "t").where("kept").count() == 7
    assert seen.value == 40


def test_sets_tell_words_apart_as_joined_shingles_do(spark):
    texts = ["", None, "a b", "A  b", "ab", "a b c d e", "a b c d e a b c d e", "a b c d ee", "ab c d e e", "x a b c d e"]
    sets = {r.ord: r["set"] for r in dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect()}
    assert [len(sets[i]) for i in range(len(texts))] == [0, 0, 1, 1, 1, 1, 5, 1, 1, 2]
    assert sets[2] == sets[3] and len({tuple(sets[i]) for i in (2, 4, 5, 7, 8)}) == 5
    assert set(sets[5]) <= set(sets[6]) and set(sets[5]) <= set(sets[9])


def test_shingles_of_one_set_are_not_joined(spark, monkeypatch):
    seen = []
    meeting = dedup.meeting
    monkeypatch.setattr(dedup, "meeting", lambda x, y, *rest: (seen.append(x.count()), meeting(x, y, *rest))[1])
    texts = [*(" ".join(f"{i}w{j}" for j in range(60)) for i in range(50)), " ".join(f"7w{j}" for j in range(59))]
    classed = dedup.classes(dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t"))
    assert [(r.a, r.b) for r in dedup.similar_pairs(classed).collect()] == [(7, 50)]
    assert 2 <= seen[0] <= 2 * 9  # all other prefix rows hold what no other set has


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_copies_and_pairs_beyond_what_is_sent(spark, monkeypatch, sent):
    for name in ("SENT_IDS", "SENT_SHINGLES", "SENT_BLOCKS"):
        monkeypatch.setattr(dedup, name, sent)
    texts = [*corpus(60, seed=8), "", None, *corpus(60, seed=8)[:20]]
    df = spark.createDataFrame([((i % 3, i), t) for i, t in enumerate(texts)], "o struct<d: int, c: int>, t string")  # in an order that is not the rows'
    order = sorted(range(len(texts)), key=lambda i: (i % 3, i))
    sets, kept = sets_of([t or "" for t in texts]), []
    for i in order:
        if sets[i] and all(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.85 for j in kept):
            kept.append(i)
    got = dedup.accepted(df, "o", "t").collect()
    assert len(got) == len(texts) and sorted(r.ord.c for r in got if r.kept) == sorted(kept)


def test_white_space_and_case_of_any_script(spark):
    from fathomline.functions import text

    texts = ["A b\xa0C\x1cd\x85E", "　ÀÉ Ω x y  z w", "€‰ \xc2â a​b c d e", "İ ẞ ǅ Ⅷ ſ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = df.select("i", text.joined(text.words(text.F.lower("t"))).alias("t"))
    sets = [{r.ord: r["set"] for r in dedup.signatures(x, "i", "t", 2).collect()} for x in (df, plain)]
    assert sets[0] == sets[1] and [len(sets[0][i]) for i in range(4)] == [4, 5, 5, 4]


@pytest.mark.parametrize(("window", "overlap"), [(256, 32), (12, 5), (4, 3)])
def test_sets_of_windows_equal_those_of_written_chunks(spark, window, overlap):
    texts = ["", None, " ", "a B", "Ab\xa0c  d\n", *(" ".join(f"W{j % 300}ΑΣ" for j in range(n)) for n in (4, 5, 12, 13, 19, 20, 256, 257, 480, 481, 900)), "ΟΔΟΣ　Σ ẞ İ\x85x", "a b c d e f " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    whole = dedup.signatures(ingest.chunks(df, "text", window, overlap).withColumn("ord", F.struct("doc", "chunk_idx")), "ord", "chunk_text")
    made = dedup.window_signatures(df, "doc", "text", window, overlap)
    assert made.dtypes == whole.dtypes
    sets = [{tuple(r.ord): r["set"] for r in x.collect()} for x in (made, whole)]
    assert sets[0] == sets[1] and len(sets[0]) == made.count() > 20


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_corpus_equals_plain_walk(spark, monkeypatch, sent):
    for name in ("SENT_IDS", "SENT_SHINGLES", "SENT_BLOCKS"):
        monkeypatch.setattr(dedup, name, sent)
    texts = [*corpus(60, seed=8, licence=12), "", None, "one two", *corpus(60, seed=8)[:20]]
    docs = [(1000 - i, t) for i, t in enumerate(texts)]  # in an order that is not the rows'
    walked, kept = {}, set()
    for doc, text in sorted(docs):
        words = (text or "").split()
        for i in range((len(words) > 0) + max(0, -((20 - len(words)) // 15))):
            walked[doc, i] = sets_of([" ".join(words[i * 15 : i * 15 + 20])])[0]
    for k, s in walked.items():
        if all(len(s & walked[o]) / len(s | walked[o]) < 0.85 for o in kept):
            kept.add(k)
    got, counts = ingest.corpus(spark.createDataFrame(docs, "d long, t string"), "d", "t", window=20, overlap=5)
    assert {(r.doc, r.chunk_idx) for r in got.collect()} == kept
    assert [tuple(r) for r in counts.collect()] == [(len({d for d, _ in walked}), len(walked), len(kept))]


def test_corpus_takes_less_disk_than_its_texts(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(20):x}" for _ in range(700)) for _ in range(600)]
    texts += [" ".join(t.split()[:-9]) for t in texts[::3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    folder = Path(store.shared_folder(spark).removeprefix("file:")) / "settled"
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet")) if folder.exists() else 0
    shuffled = lambda: {str(f) for f in list(folders) for f in Path(str(f)).rglob("shuffle_*")}
    folders = [d.toString() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    before, shuffles, most = held(), shuffled(), []
    for module in (dedup, ingest):
        settle = module.settle
        monkeypatch.setattr(module, "settle", lambda df, settle=settle, **o: (settle(df, **o), most.append(held() - before))[0])
    _, counts = ingest.corpus(docs, "i", "t")
    assert max(most) < sum(map(len, texts)) * 0.75  # chunks and sets were 2.4 times as large as the texts
    for _ in range(50):
        if not (left := shuffled() - shuffles):
            break
        time.sleep(0.2)
    assert not left
    assert tuple(counts.first())[:2] == (800, 2400)


def test_unlike_sets_that_meet_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(dedup, "KNOWN_SHINGLES", 0)
    met, settle = [], dedup.settle
    monkeypatch.setattr(dedup, "settle", lambda df, **o: (out := settle(df, **o), met.append(out.count()) if df.columns == ["a", "b"] else None)[0])
    texts = [" ".join([*(f"{i}w{j}" for j in range(80)), *(f"l{j}" for j in range(120))]) for i in range(30)]
    texts.append(" ".join(["x", *texts[7].split()[1:]]))
    classed = dedup.classes(dedup.signatures(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t"))
    assert [(r.a, r.b) for r in dedup.similar_pairs(classed).collect()] == [(7, 30)]
    assert met[0] < 10  # of 465 pairs, all of which share some shingle of their prefixes


def test_sieve_lets_all_keys_pass(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.array("id").alias("v"))
    keys = store.settle(rows.where("k % 30 = 7").select("k"))
    for most, others in ((1 << 20, 0), (0, 5)):
        got = {r.k for r in dedup._among(rows, "k", keys, most, F.xxhash64("k")).collect()}
        assert set(range(7, 3000, 30)) <= got and len(got) <= 100 + others
