"""The corpus pipeline stage by stage on a small table, against brute force."""

import random

import corpus_pipeline
import pytest
from test_pairs import groups, sets_of


def _documents():
    rng = random.Random(8)
    seed = {"de": "der die und das ist nicht ein zu mit wir haben schon wieder", "en": "the and that is not with we have been this there again", "es": "el la los que no una con para esto tiene muy bien", "fr": "le les que ne pas une avec pour cette nous est bien"}
    rows = []
    for i in range(160):
        tongue = rng.choice(sorted(seed))
        text = " ".join(rng.choice(seed[tongue].split()) + rng.choice(["", "er", "en", "al", "os", "ie"]) for _ in range(80)) + "."
        rows.append((i, text, tongue, f"src{i % 3}", len(text)))
    for i in range(160, 200):
        _, text, tongue, source, _ = rng.choice(rows[:160])
        words = text.split()
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), tongue, source, len(text)))
    rows += [(200, None, None, None, None), (None, rows[0][1], "en", None, 1), (None, rows[0][1], "en", None, 1), (201, "", "en", "src1", 0), (202, "short one that is not this", "en", "src1", 9), (203, "### " * 60, "en", "src1", 240)]
    return rows


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "x") for r in _documents()], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        out.append((docs, after))
        docs = after
    language, quality, dedup, packed = out
    assert language[1].columns == quality[1].columns == dedup[1].columns == list(corpus_pipeline.COLUMNS)
    gone = lambda pair: {r.doc_id for r in pair[0].collect()} - {r.doc_id for r in pair[1].collect()}
    assert gone(language) == {200, 201}
    assert gone(quality) == {202, 203}
    before = [(i, r.text) for i, r in enumerate(dedup[0].collect())]
    want = groups([i for i, _ in before], sets_of([t for _, t in before], 5), 80, 100)
    assert dedup[1].count() == len(set(want.values()))
    left = sets_of([r.text for r in dedup[1].collect()], 5)
    assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(left) for b in left[:i] if a | b)
    assert packed[1].select("doc_id").distinct().count() == packed[0].select("doc_id").distinct().count()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.count() == 0


@pytest.mark.parametrize("stage", [corpus_pipeline.language_stage, corpus_pipeline.dedup_stage])
def test_stage_keeps_its_rows_when_the_scan_is_split_otherwise(spark, tmp_path, stage):
    """Splits follow the session's parallelism, which moves with the executors; rows are numbered once, whatever they are later."""
    rows = [(*r, "x") for r in _documents()] * 3
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(6).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    texts = lambda df: sorted((r.text or "", r.doc_id or -1) for r in df.collect())
    want = texts(stage(spark, docs, ""))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        found = stage(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
        got = texts(found)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(got) == len(want)
    if stage is corpus_pipeline.language_stage:
        assert got == want
    else:
        left = sets_of([t for t, _ in got], 5)
        assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(left) for b in left[:i] if a | b)
