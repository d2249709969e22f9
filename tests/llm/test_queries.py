"""Every registered query of the corpus operators on a small table, against its SQL where it has one."""

import duckdb
import pytest

from fathomline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1_neardup": ("doc_id", "n_shingles", "component_id", "kept"),
    "op2_lmscore": ("doc_id", "n_words", "log_score"),
    "op3_neighbours": ("query_id", "rank", "vec_id", "score"),
    "op4_language": ("page_id", "lang"),
    "op5_bytepair": ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"),
    "op6_packing": ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"),
    "op7_sharding": ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"),
    "op8_quality": ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"),
    "op9_fixity": (),
    "op10_urls": ("page_id", "host", "path", "rule", "verdict"),
    "op11_spelling": ("word", "form", "root", "n", "n_near", "form_n"),
    "op12_alignment": ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"),
    "op13_mixing": ("doc_id", "size", "source_size", "target", "taken"),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    assert set(CONTRACT[name]) <= set(got.columns)
    rows = got.collect()
    assert rows
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names, quoted = sorted(got.columns), '"{}"'.format
    want = con.execute(f"SELECT {', '.join(map(quoted, names))} FROM ({ORACLES[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in rows), key=key) == sorted(want, key=key)
