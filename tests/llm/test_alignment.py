"""Alignment against plain loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomline.llm import alignment
from fathomline.llm.alignment import aligned, op12_query, pair_counts, weighed, with_row

ODD = ["", None, " ", "a", "two  spaces", " lead", "trail ", "tab\there", "line\n\nbreaks \n x", "▁sign", "a▁b", "ünïcode 漢字 🙂🙂 é\u0301", "<s> </s> <unk> <0x41> <|endoftext|>", "\u00a0nbsp\u2003x", "a\x00b", "'tis don't we'll", "12 345 6", "x" * 3000, "- " * 50, "\x1c \x85 y", "ﬁ ½ Ａ", "word " * 300]


def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    name = b.id_to_piece
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), (lambda i: bytes(byte[c] for c in a.id_to_token(i))), b.encode, (lambda i: bytes([int(name(i)[3:5], 16)]) if b.is_byte(i) else name(i).replace("▁", " ").encode())


def brute(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each (id, text)."""
    encode_a, bytes_a, encode_b, bytes_b = encoders()
    made, holders = [], Counter()
    for i, text in rows:
        sides, groups = [[], []], []
        if text:
            sides = [encode_a(text), encode_b(text)]
            pieces = [[known(x) for x in ids] for ids, known in zip(sides, (bytes_a, bytes_b), strict=True)]
            if any(b"".join(x) != (" " + text).encode() for x in pieces):
                sides = [[], []]
            else:
                ends = [[sum(map(len, x[: j + 1])) for j in range(len(x))] if len(x) < 500 else list(running(x)) for x in pieces]
                at = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    to = [e.index(cut) + 1 for e in ends]
                    groups.append(tuple(s[x:y] for s, x, y in zip(sides, at, to, strict=True)))
                    at = to
        made.append((i, *map(len, sides), groups))
        holders.update({(x, y) for a, b in groups for x in a for y in b})
    most = {}
    for (x, _), n in holders.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, n_a, n_b, groups in made:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=repr)


def running(pieces):
    total = 0
    for x in pieces:
        total += len(x)
        yield total


def digest(df, most_sent=alignment.SENT_PAIRS, **bounds):
    table = with_row(aligned(df, **bounds))
    sums = weighed(table.select("row", "links"), pair_counts(table), most_sent)
    full = table.join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    sha = F.when(F.col("n_a") > 0, F.sha2("groups_text", 256)).otherwise(F.lit(""))
    return sorted(map(tuple, full.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long"), "n_best", "count_sum", sha).collect()), key=repr)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(5)
    mixed = ["".join(rng.choices(["a", "b", " ", "  ", "\n", "\t", "é", "漢", "▁", ".", ",", "'s", " the", "ing", "1", "🙂", "\u200b"], k=rng.randint(0, 60))) for _ in range(150)]
    texts = [*ODD, *mixed, "a", "two  spaces"]
    return [(i if i % 7 else None, t) for i, t in enumerate(texts)]


def test_odd_texts_match_the_libraries(spark, odd_rows):
    df = spark.createDataFrame([(*r, 0) for r in odd_rows], "doc_id long, text string, links int").repartition(3)
    want = brute(odd_rows)
    assert digest(df) == want
    assert digest(df, most_sent=40, most_pieces=9) == want  # rare pairs by a shuffled join, rare pieces in each batch
    assert digest(df, most_sent=0, most_pieces=0) == want
    assert digest(df.limit(0)) == []


def test_long_text_without_seams(spark):
    rng = random.Random(6)
    rows = [(1, "".join(rng.choices("abc漢\n", k=30_000))), (2, "w " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in aligned(df).collect()}
    encode_a, bytes_a, encode_b, bytes_b = encoders()
    for i, text in rows:
        ends = [set(running([known(x) for x in encode(text)])) for encode, known in ((encode_a, bytes_a), (encode_b, bytes_b))]
        assert (got[i].n_a, got[i].n_b, got[i].n_groups) == (len(encode_a(text)), len(encode_b(text)), len(ends[0] & ends[1]))


def test_query_matches_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op12_query(spark, sf).collect()), key=repr) == brute(docs)


def test_plain_texts_are_split_without_a_search(monkeypatch):
    searched, found = [], alignment._PIECE
    monkeypatch.setattr(alignment, "_PIECE", type("Counting", (), {"findall": lambda self, text: (searched.append(text), found.findall(text))[1]})())
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("ab \n\t\x01\xa0　\x1c") for _ in range(draw.randrange(9)))
        assert alignment.split(text) == (found.findall(" " + text) if text else [])
    searched.clear()
    assert alignment.split("one two\nthree ü 世") == [" one", " two", "\nthree", " ü", " 世"] and not searched


def test_parts_bind_without_working_out_types_at_each_call(spark):
    piece = "named_struct('ids_a', array(1, 2, 3), 'ends_a', array(2, 3, 5), 'ids_b', array(7, 8), 'ends_b', array(3, 5))"
    df = spark.range(1).selectExpr(f"{piece} piece").select(alignment.part_of(F.col("piece")).alias("part"))
    shown = df._jdf.queryExecution().analyzed().toString()
    assert "transform(array(" not in shown and "array_position" not in shown
    part = df.first().part
    pair = lambda a, b: (a << alignment.ID_BITS) + b
    assert (part.n, part.text, part.links) == (2, "1,2|7;3|8", [pair(1, 7), pair(2, 7), pair(3, 8)])
