"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Python only tokenises. Both tokenizers always end a token at a seam, before a space or line
feed between two characters that are no white space, so a document is a list of pieces
between seams. The pieces that make up most of the corpus are aligned once; how many is
bounded. The others are aligned once for each batch of documents, so that the whole
vocabulary is nowhere.

From there on the token ends of a piece are arrays of byte offsets: where both end
(array_intersect) cuts it into groups, each cut's place among the tokens is looked up, and
the tokens in the sequence of places between two cuts are a group, all linked with each
other. A document's groups and links are those of its pieces, one after the other. How many
documents link a pair of ids is counted over the whole corpus and looked up again for every
link: from a table that all executors hold for the pairs that most documents have, by a
shuffled join for the others.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import FAR_SPACES, NEAR_SPACES
from fathomline.llm.common import byte_runs, frequent, let, numbered, settle
from fathomline.llm.tokens import default_ranks, fast_encoder

#: Most pairs of ids whose counts are sent to all executors, 17 bytes each.
SENT_PAIRS = 1 << 20
#: Bits of a token's place below its end, and of a B id below the A id in a pair.
PLACE_BITS, ID_BITS = 31, 24
#: Tokens of a piece in which places are looked up one by one.
SHORT = 32


def default_pieces() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def piece_encoder(path: str):
    """The sentencepiece model of a file, and the bytes that each of its pieces stands for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = map(model.id_to_piece, range(model.get_piece_size()))
    return model, [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]


@cache
def rank_encoder(path: str):
    """The encoder of a rank file, and the bytes of each of its ids."""
    encoder = fast_encoder(path)
    return encoder, [encoder.decode_single_token_bytes(i) for i in range(encoder.n_vocab)]


#: From a seam (a space or line feed between two characters that are no white space) to the next.
_PIECE = re.compile(r"[ \n](?:\S+|\s+\S*)(?:(?![ \n]\S)\s+\S*)*")
#: A character that marks seams, and what a text must not hold for that: it, white space besides spaces and line feeds, and two of these in a row.
_MARK = "\x01"
_NOT_PLAIN = (_MARK, "  ", " \n", "\n ", "\n\n", *(c for c in NEAR_SPACES + FAR_SPACES if c not in " \n"))
#: Bytes of text whose documents are aligned together.
BATCH_BYTES = 1 << 21
#: Most pieces that are aligned once for all documents, and their most bytes.
FREQUENT_PIECES, FREQUENT_BYTES = 1 << 18, 1 << 22
#: Pieces counted in a task before its counts are sent on.
COUNTED_AT_ONCE = 1 << 17


class Pair:
    """Both tokenizers over the pieces of a text that has a space before it; a piece begins with its space or line feed.

    The rank file's pattern ends a match before every seam, and no piece of the model has a
    space behind anything but spaces, or a line feed and something else (checked), so pieces
    do not depend on each other.
    """

    def __init__(self, ranks_path: str, pieces_path: str):
        (self.first, self.bytes_a), (self.second, self.bytes_b) = rank_encoder(ranks_path), piece_encoder(pieces_path)
        self.widths = [np.array([len(x) for x in known], np.int32) for known in (self.bytes_a, self.bytes_b)]
        if any(b" " in x.lstrip(b" ") or (b"\n" in x and x != b"\n") for x in self.bytes_b):
            raise ValueError(f"{pieces_path} has pieces with a space or line feed inside")

    def __call__(self, pieces: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of A and B of each piece, or None where a side's bytes are not the piece's."""
        found = []
        plain = [x[1:] if x[0] == " " else x for x in pieces]  # the model puts a space before what it encodes
        for piece, a, b in zip(pieces, map(self.first.encode_ordinary, pieces), self.second.encode(plain, num_threads=1), strict=True):
            b = b if piece[0] == " " else b[1:]
            want = piece.encode()
            same = "\u2581" not in piece  # the model reads that sign as a space
            same = same and b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want
            found.append((a, b) if same else None)
        return found

    def columns(self, found: list[tuple[list[int], list[int]] | None]) -> pa.StructArray:
        """ids_a, ends_a, ids_b and ends_b of each piece; empty for None."""
        columns = []
        for side, width in enumerate(self.widths):
            ids = [x[side] if x else [] for x in found]
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.array([i for x in ids for i in x], np.int32)
            before = np.concatenate([[0], np.cumsum(width[flat], dtype=np.int64)])
            ends = (before[1:] - np.repeat(before[np.cumsum(sizes) - sizes], sizes)).astype(np.int32)
            columns += [_lists(pa.array(flat), sizes), _lists(pa.array(ends), sizes)]
        return pa.StructArray.from_arrays(columns, ["ids_a", "ends_a", "ids_b", "ends_b"])


@cache
def pair_of(ranks_path: str, pieces_path: str) -> Pair:
    return Pair(ranks_path, pieces_path)


PIECE = "struct<ids_a: array<int>, ends_a: array<int>, ids_b: array<int>, ends_b: array<int>>"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def split(text: str | None) -> list[str]:
    """Pieces of a text with a space before it, each from a seam to the next; none of a null or empty text.

    Where every white space is one space or line feed between two words, which is common, all
    of them are seams, and none is searched for.
    """
    if not text:
        return []
    if not (text[0].isspace() or text[-1].isspace() or any(x in text for x in _NOT_PLAIN)):
        return (" " + text).replace(" ", _MARK + " ").replace("\n", _MARK + "\n").split(_MARK)[1:]
    return _PIECE.findall(" " + text)


def piece_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n): pieces that come more than once among some 2^17 distinct ones, with how often they do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def repeated() -> pa.RecordBatch:
            found = [(w, n) for w, n in counts.items() if n > 1]
            return pa.record_batch([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

        for column in (b.column(0).slice(i, j - i) for b in batches for i, j in byte_runs(b.column(0))):
            for text in column.to_pylist():
                counts.update(split(text))
                if len(counts) > COUNTED_AT_ONCE:
                    yield repeated()
                    counts.clear()
        yield repeated()

    return df.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_pieces(common: DataFrame, ranks_path: str, pieces_path: str) -> DataFrame:
    """(word, n_a, n_b, piece) of pieces (word); no tokens where one side does not give the piece back."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair_of(ranks_path, pieces_path)
        for batch in batches:
            found = both(batch.column(0).to_pylist())
            sizes = (pa.array([len(x[side]) if x else 0 for x in found], pa.int64()) for side in (0, 1))
            yield pa.record_batch([batch.column(0), *sizes, both.columns(found)], ["word", "n_a", "n_b", "piece"])

    return common.mapInArrow(encode, f"word string, n_a long, n_b long, piece {PIECE}")


def tokenised(df: DataFrame, id_col: str, text_col: str, known, ranks_path: str, pieces_path: str) -> DataFrame:
    """A row for each batch of documents: pieces (those that are not known) and docs (doc_id, n_a, n_b, of: its pieces in order).

    known: a broadcast of the known pieces' word, n_a, n_b and at, their number. Others have numbers from -1 downwards by their place in the row. Documents
    that are null, empty or not given back byte for byte by one side have no pieces.
    """
    name = uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, (number, known_sizes, known_bad) = pair_of(ranks_path, pieces_path), _numbers(name, known)
        for batch in (b.slice(i, j - i) for b in batches for i, j in byte_runs(b.column(1), BATCH_BYTES)):
            other: dict[str, int] = {}
            of = []
            for text in batch.column(1).to_pylist():
                pieces = split(text)
                numbers = list(map(number.get, pieces))
                at = -1
                for _ in range(numbers.count(None)):
                    at = numbers.index(None, at + 1)
                    numbers[at] = -1 - other.setdefault(pieces[at], len(other))
                of.append(numbers)
            found = both(list(other))
            bad = known_bad | {-1 - i for i, x in enumerate(found) if x is None}
            if bad:
                of = [x if bad.isdisjoint(x) else [] for x in of]
            per_doc, flat_of = np.array([len(x) for x in of], np.int64), np.array([i for x in of for i in x], np.int64)
            last, totals = np.cumsum(per_doc), []
            for side, known_size in enumerate(known_sizes):
                sizes = np.concatenate([known_size, np.array([len(x[side]) if x else 0 for x in found], np.int64)[::-1]])  # negative numbers count from the end
                sums = np.concatenate([[0], np.cumsum(sizes[flat_of])])
                totals.append(pa.array(sums[last] - sums[last - per_doc]))
            rest = both.columns(found)
            docs = pa.StructArray.from_arrays([batch.column(0), *totals, _lists(pa.array(flat_of.astype(np.int32)), per_doc)], ["doc_id", "n_a", "n_b", "of"])
            yield pa.record_batch([_lists(rest, np.array([len(rest)])), _lists(docs, np.array([len(docs)]))], ["pieces", "docs"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"pieces array<{PIECE}>, docs array<struct<doc_id: {kind}, n_a: bigint, n_b: bigint, of: array<int>>>"
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema)


_tables: dict[str, tuple] = {}


def _numbers(name: str, known) -> tuple[dict[str, int], list[np.ndarray], set[int]]:
    """Number of each known piece, their tokens on both sides, and the numbers of those not given back; built once in a worker."""
    if name not in _tables:
        at = known.value.column("at").to_numpy()
        order = np.argsort(at)
        sizes = [known.value.column(c).to_numpy()[order] for c in ("n_a", "n_b")]
        _tables.clear()
        _tables[name] = dict(zip(known.value.column("word").to_pylist(), at.tolist(), strict=True)), sizes, set(np.flatnonzero(sizes[0] == 0).tolist())
    return _tables[name]


def places(ends: Column, cuts: Column) -> Column:
    """For each cut, in order, the place (from 0) of the token that ends there; every cut is an end.

    In a short list the ends before each cut are counted (array_position leaves its loop by an
    exception, which takes longer). In a longer one ends with their places and cuts are
    sorted together, so that each cut follows its token, which takes no time squared.
    """
    looked_up = F.transform(cuts, lambda x: F.size(F.filter(ends, lambda end: end < x)))
    low = (1 << PLACE_BITS) - 1
    token = F.transform(ends, lambda x, i: F.shiftleft(x.cast("bigint"), PLACE_BITS).bitwiseOR(i.cast("bigint")))
    cut = F.transform(cuts, lambda x: F.shiftleft(x.cast("bigint"), PLACE_BITS).bitwiseOR(F.lit(low)))
    before = lambda both: F.transform(both, lambda x, i: F.when(x.bitwiseAND(low) == low, F.get(both, i - 1).bitwiseAND(low).cast("int")))
    merged = F.filter(let(F.sort_array(F.concat(token, cut)), before), lambda x: x.isNotNull())
    return F.when(F.size(ends) <= SHORT, looked_up).otherwise(merged)


def groups(piece: Column) -> Column:
    """array of struct(a, b): the ids of both sides between neighbouring common ends."""

    def between(side: str, at: Column, k: Column) -> Column:
        begin = F.when(k > 0, F.get(at, k - 1) + 1).otherwise(0)
        return F.transform(F.sequence(begin, F.get(at, k)), lambda i: F.get(piece[f"ids_{side}"], i)).alias(side)

    def cut(at_a: Column, at_b: Column) -> Column:
        return F.transform(at_a, lambda _, k: F.struct(between("a", at_a, k), between("b", at_b, k)))

    ends_a, ends_b = piece["ends_a"], piece["ends_b"]
    return let(F.array_intersect(ends_a, ends_b), lambda cuts: let(places(ends_a, cuts), lambda at_a: let(places(ends_b, cuts), lambda at_b: cut(at_a, at_b))))


def links(group: Column) -> Column:
    """All pairs of a group's ids, as a * 2^ID_BITS + b."""
    return F.flatten(F.transform(group["a"], lambda a: F.transform(group["b"], lambda b: F.shiftleft(a.cast("bigint"), ID_BITS).bitwiseOR(b.cast("bigint")))))


def group_text(group: Column) -> Column:
    """Like a1,a2|b1."""
    return F.concat(F.array_join(group["a"].cast("array<string>"), ","), F.lit("|"), F.array_join(group["b"].cast("array<string>"), ","))


def part_of(piece: Column) -> Column:
    """struct(n, text, links) of a piece's groups."""
    shown = lambda g: F.struct(F.size(g).cast("bigint").alias("n"), F.array_join(F.transform(g, group_text), ";").alias("text"), F.flatten(F.transform(g, links)).alias("links"))
    return let(groups(piece), shown)


def aligned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pieces_path: str | None = None, most_pieces: int = FREQUENT_PIECES, most_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """Every row of df, aligned: doc_id, n_a, n_b, n_groups, groups_text (like a1,a2|b1;a3|b2) and links (array of pairs).

    Texts that are null, empty or not given back byte for byte by one tokenizer have no
    tokens, no links and an empty groups_text. Ids are only carried along, so null, equal and
    repeated ones do no harm, and repeated rows are aligned each; an empty table gives an
    empty result; other columns of df are not read. Texts may be of any length: all steps
    but sorts take time in proportion to it.
    """
    paths = ranks_path or default_ranks(), pieces_path or default_pieces()
    common = frequent(settle(piece_counts(df, text_col)), most_pieces, most_bytes)
    parts = settle(numbered(common_pieces(common, *paths), "at", F.asc("word")).select("word", "n_a", "n_b", "at", part_of(F.col("piece")).alias("part")))
    sent = df.sparkSession.sparkContext.broadcast(parts.select("word", "n_a", "n_b", "at").toArrow().combine_chunks())  # of bounded number and bytes
    known = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]).alias("known")).scalar()
    rows = tokenised(df, id_col, text_col, sent, *paths).select("docs", F.transform("pieces", part_of).alias("rest"), known.alias("known"))
    part = lambda i: F.when(i >= 0, F.get("known", i)).otherwise(F.get("rest", -1 - i))

    def document(d: Column) -> Column:
        def of(parts: Column) -> Column:
            n_groups = F.aggregate(parts["n"], F.lit(0).cast("bigint"), lambda s, n: s + n)
            return F.struct(d["doc_id"].alias("doc_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), n_groups.alias("n_groups"), F.array_join(parts["text"], ";").alias("groups_text"), F.flatten(parts["links"]).alias("links"))

        return let(F.transform(d["of"], part), of)

    return rows.select(F.inline(F.transform("docs", document)))


def with_row(df: DataFrame) -> DataFrame:
    """df, written with a number of its own for each row."""
    return settle(df.withColumn("row", F.monotonically_increasing_id()))


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows of (links) hold each pair, and whether no pair with the same A id has more. Written."""
    counts = settle(linked.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.shiftright("pair", ID_BITS).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # a row for each A id, so the vocabulary bounds it
    return settle(counts.join(F.broadcast(most), a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def weighed(linked: DataFrame, counts: DataFrame, most_sent: int = SENT_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of every row of (row, links) with links, from the counts of its pairs.

    The pairs of the highest counts, in steps of doubling counts, are sent to all executors
    while there are at most `most_sent` of them; links of other pairs meet their counts in a
    shuffled join, where no pair is frequent.
    """
    step = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sent, least = 0, 64
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a row for each doubling
        sent += r["count"]
        if sent > most_sent:
            break
        least = r.step
    known = F.broadcast(counts.where(step >= least))
    each = linked.select("row", F.explode("links").alias("pair"))
    sums = lambda df: df.groupBy("row").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    found = sums(each.join(known, "pair"))
    rare = counts.where(step < least)
    if sent <= most_sent:
        return found
    other = each.join(known, "pair", "left_anti").groupBy("row", "pair").agg(F.count("*").alias("times")).join(rare, "pair")
    more = other.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return found.union(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def op12_query(spark, sf_dir: str) -> DataFrame:
    """Digest of the alignment of all documents, with the corpus-wide counts of their links."""
    found = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups_text", 256)).otherwise(F.lit(""))
    table = with_row(found.withColumns({"n_links": F.size("links").cast("bigint"), "groups_sha256": digest}).drop("groups_text"))
    sums = weighed(table.select("row", "links"), pair_counts(table))
    zero = F.lit(0).cast("bigint")
    return table.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
