"""Byte-level BPE encoding and decoding.

Words are the matches of the tokenizer's pattern. Merging is a fold of Spark's higher-order
functions over the parts of a word, which are its bytes at first: each step merges the first
pair of least rank and looks up the pairs on both sides in a literal rank map. A word's merges do not depend on its neighbours, so the words that make
up most of the corpus are folded once each; how many those are is bounded by bytes, and
every other word is folded where it stands, which keeps the result whole without a table of
the whole vocabulary anywhere. Words always end at seams (see alignment), so the most frequent
pieces of several words between seams are known as a whole as well. The pattern searches only
other pieces, and of these only such as are not letters with a mark behind them at most.

Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.alignment import split
from fathomline.llm.common import byte_runs, frequent, let, settle
from fathomline.llm.tokens import default_ranks, ranks_of

#: Most words that are folded once for all documents, and their most bytes; about 50 MB in a worker.
FREQUENT_WORDS, FREQUENT_BYTES = 1 << 18, 1 << 22
#: Times that a piece of several words must come as often as a word to be known in its place: it spares a search, the word a fold.
PIECE_WEIGHT = 32
#: Words counted in a task before its counts are sent on.
COUNTED_AT_ONCE = 1 << 17
#: Rows put together at once after encoding and in decoding.
ROWS_AT_ONCE = 500
WIDTH, SHIFT = 16, 46  # bits of an id, and bits below a rank
NO_ID, NO_RANK = (1 << WIDTH) - 1, 1 << WIDTH
LANES = 64  # slots of the pairs with one first id
LOW = (1 << SHIFT) - 1  # of a part: place and id
MARKS = ".,;:!?"


class RankMap(NamedTuple):
    """Pairs (a, b) of ids without collision in one table, at b + shifts[slots[a] + b mod LANES].

    The entry of a pair holds its rank above SHIFT and the pair below it, a * 2^16 + b.
    first is that of first_parts.
    """

    slots: list[int]
    shifts: list[int]
    table: list[int]
    first: list[int]


@cache
def first_parts(path: str) -> np.ndarray:
    """At 257 * x + y the rank of two bytes x and y above the id of x; y is 256 behind the last byte."""
    ranks = ranks_of(path)
    rank = lambda x, y: ranks.get(bytes([x, y]), NO_RANK) if y < 256 else NO_RANK
    return np.array([(rank(x, y) << SHIFT) + ranks[bytes([x])] for x in range(256) for y in range(257)])


@cache
def rank_map(path: str) -> RankMap:
    """The pairs of ids whose bytes together are a token, with that token's rank.

    Each a takes slots drawn at random in which its pairs meet no other with the same b. From
    the fullest slot on, each takes the first shift, from a place drawn at random, at which
    all its entries meet free places; half of the places stay free.
    """
    ranks = ranks_of(path)
    if max(ranks.values()) >= NO_ID:
        raise ValueError(f"ids of {path} need more than {WIDTH} bits")
    rows: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                rows.setdefault(a, {})[b] = rank
    rng = np.random.default_rng(1)
    slots, shifts, members = [0] * (1 << WIDTH), [0] * ((1 << WIDTH) + LANES), {}
    for a in sorted(rows, key=lambda a: len(rows[a]), reverse=True):
        for slot in map(int, rng.integers(1 << WIDTH, size=1000)):
            if not any(b in members.get(slot + b % LANES, ()) for b in rows[a]):
                break
        else:
            raise RuntimeError(f"no slots for {len(rows[a])} pairs of {path}")
        slots[a] = slot
        for b, rank in rows[a].items():
            members.setdefault(slot + b % LANES, {})[b] = (rank << SHIFT) + (a << WIDTH) + b
    places = max(2 * sum(map(len, rows.values())), 256)
    table, tries = np.full(places + (1 << WIDTH), -1, np.int64), np.arange(256)[:, None]
    for slot in sorted(members, key=lambda slot: len(members[slot]), reverse=True):
        seconds, begin = np.array(list(members[slot])), int(rng.integers(places))
        for at in range(0, places, 256):
            shift = (begin + at + tries) % places
            fits = (table[shift + seconds] < 0).all(axis=1)
            if fits.any():
                shifts[slot] = int(shift[fits.argmax(), 0])
                break
        else:
            raise RuntimeError(f"no place for {len(seconds)} pairs of {path}")
        table[shifts[slot] + seconds] = list(members[slot].values())
    return RankMap(slots, shifts, table.tolist(), first_parts(path).tolist())


def _literal(values: list, kind: str) -> Column:
    """A list as one literal: the optimiser folds the parse of a constant."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _lets(values: list[Column], body: Callable[..., Column], *bound: Column) -> Column:
    """body over several values; a large literal bound so is in the plan once, however often it is used."""
    return let(values[0], lambda v: _lets(values[1:], body, *bound, v)) if values else body(*bound)


def merged(words: Column, path: str) -> Column:
    """Token ids of each byte array in an array of them."""

    def begin(first: Column) -> Column:
        part = lambda word, x, i: F.get(first, x * 257 + F.coalesce(F.get(word, i + 1), F.lit(256))) + F.shiftleft(i.cast("bigint"), WIDTH)
        return F.transform(words, lambda word: F.transform(word, lambda x, i: part(word, x, i)))

    parts = merged_parts(let(_literal(rank_map(path).first, "bigint"), begin), path)
    return F.transform(parts, lambda word: F.transform(word, _id_of))


def merged_parts(words: Column, path: str) -> Column:
    """The parts that are left of each array of parts in an array of them, after all merges.

    A part is one number: from the top the rank of the pair that it begins, the place of its
    first byte and its id. So the least number is the first pair of least rank.
    """
    known = rank_map(path)
    literals = [_literal(known.slots, "int"), _literal(known.shifts, "int"), _literal(known.table, "bigint")]
    return _lets(literals, lambda *tables: _folded(words, *tables))


def _id_of(part: Column) -> Column:
    return part.bitwiseAND(NO_ID).cast("int")


def _folded(words: Column, slots: Column, shifts: Column, table: Column) -> Column:
    def ranked(a: Column, b: Column) -> Column:
        """The rank of a pair in its place in a part."""
        entry = F.get(table, F.get(shifts, F.get(slots, a) + b.bitwiseAND(LANES - 1)) + b)
        pair = F.shiftleft(a.cast("bigint"), WIDTH) + b
        return let(entry, lambda e: F.when(e.bitwiseAND((1 << 2 * WIDTH) - 1) == pair, e - pair).otherwise(NO_RANK << SHIFT))

    def merge(state: Column, least: Column, at: Column) -> Column:
        """Replace the pair at a place by the token of its rank; only the pairs on both sides are looked up again.

        Parts are taken out and put in by their own functions: slice and concat copy an array several times.
        """

        def around(best: Column) -> Column:
            here = least.bitwiseAND(LOW - NO_ID) + best + ranked(best, _id_of(F.get(state, at + 1)))
            now = F.array_insert(F.array_remove(F.array_remove(state, F.get(state, at)), least), at, here)
            left = lambda part: F.array_insert(F.array_remove(now, part), at - 1, part.bitwiseAND(LOW) + ranked(_id_of(part), best))
            return F.when(at > 1, let(F.get(state, at - 2), left)).otherwise(now)

        return let(F.shiftright(least, SHIFT).cast("int"), around)

    def step(state: Column, _: Column) -> Column:
        """Merge the first pair of least rank, if any pair has one."""
        place = lambda part: part.bitwiseAND(LOW - NO_ID)
        at_of = lambda least: let(place(least), lambda p: F.size(F.filter(state, lambda x: x.bitwiseAND(LOW) < p)) + 1)  # noqa: E731 (array_position leaves its loop by an exception)
        found = lambda least: let(at_of(least), lambda at: merge(state, least, at))
        return let(F.array_min(state), lambda least: F.when(least < NO_RANK << SHIFT, found(least)).otherwise(state))

    def fold(word: Column) -> Column:
        steps = F.when(F.size(word) > 1, F.sequence(F.lit(2), F.size(word))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, word, step)

    return F.transform(words, fold)


def pieces_of(text: str | None) -> list[str]:
    """The pieces of a text between its seams, where matches of the pattern always end."""
    pieces = split(text)
    if pieces:
        pieces[0] = pieces[0][1:]  # the space that split puts before the text
    return pieces


def words_of(piece: str, matches: Callable[[str], list[str]]) -> list[str]:
    """The pattern's matches in a piece; letters with a mark behind them at most are not searched."""
    letters = piece[1:] if piece[:1] == " " else piece
    if letters.isalpha():
        return [piece]
    if letters[-1:] in MARKS and letters[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return matches(piece)


def unit_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n, several): pieces, with whether they hold several words, and the words of those that hold several, that come more than once among some 2^17 distinct pieces, with how often they do.

    Where there are as many pieces, those that come once are not searched for their words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matches, counts = regex.compile(public_tokenizers.PATTERN).findall, Counter()

        def repeated(least: int) -> pa.RecordBatch:
            units, pieces = Counter(), {}
            for piece, n in counts.items():
                if n >= least:
                    words = words_of(piece, matches)
                    if len(words) > 1 and n > 1:
                        pieces[piece] = n
                    for word in words:
                        units[word] += n
            found = [(w, n, False) for w, n in units.items() if n > 1] + [(w, n, True) for w, n in pieces.items()]
            return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*found, strict=True) if found else ((), (), ()), (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["word", "n", "several"])

        for column in (b.column(0).slice(i, j - i) for b in batches for i, j in byte_runs(b.column(0))):
            for text in column.to_pylist():
                counts.update(pieces_of(text))
                if len(counts) > COUNTED_AT_ONCE:
                    yield repeated(2)
                    counts.clear()
        yield repeated(1)

    return df.select(text_col).mapInArrow(count, "word string, n long, several boolean").groupBy("word", "several").agg(F.sum("n").alias("n"))


def common_units(counts: DataFrame, most_words: int, most_bytes: int) -> DataFrame:
    """(word): the units that are known to all tasks, those first that spare most."""
    weighed = F.when(F.col("several"), F.col("n") / PIECE_WEIGHT).otherwise(F.col("n"))
    return frequent(counts.withColumn("n", weighed), most_words, most_bytes)


def unit_words(units: DataFrame) -> DataFrame:
    """(word, parts): the bytes of the pattern's matches in each unit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matches = regex.compile(public_tokenizers.PATTERN).findall
        for batch in batches:
            words, ends = [], [0]
            for unit in batch.column(0).to_pylist():
                words += [w.encode() for w in matches(unit)]
                ends.append(len(words))
            yield pa.record_batch([batch.column(0), _nested(words, ends)], ["word", "parts"])

    return units.mapInArrow(cut, "word string, parts array<array<int>>")


def encode(df: DataFrame, text_col: str = "text", ranks_path: str | None = None, most_words: int = FREQUENT_WORDS, most_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """df without the text, with ids: each whole text's token ids (binary, unsigned 32-bit little-endian).

    A null or empty text has no ids. Special strings are ordinary text. Ties, repeated rows,
    empty tables and other columns (kept, but for one named ids) need nothing special. A
    word of n bytes takes up to n folding steps of n pairs, so only single words beyond some
    ten thousand bytes are slow; texts may have any length.
    """
    path = ranks_path or default_ranks()
    df = df.drop("ids")
    common = unit_words(common_units(settle(unit_counts(df, text_col)), most_words, most_bytes))
    folded = common.select("word", F.flatten(merged(F.col("parts"), path)).alias("ids")).toArrow()  # at most most_words rows
    name = uuid.uuid4().hex
    known = df.sparkSession.sparkContext.broadcast((folded.column("word").combine_chunks(), folded.column("ids").combine_chunks()))
    others, first = [c for c in df.columns if c != text_col], first_parts(path)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matches, table = regex.compile(public_tokenizers.PATTERN).findall, _table(name, known)
        for batch in (b.slice(i, j - i) for b in batches for i, j in byte_runs(b.column(b.schema.get_field_index(text_col)))):
            runs, rests, per_row, words_in_row = [], [], [0], [0]
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                pieces, run, at = pieces_of(text), [], 0
                found = list(map(table.get, pieces))
                for _ in range(found.count(None)):
                    to = found.index(None, at)
                    run += found[at:to]
                    for word in words_of(pieces[to], matches):
                        ids = table.get(word)
                        if ids is None:
                            runs.append(b"".join(run))
                            rests.append(word.encode())
                            run = []
                        else:
                            run.append(ids)
                    at = to + 1
                runs.append(b"".join(run + found[at:]))
                per_row.append(len(runs))
                words_in_row.append(len(rests))
            lists = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.array(runs, pa.binary()))
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in others), lists, _first(rests, words_in_row, first)], [*others, "__runs", "__rest"])

    def weave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            runs, rest = (batch.column(batch.schema.get_field_index(c)) for c in ("__runs", "__rest"))
            pieces, words = runs.flatten().to_pylist(), rest.flatten()
            flat = (words.flatten().to_numpy(zero_copy_only=False) & NO_ID).astype("<u4").tobytes()
            cuts = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(int) * 4
            out, p, w = [], 0, 0
            for n in runs.value_lengths().to_pylist():
                mixed = [pieces[p]]
                for i in range(1, n):
                    mixed += (flat[cuts[w] : cuts[w + 1]], pieces[p + i])
                    w += 1
                out.append(b"".join(mixed))
                p += n
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(out, pa.binary())], [*others, "ids"])

    kept = [df.schema[c] for c in others]
    rest = T.StructField("__rest", T.ArrayType(T.ArrayType(T.LongType())))
    partly = df.mapInArrow(look_up, T.StructType([*kept, T.StructField("__runs", T.ArrayType(T.BinaryType())), rest]))
    partly = partly.withColumn("__rest", merged_parts(F.col("__rest"), path))
    return partly.mapInArrow(weave, T.StructType([*kept, T.StructField("ids", T.BinaryType())]))


def decode(df: DataFrame, ids_col: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """df with raw (binary): the pieces of the packed ids, one after the other. Null ids are empty, an unknown id fails."""
    path = ranks_path or default_ranks()
    df = df.drop("raw")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        places, pieces = np.full(max(ranks.values()) + 1, -1), pa.array(ranks.keys(), pa.binary())
        places[list(ranks.values())] = np.arange(len(ranks))
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            for part in (batch.slice(i, j - i) for i, j in byte_runs(batch.column(batch.schema.get_field_index(ids_col)))):
                packed = [x or b"" for x in part.column(part.schema.get_field_index(ids_col)).to_pylist()]
                ids = np.frombuffer(b"".join(packed), "<u4")
                if ids.size and (ids.max() >= len(places) or places[ids].min() < 0):
                    raise KeyError(f"ids that {path} does not have")
                _, ends, values = pieces.take(pa.array(places[ids])).buffers()  # of all pieces, one after the other
                cuts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed], dtype=np.int64)])
                raw = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(np.frombuffer(ends, np.int32)[cuts]), values])
                yield part.append_column("raw", raw)

    return df.mapInArrow(join, T.StructType([*df.schema.fields, T.StructField("raw", T.BinaryType())]))


_tables: dict[str, dict[str, bytes]] = {}


def _table(name: str, known) -> dict[str, bytes]:
    """Word to packed ids, built once in a worker."""
    if name not in _tables:
        words, ids = known.value
        packed = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
        cuts = (ids.offsets.to_numpy() - ids.offsets[0].as_py()) * 4
        _tables.clear()
        table = {}
        for i in range(0, len(words), 4096):  # lists of all words and places would be 21 MB more
            ends = cuts[i : i + 4097].tolist()
            table |= {w: packed[a:b] for w, a, b in zip(words.slice(i, 4096).to_pylist(), ends, ends[1:], strict=False)}
        _tables[name] = table
    return _tables[name]


def _nested(words: list[bytes], rows: list[int]) -> pa.Array:
    """array<array<int>>: the bytes of each word, and where each row's words end."""
    values = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
    return _lists(values, _ends(words), rows)


def _first(words: list[bytes], rows: list[int], first: np.ndarray) -> pa.Array:
    """array<array<bigint>>: the parts that each word's fold starts from, and where each row's words end."""
    values, ends = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), _ends(words)
    behind = np.full(len(values), 256)
    behind[:-1] = values[1:]
    behind[ends[1:] - 1] = 256
    places = np.arange(len(values)) - np.repeat(ends[:-1], np.diff(ends))
    return _lists(first[values * 257 + behind] + (places << WIDTH), ends, rows)


def _ends(words: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(x) for x in words], dtype=np.int64)])


def _lists(values: np.ndarray, ends: np.ndarray, rows: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)))


def op5_query(spark, sf_dir: str) -> DataFrame:
    ids = settle(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))  # written, so that a task runs two Python workers and not three
    coded = decode(ids)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
