"""Text as Column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of words for the lexical index: letters and digits of any script, and the underscore.
TERM = r"[\p{L}\p{N}_]+"
#: The characters of white space, those of one byte in Latin-1 and those beyond.
NEAR_SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
FAR_SPACES = "\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The same as a class for Java's and RE2's regular expressions alike.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def terms(text: Column) -> Column:
    """Lower-cased index terms in order, with repetition."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), 0)


#: A class of single Latin-1 characters is one table look-up a character; what holds one of FAR is split at SPACE.
_NEAR = "[" + "".join(f"\\x{ord(c):02x}" for c in NEAR_SPACES) + "]"
_FAR = "[\u1680\u2000-\u3000]"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(NEAR_SPACES + FAR_SPACES))


def words(text: Column) -> Column:
    """White-space separated words in order."""
    known = F.coalesce(text, F.lit(""))
    return F.array_remove(F.when(F.rlike(known, F.lit(_FAR)), F.split(known, f"{SPACE}+")).otherwise(F.split(known, f"{_NEAR}+")), "")


def joined(items: Column) -> Column:
    return F.array_join(items, " ")


def truncated(text: Column, most: int, keep_short: bool = False) -> Column:
    """The first `most` words, single-spaced; keep_short leaves a text that is short enough as it is."""
    cut = joined(F.slice(words(text), 1, most))
    return F.when(F.size(words(text)) <= most, text).otherwise(cut) if keep_short else cut


def sentences(text: Column) -> Column:
    """Pieces between a full stop, question or exclamation mark and white space before a capital or digit."""
    parts = F.split(stripped(F.coalesce(text, F.lit(""))), rf"(?<=[.!?]){SPACE}+(?=[A-Z0-9])")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def runs(items: Column, k: int) -> Column:
    """All runs of k neighbouring items, joined; none if there are fewer items."""

    def of(x: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - k + 1, F.lit(1))), lambda i: joined(F.slice(x, i, k)))
        return F.when(F.size(x) >= k, made).otherwise(F.array().cast("array<string>"))

    return let(items, of)


def shingles(items: Column, k: int) -> Column:
    """Distinct k-word shingles as strings; fewer words give one shingle of all, none give none."""
    whole = lambda x: F.when(F.size(x) == 0, F.array().cast("array<string>")).when(F.size(x) < k, F.array(joined(x))).otherwise(F.array_distinct(runs(x, k)))
    return let(items, whole)


def json_object(text: Column) -> Column:
    """From the first { to the last }, or null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def json_array(text: Column) -> Column:
    """From the first [ to the last ], or null."""
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def normal_term(text: Column, collapse: bool = True) -> Column:
    """Stripped and lower-cased; white space inside collapsed unless told otherwise."""
    low = F.lower(stripped(text))
    return F.regexp_replace(low, f"{SPACE}+", " ") if collapse else low


def strings_of(variant: Column, nested: bool = False) -> Column:
    """A list-or-scalar JSON value as strings: a list's items, or a string split at commas; anything else is empty.

    nested: items may be objects, which stand for their name, or for their JSON text without one.
    """
    kind = F.schema_of_variant(variant)
    plain = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    named = lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.coalesce(F.try_variant_get(v, "$.name", "string"), F.to_json(v))).otherwise(plain(v))
    items = F.transform(F.try_variant_get(variant, "$", "array<variant>"), lambda v: stripped(named(v) if nested else plain(v)))
    parts = F.transform(F.split(F.try_variant_get(variant, "$", "string"), ","), stripped)
    chosen = F.when(F.startswith(kind, F.lit("ARRAY")), items).when(kind == "STRING", parts)
    return F.filter(F.coalesce(chosen, F.array().cast("array<string>")), lambda x: x != "")


def keywords(text: Column, key: str, nested: bool = False) -> Column:
    """The strings under `key` of the JSON object that a text is or holds; malformed or missing gives none."""
    whole = F.try_parse_json(text)
    inner = F.try_parse_json(json_object(text))
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    value = F.when(whole.isNotNull() & is_object(whole), whole).when(inner.isNotNull() & is_object(inner), inner)
    return strings_of(F.try_variant_get(value, f"$.{key}", "variant"), nested)


#: What stands in a report for a number that is not there yet.
PLACEHOLDER = "--"


def fixed(value: Column, places: int = 4) -> Column:
    """A number with so many places, or PLACEHOLDER."""
    return F.when(value.isNull(), F.lit(PLACEHOLDER)).otherwise(F.format_string(f"%.{places}f", value.cast("double")))


def mean_interval(mean: Column, low: Column, high: Column, percent: bool = False, places: int = 4) -> Column:
    """"mean [low, high]", as percentages with two places if asked; PLACEHOLDER without a mean."""
    shown = lambda x: F.format_string(f"%.{2 if percent else places}f", x.cast("double") * (100 if percent else 1))
    return F.when(mean.isNull(), F.lit(PLACEHOLDER)).otherwise(F.concat(shown(mean), F.lit(" ["), shown(low), F.lit(", "), shown(high), F.lit("]")))


def plus_minus(mean: Column, deviation: Column, places: int = 2) -> Column:
    return F.concat(fixed(mean, places), F.lit(" ± "), fixed(deviation, places))


def sign(value: Column) -> Column:
    """"+" for zero and above, else nothing, as the minus belongs to the number."""
    return F.when(value >= 0, "+").otherwise("")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in double precision; 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, F.lit(0.0)).otherwise(2 * a * b / (a + b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
