"""English suffix stripping after Porter (1980), with the usual later extensions, for one word at a time.

It is run once for each distinct term; see `metrics.stemmed`.
"""

from __future__ import annotations

# The published rules of each step, as (suffix, replacement), in the order in which they are tried.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
REPAIRS = (("at", "ate"), ("bl", "ble"), ("iz", "ize"))
DOUBLE = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
SINGLE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
ENDINGS = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing",
    "canning": "canning", "cannings": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """How often consonants follow vowels."""
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Whether a word ends in consonant, vowel and a consonant other than w, x and y, or is a vowel and a consonant."""
    shape = _shape(word)
    return shape == "vc" or (shape.endswith("cvc") and word[-1] not in "wxy")


def _ending(word: str, rules: tuple[tuple[str, str], ...]) -> tuple[str, str] | None:
    """(stem, replacement) by the first rule whose suffix the word has."""
    return next(((word[: len(word) - len(old)], new) for old, new in rules if word.endswith(old)), None)


def _without_tense(word: str) -> str:
    if word.endswith("ied"):
        return word[:-3] + ("ie" if len(word) == 4 else "i")
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    cut = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x) and "v" in _shape(word[: -len(x)])), None)
    if cut is None:
        return word
    if found := _ending(cut, REPAIRS):
        return "".join(found)
    if len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c":
        return cut if cut[-1] in "lsz" else cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _short(cut) else cut


def _double(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _double(word[:-2])
    found = _ending(word, DOUBLE)
    if found is None and word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return "".join(found) if found and _measure(found[0]) > 0 else word


def _without_ending(word: str) -> str:
    found = _ending(word, tuple((x, "") for x in ENDINGS))
    if found is None or _measure(found[0]) < 2 or (word.endswith("ion") and found[0][-1] not in "st"):
        return word
    return found[0]


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif found := _ending(word, PLURALS):
        word = "".join(found)
    word = _without_tense(word)
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _double(word)
    if (found := _ending(word, SINGLE)) and _measure(found[0]) > 0:
        word = "".join(found)
    word = _without_ending(word)
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
