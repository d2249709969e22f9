"""Access to the public tokenizer files; their paths are parameters and nothing is copied."""

from __future__ import annotations

import base64
from functools import cache

import public_tokenizers


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def tokenizer_of(path: str):
    """The tokenizers library's model of a .json file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(string, id) of the special tokens of a .json file."""
    found = tokenizer_of(path).get_added_tokens_decoder()
    return tuple((token.content, i) for i, token in sorted(found.items()))


@cache
def fast_encoder(path: str, special: tuple[tuple[str, int], ...] = ()):
    """tiktoken's encoder over the same vocabulary: the same ids several times as fast."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens=dict(special))
