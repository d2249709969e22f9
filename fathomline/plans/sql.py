"""Pieces of SQL that several queries share, for DuckDB."""

from fathomline.functions.text import SPACE


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda x: x <> '')"


def terms(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sentences(x: str) -> str:
    cut = rf"regexp_replace({stripped(x)}, '([.!?]){SPACE}+([A-Z0-9])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {stripped('s')}), lambda s: s <> '')"
