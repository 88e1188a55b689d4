"""Regex specifications and string helpers used as Spark column expressions.

All patterns are written for Java regex (Spark) and are chosen so that an
RE2 engine gives the same matches (no look-around in the tokenizer).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word tokenizer: URLs, grouped numbers, words with inner hyphen/apostrophe,
# else any single non-space character.
WORD_TOKEN_RE = r"https?://\S+|\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{M}\p{N}]+(?:[-'’][\p{L}\p{M}\p{N}]+)*|\S"
URL_RE = r"^https?://"
NUMBER_RE = r"^\p{N}+(?:[.,]\p{N}+)*$"
PUNCT_RE = r"^\p{P}+$"
SYMBOL_RE = r"^\p{S}+$"
HYPHEN_SPLIT_RE = r"(?<=[\p{L}\p{M}\p{N}])-(?=[\p{L}\p{M}\p{N}])"


def glob_to_regex(glob: str) -> str:
    """Anchored Java/RE2 regex for a glob (``*`` any run, ``?`` one char)."""
    out = []
    for ch in glob:
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        else:
            out.append(re.escape(ch))
    return "^" + "".join(out) + "$"


def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def sql_str(s: str) -> str:
    """SQL string literal (single quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def array_lit(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def drop_token_regex(remove_numbers: bool, remove_punct: bool, remove_symbols: bool,
                     remove_url: bool) -> str | None:
    """One anchored regex matching every token class to drop (a single regex
    test per token instead of one per class)."""
    whole = []
    if remove_numbers:
        whole.append(NUMBER_RE[1:-1])
    if remove_punct:
        whole.append(PUNCT_RE[1:-1])
    if remove_symbols:
        whole.append(SYMBOL_RE[1:-1])
    alts = []
    if remove_url:
        alts.append(URL_RE[1:])
    if whole:
        alts.append("(?:" + "|".join(whole) + ")$")
    return ("^(?:" + "|".join(alts) + ")") if alts else None


def drop_token_filter(remove_numbers: bool, remove_punct: bool, remove_symbols: bool,
                      remove_url: bool):
    """Lambda for ``F.filter`` removing empty tokens and token classes by flag."""
    rx = drop_token_regex(remove_numbers, remove_punct, remove_symbols, remove_url)

    def keep(x: Column) -> Column:
        cond = x != F.lit("")
        return cond if rx is None else (cond & ~x.rlike(rx))

    return keep
