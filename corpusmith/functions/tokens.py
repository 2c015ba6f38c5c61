"""Cutting text into the tokens that are searched."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_LOWER_UPPER = re.compile(r"([a-z0-9])([A-Z])")
_ACRONYM = re.compile(r"([A-Z]+)([A-Z][a-z])")
_JOINS = re.compile(r"[_\-./\\]+")
#: Han, Hiragana, Katakana and Hangul, which aren't spaced.
_UNSPACED = "ᄀ-ᇿ⺀-⿕々〇〡-〩〸-〻ぁ-ゖゝ-ゟァ-ヺヽ-ヿㄱ-ㆎㇰ-ㇿ㐀-䶿一-鿿ꥠ-ꥼ가-힣豈-﫿\U00020000-\U0003134f"
_RUN = re.compile(f"[{_UNSPACED}]+")
_WORD = re.compile(r"[^\W_]+")


def tokenize(text: str | None) -> list[str]:
    """The tokens of a text.

    Compatibility forms are unified, camel case and joined words are split, letters are lowered
    and stripped of accents; words of one character are dropped. Unspaced scripts give
    overlapping pairs of characters, or the character where there is only one. Null has none.
    """
    if not text:
        return []
    plain = unicodedata.normalize("NFKC", text)
    plain = _ACRONYM.sub(r"\1 \2", _LOWER_UPPER.sub(r"\1 \2", plain)).lower()
    plain = _RUN.sub(lambda m: f" {m.group()} ", _JOINS.sub(" ", plain))
    out: list[str] = []
    for word in _WORD.findall(plain):
        if _RUN.search(word):
            out += [word[i : i + 2] for i in range(len(word) - 1)] or [word]
            continue
        if not word.isascii():
            word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.category(c).startswith("M"))
        if len(word) >= 2:
            out.append(word)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens(text: pd.Series) -> pd.Series:
    """:func:`tokenize` of a column; null gives an empty array."""
    return text.map(tokenize)


def plain_tokens(text: Column) -> Column:
    """ASCII tokens by built-in functions alone: as :func:`tokenize` gives for texts in ASCII."""
    split = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.regexp_extract_all(F.lower(split), F.lit("([a-z0-9]+)"), 1)
    return F.coalesce(F.filter(words, lambda w: F.length(w) >= 2), F.array().cast("array<string>"))


def search_text(path: Column, symbol: Column, language: Column, content: Column) -> Column:
    """What is indexed of a chunk: path and symbol twice, language and content once."""
    return F.concat_ws("\n", path, path, symbol, symbol, language, content)
