"""Vectorised Python functions, for what built-in functions cannot say."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemmers import STEMMERS

#: Words that a task lays out at a time.
WORDS_AT_ONCE = 250_000
# Inflectional endings by language code, longest first, for light stemming. A stem keeps three letters or more. STEMMERS has languages by name.
ENDINGS = {
    "nl": ("heden", "ingen", "eren", "en", "er", "es", "je", "e", "s"),
    "en": ("ingly", "edly", "ings", "ing", "ies", "ed", "ly", "es", "s"),
    "de": ("ungen", "ern", "em", "en", "er", "es", "e", "s"),
    "fr": ("ements", "ement", "euses", "euse", "eux", "es", "er", "e", "s"),
    "es": ("amente", "mente", "aciones", "ación", "iones", "os", "as", "es", "o", "a", "s"),
}


@F.pandas_udf(T.StringType())
def fold_all(texts: pd.Series) -> pd.Series:
    """Lower case without the combining marks U+0300 to U+036F, for letters of any script."""
    return texts.map(lambda t: re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", t)).lower(), na_action="ignore")


def stem_word(word: str, lang: str) -> str:
    """By the stemmer of a language's name ("english", "dutch"), or the light one of a code ("en", "nl", "de", "fr", "es")."""
    if lang in STEMMERS:
        return STEMMERS[lang](word)
    for ending in ENDINGS[lang]:
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            return word[: -len(ending)]
    return word


def pieces(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows that hold about `most` words together, so that a task's memory doesn't follow the rows of a batch. A row is never cut."""
    before = np.cumsum(lengths, dtype=np.int64) - lengths
    cuts = (np.flatnonzero(np.diff(before // most)) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(lengths)], strict=True) if len(lengths) else iter(())


def stemmed(tokens: Column, lang: str) -> Column:
    """A token array with each word as its stem. Words are stemmed once per batch, and stay in Arrow otherwise."""
    if lang not in ENDINGS and lang not in STEMMERS:
        raise ValueError(f"no stemmer for {lang!r}; there are {sorted([*ENDINGS, *STEMMERS])}")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stems(arrays: pa.Array) -> pa.Array:
        known: dict[str, str] = {}

        def of(word: str | None) -> str | None:
            if word is not None and word not in known:
                known[word] = stem_word(word, lang)
            return known.get(word)

        def piece(part: pa.Array) -> pa.Array:
            words = part.flatten().dictionary_encode()
            values = pa.array([of(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
            lengths = pc.fill_null(part.value_lengths(), 0).to_numpy(zero_copy_only=False)
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values, mask=part.is_null())

        lengths = pc.fill_null(arrays.value_lengths(), 0).to_numpy(zero_copy_only=False)
        return pa.concat_arrays([piece(arrays.slice(lo, hi - lo)) for lo, hi in pieces(lengths, WORDS_AT_ONCE)]) if len(arrays) else pa.array([], pa.list_(pa.string()))

    return stems(tokens)
