"""Full-text search on token arrays; search_index has the same on an index."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound
from .udfs import stem_word, stemmed


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _words(part: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", part.lower()) if w]


def _phrase(toks: Column, words: list[str]) -> Column:
    if len(words) == 1:
        return F.array_contains(toks, words[0])
    return F.contains(F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))


def clauses(query: str, mode: str = "websearch") -> list[list[tuple[bool, list[str]]]]:
    """What a query asks for: every group, of which any part (minus: is forbidden, words that follow one another) is enough. Without words, no group.

    plain: all words. phrase: the words in a row. websearch: words and "phrases" are all asked for, `or` between
    two of them asks for either, a minus forbids.
    """
    if mode not in ("plain", "phrase", "websearch"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode != "websearch":
        words = _words(query)
        return [[(False, words)]] if words and mode == "phrase" else [[(False, [w])] for w in words]
    wanted: list[list[tuple[bool, list[str]]]] = []
    either = False
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if bare.lower() == "or" and not minus:
            either = bool(wanted)
            continue
        words = _words(quoted or bare)
        if words:
            if either:
                wanted[-1].append((bool(minus), words))
            else:
                wanted.append([(bool(minus), words)])
        either = False
    return wanted


def condition(toks: Column, query: str, mode: str = "websearch") -> Column:
    """A predicate on a token array: what clauses() asks for. A query without words finds nothing."""
    asked = clauses(query, mode)
    if not asked:
        return F.lit(False)
    part = lambda t, minus, words: ~_phrase(t, words) if minus else _phrase(t, words)
    return bound(toks, lambda t: reduce(Column.__and__, [reduce(Column.__or__, [part(t, *p) for p in group]) for group in asked]))


def may_match(text: Column, query: str, mode: str = "websearch") -> Column:
    """False only where condition() can't hold, since the text lacks words that are asked for: cheaper than tokens, and asked before them."""
    groups = [[words for _, words in group] for group in clauses(query, mode) if not any(minus for minus, _ in group)]
    if not groups:
        return F.lit(True)
    has = lambda low, words: reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in words])
    return bound(F.lower(text), lambda low: reduce(Column.__and__, [reduce(Column.__or__, [has(low, words) for words in group]) for group in groups]))


def text_search(df: DataFrame, text: str, query: str, mode: str = "websearch", lang: str | None = None) -> DataFrame:
    """Rows whose text meets the query. lang: compare word stems of that language; by default, words as they are."""
    toks = tokens(F.col(text))
    if lang is None:
        return df.where(may_match(F.col(text), query, mode) & condition(toks, query, mode))
    asked = re.sub(r"[^\W_]+", lambda m: m[0] if m[0].lower() == "or" else stem_word(m[0].lower(), lang), query)
    return df.withColumn("__toks", stemmed(toks, lang)).where(condition(F.col("__toks"), asked, mode)).drop("__toks")


def token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, pos): an inverted index to write once, partitioned by term."""
    return df.select(F.posexplode(tokens(F.col(text))).alias("pos", "term"), F.col(key)).select("term", key, "pos")
