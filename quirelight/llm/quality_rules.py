"""Quality rules as a short-circuit cascade.

Each rule is a pure test of one text. A bounded sample measures what every rule costs and how
often it rejects; the cascade then runs the rules by rejections per second, and stops at the first
that rejects. The order changes the time only, never a verdict, since a text is kept if no rule
rejects it.

Defined cases: a null text is an empty one, and has no words; empty texts fail min_words; equal
rows get equal results, one each; an empty table gives an empty result; columns other than the id
and the text are not read.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_text

_NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
_NO_LETTERS = bytes(sorted(set(range(0x80)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz \t\n\x0b\x0c\r")))
_BULLET = re.compile(rb"(?m)^[ \t]*(?:\xe2\x80\xa2|[*-])[ \t]")
_ELLIPSIS = re.compile(rb"(?m)(?:\.\.\.|\xe2\x80\xa6)[ \t\x0b-\r]*$")
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(b"#*$%&|<>")))
#: Rows that the cost and selectivity sample holds on average.
SAMPLE_ROWS = 2000


class TextFeatures:
    """Features of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str):
        self.data = text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # bytes split at \x20 and \x09-\x0d

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data.translate(None, _NOT_COUNTED))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data.translate(None, _NOT_SYMBOLS))

    @cached_property
    def n_shouts(self) -> int:
        return self.data.count(b"!!")

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_letter_words(self) -> int:
        """Words with a letter; bytes beyond ASCII count as letters."""
        return len(self.data.translate(None, _NO_LETTERS).split())

    @cached_property
    def n_bullets(self) -> int:
        return len(_BULLET.findall(self.data))

    @cached_property
    def n_ellipses(self) -> int:
        """Lines that end in an ellipsis."""
        return len(_ELLIPSIS.findall(self.data))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, n)
        pairs = ids[:-1] * len(seen) + ids[1:]
        if len(seen) >= 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, group, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[group] > 1)
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[at + k] = True
        return int(hit.sum())


Rule = tuple[str, Callable[[TextFeatures], bool]]

#: The two rules of base_failed.
BASE_RULES: list[Rule] = [
    ("min_words", lambda f: f.n_words < 50),
    ("repeat_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
]
RULES: list[Rule] = [
    *BASE_RULES,
    ("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    ("shouts", lambda f: 10 * f.n_shouts > 3 * f.n_words),
    ("dup_lines", lambda f: 10 * f.n_dup_lines > 3 * f.n_lines),
    ("letters", lambda f: 10 * f.n_letter_words < 8 * f.n_words),
    ("bullets", lambda f: 10 * f.n_bullets > 9 * f.n_lines),
    ("ellipses", lambda f: 10 * f.n_ellipses > 3 * f.n_lines),
    ("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 15 * f.n_words),
]


def measure(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[dict]:
    """Per rule: rows, rejected rows and seconds on a sample of about sample_rows rows.

    Each rule is timed on fresh features, and so pays for all that it needs.
    """
    n = docs.count()
    sample = docs if n <= sample_rows else docs.sample(sample_rows / n, seed)

    def make() -> Callable[[str], tuple]:
        def fn(t: str) -> tuple:
            took, hit = [], []
            for _, test in rules:
                began = time.perf_counter()
                hit.append(int(test(TextFeatures(t))))
                took.append(time.perf_counter() - began)
            return hit, took

        return fn

    fields = [T.StructField("hit", T.ArrayType(T.LongType())), T.StructField("took", T.ArrayType(T.DoubleType()))]
    seen = per_text(sample, [], text, fields, make)
    sums = [F.count(F.lit(1)).alias("n")]
    for i in range(len(rules)):
        sums += [F.sum(F.col("hit")[i]).alias(f"h{i}"), F.sum(F.col("took")[i]).alias(f"s{i}")]
    row = seen.agg(*sums).first()
    return [{"rule": name, "rows": row["n"], "rejected": row[f"h{i}"] or 0, "seconds": row[f"s{i}"] or 0.0} for i, (name, _) in enumerate(rules)]


def cascade_order(measured: list[dict]) -> list[str]:
    """Rule names, most rejections per second first; ties by fewer seconds, then by name."""
    return [m["rule"] for m in sorted(measured, key=lambda m: (-m["rejected"] / max(m["seconds"], 1e-9), m["seconds"], m["rule"]))]


def ordered_rules(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, **sampling) -> list[Rule]:
    by = dict(rules)
    return [(name, by[name]) for name in cascade_order(measure(docs, text, rules, **sampling))]


def first_rejection(f: TextFeatures, rules: list[Rule]) -> str | None:
    return next((name for name, test in rules if test(f)), None)


def keep_column(rules: list[Rule], text: str = "text") -> Column:
    """Boolean column: no rule rejects the text. Features are computed only as far as the cascade comes."""

    @F.pandas_udf(T.BooleanType())
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([first_rejection(TextFeatures(t or ""), rules) is None for t in texts], dtype=bool)

    return keep(F.coalesce(F.col(text), F.lit("")))


def filter_documents(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects."""
    return docs.filter(keep_column(ordered_rules(docs, text, rules), text))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Per row: the id, the features that the base asks for, base_failed and kept. What only other rules need is computed as far as the cascade comes."""
    order = ordered_rules(docs, text, rules)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = dict(BASE_RULES)

    def make() -> Callable[[str], tuple]:
        def fn(t: str) -> tuple:
            f = TextFeatures(t)
            failed = any(test(f) for test in base.values())
            return (*(getattr(f, c) for c in counts), failed, not failed and first_rejection(f, order) is None)

        return fn

    fields = [T.StructField(c, T.LongType()) for c in counts] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    return per_text(docs, [doc_id], text, fields, make)
