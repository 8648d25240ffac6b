"""Named functions over data, and table functions for SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .structure import alias_keys, reference_candidates
from .text import SPACES

_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {}


def register_function(name: str, fn: Callable[..., DataFrame]) -> None:
    _FUNCTIONS[name] = fn


def call_function(name: str, *, count_only: bool = False, **args) -> DataFrame:
    """The relation that the named function returns, to filter and order like any other; or its row count alone."""
    if name not in _FUNCTIONS:
        raise KeyError(f"no function {name!r}; there are {sorted(_FUNCTIONS)}")
    df = _FUNCTIONS[name](**args)
    return df.agg(F.count(F.lit(1)).alias("n")) if count_only else df


def register_table_functions(spark: SparkSession) -> None:
    """For LATERAL joins in SQL: text_lines(text): rows (pos, line); text_paragraphs(text): rows (pos, para), as structure.paragraphs() gives them. Both are SQL alone."""
    trim = lambda x: f"btrim({x}, r'{SPACES}')"
    some = lambda a: f"filter(transform({a}, p -> {trim('p')}), p -> p <> '')"
    once = lambda value, name, then: f"transform(array({value}), {name} -> {then})[0]"
    pieces = some("regexp_extract_all(t, r'(?s).{249,499}[.!?](?=\\s|$)|.{1,500}', 0)")
    short = f"CASE WHEN length(t) >= 600 THEN {pieces} ELSE {some('array(t)')} END"
    lines = once(some("split(t, r'\\n')"), "l", f"CASE WHEN size(l) > 1 THEN l ELSE {short} END")
    blocks = once(some("split(t, r'\\n[ \\t]*\\n\\s*')"), "b", f"CASE WHEN size(b) > 1 THEN b ELSE {lines} END")
    paras = once(trim("text"), "t", f"CASE WHEN contains(t, '\n') THEN {blocks} ELSE {short} END")
    kept = "filter(split(text, '\\n'), x -> trim(x) <> '')"
    for name, column, array in (("text_lines", "line", kept), ("text_paragraphs", "para", paras)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE (pos INT, {column} STRING) RETURN SELECT * FROM posexplode({array})")


def register_references(spark: SparkSession, aliases: DataFrame, name: str = "refs") -> None:
    """For LATERAL joins in SQL: refs(text): one row (book, chapter, start, end) for a text that is a reference, none for others, as structure.parse_refs() gives them.

    The aliases' keys are a view that the function joins, so that neither they nor the texts pass through Python or the driver; Spark plans the lateral join as
    a join of distinct texts. LEFT JOIN LATERAL refs(text) keeps the other texts.
    """
    alias_keys(aliases).createOrReplaceTempView(f"{name}_keys")
    book = f"CASE WHEN c.exact THEN {name}_keys.own ELSE {name}_keys.name END"
    best = f"SELECT min_by(named_struct('book', {book}, 'chapter', c.chapter, 'start', c.start, 'end', c.end), named_struct('n', c.n, 'tier', tier, 'name', {book})) AS r FROM explode({reference_candidates('text')}) AS e(c) JOIN {name}_keys ON {name}_keys.key = c.key WHERE {book} IS NOT NULL"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE (book STRING, chapter INT, start INT, `end` INT) RETURN SELECT r.book, r.chapter, r.start, r.`end` FROM ({best}) WHERE r IS NOT NULL")
