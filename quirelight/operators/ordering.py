"""Orders, pages and cardinality. Every order that limits rows ends in a unique column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_key(col: str, ascending: bool = True, nulls: str | None = None) -> Column:
    c = F.col(col)
    if nulls is None:
        return c.asc() if ascending else c.desc()
    return getattr(c, f"{'asc' if ascending else 'desc'}_nulls_{nulls}")()


def order(df: DataFrame, keys: list[tuple[str, bool, str | None]]) -> DataFrame:
    """df by (column, ascending, nulls first/last/None) keys."""
    return df.orderBy(*[order_key(*k) for k in keys])


def order_embedded(col: Column, field: str, descending: bool = False) -> Column:
    """An array of structs, by one field."""

    def compare(a: Column, b: Column) -> Column:
        less, more = (1, -1) if descending else (-1, 1)
        return F.when(a[field] < b[field], less).when(a[field] > b[field], more).otherwise(0)

    return F.array_sort(col, compare)


def limit_embedded(col: Column, n: int) -> Column:
    return F.slice(col, 1, n)


def page(df: DataFrame, keys: list, first: int, last: int) -> DataFrame:
    """Rows first to last of the order, both included and counted from 0."""
    return df.orderBy(*keys).offset(first).limit(last - first + 1)


def search_page(df: DataFrame, cond: Column, keys: list, first: int, last: int) -> DataFrame:
    """A page of the rows that meet cond, each with the number of all that do. The total is an aggregate of its own."""
    found = df.where(cond)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return page(found, keys, first, last).join(F.broadcast(total))  # total is one row


def single(df: DataFrame) -> DataFrame:
    """df, or an error unless it has exactly one row."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError("no row where one is asked for" if n == 0 else "more than one row where one is asked for")
    return df


def maybe_single(df: DataFrame) -> DataFrame:
    """df, or an error if it has more than one row."""
    if df.limit(2).count() > 1:
        raise ValueError("more than one row where one at most is asked for")
    return df


def top_k(df: DataFrame, score: str, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *ties).limit(k)


def order_with_default(df: DataFrame, col: str, default: object, then: list[str]) -> DataFrame:
    """df by a column in which null counts as the default."""
    return df.orderBy(F.coalesce(F.col(col), F.lit(default)), *then)


def recent(df: DataFrame, ts: str, ties: list[str]) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), *ties)


def canonical_order(df: DataFrame, book: str, chapter: str, verse: str) -> DataFrame:
    return df.orderBy(book, chapter, verse)
