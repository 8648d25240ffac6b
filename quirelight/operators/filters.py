"""Predicates as Columns. A comparison with NULL is not true, and so drops the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like_all(col: Column, patterns: list[str]) -> Column:
    return reduce(Column.__and__, [col.like(p) for p in patterns])


def like_any(col: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [col.like(p) for p in patterns])


def ilike_all(col: Column, patterns: list[str]) -> Column:
    return reduce(Column.__and__, [col.ilike(p) for p in patterns])


def ilike_any(col: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [col.ilike(p) for p in patterns])


def matches(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    return col.rlike(("(?i)" if ignore_case else "") + pattern)


def is_(col: Column, value: bool | None) -> Column:
    return col.isNull() if value is None else col.eqNullSafe(F.lit(value))


def is_distinct(col: Column, value: object) -> Column:
    return ~col.eqNullSafe(value if isinstance(value, Column) else F.lit(value))


def in_list(col: Column, values: list) -> Column:
    return col.isin(list(dict.fromkeys(values)))


def not_in_list(col: Column, values: list) -> Column:
    return ~in_list(col, values)


def contains_all(col: Column, values: list) -> Column:
    """The array has all of the values."""
    return F.size(F.array_except(F.array(*[F.lit(v) for v in values]), col)) == 0


def contained_by(col: Column, values: list) -> Column:
    """The array has none but the values."""
    return F.size(F.array_except(col, F.array(*[F.lit(v) for v in values]))) == 0


def json_contains(col: Column, wanted: dict[str, object]) -> Column:
    """The JSON object has all of the wanted fields with these values."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    parsed = F.try_parse_json(col)
    return reduce(Column.__and__, [F.try_variant_get(parsed, f"$.{k}", kinds[type(v)]) == F.lit(v) for k, v in wanted.items()])


def ranges_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Closed ranges that share a point."""
    return (lo1 <= hi2) & (lo2 <= hi1)


def range_right_of(lo1: Column, hi2: Column) -> Column:
    return lo1 > hi2


def range_left_of(hi1: Column, lo2: Column) -> Column:
    return hi1 < lo2


def range_not_left(lo1: Column, lo2: Column) -> Column:
    """Does not extend to the left of the other."""
    return lo1 >= lo2


def range_not_right(hi1: Column, hi2: Column) -> Column:
    return hi1 <= hi2


def ranges_adjacent(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Closed whole-number ranges with no point shared and none between."""
    return (hi1 + 1 == lo2) | (hi2 + 1 == lo1)


def match(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    return df.where(reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in wanted.items()]))


def any_of(conds: list[Column]) -> Column:
    return reduce(Column.__or__, conds)


_OPS = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v), "ilike": lambda c, v: c.ilike(v), "match": matches, "imatch": lambda c, v: matches(c, v, True), "is": is_, "isdistinct": is_distinct,
    "in": in_list, "cs": contains_all, "cd": contained_by,
}


def where_op(col: str, op: str, value: object) -> Column:
    """A predicate by operator name; a "not." before the name negates it."""
    negated, name = op.startswith("not."), op.removeprefix("not.")
    if name not in _OPS:
        raise ValueError(f"unknown operator {name!r}; there are {sorted(_OPS)}")
    cond = _OPS[name](F.col(col), value)
    return ~cond if negated else cond


def nonblank(col: Column, min_len: int = 10) -> Column:
    """Not null, and longer than min_len characters without the white space around it."""
    return F.coalesce(F.length(F.regexp_replace(col, r"^[\s ﻿]+|[\s ﻿]+$", "")) > min_len, F.lit(False))


def no_rows(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def grep(df: DataFrame, text_col: str, needle: str, order: str, limit: int | None = 50) -> DataFrame:
    """Rows whose text has the needle, in any case, literally; the first `limit` by order."""
    found = df.where(F.contains(F.lower(F.col(text_col)), F.lit(needle.lower())))
    return found if limit is None else found.orderBy(order).limit(limit)


def not_front_matter(text: Column, headings: list[str]) -> Column:
    """The upper-cased first 200 characters are not empty and begin with none of the headings."""
    head = F.upper(F.substring(F.trim(text), 1, 200))
    return (head != "") & ~any_of([head.startswith(h) for h in headings])


def optional_eq(df: DataFrame, col: str, value: object, every: object = "all") -> DataFrame:
    return df if value == every else df.where(F.col(col) == F.lit(value))


def flag_range(df: DataFrame, pos: str, lo: int, hi: int, out: str = "highlight") -> DataFrame:
    """Whether the row's position is in the range; lo = 0 marks nothing."""
    return df.withColumn(out, F.lit(lo > 0) & F.col(pos).between(lo, hi))
