"""Joins of corpus relations. Sides are broadcast where Spark knows them to be small; nothing here forces it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def embed(df: DataFrame, dim: DataFrame, on: tuple[str, str], cols: list[str], name: str, how: str = "left") -> DataFrame:
    """df with the matching row of dim as a struct column; how="inner" drops rows without one.

    on: (column of df, key of dim). A name may be used for one role, so a dimension can be embedded more than once.
    """
    child, parent = on
    d = dim.select(F.col(parent).alias("__key"), F.struct(*cols).alias(name))
    return df.join(d, F.col(child) == F.col("__key"), how).drop("__key")


def semi(df: DataFrame, keys: DataFrame, on: tuple[str, str]) -> DataFrame:
    return df.join(keys.select(F.col(on[1]).alias("__key")), F.col(on[0]) == F.col("__key"), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: tuple[str, str]) -> DataFrame:
    return df.join(keys.select(F.col(on[1]).alias("__key")), F.col(on[0]) == F.col("__key"), "left_anti")


def lookup_any(df: DataFrame, dim: DataFrame, value: str, names: list[str], dim_id: str, out: str = "found_id") -> DataFrame:
    """df with the smallest id of dim of which one of the columns `names` equals df's value; one equi-join, no OR."""
    alias = dim.select(F.col(dim_id).alias("__id"), F.explode(F.array(*[F.col(n).cast("string") for n in names])).alias("__name"))
    alias = alias.where(F.col("__name").isNotNull()).groupBy("__name").agg(F.min("__id").alias(out))
    return df.join(alias, F.col(value) == F.col("__name"), "left").drop("__name")


#: Widths of the position bins of range joins. A range takes the first by which it lies in RANGE_BINS bins or fewer, or the last.
BIN_WIDTHS, RANGE_BINS = (64, 64 << 7, 64 << 14, 64 << 21), 128


def _whole(df: DataFrame, *cols: str) -> bool:
    return all(df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in cols)


def range_join(refs: DataFrame, units: DataFrame, on: list[str], lo: str, hi: str, pos: str) -> DataFrame:
    """Units whose position lies in a reference's range.

    Where positions are whole numbers, units are dealt by group and bin of positions, and a reference goes to the bins of its range: so a hot group is many tasks, and a unit
    meets the references of its own stretch alone. Long ranges, if there are any, are first cut to their group's ends, and take wider bins. Other positions are an
    equi-join on the group, with the range as residual predicate.
    """
    if not _whole(refs, lo, hi) or not _whole(units, pos):
        return refs.join(units, on).where(F.col(pos).between(F.col(lo), F.col(hi)))
    real = refs.where(F.col(lo) <= F.col(hi)).withColumns({"__lo": F.col(lo), "__hi": F.col(hi)})
    long = F.col("__hi").cast("double") - F.col("__lo").cast("double") >= BIN_WIDTHS[0] * (RANGE_BINS - 1)
    placed, used = real, BIN_WIDTHS[:1]
    if real.where(long).limit(1).count():
        ends = units.groupBy(*on).agg(F.min(pos).alias("__first"), F.max(pos).alias("__last"))
        cut = real.join(ends, on).withColumns({"__lo": F.greatest("__lo", "__first"), "__hi": F.least("__hi", "__last")}).where("__lo <= __hi").drop("__first", "__last")
        placed, used = real.where(~long).unionByName(cut.where(F.col(lo).isNotNull() & (F.col(hi).cast("double") - F.col(lo).cast("double") >= BIN_WIDTHS[0] * (RANGE_BINS - 1)))), BIN_WIDTHS
    width = F.lit(used[-1])
    for w in used[-2::-1]:
        width = F.when(F.col("__hi") - F.col("__lo") < w * (RANGE_BINS - 1), F.lit(w)).otherwise(width)
    bins = F.sequence(F.floor(F.col("__lo") / F.col("__width")), F.floor(F.col("__hi") / F.col("__width")))
    placed = placed.withColumn("__width", width).withColumn("__bin", F.explode(bins)).drop("__lo", "__hi")
    dealt = units.withColumn("__width", F.explode(F.array(*[F.lit(w) for w in used])) if len(used) > 1 else F.lit(used[0])).withColumn("__bin", F.floor(F.col(pos) / F.col("__width")))
    return placed.join(dealt, [*on, "__width", "__bin"]).where(F.col(pos).between(F.col(lo), F.col(hi))).drop("__width", "__bin")


def range_join_clamped(refs: DataFrame, units: DataFrame, on: list[str], lo: str, hi: str, pos: str) -> DataFrame:
    """range_join, but a range that begins after the group's end gets the group's last unit."""
    ends = units.groupBy(*on).agg(F.max(pos).alias("__last"))
    clamped = refs.join(ends, on).withColumn(lo, F.least(F.col(lo), F.col("__last")))
    return range_join(clamped.withColumn(hi, F.greatest(F.col(hi), F.col(lo))).drop("__last"), units, on, lo, hi, pos)


def interval_overlap(passages: DataFrame, selection: DataFrame, group: str, start: str, end: str, end_group: str, pos: str, width: int = 1 << 12) -> DataFrame:
    """Passages that meet the selected positions of their group.

    A passage whose end is missing, in another group, or before its start is its start alone. Where positions are whole numbers, this is a sweep: each passage finds the next
    selected position at or after its start, within its stretch of `width` positions or as the first of a later stretch, and no task holds a group.
    """
    real = (F.col(end_group) == F.col(group)) & (F.col(end) >= F.col(start))
    p = passages.withColumn("__hi", F.when(real, F.col(end)).otherwise(F.col(start)))
    s = selection.select(F.col(group).alias("__g"), F.col(pos).alias("__p"))
    if not _whole(passages, start, end) or not _whole(selection, pos):
        return p.join(s, (F.col(group) == F.col("__g")) & F.col("__p").between(F.col(start), F.col("__hi")), "left_semi").drop("__hi")
    stretch = lambda c: F.floor(F.col(c) / F.lit(width))
    s = s.where("__g is not null and __p is not null").withColumn("__b", stretch("__p"))
    p = p.where(F.col(group).isNotNull() & F.col(start).isNotNull())
    every = s.distinct().unionByName(p.withColumns({"__g": F.col(group), "__b": stretch(start)}), allowMissingColumns=True)
    at = F.coalesce("__p", F.col(start))
    ahead = F.min("__p").over(Window.partitionBy("__g", "__b").orderBy(at).rangeBetween(Window.currentRow, Window.unboundedFollowing))
    swept = every.withColumn("__next", ahead).where("__p is null")
    firsts = s.groupBy("__g", "__b").agg(F.min("__p").alias("__first"))
    turns = firsts.unionByName(p.select(F.col(group).alias("__g"), stretch(start).alias("__b")).distinct(), allowMissingColumns=True).groupBy("__g", "__b").agg(F.min("__first").alias("__first"))
    later = turns.select(F.col("__g").alias("__h"), F.col("__b").alias("__c"), F.min("__first").over(Window.partitionBy("__g").orderBy("__b").rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    met = swept.join(later, (F.col("__g") == F.col("__h")) & (F.col("__b") == F.col("__c")))
    return met.where(F.coalesce("__next", "__later") <= F.col("__hi")).select(*passages.columns)


def context(df: DataFrame, group: str, pos: str, text: str, n: int = 1, out: str = "context") -> DataFrame:
    """Each unit's text with those of the n before and after it in its group, joined by spaces."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(-n, n)
    return df.withColumn(out, F.array_join(F.collect_list(text).over(w), " "))


def neighbours(edges: DataFrame, selected: DataFrame, src: str, dst: str, votes: str, k: int) -> DataFrame:
    """The k edges with the most votes that lead out of selected nodes; ties by destination, then source."""
    return semi(edges, selected, (src, src)).orderBy(F.col(votes).desc(), dst, src).limit(k)


def cited_by(proofs: DataFrame, questions: DataFrame, selected: DataFrame, unit: str, question: str) -> DataFrame:
    """Questions that cite a selected unit, each once, with its first such unit."""
    first = semi(proofs, selected, (unit, unit)).groupBy(question).agg(F.min(unit).alias("first_unit"))
    return questions.join(first, question)


def count_children(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """parent with the number of rows of each child relation; none is 0. Children are counted before they are joined."""
    for name, (child, child_key) in children.items():
        counts = child.groupBy(F.col(child_key).alias("__key")).agg(F.count(F.lit(1)).alias(name))
        parent = parent.join(counts, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return parent


def order_by_lookup(df: DataFrame, dim: DataFrame, on: tuple[str, str], value: str, then: list[str]) -> DataFrame:
    """df ordered by a value found in dim (none counts as 0), then by its own columns."""
    d = dim.select(F.col(on[1]).alias("__key"), F.col(value).alias("__value"))
    joined = df.join(d, F.col(on[0]) == F.col("__key"), "left").withColumn("lookup", F.coalesce("__value", F.lit(0)))
    return joined.drop("__key", "__value").orderBy("lookup", *then)


def grouped_left(units: DataFrame, notes: DataFrame, on: tuple[str, str], item: Column, out: str = "items", keep_empty: bool = True) -> DataFrame:
    """Every unit with the sorted list of its notes' items; units without notes keep their place, or go."""
    lists = notes.groupBy(F.col(on[1]).alias("__key")).agg(F.sort_array(F.collect_list(item)).alias(out))
    kind = lists.schema[out].dataType
    joined = units.join(lists, F.col(on[0]) == F.col("__key"), "left" if keep_empty else "inner").drop("__key")
    return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast(kind)))


def plan_join(plan: DataFrame, books: DataFrame, units: DataFrame, name: str, book_id: str, book_name: str, chapter: str, pos: str, text: str) -> DataFrame:
    """Plan rows (name, chapter, lo, hi) with the texts of their units in order; null where there are none."""
    ids = plan.join(books.select(F.col(book_id).alias("__book"), F.col(book_name).alias("__name")), F.col(name) == F.col("__name"), "left").drop("__name")
    found = ids.join(units, (F.col("__book") == units[book_id]) & (F.col("plan_chapter") == units[chapter]) & units[pos].between(F.col("lo"), F.col("hi")))
    texts = found.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct(pos, text))).alias("__t"))
    return plan.join(texts.select("plan_id", F.array_join(F.col(f"__t.{text}"), " ").alias("texts")), "plan_id", "left")


def match_entities(queries: DataFrame, query_id: str, text: str, entities: DataFrame, entity_id: str, name: str) -> DataFrame:
    """(query, entity) for each entity whose name's words, of one or two, follow one another in the query; any case."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9#]+"), lambda w: w != "")
    q = queries.select(F.col(query_id).alias("query_id"), words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(F.col("w"), i - 1), F.get(F.col("w"), i)))
    grams = q.select("query_id", F.explode(F.array_distinct(F.concat("w", pairs))).alias("gram"))
    e = entities.select(F.col(entity_id).alias("entity_id"), F.lower(F.col(name)).alias("gram"))
    return grams.join(e, "gram").select("query_id", "entity_id").distinct()
