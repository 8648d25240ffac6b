"""Windows over groups, and the packing of texts into pages."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound
from .folds import fold_groups, summed_up


def dedup_prefer(df: DataFrame, keys: list[str], prefer: Column, order: list) -> DataFrame:
    """One row per key: the first of those that are preferred, else the first."""
    w = Window.partitionBy(*keys).orderBy(prefer.desc_nulls_last(), *order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def _whole(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() in ("byte", "short", "integer", "long")


def neighbours_in_group(df: DataFrame, group: str, order: str, width: int = 1 << 16) -> DataFrame:
    """df with the previous and next value of order in the group.

    Where order is a whole number, groups are cut into stretches of `width` values; only the first and last value of each stretch meet over the whole group.
    """
    if not _whole(df, order):
        w = Window.partitionBy(group).orderBy(order)
        return df.withColumns({"prev": F.lag(order).over(w), "next": F.lead(order).over(w)})
    stretch = F.floor(F.col(order) / F.lit(width))
    w = Window.partitionBy(group, "__b").orderBy(order)
    inside = df.withColumn("__b", stretch).withColumns({"__prev": F.lag(order).over(w), "__next": F.lead(order).over(w), "__rn": F.row_number().over(w), "__up": F.lead(F.lit(1)).over(w)})
    ends = df.groupBy(F.col(group).alias("__g"), stretch.alias("__c")).agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    over = Window.partitionBy("__g").orderBy("__c")
    edges = ends.select("__g", "__c", F.lag("hi").over(over).alias("__before"), F.lead("lo").over(over).alias("__after"))
    met = inside.join(edges, F.col(group).eqNullSafe(F.col("__g")) & F.col("__b").eqNullSafe(F.col("__c")))
    prev, following = F.when(F.col("__rn") == 1, F.col("__before")).otherwise(F.col("__prev")), F.when(F.col("__up").isNull(), F.col("__after")).otherwise(F.col("__next"))
    return met.select(*df.columns, prev.alias("prev"), following.alias("next"))


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int = 3) -> DataFrame:
    """The first n rows of each group, with their rank and the group's whole size.

    The size comes from its own aggregate: a rank filter alone lets Spark cut groups before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    first = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    sizes = df.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.count(F.lit(1)).alias("group_size"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
    return first.join(sizes, same).drop(*[f"__{g}" for g in group])


def ordinal(df: DataFrame, group: str, order: str, out: str = "ordinal", width: int = 1 << 16) -> DataFrame:
    """df with each row's number in its group, from 1.

    Where order is a whole number, groups are numbered by buckets of `width` values, shifted by the sizes of the buckets before them, so that no task sorts a group.
    """
    if df.schema[order].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(order)))
    bucket = F.floor(F.col(order) / F.lit(width))
    numbered = df.withColumn("__b", bucket).withColumn("__rn", F.row_number().over(Window.partitionBy(group, "__b").orderBy(order)))
    sizes = df.groupBy(F.col(group).alias("__g"), bucket.alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__g", "__c", (F.sum("__n").over(Window.partitionBy("__g").orderBy("__c")) - F.col("__n")).alias("__before"))
    met = numbered.join(before, F.col(group).eqNullSafe(F.col("__g")) & F.col("__b").eqNullSafe(F.col("__c")))
    return met.withColumn(out, (F.col("__rn") + F.col("__before")).cast("long")).select(*df.columns, out)


def runs(df: DataFrame, part: str, order: list[str], key: str, width: int = 1 << 16) -> DataFrame:
    """(part, run, key, n, first, last): consecutive rows with the same key; a key may come again in a later run.

    Where order begins with a whole number, parts are cut into stretches of `width` values. A stretch gives its own runs; over a whole part only the stretches' summaries
    meet (their first and last key, and how many runs), which say where a run goes on into the next stretch, and runs of one number are then summed up.
    """
    cut = F.floor(F.col(order[0]) / F.lit(width)) if _whole(df, order[0]) else F.lit(0)
    rows = df.select(F.col(part).alias("part"), cut.alias("b"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("key"))
    w = Window.partitionBy("part", "b").orderBy(*[f"o{i}" for i in range(len(order))])
    change = F.when(F.lag("key").over(w).eqNullSafe(F.col("key")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("c", change).withColumn("own", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = numbered.groupBy("part", "b", "own", "key").agg(F.count(F.lit(1)).alias("n"), F.min("o0").alias("first"), F.max("o0").alias("last"))
    sums = own.groupBy(F.col("part").alias("__p"), F.col("b").alias("__b")).agg(F.max("own").alias("runs"), F.min_by(F.struct("key"), "own").alias("head"), F.max_by(F.struct("key"), "own").alias("tail"))
    over = Window.partitionBy("__p").orderBy("__b")
    joins = F.coalesce(F.lag("tail").over(over)["key"].eqNullSafe(F.col("head.key")) & F.lag("tail").over(over).isNotNull(), F.lit(False)).cast("int")
    turns = sums.withColumn("joins", joins).withColumn("before", F.sum(F.col("runs") - F.col("joins")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("runs"))
    met = own.join(turns.select("__p", "__b", "before"), F.col("part").eqNullSafe(F.col("__p")) & F.col("b").eqNullSafe(F.col("__b")))
    whole = met.groupBy("part", (F.col("own") + F.col("before")).alias("run"), "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.select(F.col("part").alias(part), "run", F.col("key").alias(key), "n", "first", "last")


def page_starts(sizes: Column, budget: int) -> Column:
    """Where each page begins: a new one when the page is not empty and the item would not fit. Only pages are collected, so that the work is linear in the items."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, size: Column) -> Column:
        turn = (acc["used"] > 0) & (acc["used"] + size > budget)
        used = F.when(turn, size.cast("long")).otherwise(acc["used"] + size)
        starts = F.when(turn, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"])
        return F.struct(used.alias("used"), (acc["i"] + 1).alias("i"), starts.alias("starts"))

    return F.aggregate(sizes, start, step, lambda acc: acc["starts"])


def pack_lines(df: DataFrame, text: str, budget: int = 2400, sep: str = "\n") -> DataFrame:
    """df exploded to pages of one text's lines: (…, page, n_lines, page_text). Works inside the row, without a shuffle."""

    def pages(p: Column) -> Column:
        end = lambda i: F.coalesce(F.get(p["starts"], i + 1), F.size(p["lines"]))
        return F.transform(p["starts"], lambda s, i: F.slice(p["lines"], s + 1, end(i) - s))

    lines = F.split(F.col(text), sep)
    cut = bound(lines, lambda a: F.struct(a.alias("lines"), page_starts(F.transform(a, lambda x: F.length(x)), budget).alias("starts")))
    out = df.select(*df.columns, F.posexplode(bound(cut, pages)).alias("__i", "__page"))
    return out.select(*df.columns, (F.col("__i") + 1).alias("page"), F.size("__page").alias("n_lines"), F.array_join("__page", "\n").alias("page_text"))


def _page_step(state: tuple[int, int], size: int, budget: int) -> tuple[tuple[int, int], int]:
    used, page = state
    size = size or 0
    used, page = (size, page + 1) if used > 0 and used + size > budget else (used + size, page)
    return (used, page), page


def _packing(sizes: np.ndarray, budget: int) -> tuple:
    """What blocks of these sizes do to a page that is filled up to some room before them.

    least, used, turns: from `least` on (descending) the first page turn is at one block, after which, at the end, `used` is filled and `turns` pages were turned; with less
    before them none is turned, and `total` comes on top. empty_used, empty_turns: the same for an empty page, which no block turns.
    """
    n, p = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
    over = np.searchsorted(p, p[:-1] + budget, side="right") - 1  # first block with which a page begun at each block is too full
    turn = np.maximum(over, np.arange(n) + 1)
    turn = np.where((turn < n) & (p[np.minimum(turn, n)] == p[:-1]), turn + 1, turn).tolist()  # a page that is still empty isn't turned
    ends, used, turns = p.tolist(), [0] * (n + 1), [0] * (n + 1)
    for j in range(n - 1, -1, -1):
        k = turn[j]
        used[j], turns[j] = (used[k], turns[k] + 1) if k < n else (ends[n] - ends[j], 0)
    # the first turn of a page that is filled before: at the first block j with filled + p[j + 1] > budget
    firsts = [j for j in range(n) if ends[j] <= budget and (j == 0 or ends[j + 1] > ends[j])]
    first = firsts[: next((i + 1 for i, j in enumerate(firsts) if ends[j + 1] >= budget), len(firsts))]
    empty = 0
    while empty < n and not sizes[empty]:
        empty += 1
    k = turn[empty] if empty < n else n
    whole = (used[k], turns[k] + 1) if k < n else (ends[n], 0)
    return [max(budget - ends[j + 1] + 1, 1) for j in first], [used[j] for j in first], [turns[j] + 1 for j in first], ends[n], *whole


def _packed_step(state: tuple[int, int], least: list[int], used: list[int], turns: list[int], total: int, empty_used: int, empty_turns: int) -> tuple[tuple[int, int], dict]:
    filled, page = state
    if filled == 0:
        after = (empty_used, page + empty_turns)
    else:
        k = next((k for k, x in enumerate(least) if filled >= x), None)
        after = (filled + total, page) if k is None else (used[k], page + turns[k])
    return after, {"filled": filled, "page": page}


def pack_pages(df: DataFrame, group: str, order: list[str], size: Column, budget: int = 1800, width: int = 1 << 16) -> DataFrame:
    """df with each block's page in its group, greedily filled in order. Blocks of unknown size take no room.

    Where the first order column is a whole number, a group is cut into parts of `width` values of it: tasks sum up what each part does to the page before it, these sums
    are folded in order, and then the parts are filled side by side. So no task gets a group.
    """
    sized = df.withColumn("__size", F.greatest(size.cast("long"), F.lit(0)))
    if df.schema[order[0]].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return fold_groups(sized, [group], order, ["__size"], (0, 1), lambda state, n: _page_step(state, n, budget), "page", T.IntegerType()).drop("__size")
    parts = sized.withColumn("__part", F.floor(F.col(order[0]) / F.lit(width)))
    sums = summed_up(parts, [group, "__part"], order, "__size", lambda sizes: _packing(sizes, budget), "least array<long>, used array<long>, turns array<long>, total long, empty_used long, empty_turns long")
    before = T.StructType([T.StructField("filled", T.LongType()), T.StructField("page", T.LongType())])
    folded = fold_groups(sums, [group], ["__part"], ["least", "used", "turns", "total", "empty_used", "empty_turns"], (0, 1), _packed_step, "__before", before)
    known = folded.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), "__before.*")
    met = parts.join(known.hint("merge"), F.col(group).eqNullSafe(F.col("__g")) & F.col("__part").eqNullSafe(F.col("__p")))
    met = met.select(*df.columns, "__size", "__part", F.col("filled").alias("__filled"), F.col("page").alias("__page"))

    def step(state: tuple[int, int] | None, n: int, filled: int, page: int) -> tuple[tuple[int, int], int]:
        return _page_step((filled, page) if state is None else state, n, budget)

    out = fold_groups(met, [group, "__part"], order, ["__size", "__filled", "__page"], None, step, "page", T.IntegerType())
    return out.select(*df.columns, "page")


def pack_paragraphs(df: DataFrame, group: str, order: str, text: str, budget: int = 1800, header: int = 0) -> DataFrame:
    """Paragraphs of a group's texts packed into pages: (group, order, pos, paragraph, page). header: size of a title before each text."""
    paras = df.select(group, order, F.posexplode(F.filter(F.split(text, "\n\n+"), lambda p: F.length(F.trim(p)) > 0)).alias("pos", "paragraph"))
    size = F.length("paragraph") + F.when(F.col("pos") == 0, header).otherwise(0)
    return pack_pages(paras, group, [order, "pos"], size, budget)


def locate_page(pages: DataFrame, group: str, entry: str, wanted: DataFrame) -> DataFrame:
    """(request, page): the page of the wanted entry, else of the wanted unit, else the page asked for, else 1.

    pages: (group, entry, unit, page). wanted: (request, group, want_entry, want_unit, want_page).
    """
    by_entry = pages.select(F.col(group).alias("__g"), F.col(entry).alias("__e"), F.col("page").alias("__pe"))
    by_unit = pages.groupBy(F.col(group).alias("__h"), F.col("unit").alias("__u")).agg(F.min("page").alias("__pu"))
    out = wanted.join(by_entry, (F.col(group) == F.col("__g")) & (F.col("want_entry") == F.col("__e")), "left").join(by_unit, (F.col(group) == F.col("__h")) & (F.col("want_unit") == F.col("__u")), "left")
    return out.select("request", F.coalesce("__pe", "__pu", "want_page", F.lit(1)).alias("page"))


def list_rank(col: Column, values: list[str], last: int = 99) -> Column:
    """The value's place in the list, from 1; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), col), F.lit(0)), F.lit(last))


def pick_first(df: DataFrame, group: list[str], conds: list[Column], order: list) -> DataFrame:
    """One row per group: the first that meets the first condition that any meets, else the first."""
    rank = F.lit(len(conds))
    for i in range(len(conds) - 1, -1, -1):
        rank = F.when(conds[i], i).otherwise(rank)
    w = Window.partitionBy(*group).orderBy(rank, *order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def daily_pick(df: DataFrame, order: str, days: DataFrame, day: str, width: int = 1 << 16) -> DataFrame:
    """For each day, the row of df whose number (from 0, by the whole-number column `order`) is day of year mod n.

    Rows are numbered without one global window: buckets of `width` values are numbered on their own and shifted by
    the sizes of the buckets before them, of which there is one row each.
    """
    parts = df.withColumn("__b", F.floor(F.col(order) / F.lit(width)))
    parts = parts.withColumn("__rn", F.row_number().over(Window.partitionBy("__b").orderBy(order)) - 1)
    sizes = df.groupBy(F.floor(F.col(order) / F.lit(width)).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    wanted = days.join(F.broadcast(total)).withColumn("__pick", F.pmod(F.dayofyear(day).cast("long"), F.col("__total")))  # total is one row
    numbered = parts.join(before, "__b").withColumn("__pick", F.col("__rn") + F.col("__before"))
    return wanted.join(numbered, "__pick").drop("__b", "__rn", "__before", "__total", "__pick")
