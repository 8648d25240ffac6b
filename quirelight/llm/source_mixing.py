"""Mixing sources to target weights, by temperature; DataFrame functions only.

The token shares p of the sources are raised to an exponent a in [0, 1] and normalised. a = 1 keeps
the corpus as it is, a = 0 makes all sources equal; in between, the entropy of the weights falls as a
grows, and so does the most often any source has to be repeated. Bisection over a grid of 2^-20
finds the largest a whose entropy reaches the target, and then, if some source would be repeated
more than max_repeats times, the smallest a that keeps within it. The budget of a source is its weight
times the whole budget. It is realised as passes over the source: every document floor(budget /
tokens) times, and the rest from a permutation of the source's blocks, within the block that the rest
ends in from a permutation of its documents, as long as the tokens fit.

Blocks hold about block_docs documents of one source, chosen by a hash of id and text, so a source with a third of
all rows is many blocks, and so are rows that share one id; more than block_docs rows that are alike in all are told apart by a number of their own. Sums over a source's blocks go in two steps, over 4,096 ranges of blocks and over the blocks of a range, so that
only a block's documents, a range's blocks and a source's ranges are ever ordered together.
The bisection runs as aggregates over the per-source table, five halvings to a job; no source list
comes to the driver.

Defined cases: a null source is a source of its own; null or wordless texts have no tokens and are used 0
times, as are all documents of a source without tokens; rows that repeat a doc_id are each used by
themselves; ties in the permutation are broken by id, tokens and a hash of the text; an empty table gives an empty result. Only the id,
the text and the source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Entropy to reach, as a share of the way from the corpus' own entropy to that of equal weights.
TARGET_LIFT = 0.5
MAX_REPEATS = 4.0
BLOCK_DOCS = 1000
SEED = "mix-1"
GRID_BITS = 20
HALVINGS_PER_JOB = 5


def token_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_key(doc_id: str, text: str) -> Column:
    """The permutation's key: 32 hex digits of a hash of the seed, the id and the text, so that rows that share an id, or have none, lie in all blocks."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def _spread(d: DataFrame, most: int) -> DataFrame:
    """d, where rows that are alike in source, id and text, if they are more than `most`, have a key for each; which of them is used is then open, and they are alike."""
    alike = d.groupBy(F.col("src").alias("hs"), F.col("key").alias("hk")).agg(F.count(F.lit(1)).alias("alike")).where(F.col("alike") > most)
    met = d.join(alike, d["src"].eqNullSafe(F.col("hs")) & (d["key"] == F.col("hk")), "left")
    own = F.when(F.col("alike").isNotNull(), F.md5(F.concat("key", F.col("row").cast("string")))).otherwise(F.col("key"))
    return met.withColumn("key", own).select("src", "id", "n_tokens", "key", "th")


def _number(key: Column, start: int) -> Column:
    return F.conv(F.substring(key, start, 8), 16, 10).cast("long")


def _entropy(p: Column, a: Column) -> list[Column]:
    """Sums from which the entropy of normalised p^a follows: S = sum p^a and L = sum p^a * ln p^a."""
    w = F.pow(p, a)
    return [F.sum(w), F.sum(w * F.log(w))]


def bisect_grid(table: DataFrame, holds: str, sums, value, bits: int = GRID_BITS) -> int:
    """The largest j in [0, 2^bits] for which value(*sums at a = j / 2^bits) holds, where it holds up to some j; 0 if never.

    holds: ">=" with value's second result. Each job evaluates all inner points of HALVINGS_PER_JOB halvings.
    """
    low, high = 0, 1 << bits  # holds at low (or nowhere)
    if value(*_row(table, sums, [high], bits)[0]):
        return high
    while high - low > 1:
        step = max(1, (high - low) >> HALVINGS_PER_JOB)
        points = list(range(low + step, high, step))
        ok = [value(*r) for r in _row(table, sums, points, bits)]
        n = next((i for i, x in enumerate(ok) if not x), len(points))
        low, high = (points[n - 1] if n else low), (points[n] if n < len(points) else high)
    return low


def _row(table: DataFrame, sums, points: list[int], bits: int) -> list[tuple]:
    cells = [c for j in points for c in sums(F.lit(j / (1 << bits)))]
    row = table.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
    k = len(cells) // len(points)
    return [tuple(row[i * k : i * k + k]) for i in range(len(points))]


def mixing_exponent(sources: DataFrame, target_lift: float = TARGET_LIFT, max_repeats: float = MAX_REPEATS, budget_x: float = 1.0) -> float:
    """The exponent. sources: (tokens), one row per source with tokens."""
    import math

    total, n = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not total:
        return 1.0
    p = F.col("tokens") / F.lit(total)
    s1, l1 = _row(sources, lambda a: _entropy(p, a), [1 << GRID_BITS], GRID_BITS)[0]
    own = math.log(s1) - l1 / s1
    target = own + target_lift * (math.log(n) - own) - 1e-9
    j = bisect_grid(sources, ">=", lambda a: _entropy(p, a), lambda s, l: math.log(s) - l / s >= target)
    # times that a source is repeated: budget_x * p^a / S / p
    too_often = lambda s, m: budget_x * m / s > max_repeats
    repeats = lambda a: [F.sum(F.pow(p, a)), F.max(F.pow(p, a) / p)]
    if too_often(*_row(sources, repeats, [j], GRID_BITS)[0]):
        j = min(1 << GRID_BITS, bisect_grid(sources, "<=", repeats, too_often) + 1)
    return j / (1 << GRID_BITS)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", target_lift: float = TARGET_LIFT, max_repeats: float = MAX_REPEATS, budget_x: float = 1.0, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Per row: id, source, n_tokens, source_weight, block, and copies: how often the mixture has the document.

    budget_x: the mixture's tokens as a multiple of the corpus' own.
    """
    key = order_key(doc_id, text)
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("src"), token_count(text).alias("n_tokens"), key.alias("key"), F.xxhash64(text).alias("th"))
    d = checkpointed(d)
    per = checkpointed(d.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    live = per.where("tokens > 0")
    a = mixing_exponent(live, target_lift, max_repeats, budget_x)
    total, norm = live.agg(F.sum("tokens"), F.sum(F.pow(F.col("tokens") / F.lit(live.agg(F.sum("tokens")).first()[0] or 1), F.lit(a)))).first()
    total, norm = total or 0, norm or 1.0
    weight = F.when(F.col("tokens") > 0, F.round(F.pow(F.col("tokens") / F.lit(total or 1), F.lit(a)) / F.lit(norm), 9)).otherwise(F.lit(0.0))
    plan = per.select("src", "tokens", weight.alias("source_weight"), F.ceil(F.col("docs") / F.lit(block_docs)).cast("long").alias("n_blocks"))
    budget = F.floor(F.col("source_weight") * F.lit(int(total * budget_x))).cast("long")
    plan = plan.withColumn("budget", budget)
    plan = plan.select("src", "source_weight", "n_blocks", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long").alias("passes"), F.when(F.col("tokens") > 0, F.pmod("budget", "tokens")).otherwise(0).cast("long").alias("rest"))
    d = _spread(d, block_docs)
    x = d.join(plan, d["src"].eqNullSafe(plan["src"])).select(d["src"], "id", "n_tokens", "key", "th", "source_weight", "passes", "rest", F.pmod(_number(F.col("key"), 1), F.col("n_blocks")).alias("block"))
    x = x.withColumn("block_key", F.md5(F.concat(F.lit(SEED + ":b"), F.col("block").cast("string"))))

    blocks = checkpointed(x.groupBy("src", "block", "block_key").agg(F.sum("n_tokens").alias("block_tokens")).withColumn("range", F.substring("block_key", 1, 3)))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("src", "range").agg(F.sum("block_tokens").alias("range_tokens"))
    ranges = ranges.select(F.col("src").alias("rs"), F.col("range").alias("rr"), F.coalesce(F.sum("range_tokens").over(before("src").orderBy("range")), F.lit(0)).alias("before_range"))
    in_range = F.coalesce(F.sum("block_tokens").over(before("src", "range").orderBy("block_key", "block")), F.lit(0))
    blocks = blocks.withColumn("in_range", in_range).join(ranges, blocks["src"].eqNullSafe(ranges["rs"]) & (blocks["range"] == ranges["rr"]))
    blocks = blocks.select(F.col("src").alias("bs"), F.col("block").alias("bb"), (F.col("before_range") + F.col("in_range")).alias("before"))
    y = x.join(blocks, x["src"].eqNullSafe(blocks["bs"]) & (x["block"] == blocks["bb"]))
    in_block = Window.partitionBy("src", "block").orderBy("key", "id", "n_tokens", "th").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("before") + F.sum("n_tokens").over(in_block) <= F.col("rest")
    copies = F.when(F.col("n_tokens") > 0, F.col("passes") + F.when(fits, 1).otherwise(0)).otherwise(0).cast("long")
    return y.select(F.col("id").alias(doc_id), F.col("src").alias(source), "n_tokens", "source_weight", "block", copies.alias("copies"))
