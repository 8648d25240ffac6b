"""Near-duplicate groups by DartMinHash (Christiani, 2020) over weighted five-word shingles.

A text is a weighted set: its five-word shingles (lower-cased, split at white space; a text of
fewer words is one shingle), weighted by how often it has them. The weight axis of an element is
cut into unit regions, one per occurrence. Every region has its own Poisson process of darts along
the rank axis, drawn from a hash of the region alone; all darts of rank below theta = t / weight
hit, with t = k ln k + 2k, and each falls on one of k coordinates. The earliest dart of each
coordinate is its signature value, so two texts agree on a coordinate with a probability equal to
their weighted Jaccard similarity, at a cost of about weight + t darts instead of weight * k.
Where a coordinate stays empty, theta is doubled; darts drawn before keep their ranks.

Signatures are cut into bands. Texts with equal weighted sets are one node from the start, so that a
group of copies costs one row per member and never a pair. In a band bucket each node is compared
with two centres only: the member whose buckets are the most populous (which is near the middle of a cloud
of copies), and one nearly as popular, drawn by hash. Compared pairs are checked exactly (weighted Jaccard >= threshold), and checked
pairs are linked into components: tasks join the edges they hold, and alternating large-star and small-star steps join what
tasks hold apart. No step gathers a group, and the pairs are linear in the rows. Hot buckets meet partial aggregates, and joins with
what these give; that is written before it is joined, because Spark splits a skewed join only where both sides come straight from a shuffle.

The members of buckets that then still hold more than one component are compared
exactly, by a prefix filter: with each text's unit regions in one order for all texts, rare ones first, texts that reach the
threshold share a region among their first |x| - ceil(threshold |x|) + 1. Members of different components that share
one, and pass the bounds on lengths and positions, are checked. A region shared by many is cut into salted blocks, and
every two blocks meet in a cell of their own, so that no task holds a group; nothing is capped or left out. Only
where hundreds of texts share their rare regions and yet stay apart do the pairs grow with the square of their number.
So a pair that reaches the threshold is missed only if it shares no band at all.

Every table between two jobs is written to the shared folder, which cuts lineage and keeps plans small, and removed when
nothing reads it any more; what the returned table reads stays.

Defined cases: a row's class is that of its text, whatever its doc_id, so that rows that share a doc_id with different texts
may be in different classes, and no text is lost; the class id is the smallest doc_id of the class (two classes may then bear the
same one); of several rows that could stand for a class, one does; rows with a null doc_id have no class
(null) and are never dropped; texts without words (null, empty, blank) are only like themselves,
each its own class; an empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS_AT_ONCE, Scratch, per_text

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5  # a pair at 0.8 shares no band with a probability of 1.5e-5
BLOCK = 256  # holders of a region that are compared in one cell
FOREST = 500_000  # nodes of the forest that a task holds while it joins edges
_SLOTS = 1 << 18  # counters of unit regions; regions that share one are only ordered less well

_GOLD, _M1, _M2, _FOLD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x100000001B3))


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to unit regions: one 64-bit hash for each occurrence of each shingle, sorted, all distinct."""

    def __init__(self, words: int = SHINGLE_WORDS):
        self.words, self.hashes = words, {}

    def _hashes(self, text: str) -> np.ndarray:
        known = self.hashes
        if len(known) > 200_000:
            known.clear()
        words = text.lower().split()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        w = self._hashes(text)
        k = min(self.words, len(w))
        if not k:
            return w
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h = h * _FOLD + w[j : len(w) - k + 1 + j]
        h = np.sort(_mix(h))
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        nth = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
        return np.sort(_mix(h + nth.astype(np.uint64) * _GOLD))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' unit regions."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def dart_signature(units: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each of k coordinates; units must not be empty."""
    theta = (k * np.log(k) + 2 * k) / len(units)
    while True:
        rank, dart = _darts(units, theta)
        coordinate = (_mix(dart + _GOLD) % np.uint64(k)).astype(np.int64)
        last_first = np.argsort(rank)[::-1]
        signature, found = np.zeros(k, np.uint64), np.zeros(k, bool)
        signature[coordinate[last_first]] = dart[last_first]
        found[coordinate] = True
        if found.all():
            return signature
        theta *= 2


def _darts(units: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Rank and id of every dart of rank below theta. A region's n-th gap is a hash of the region and n."""
    ranks, darts = [], []
    reached, at = np.zeros(len(units)), 0
    while len(units):
        ahead = int(min(max(1, theta + 2 * theta**0.5), 1 + (1 << 20) // len(units)))
        nth = np.arange(at, at + ahead, dtype=np.uint64) * _GOLD
        ids = _mix(units[:, None] ^ _mix(nth + _M2)[None, :])
        gaps = -np.log(((_mix(ids) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
        rank = np.cumsum(gaps, axis=1) + reached[:, None]
        inside = rank < theta
        ranks.append(rank[inside])
        darts.append(ids[inside])
        more = inside[:, -1]
        units, reached, at = units[more], rank[more, -1], at + ahead
    return np.concatenate(ranks), np.concatenate(darts)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(bands, dtype=np.uint64) * _GOLD
    for column in signature.reshape(bands, rows).T:
        h = _mix(h * _FOLD + column)
    return h.astype(np.int64)


def signatures(rows: DataFrame, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """(row, id, h1, h2: content hash, null without words; bands: array of keys) of each of rows (row, id, t)."""

    def make() -> Callable[[str], tuple]:
        shingle = Shingler()

        def fn(t: str) -> tuple:
            units = shingle(t)
            if not len(units):
                return None, None, []
            with np.errstate(over="ignore"):
                keys = band_keys(dart_signature(units, bands * rows_per_band), bands, rows_per_band)
            h = xxhash.xxh3_128_intdigest(units.tobytes())
            return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), np.unique(keys)

        return fn

    fields = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return per_text(rows, ["row", "id"], "t", fields, make)


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast, so that the plan is the same at every size."""
    return side.hint("merge")


def shared_buckets(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, node, pop) of the buckets with more than one node. pop: sizes of all the node's buckets together. nodes: (node, bands)."""
    keyed = nodes.select("node", F.explode("bands").alias("k"))
    counted = scratch.keep(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = scratch.keep(keyed.join(merged(counted), "k"))
    popular = shared.groupBy("node").agg(F.sum("n").alias("pop"))
    out = scratch.keep(shared.select("k", "node").join(merged(popular), "node"))
    scratch.drop(counted, shared)
    return out


def _centre(nth: int) -> Column:
    """Aggregate: a bucket's nth centre: the most popular member for 0; then, drawn by hash, one that is nearly as popular."""
    noise = F.pmod(F.xxhash64("node", "k", F.lit(nth)), F.lit(1 << 20)) / F.lit(5.0 * (1 << 20)) if nth else F.lit(0.0)
    return F.max(F.struct((F.col("pop") * (1 + noise)).alias("p"), "node"))["node"]


def centre_pairs(shared: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct (a, b, low), a < b, of each bucket's members with its two centres; low: the centre is a."""
    centres = scratch.keep(shared.groupBy("k").agg(F.array_distinct(F.array(_centre(0), _centre(1))).alias("cs")))
    met = shared.join(merged(centres), "k").select("node", F.explode("cs").alias("c")).where("node <> c")
    pairs = met.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"), (F.col("c") < F.col("node")).alias("low"))
    out = scratch.keep(pairs.groupBy("a", "b").agg(F.max("low").alias("low")))
    scratch.drop(centres)
    return out


def unsettled(shared: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the nodes in buckets that hold more than one component. Buckets of two nodes are settled, since one is the other's centre."""
    labelled = scratch.keep(shared.select("k", "node").join(merged(roots), "node", "left").withColumn("root", F.coalesce("root", "node")))
    sizes = labelled.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    mixed = scratch.keep(sizes.where("n > 2 and r1 <> r2").select("k"))
    out = scratch.keep(labelled.join(merged(mixed), "k", "left_semi").select("node", "root").distinct())
    scratch.drop(labelled, mixed)
    return out


def unit_counts(texts: DataFrame) -> np.ndarray:
    """How many unit regions of the texts (t) fall into each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, n = Shingler(), np.zeros(_SLOTS, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for t in batch.column(0):
                    n += np.bincount(_slot(shingle(t.as_py())), minlength=_SLOTS)
        slots = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n[slots])], names=["slot", "n"])

    total = texts.select("t").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_SLOTS, np.int64)
    counts[total["slot"].to_numpy()] = total["n"].to_numpy()
    return counts


def _slot(units: np.ndarray) -> np.ndarray:
    return (units % np.uint64(_SLOTS)).astype(np.int64)


def rare_prefixes(texts: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """(u, node, root, size, place) of the unit regions u of which texts (node, root, t) that reach the threshold share one."""
    kind = texts.schema["node"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch, us, sizes, places, rows = whole.slice(at, ROWS_AT_ONCE), [], [], [], []
                with np.errstate(over="ignore"):
                    for i, t in enumerate(batch.column(2)):
                        units = shingle(t.as_py())
                        n = len(units)
                        first = units[np.lexsort((units, counts[_slot(units)]))][: n - _least(threshold * n) + 1]
                        us.append(first.astype(np.int64))
                        places.append(np.arange(len(first)))
                        sizes.append(np.full(len(first), n))
                        rows.append(np.full(len(first), i))
                if us:
                    rows = pa.array(np.concatenate(rows))
                    columns = [pa.array(np.concatenate(us)), batch.column(0).take(rows), batch.column(1).take(rows)]
                    columns += [pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(places).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["u", "node", "root", "size", "place"])

    long = T.LongType()
    fields = [("u", long), ("node", kind), ("root", kind), ("size", long), ("place", long)]
    return texts.select("node", "root", "t").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in fields]))


def _least(x: float | np.ndarray) -> int | np.ndarray:
    """The smallest whole number that is not below x, but for the error of the product."""
    up = np.ceil(x - 1e-6)
    return int(up) if np.ndim(up) == 0 else up


def sharing_pairs(prefixes: DataFrame, threshold: float, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes of different components that share a region of their prefixes and may reach the threshold."""
    prefixes = scratch.keep(prefixes)
    groups = prefixes.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    groups = scratch.keep(groups.where("r1 <> r2").select("u", F.ceil(F.col("n") / block).alias("blocks")))
    held = prefixes.join(merged(groups), "u").withColumn("own", F.pmod(F.xxhash64("node", "u"), F.col("blocks")))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = [F.col("u"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    # a cell (i, j) of different blocks compares across them; (i, i) within the block
    cells = held.select(*cell, "own", "node", "root", "size", "place").repartition("u", "i", "j").sortWithinPartitions("u", "i", "j")

    def compared(rows: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
        rows = pa.Table.from_batches(rows)
        own, size, place = (rows[c].to_numpy() for c in ("own", "size", "place"))
        root = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        within = rows["i"][0].as_py() == rows["j"][0].as_py()
        x, y = np.triu_indices(len(own), 1)
        ok = (root[x] != root[y]) & (within | (own[x] != own[y]))
        x, y = x[ok], y[ok]
        ok = np.minimum(size[x], size[y]) >= _least(threshold * np.maximum(size[x], size[y]))
        x, y = x[ok], y[ok]
        # the first region that two texts share in this order has all that they share at or behind it
        ok = np.minimum(size[x] - place[x], size[y] - place[y]) >= _least(threshold / (1 + threshold) * (size[x] + size[y]))
        node = rows["node"].combine_chunks()
        return node.take(pa.array(x[ok])), node.take(pa.array(y[ok]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back: list[pa.RecordBatch] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            if sum(r.num_rows for r in held_back) > 1:
                yield pa.RecordBatch.from_arrays([*compared(held_back)], names=["x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            for at, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                if key != (now := tuple(keys[:, at].tolist())):
                    yield from done()
                    held_back, key = [], now
                held_back.append(batch.slice(at, end - at))
        yield from done()

    kind = prefixes.schema["node"].dataType
    met = cells.mapInArrow(run, T.StructType([T.StructField("x", kind), T.StructField("y", kind)]))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts' exact similarity reaches the threshold. texts: (node, t), one row per node."""
    one = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    centre, member = F.when(F.col("low"), F.col("a")), F.when(F.col("low"), F.col("b"))
    sides = pairs.select(centre.otherwise(F.col("b")).alias("b"), member.otherwise(F.col("a")).alias("a"))
    met = sides.join(merged(one), "a").join(merged(two), "b").select("a", "b", "ta", "tb")  # the centre's text, which many pairs need, joins last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last = Shingler(), {}

        def units(node: object, t: str) -> np.ndarray:
            if node not in last:
                if len(last) > 64:
                    last.clear()
                last[node] = shingle(t)
            return last[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            with np.errstate(over="ignore"):
                ok = [similarity(units(x, s.as_py()), units(y, t.as_py())) >= threshold for x, y, s, t in zip(a, b, batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType
    return met.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def contracted(edges: DataFrame, most: int = FOREST) -> DataFrame:
    """(node, root), root < node, with the same components as the edges (node, root): each task joins what its own edges link."""
    kind = edges.schema["node"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(x: object) -> object:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def forest() -> pa.RecordBatch:
            named = [(x, top(x)) for x in list(parent)]
            named = [n for n in named if n[0] != n[1]]
            return pa.RecordBatch.from_arrays([pa.array([n[i] for n in named], batch.schema.field(0).type) for i in (0, 1)], names=["node", "root"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (x := top(a)) != (y := top(b)):
                    parent[max(x, y)] = min(x, y)
            if len(parent) > most:  # bounded memory; what is linked across forests is left to the steps between tasks
                yield forest()
                parent.clear()
        if parent:
            yield forest()

    return edges.select("node", "root").mapInArrow(run, schema)


def _is_settled(e: DataFrame) -> bool:
    """Whether every node has one row, and no root is a node."""
    ends = e.select(F.col("node").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("root", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the edges (a, b) except the roots themselves; root: the smallest of its component."""
    e = scratch.keep(contracted(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root")))
    while not _is_settled(e):
        both = e.union(e.select("root", "node"))
        least = scratch.keep(both.groupBy("node").agg(F.min(F.least("node", "root")).alias("m")))
        large = scratch.keep(contracted(both.join(merged(least), "node").where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root"))))
        scratch.drop(e, least)
        least = scratch.keep(large.groupBy("node").agg(F.min("root").alias("m")))
        small = large.join(merged(least), "node").select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root")
        e = scratch.keep(contracted(small.union(least.select("node", F.col("m").alias("root"))).distinct()))
        scratch.drop(large, least)
    return e


def row_classes(rows: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """(row, id, class_id, is_first) of each of rows (row, id, t). It reads tables that scratch keeps."""
    before = scratch.tables()
    signed = scratch.keep(signatures(rows, bands, rows_per_band))
    first = F.min(F.struct("id", "row")).alias("first")
    nodes = scratch.keep(signed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("row").alias("node"), first, F.any_value("bands").alias("bands")))
    shared = shared_buckets(nodes, scratch)
    pairs = centre_pairs(shared, scratch)
    texts = rows.select(F.col("row").alias("node"), F.coalesce("t", F.lit("")).alias("t"))
    texts = scratch.keep(texts.join(merged(shared.select("node").distinct()), "node", "left_semi"))
    roots = components(verified(pairs, texts, threshold), scratch)
    left = unsettled(shared, roots, scratch)
    if not left.isEmpty():
        # every pair of these texts that reaches the threshold is found here, whatever the centres missed
        left = scratch.keep(texts.join(merged(left), "node"))
        more = sharing_pairs(rare_prefixes(left, unit_counts(left), threshold), threshold, scratch)
        more = scratch.keep(more.join(merged(pairs.select("a", "b")), ["a", "b"], "left_anti").withColumn("low", F.lit(True)))
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(more, texts, threshold)), scratch)
    linked = roots.union(roots.select("root", "root").distinct())
    whole = scratch.keep(linked.join(merged(nodes.select("node", "first")), "node").groupBy("root").agg(F.min("first").alias("of_class")))
    named = linked.join(merged(whole), "root").select("node", "of_class")
    classes = scratch.keep(nodes.join(merged(named), "node", "left").select("h1", "h2", F.coalesce("of_class", "first").alias("first")))
    scratch.drop_all_but(signed, classes, *before)
    out = signed.select("row", "id", "h1", "h2").join(merged(classes), ["h1", "h2"], "left")
    return out.select("row", "id", F.coalesce("first.id", "id").alias("class_id"), F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("is_first"))


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of docs: its doc_id, class_id and whether it is the row that stands for its class. options: threshold, bands, rows_per_band."""
    columns = [F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")]
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), *columns).where("id is not null"))
    out = row_classes(rows, scratch, **options)
    scratch.drop(rows)
    nameless = docs.select(columns[0]).where("id is null")
    return out.select("id", "class_id", "is_first").unionByName(nameless.select("id", F.col("id").alias("class_id"), F.lit(True).alias("is_first"))).withColumnRenamed("id", doc_id)


def filter_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of docs, with all its columns, for each class; rows with a null id all stay."""
    scratch = Scratch(docs.sparkSession)
    whole = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    rows = whole.select("row", F.col(f"doc.`{doc_id}`").alias("id"), F.col(f"doc.`{text}`").alias("t")).where("id is not null")
    others = scratch.keep(row_classes(rows, scratch, **options).where("not is_first").select("row"))
    scratch.drop_all_but(whole, others)
    return whole.join(merged(others), "row", "left_anti").select("doc.*")
