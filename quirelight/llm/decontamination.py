"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is a set of windows of `window` consecutive words (an item with fewer words, but
not none, is one window), and a window is a set of shingles of SHINGLE words at their offsets (of all its words, if it has fewer). A document contains a window only if it
contains all its shingles, so the necessary prefix of a window under exact containment is one shingle: the one that the
whole corpus has least often. Windows with a shingle that the corpus lacks drop out. Prefix shingles are joined with the documents' shingles; the
offset gives the only possible start (positional bound), the words around a document's shingle bound the
length, and what is left is compared word by word, over windows of the item's size.

All of it is Spark joins: the benchmark never comes to the driver. Documents are read twice, once to count the benchmark's shingles and once for those in some
prefix, which leave with the words around them. Both passes ask a Bloom filter of the shingles first, of 16 bits for each and at most MOST_BITS; in a
benchmark too large for that it lets more shingles through to the join, which finds the same. A passage that a third of all documents share is a hot key of the
documents' side, which Spark splits, since the other side is a written table.

Defined cases: a null or wordless text has no words and no hits; items with a null id or without
words match nothing; repeated items count once, repeated document rows get equal rows; an empty
benchmark marks nothing. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS_AT_ONCE, Scratch

WINDOW, SHINGLE = 10, 3
#: Bits of a Bloom filter at most (32 MB).
MOST_BITS = 1 << 28
#: Counts that a task holds before it hands them on.
_COUNTED = 1_000_000

_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TO_SPACE = bytes(c if c >= 0x80 or c in _ALNUM else 0x20 for c in range(256))
_GOLD, _M1, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)


def words_of(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()


class Shingles:
    """64-bit hashes of each run of q words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    def of(self, hashes: np.ndarray, q: int) -> np.ndarray:
        n = max(0, len(hashes) - q + 1)
        h = np.full(n, q, np.uint64)
        for j in range(q):
            h = (h * _FOLD + hashes[j : j + n]) * _GOLD
        return ((h ^ (h >> np.uint64(31))) * _M1).view(np.int64)


class Bloom:
    """Which hashes may be in a set; two bits each."""

    def __init__(self, hashes: DataFrame, most_bits: int = MOST_BITS):
        n = hashes.count()
        self.size = min(most_bits, max(1 << 12, 1 << (16 * n).bit_length()))
        last = F.lit(self.size - 1)
        slots = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(last), F.shiftrightunsigned("h", 32).bitwiseAND(last))).alias("slot"))
        cells = slots.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63L as int)))").alias("bits")).toArrow()
        self.cells = np.zeros(self.size >> 6, np.int64)
        self.cells[cells["cell"].to_numpy()] = cells["bits"].to_numpy()

    def has(self, h: np.ndarray) -> np.ndarray:
        last = self.size - 1
        one, two = h & last, (h >> 32) & last
        return ((self.cells[one >> 6] >> (one & 63)) & (self.cells[two >> 6] >> (two & 63)) & 1).astype(bool)


def windows_of(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, w: words) of every window of every item, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(t.as_py())
                starts = range(max(1, len(words) - window + 1)) if words else range(0)
                for at in range(0, len(starts), 4096):
                    found = [words[s : s + window] for s in starts[at : at + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(found)), pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], names=["item", "w"])

    known = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).dropna()
    return known.mapInArrow(run, "item string, w array<string>")


def window_shingles(windows: DataFrame) -> DataFrame:
    """(wid, h, place, q) of every shingle of the windows (wid, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            rows = []
            for wid, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q = min(SHINGLE, len(w))
                hashes = shingles.of(shingles.word_hashes([x.encode() for x in w]), q)
                rows += [(wid, h, place, q) for place, h in enumerate(hashes.tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["wid", "h", "place", "q"])

    return windows.select("wid", "w").mapInArrow(run, "wid long, h long, place long, q long")


def corpus_counts(texts: DataFrame, bloom: Bloom, lengths: list[int]) -> DataFrame:
    """(h, n): how often all texts (t) together have each shingle that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingles(), {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["h", "n"])

        for batch in batches:
            for t in batch.column(0):
                hashes = shingles.word_hashes(words_of(t.as_py() or ""))
                for q in lengths:
                    h = shingles.of(hashes, q)
                    for x in h[bloom.has(h)].tolist():
                        counts[x] = counts.get(x, 0) + 1
            if len(counts) > _COUNTED:
                yield counted()
                counts.clear()
        if counts:
            yield counted()

    return texts.select("t").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


_CANDIDATES = "row long, n_words long, found array<struct<h: long, at: long, start: long, words: array<string>>>"


def candidates(rows: DataFrame, bloom: Bloom, lengths: list[int], window: int) -> DataFrame:
    """(row, n_words, found: shingles that the filter lets through, with place, and start and words of what is around) of each of rows (row, t)."""
    around = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch, n_words, found = whole.slice(at, ROWS_AT_ONCE), [], []
                for t in batch.column(1):
                    words = words_of(t.as_py() or "")
                    hashes, own = shingles.word_hashes(words), []
                    for q in lengths:
                        h = shingles.of(hashes, q)
                        for p in np.flatnonzero(bloom.has(h)).tolist():
                            start = max(0, p - window + 1)
                            own.append({"h": int(h[p]), "at": p, "start": start, "words": [w.decode("utf-8", "replace") for w in words[start : p + window]]})
                    n_words.append(len(words))
                    found.append(own)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, around)], names=["row", "n_words", "found"])

    return rows.select("row", "t").mapInArrow(run, _CANDIDATES)


def hits(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, n_words) of rows (row, t); distinct (row, wid, s, e) of the windows that occur in them; and (wid, item)."""
    all_windows = scratch.keep(windows_of(items, item_id, item_text, window).distinct())
    windows = scratch.keep(all_windows.select("w").distinct().select(F.monotonically_increasing_id().alias("wid"), "w"))
    of_item = scratch.keep(all_windows.join(windows.hint("merge"), "w").select("wid", "item"))
    shingles = scratch.keep(window_shingles(windows))
    lengths = [r.q for r in shingles.select("q").distinct().orderBy("q").collect()]  # at most SHINGLE numbers
    counts = scratch.keep(corpus_counts(rows, Bloom(shingles.select("h")), lengths))
    rarest = shingles.join(counts.hint("merge"), "h").groupBy("wid").agg(F.min(F.struct("n", "h", "place")).alias("rarest"), F.count(F.lit(1)).alias("known"))
    whole = rarest.join(windows.hint("merge"), "wid").where(F.col("known") == F.greatest(F.size("w") - SHINGLE + 1, F.lit(1)))
    prefixes = scratch.keep(whole.select("rarest.h", "rarest.place", "wid", "w"))
    met = scratch.keep(candidates(rows, Bloom(prefixes.select("h")), lengths, window))
    found = met.select("row", F.inline("found")).join(prefixes.hint("merge"), "h").withColumn("s", F.col("at") - F.col("place"))
    same = found.where("s >= start").where(F.slice("words", (F.col("s") - F.col("start") + 1).cast("int"), F.size("w")) == F.col("w"))
    out = scratch.keep(same.select("row", "wid", "s", (F.col("s") + F.size("w")).alias("e")).distinct())
    scratch.drop(all_windows, windows, shingles, counts, prefixes)
    return met.select("row", "n_words"), out, of_item


def filter_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in which no window occurs."""
    scratch = Scratch(docs.sparkSession)
    whole = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    _, found, _ = hits(whole.select("row", F.col(f"doc.`{text}`").alias("t")), items, item_id, item_text, window, scratch)
    hit = scratch.keep(found.select("row").distinct())
    scratch.drop_all_but(whole, hit)
    return whole.join(hit.hint("merge"), "row", "left_anti").select("doc.*")


def mark_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of docs: the id, n_words, n_hit, n_items, spans ("start:end" in words, merged), the item ids and their hash."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")))
    counted, found, of_item = hits(rows, items, item_id, item_text, window, scratch)

    @F.pandas_udf("n_hit long, spans string")
    def merged(places: pd.Series) -> pd.DataFrame:
        out = []
        for own in places:
            spans: list[list[int]] = []
            for s, e in sorted((p["s"], p["e"]) for p in own):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            out.append((sum(e - s for s, e in spans), ",".join(f"{s}:{e}" for s, e in spans)))
        return pd.DataFrame(out, columns=["n_hit", "spans"])

    placed = found.groupBy("row").agg(F.collect_set(F.struct("s", "e")).alias("places")).select("row", merged("places").alias("m")).select("row", "m.*")
    named = found.select("row", "wid").distinct().join(of_item.hint("merge"), "wid").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    marks = scratch.keep(placed.join(named.hint("merge"), "row"))
    out = rows.select("row", "id").join(counted.hint("merge"), "row").join(marks.hint("merge"), "row", "left")
    none = F.array().cast(T.ArrayType(T.StringType()))
    items_found = F.coalesce("items", none)
    return out.select(
        F.col("id").alias(doc_id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        items_found.alias("items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
    )
