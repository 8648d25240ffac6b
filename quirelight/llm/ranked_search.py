"""Ranked lexical search by the Best Position Algorithm (Akbarinia, Pacitti and Valduriez, 2007) over impact lists.

One pass over all texts keeps, for every document, its length and how often it has each of the asked terms; the corpus statistics (documents, terms,
documents per term) are sums over all of that table. Impacts are integers: a term's weight times its saturated frequency.

The corpus is dealt by document. A task reads its documents in segments of at most SEGMENT_POSTINGS postings, and lists each term's documents by falling impact. For each query it
reads its lists side by side, a few positions at a time (sorted accesses), looks the new documents up in all other lists (direct accesses), and marks in every list which positions
have been seen either way. The best position of a list is the last before its first unseen one. No unseen document can reach more than the sum of the lists' impacts at their first
unseen positions, which is less than what the positions read in turn would allow; a query ends as soon as that sum is strictly below its kth best score, so that ties are kept.
The kth best goes on from segment to segment of a task, so that later ones end sooner, and a task gives k rows per query. Those are ranked in two steps, by slices and then in all.

Queries are a stated set. They are sent to the tasks in blocks of at most BLOCK_TERMS pairs of a query and a term, one block at a time; the vocabulary and its statistics are bounded by the block.

Defined cases: null texts have no terms, and documents without terms count nowhere; a query without terms, or without a document of positive score, has no rows; rows that share an
item_id or a doc_id are rows of their own, and of equal scores and doc_ids either may come first; a null doc_id comes last among equal scores. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, Scratch

TOP = 10
LENGTH_SHARE = 90  # of a hundred parts of the length normaliser, those that follow the document's length
BLOCK_TERMS = 500_000
SEGMENT_POSTINGS = 4_000_000
FIRST_DEPTH = 16  # positions of each list that are read in a query's first round; each round reads as many as all before
SLICES = 256

# Bytes of UTF-8: A-Z to a-z, digits, letters and all beyond ASCII as they are, and everything else a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def postings(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, n, terms, tfs) of documents with terms: all terms counted in n, those of the vocabulary listed."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("binary").alias("text"))
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(at, ROWS_AT_ONCE)
                out: tuple[list, ...] = ([], [], [], [])
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = terms(t)
                    if words:
                        tf = Counter(filter(None.__ne__, map(vocabulary.get, words)))
                        for column, value in zip(out, (i, len(words), list(tf), list(tf.values())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(run, "key bigint, n bigint, terms array<int>, tfs array<bigint>")


class Segment:
    """Some documents' impact lists: by falling impact, and by document with the position in the former."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((doc, -impact, term))
        self.docs, self.impacts, term = doc[order], impact[order], term[order]
        self.terms, starts = np.unique(term, return_index=True)
        self.bounds = np.append(starts, len(term))
        position = np.arange(len(term)) - np.repeat(starts, np.diff(self.bounds))
        by_doc = np.lexsort((self.docs, term))
        self.own_docs, self.own_positions = self.docs[by_doc], position[by_doc]
        self.n_docs = n_docs
        self.read = 0  # sorted accesses

    def lists(self, asked: np.ndarray) -> list[tuple[int, int]]:
        at = np.searchsorted(self.terms, asked)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == asked[known]
        return [(int(self.bounds[i]), int(self.bounds[i + 1])) for i in at[known]]

    def best(self, asked: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the k best of the query: all with a score of `least` or more that are, and perhaps others."""
        lists = self.lists(asked)
        seen_doc = np.zeros(self.n_docs, bool)
        seen = [np.zeros(hi - lo + 1, bool) for lo, hi in lists]  # the last stays unseen: the list's end
        best = [0] * len(lists)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, FIRST_DEPTH
        while True:
            found = [self.docs[lo + depth : min(hi, lo + depth + step)] for lo, hi in lists]
            self.read += sum(map(len, found))
            new = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            new = new[~seen_doc[new]]
            seen_doc[new] = True
            score = np.zeros(len(new), np.int64)
            for i, (lo, hi) in enumerate(lists):
                at = np.searchsorted(self.own_docs[lo:hi], new)
                has = at < hi - lo
                has[has] = self.own_docs[lo:hi][at[has]] == new[has]
                position = self.own_positions[lo:hi][at[has]]
                score[has] += self.impacts[lo:hi][position]
                seen[i][position] = True
                best[i] += int(np.argmin(seen[i][best[i] :]))
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
            if len(scores) > k:
                kth = np.partition(scores, -k)[-k]
                docs, scores = docs[scores >= kth], scores[scores >= kth]  # ties stay
                least = max(least, int(kth))
            elif len(scores) == k:
                least = max(least, int(scores.min()))
            bound = sum(int(self.impacts[lo + b]) for (lo, hi), b in zip(lists, best, strict=True) if lo + b < hi)
            depth += step
            step = depth
            if bound < max(least, 1):
                return docs, scores


class _Query:
    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k = asked, k
        self.scores, self.keys, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def see(self, segment: Segment, keys: np.ndarray, none: np.ndarray) -> None:
        docs, scores = segment.best(self.asked, self.k, int(self.scores[-1]) if len(self.scores) == self.k else 1)
        docs, scores = docs[scores > 0], scores[scores > 0]
        scores, ids, nil = (np.concatenate(x) for x in ((self.scores, scores), (self.keys, keys[docs]), (self.none, none[docs])))
        order = np.lexsort((ids, nil, -scores))[: self.k]
        self.scores, self.keys, self.none = scores[order], ids[order], nil[order]


def segments(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int, most: int) -> Iterator[tuple[Segment, np.ndarray, np.ndarray]]:
    """(lists, keys, null keys) of each run of documents with at most so many postings, or of one document."""

    def made(held: list[pa.RecordBatch]) -> tuple[Segment, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        counts = rows["terms"].combine_chunks().value_lengths().to_numpy()
        term = rows["terms"].combine_chunks().flatten().to_numpy().astype(np.int64)
        tf = rows["tfs"].combine_chunks().flatten().to_numpy()
        doc = np.repeat(np.arange(len(counts)), counts)
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * rows["n"].to_numpy() * n_docs) // n_terms
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        some = impact > 0
        keys = rows["key"].combine_chunks()
        return Segment(doc[some], term[some], impact[some], len(counts)), keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        ends = np.cumsum(batch.column(2).value_lengths().to_numpy())
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, before + most - n, "right")), at)
            if to == at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                n += int(ends[to - 1]) - before
            if to < batch.num_rows:
                yield made(held)
                held, n = [], 0
            at = to
    if held:
        yield made(held)


def _top(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, asked: pa.Table, key: str, text: str, k: int, segment_postings: int, scratch: Scratch) -> DataFrame:
    """(q, key, score, rank) for the asked (q, term)."""
    words = {t: i for i, t in enumerate(dict.fromkeys(asked["term"].to_pylist()))}
    by_query: dict[int, list[int]] = {}
    for q, t in zip(asked["q"].to_pylist(), asked["term"].to_pylist(), strict=True):
        by_query.setdefault(q, []).append(words[t])
    held = scratch.keep(postings(docs, words, key, text))
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    counted = held.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # as many rows as the block has terms
    df[counted["t"].to_numpy()] = counted["count"].to_numpy()
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    queries = {q: np.unique(np.array(t, np.int64)) for q, t in by_query.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = {q: _Query(t, k) for q, t in queries.items()}
        for segment, keys, none in segments(batches, weights, n_docs, n_terms, segment_postings):
            for state in states.values():
                state.see(segment, keys, none)
        for q, s in states.items():
            if len(s.scores):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(s.scores), pa.int64()), pa.array(s.keys, mask=s.none), pa.array(s.scores)], names=["q", "key", "score"])

    found = held.where(F.size("terms") > 0).mapInArrow(run, "q bigint, key bigint, score bigint").withColumn("slice", F.spark_partition_id() % SLICES)
    out = scratch.keep(_top(_top(found, k, "q", "slice").drop("rank", "slice"), k, "q"))
    scratch.drop(held)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", item: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS, segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """(item, rank, key, score): the k best documents of each item."""
    scratch = Scratch(docs.sparkSession)
    named = scratch.keep(items.select(F.monotonically_increasing_id().alias("q"), F.col(item).alias("item"), F.col(text).alias("text")))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    asked = scratch.keep(named.select("q", F.explode(found).alias("t")).select("q", F.col("t").cast("binary").alias("term")))
    blocks = max(1, -(-asked.count() // block_terms))
    parts = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()
        if block.num_rows:
            parts.append(_block(docs, block, key, text, k, segment_postings, scratch))
    scratch.drop(asked)
    if not parts:
        return named.select(F.col("item").alias(item), F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias(key), F.lit(0).cast("bigint").alias("score")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.join(named.select("q", "item"), "q").select(F.col("item").alias(item), F.col("rank"), F.col("key").alias(key), "score")
