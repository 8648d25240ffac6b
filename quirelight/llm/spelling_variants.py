"""Spelling variants: words one edit apart, found by search schemes over a bidirectional FM-index of the vocabulary.

Words are counted in tasks and summed up. Two words of six code points or more that are one edit (insertion, deletion or replacement of a code
point) apart agree exactly on one half of the query word, on the left or on the right of the edit. So the search scheme has two searches:
match the left half and extend to the right allowing one error, and match the right half and extend to the left.

An FM-index reads patterns from right to left; the right half therefore uses the index of the words, and the left half that of the
reversed words. Both are built over the delimited vocabulary ("\\x01word\\x01word\\x01"), so that a pattern with its delimiters is a whole word, and
every state of a search is an interval of suffix ranks; a step maps both ends by LF, and a state is dropped when its interval is empty. No
two words are compared, and no candidates are listed: what a search ends with are the words at distance one.

The vocabulary is dealt into shards, each with an index of its own in one task. A query word goes to one shard for each half, by the hash of that half;
an indexed word goes where words of its length, of one less and of one more would ask for it, which are two halves for each side. A half that
more than SHARD_WORDS words have is cut into shards of its own of that size, and its queries ask all of them. A pair that both searches see is
left to the left half. Shards give one row per word: how many are near, and the best of them.

Forms are followed to their roots by pointer doubling, in written tables; forms are five times as frequent as the words that have them, so chains are short.

Defined cases: null texts have no words; a null doc_id counts as the empty string in the hash; rows that share a doc_id are rows of their own, and
repeated rows count as often as they stand there; an empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, Scratch

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
DROP_ONE_IN = 199  # runs that lose a letter, by their hash
SHARD_WORDS = 1 << 15
_HELD_WORDS = 100_000  # different words that a task counts before it passes their counts on
_SEARCH_AT_ONCE = 500

# Latin-1 bytes: A-Z to a-z, a-z and 0xC0 to 0xFF as they are, and everything else a blank. Code points beyond are '?' in Latin-1, and so blanks.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> Counter:
    """The maximal runs of Latin letters, as Latin-1 bytes with A-Z lower-cased, and how often each stands there."""
    return Counter(text.encode("latin-1", "replace").translate(_RUNS).split())


def misspelt(key: str, run: bytes, one_in: int = DROP_ONE_IN) -> str:
    """The run, or without one of its letters where the hash of key and run says so."""
    word = run.decode("latin-1")
    h = zlib.crc32(f"{key}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(at, ROWS_AT_ONCE)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    base = zlib.crc32(f"{i}:".encode())
                    for r, n in runs(t).items():
                        if len(r) < least_length:
                            continue
                        if r.isascii() and zlib.crc32(r, base) % DROP_ONE_IN:
                            held[r.decode("ascii")] += n
                        else:
                            word = misspelt(i, r)
                            if len(word) >= least_length:
                                held[word] += n
                if len(held) > _HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class FMIndex:
    """Suffix ranks of "\\x01w1\\x01w2\\x01...\\x00": LF by binary search in the places of each letter, so that memory is linear whatever the alphabet."""

    def __init__(self, words: list[str]):
        self.words = words
        flat = np.array([ord(c) for c in "\x01" + "\x01".join(words) + "\x01\x00"] if words else [0], np.int64)
        self.letters = np.unique(flat)
        code = np.searchsorted(self.letters, flat)
        self.n, self.sigma = len(code), len(self.letters)
        rank, step = code.copy(), 1
        while True:  # prefix doubling
            key = rank * (self.n + 1)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank[order] = fresh
            step *= 2
            if fresh[-1] == self.n - 1 or step >= self.n:
                break
        self.order = order
        bwt = code[order - 1]
        self.places = np.sort(bwt * (self.n + 1) + np.arange(self.n))  # letter and place, in order: a place's index here is LF
        self.starts = np.flatnonzero(code == 1) if words else np.zeros(0, np.int64)

    def code(self, points: np.ndarray) -> np.ndarray:
        """Letters' codes; -1 for those that no word has."""
        at = np.minimum(np.searchsorted(self.letters, points), self.sigma - 1)
        return np.where((self.letters[at] == points) & (points > 0), at, -1)

    def step(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more letter on their left; empty for code -1."""
        base = np.maximum(code, 0) * (self.n + 1)
        lo = np.searchsorted(self.places, base + lo)
        hi = np.searchsorted(self.places, base + hi)
        return lo, np.where(code < 0, lo, hi)

    def word_at(self, rank: np.ndarray) -> np.ndarray:
        """Of suffixes that begin with a delimiter, the word after it."""
        return np.searchsorted(self.starts, self.order[rank])

    def one_error(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) where the word has the last `exact` letters of the query as its end, and what is before them has one edit more or less."""
        if not self.words or not queries:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.array([len(q) for q in queries])
        grid = np.full((len(queries), int(lengths.max())), -1, np.int64)
        for r, q in enumerate(queries):
            grid[r, : len(q)] = self.code(np.array([ord(c) for c in q]))
        q = np.arange(len(queries))
        lo, hi = self.step(np.ones(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.n))
        left = lengths.copy()  # letters of the query that are not read yet
        for j in range(int(exact.max())):
            now = exact[q] > j
            at = left[q][now] - 1
            lo[now], hi[now] = self.step(grid[q[now], at], lo[now], hi[now])
            left[q[now]] -= 1
            full = hi > lo
            q, lo, hi = q[full], lo[full], hi[full]
        i = left[q]
        one: list[tuple[np.ndarray, ...]] = []  # states that have had their error: query, letters left, interval
        others = np.arange(2, self.sigma)
        while len(q):
            some = i > 0
            one.append((q[some], i[some] - 1, lo[some], hi[some]))  # a letter of the query is missing in the word
            wide = [np.repeat(x, len(others)) for x in (q, i, lo, hi)]
            c = np.tile(others, len(q))
            l2, h2 = self.step(c, wide[2], wide[3])
            full = h2 > l2
            wq, wi, c, l2, h2 = wide[0][full], wide[1][full], c[full], l2[full], h2[full]
            one.append((wq, wi, l2, h2))  # the word has a letter more
            own = grid[wq, np.maximum(wi - 1, 0)] == c
            other = (wi > 0) & ~own
            one.append((wq[other], wi[other] - 1, l2[other], h2[other]))  # another letter
            same = (wi > 0) & own
            q, i, lo, hi = wq[same], wi[same] - 1, l2[same], h2[same]
        q, i, lo, hi = (np.concatenate(x) for x in zip(*one, strict=True)) if one else (np.zeros(0, np.int64),) * 4
        while (i > 0).any():
            more = i > 0
            l2, h2 = self.step(np.where(more, grid[q, np.maximum(i - 1, 0)], -1), lo, hi)
            lo, hi, i = np.where(more, l2, lo), np.where(more, h2, hi), np.where(more, i - 1, i)
            full = hi > lo
            q, i, lo, hi = q[full], i[full], lo[full], hi[full]
        lo, hi = self.step(np.ones(len(q), np.int64), lo, hi)
        full = hi > lo
        found = np.unique(np.stack([q[full], self.word_at(lo[full])]), axis=1)  # a pattern with both delimiters is one word
        return found[0], found[1]


_FOUND = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def search_shard(rows: pa.Table) -> pa.Table:
    """One shard (side, asks, word, n): for each asking word, how many words of the shard are near it, and the best."""
    backwards = rows["side"][0].as_py() == "left"
    turn = (lambda w: w[::-1]) if backwards else (lambda w: w)
    count = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
    asks, held = (rows.filter(pc.equal(rows["asks"], a))["word"].unique().to_pylist() for a in (True, False))
    index, queries = FMIndex(sorted(map(turn, held))), sorted(map(turn, asks))
    near: dict[str, tuple[int, int, str]] = {}
    for at in range(0, len(queries), _SEARCH_AT_ONCE):
        some = queries[at : at + _SEARCH_AT_ONCE]
        halves = np.array([len(w) // 2 if backwards else len(w) - len(w) // 2 for w in some])
        for i, j in zip(*index.one_error(some, halves), strict=True):
            word, other = turn(some[i]), turn(index.words[j])
            half = len(word) // 2
            if word == other or not backwards and word[:half] == other[:half]:  # itself, by two edits that cancel out; or what the left half finds
                continue
            n, best_n, best = near.get(word, (0, 0, ""))
            better = count[other] > best_n or count[other] == best_n and other < best
            near[word] = (n + 1, count[other] if better else best_n, other if better else best)
    words = list(near)
    return pa.table([pa.array(words, pa.string()), pa.array([count[w] for w in words], pa.int64()), *(pa.array([near[w][k] for w in words], t) for k, t in ((0, pa.int64()), (2, pa.string()), (1, pa.int64())))], schema=_FOUND)


def _shards(words: DataFrame, scratch: Scratch, shard_words: int) -> DataFrame:
    """(side, shard, asks, word, n): each word where it asks, and where it is found."""
    size = F.length("word")
    left = lambda n: F.struct(F.lit("left").alias("side"), F.substring("word", F.lit(1), n).alias("half"))
    right = lambda n: F.struct(F.lit("right").alias("side"), F.right("word", n).alias("half"))
    lower, upper = lambda n: F.floor(n / 2).cast("int"), lambda n: F.ceil(n / 2).cast("int")
    asked = words.select(F.explode(F.array(left(lower(size)), right(upper(size)))).alias("at"), "word", "n").select("at.*", "word", "n")
    keys = F.array_distinct(F.array(*[left(lower(size + d)) for d in (-1, 1)], *[right(upper(size + d)) for d in (-1, 1)]))
    held = words.select(F.explode(keys).alias("at"), "word", "n").select("at.*", "word", "n")
    hot = scratch.keep(held.groupBy("side", "half").count().where(F.col("count") > shard_words).select("side", "half", F.ceil(F.col("count") / shard_words).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    held = held.join(hot, ["side", "half"], "left").select("side", "half", parts.alias("parts"), F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.lit(False).alias("asks"), "word", "n")
    asked = asked.join(hot, ["side", "half"], "left").select("side", "half", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("asks"), "word", "n")
    spread = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * words.count() // shard_words))
    shard = F.when(F.col("parts") > 1, F.concat_ws("-", "half", "part")).otherwise(F.pmod(F.xxhash64("half"), F.lit(spread)).cast("string"))
    return held.union(asked).select("side", shard.alias("shard"), "asks", "word", "n")  # a word may come to a shard by both of its halves


def near_words(words: DataFrame, scratch: Scratch | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have near words: how many, and the most frequent."""
    scratch = scratch or Scratch(words.sparkSession)
    found = _shards(words, scratch, shard_words).groupBy("side", "shard").applyInArrow(search_shard, "word string, n bigint, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.n")).alias("form_n"))


def follow(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of links (word, form) that have no circles: each round halves the steps to go."""
    at = scratch.keep(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while at.where("moved").limit(1).count():
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.keep(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(at)
        at = new
    return at.select("word", "root")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every frequent word."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(count_words(docs, key, text))
    near = scratch.keep(near_words(words, scratch, shard_words))
    both = words.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    forms = scratch.keep(both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("is_form"), F.col(c)).alias(c) for c in ("form", "form_n")]))
    scratch.drop(words, near)
    roots = follow(forms.where("form is not null"), scratch)
    out = scratch.keep(forms.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")))
    scratch.drop_all_but(out)
    return out
