"""Ranked search: scores by brute force, early ends, blocks, segments and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quirelight.llm import ranked_search
from quirelight.llm.ranked_search import Segment, search

from .test_operators import ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(docs, items, k=10):
    """docs, items: (id, text); (item, rank, doc, score)."""
    bags = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs if t is not None]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, t in items:
        asked = set(TERM.findall(lowered(t or "")))
        scored = []
        for i, b, n in bags:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * b[x] // (1000 * b[x] + 8 * m)) for x in asked if b[x])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    some = lambda: " ".join(words[min(199, int(rng.expovariate(0.03)))] for _ in range(rng.randrange(1, 60)))
    docs = [(i, some()) for i in range(n)]
    return [*docs, *[(n + i, docs[i][1].upper()) for i in range(0, n, 5)]], [(i, some()) for i in range(12)]


@pytest.mark.parametrize("settings", [{}, {"block_terms": 20}, {"segment_postings": 50}, {"k": 3}])
def test_equals_brute_force(spark, settings):
    docs, items = corpus(400)
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")
    assert result(search(d, q, **settings)) == brute(docs, items, settings.get("k", 10))


def test_odd_rows(spark):
    docs = [(i, t) for i, t, _, _ in ODD] + [(None, "three four"), (11, "Three, FOUR!"), (12, "three four"), (13, "?!")]
    items = [(1, "THREE four"), (1, "one"), (None, "word7 word8 é"), (2, None), (3, " ;"), (4, "unknown"), (5, "w" * 100_000)]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, rank int, key string").repartition(2)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, q string")
    assert result(search(d, q)) == brute(docs, items)
    assert result(search(d, q.limit(0))) == [] and result(search(d.limit(0), q)) == []


def segment(n, n_terms, seed=1):
    rng = np.random.default_rng(seed)
    doc, term = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n_terms), indexing="ij"))
    some = rng.random(len(doc)) < 0.5
    doc, term = doc[some], term[some]
    quality = rng.random(n) ** 4  # documents that are good for one term are good for the others
    return doc, term, (1 + 1000 * quality[doc] * (0.8 + 0.2 * rng.random(len(doc)))).astype(np.int64)


def test_a_query_ends_before_its_lists_do():
    doc, term, impact = segment(20_000, 5)
    s = Segment(doc, term, impact, 20_000)
    docs, scores = s.best(np.arange(5), 10, 1)
    total = np.bincount(doc, impact, 20_000).astype(np.int64)
    kth = np.sort(total)[-10]
    assert set(docs) >= set(np.flatnonzero(total >= kth)) and (scores == total[docs]).all()
    assert s.read < len(doc) / 20


def test_best_positions_stop_no_later_than_last_positions():
    """The bound of the first unseen positions is at most that of the last positions read, so fewer are read than by the threshold algorithm."""
    doc, term, impact = segment(5_000, 4, seed=7)
    s = Segment(doc, term, impact, 5_000)
    s.best(np.arange(4), 10, 1)
    total = np.bincount(doc, impact, 5_000)
    kth = np.sort(total)[-10]
    lists = [s.impacts[lo:hi] for lo, hi in s.lists(np.arange(4))]
    depth = ranked_search.FIRST_DEPTH
    while sum(x[min(depth, len(x)) - 1] for x in lists) >= kth:
        depth *= 2
    assert s.read <= sum(min(depth, len(x)) for x in lists)


def test_ties_at_the_last_place_go_to_the_smaller_id(spark):
    docs = [(i, "same text here") for i in range(300, 0, -1)] + [(1000, "nothing else")] * 400
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame([(7, "text")], "item_id bigint, text string")
    assert [r[2] for r in sorted(result(search(d, q)), key=lambda r: r[1])] == list(range(1, 11))
