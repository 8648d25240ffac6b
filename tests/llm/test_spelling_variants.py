"""Spelling variants: the index's searches, counts, forms and roots against brute force."""

import random
import zlib
from collections import Counter

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelight.llm import spelling_variants
from quirelight.llm.common import Scratch
from quirelight.llm.spelling_variants import FMIndex, group_variants, near_words

from .test_operators import ODD


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute_near(words):
    """words: {word: n}; {word: (n_near, best near word, its n)}."""
    out = {}
    for w in words:
        near = sorted((-words[x], x) for x in words if one_edit(w, x))
        if near:
            out[w] = (len(near), near[0][1], -near[0][0])
    return out


def brute(docs):
    counts = Counter()
    for i, t in docs:
        for run in regex.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = regex.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    near = brute_near(words)
    form = {w: near[w][1] for w, n in words.items() if w in near and near[w][2] >= 5 * n}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, n, near.get(w, (0,))[0], form.get(w), words[form[w]] if w in form else None, root(w)) for w, n in words.items()), key=repr)


def result(df):
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()), key=repr)


words_of = st.sets(st.text("abcé", min_size=5, max_size=9), min_size=1, max_size=60)


@settings(max_examples=120, deadline=None)
@given(words_of, st.integers(1, 4))
def test_index_finds_all_words_at_one_edit_before_the_exact_end(words, exact):
    import numpy as np

    index = FMIndex(sorted(words))
    queries = sorted(words)
    got = {(queries[i], index.words[j]) for i, j in zip(*index.one_error(queries, np.full(len(queries), exact)), strict=True)}
    want = {(a, b) for a in words for b in words if len(b) >= exact and a[-exact:] == b[-exact:] and one_edit(a[:-exact], b[:-exact])}
    assert got == want


def vocabulary(n, seed=2):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeiou" if j % 2 else "bcdfgé") for j in range(rng.randrange(6, 12))) for _ in range(n)]
    for w in list(base):
        at = rng.randrange(len(w))
        base += [w[:at] + w[at + 1 :], w[:at] + rng.choice("xyz") + w[at:], w[:at] + "q" + w[at + 1 :]]
    return {w: rng.randrange(5, 400) for w in base if len(w) >= 6}


@pytest.mark.parametrize("shard_words", [1 << 15, 6])
def test_near_words_equal_brute_force_however_words_are_dealt(spark, shard_words):
    words = vocabulary(150)
    words |= {"prefix" + a + b: 9 for a in "abcdefgh" for b in "ijklmnop"} | {a + b + "suffix": 9 for a in "abcdefgh" for b in "ijklmnop"}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    got = {r.word: (r.n_near, r.form, r.form_n) for r in near_words(df, shard_words=shard_words).collect()}
    assert got == brute_near(words)


def test_equals_brute_force(spark):
    words = vocabulary(80)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(list(words), list(words.values()), k=200)).title() + "€word-à×b÷") for i in range(150)] + [(None, "WORDS words"), (3, None)] * 3
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, word string, n int").repartition(4)
    want = brute(docs)
    assert result(group_variants(df)) == want and sum(w[3] is not None for w in want) > 20


def test_forms_are_followed_to_their_roots(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "w3")]
    got = spelling_variants.follow(spark.createDataFrame(links, "word string, form string"), Scratch(spark)).collect()
    assert {r.word: r.root for r in got} == {w: "w21" for w, _ in links}


def test_odd_rows(spark):
    docs = [(i, t) for i, t, _, _ in ODD] + [(20, "Letters lettérs " * 5), (21, "letters" * 3000), (None, "letters " * 30), (22, "ßßßßßßß ÀÀÀÀÀÀÀ " * 6)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    assert result(group_variants(df)) == brute(docs)
    assert result(group_variants(df.limit(0))) == [] and result(group_variants(df.where("doc_id < 4"))) == []
