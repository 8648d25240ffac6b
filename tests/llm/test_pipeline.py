"""The pipeline against a brute-force version of its stages, and on odd rows."""

import re

import corpus_pipeline
from quirelight.llm import quality_rules, secret_scan, source_mixing

from .test_operators import ODD, brute_classes, brute_features, brute_hits


def test_pipeline_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def good(t):
        n, chars, symbols, dup, repeat = brute_features(t)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
        letters = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in re.findall(r"[^\x20\x09-\x0D]+", t))
        bullets, ellipses = (sum(bool(re.search(p, x)) for x in t.split("\n")) for p in (r"^[ \t]*[•*-][ \t]", r"(\.\.\.|…)[\x20\x09\x0B-\x0D]*$"))
        if 10 * letters < 8 * n or 10 * bullets > 9 * lines or 10 * ellipses > 3 * lines:
            return False
        return n >= 50 and 2 * repeat <= n and 10 * symbols <= n and 10 * t.count("!!") <= 3 * n and 10 * dup <= 3 * lines and 2 * n <= chars <= 15 * n

    kept = [i for i, r in docs.items() if good(r.text)]
    classes = brute_classes([(i, docs[i].text) for i in kept])
    kept = [i for i in kept if classes[i] == i]
    kept = [i for i in kept if not brute_hits(docs[i].text, items)[1]]
    assert sorted(got) == sorted(kept)
    novelty = secret_scan.Novelty()
    clean = [(i, secret_scan.redact(docs[i].text, secret_scan.all_spans(docs[i].text, novelty)[1]), docs[i].source) for i in kept]
    for i, t, _ in clean:
        assert got[i].n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = {r.doc_id: r.copies for r in source_mixing.mix_sources(spark.createDataFrame(clean, "doc_id bigint, text string, source string")).collect()}
    assert {i: r.copies for i, r in got.items()} == want


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s, _ in ODD], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "minhash_near_dedup"
    for table in (docs.limit(0), odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns and out.dtypes == table.dtypes, name
            assert out.count() <= table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, sf_dir).count() == table.count()


def test_pipeline_on_empty_and_odd_tables(spark, sf_dir, tmp_path):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    words = [f"{a}{b}" for a in ("sun", "moon", "river", "stone", "wind", "leaf", "bird") for b in ("light", "side", "less", "like", "ward", "born", "made", "fall", "song")]
    good, other = " ".join(words), " ".join(w + "x" for w in words)
    odd = spark.createDataFrame([(1, good, None, "s", None), (1, other, "en", None, 3), (2, other, "en", "t", 3), (None, good, "en", "t", 9), (3, None, None, None, None)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    for name, table, items, want in (("none", docs.limit(0), benchmark.limit(0), 0), ("odd", odd, benchmark.limit(0), 3), ("items", docs.limit(0), benchmark, 0)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == want, name


def test_secret_stage_changes_secrets_only(spark, sf_dir):
    rows = [(1, "plain text", "en", "s", 10), (2, "token = 'abcdefghijklmnop' end", "en", "s", 30), (3, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.redact_secrets(spark, docs, sf_dir).collect()}
    assert got == {1: ("plain text", 10), 2: ("[SECRET]' end", 13), 3: (None, None)}


def test_quality_stage_keeps_clean_documents(spark, sf_dir):
    words = " ".join(f"{a}{b}" for a in ("sun", "moon", "river", "stone", "wind", "leaf", "bird") for b in ("light", "side", "less", "like", "ward", "born", "made", "fall", "song")) + "."
    docs = spark.createDataFrame([(1, words), (2, words[:100])], "doc_id bigint, text string")
    assert [r.doc_id for r in quality_rules.filter_documents(docs).collect()] == [1]
