"""The index against the scan in all modes, what it reads, and the stemmers' golden words."""

import contextlib
import io
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelight.functions import search, search_index, udfs
from quirelight.functions.stemmers import dutch, english

QUERIES = [
    ("genade", "websearch"), ("genade god", "websearch"), ("genade or liefde", "websearch"), ("god -genade", "websearch"), ("-genade", "websearch"), ('"genade van god"', "websearch"),
    ('-"van god" or groot', "websearch"), ("-god -liefde or genade", "websearch"), ("van van", "phrase"), ("genade van god", "phrase"), ("god genade", "plain"), ("x-y", "websearch"),
    ('"a a a"', "websearch"), ("onbekend", "websearch"), ("", "websearch"), ("?!", "plain"), ("or god", "websearch"), ("Écht 2024", "plain"), ('"god', "websearch"),
]
TEXTS = [
    "De genade van God is groot", "God van genade", "liefde, liefde en liefde", "genade", "van van God", "a a a b", "a a", "x y z", "Écht 2024!", "", None, "   ", "God groot GENADE", "genade van de God",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string").repartition(3)


@pytest.mark.parametrize("lang", [None, "dutch"])
def test_index_finds_what_the_scan_finds(spark, texts, tmp_path, lang):
    search_index.write_index(texts, "id", "text", f"{tmp_path}/i", lang, buckets=8)
    for query, mode in QUERIES:
        want = sorted(r.id for r in search.text_search(texts.where("text is not null"), "text", query, mode, lang).collect())
        got = sorted(r.key for r in search_index.search_index(spark, f"{tmp_path}/i", query, mode).collect() if TEXTS[r.key] is not None)
        assert got == want, (query, mode)


def test_documents_without_words_are_found_where_words_are_forbidden(spark, texts, tmp_path):
    search_index.write_index(texts, "id", "text", f"{tmp_path}/i")
    assert sorted(r.key for r in search_index.search_index(spark, f"{tmp_path}/i", "-god -liefde").collect()) == [3, 5, 6, 7, 8, 9, 10, 11]


def test_query_reads_its_terms_buckets_only(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    search_index.write_index(docs, "doc_id", "text", f"{tmp_path}/i", buckets=64)
    found = search_index.search_index(spark, f"{tmp_path}/i", "the with")
    found.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        found.explain("formatted")
    plan = out.getvalue()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(\d+,\d+\)", plan) and "In(term, [" in plan and "positions" not in re.search(r"ReadSchema: (.*)", plan)[1]
    read = spark.read.parquet(f"{tmp_path}/i/postings").select("bucket", F.input_file_name().alias("f")).distinct()
    assert read.select("bucket").distinct().count() > 50
    phrase = io.StringIO()
    with contextlib.redirect_stdout(phrase):
        search_index.search_index(spark, f"{tmp_path}/i", '"the with"').explain("formatted")
    assert "positions" in re.search(r"ReadSchema: (.*)", phrase.getvalue())[1]


def test_index_of_an_empty_table(spark, texts, tmp_path):
    search_index.write_index(texts.limit(0), "id", "text", f"{tmp_path}/i")
    assert search_index.search_index(spark, f"{tmp_path}/i", "-god").collect() == []


def test_stemmers_have_their_golden_words():
    want = {
        "consigned": "consign", "consistently": "consist", "consolatory": "consolatori", "console": "consol", "knackeries": "knackeri", "knotted": "knot", "generous": "generous", "generate": "generat",
        "communication": "communic", "happy": "happi", "by": "by", "say": "say", "enjoyed": "enjoy", "hopping": "hop", "hoping": "hope", "relational": "relat", "digitizer": "digit", "operator": "oper",
        "hopefulness": "hope", "formalize": "formal", "replacement": "replac", "adoption": "adopt", "controll": "control", "ties": "tie", "cries": "cri", "gas": "gas", "kiwis": "kiwi", "skies": "sky",
        "inning": "inning", "luxuriated": "luxuri", "agreed": "agre", "at": "at", "": "",
    }
    assert {w: english(w) for w in want} == want
    want = {
        "lichaam": "licham", "lichaamsziek": "lichaamsziek", "lichamelijk": "licham", "lichamelijke": "licham", "lichamelijkheden": "licham", "lichamen": "licham", "lichere": "licher", "opheffen": "opheff",
        "opheffende": "opheff", "opheffing": "opheff", "opgingen": "opging", "opgroeiende": "opgroei", "opgewonden": "opgewond", "maan": "man", "brood": "brod", "bakken": "bak", "huizen": "huiz", "ruïne": "ruin",
        "gerechtigheden": "gerecht", "gemeenten": "gemeent", "mogelijkheid": "mogelijk", "zonden": "zond", "": "",
    }
    assert {w: dutch(w) for w in want} == want


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_postings_of_a_large_batch_take_little_memory(spark, texts, monkeypatch):
    monkeypatch.setattr(type(texts), "mapInArrow", lambda self, fn, schema: fn)
    run = search_index.postings(texts, "id", "text")
    words = pa.array([f"w{n % 999}" for n in range(2_000_000)])
    lists = pa.ListArray.from_arrays(pa.array(range(0, 2_000_001, 1000), pa.int32()), words)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), lists], names=["key", "toks"])
    n, peak = peak_mb(lambda: sum(out.num_rows for out in run(iter([batch]))))
    assert n == 2000 * 999 and peak < 40  # all words of the batch at once: some 100 MB


@pytest.mark.parametrize("lang", [None, "dutch"])
def test_pieces_make_no_difference(spark, texts, tmp_path, monkeypatch, lang):
    for module in (search_index, udfs):
        monkeypatch.setattr(module, "WORDS_AT_ONCE", 3)
    test_index_finds_what_the_scan_finds(spark, texts, tmp_path, lang)
    lengths = [0, 2, 2, 9, 0, 1, 1]
    cut = list(udfs.pieces(np.array(lengths), 3))
    assert cut == [(0, 3), (3, 4), (4, 7)] and list(udfs.pieces(np.zeros(0, np.int64), 3)) == []


def test_stems_make_no_python_string_for_each_word(monkeypatch):
    made = []
    monkeypatch.setattr(udfs.F, "arrow_udf", lambda kind: lambda fn: made.append(fn) or (lambda tokens: tokens))
    udfs.stemmed(None, "english")
    words = pa.array([f"{'bcdfghj'[n % 7]}oping" for n in range(600_000)])
    arrays = pa.ListArray.from_arrays(pa.array(range(0, 600_001, 600), pa.int32()), words)
    out, peak = peak_mb(lambda: made[0](arrays))
    assert out.flatten().slice(0, 2).to_pylist() == ["bope", "cope"] and len(out) == 1000 and peak < 10
    odd = pa.array([["x"], None, [], ["hoping", None, "x"]], pa.list_(pa.string()))
    assert made[0](odd).to_pylist() == [["x"], None, [], ["hope", None, "x"]] and made[0](odd.slice(1, 3)).to_pylist() == [None, [], ["hope", None, "x"]] and made[0](odd.slice(0, 0)).to_pylist() == []
