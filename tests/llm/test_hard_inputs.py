"""Inputs that are legal and seldom: long or broken pages, urls like version blocks, rows without ids, long labelled texts."""

import time
from collections import Counter

from quirelight.llm import html_text, quality_classifier, source_mixing, warc
from quirelight.llm.html_text import LineParser, main_text


def test_end_tags_without_a_partner_take_linear_time():
    page = lambda n: "<html><body><article><h1>Title</h1><p>" + "A sentence of the article. " * 20 + "</p></article>" + "<div><span>x</b></i></u></em>" * n + "</body></html>"
    began = time.perf_counter()
    text = main_text(page(40_000))  # over 1 MB
    assert time.perf_counter() - began < 30 and text.startswith("Title\nA sentence")
    deep = "<p>" + "<span><b>" * 30_000 + "word" + "<div>y</div>" * 30_000
    began = time.perf_counter()
    main_text(deep)
    assert time.perf_counter() - began < 30


def test_links_are_known_however_deep_their_text_stands():
    def links(html):
        p = LineParser()
        p.feed(html)
        p.close()
        p.flush()
        return sum(x.links for x in p.lines)

    assert links("<p><a href='#'><span><b><i><u>six</u></i></b></span></a> rest</p>") == 3
    assert links("<p><a name='top'>anchor <b>rest</b></p>") == 0  # no link
    assert links("<p><a href='x'>one<a href='y'>two</a> rest</p>") == 6
    assert links("<p><a href='x'>open</p><p>rest</p>") == 4


def test_menu_of_deep_links_is_left_out():
    menu = "".join(f"<div><a href='{i}'><span><b><i><u>A long entry of the menu number {i}</u></i></b></span></a></div>" for i in range(12))
    page = f"<body><div>{menu}</div><div><h1>Title</h1>{'<p>' + 'A sentence of the article that goes on. ' * 12 + '</p>'}{'<p>' + 'More of it. ' * 30 + '</p>'}</div></body>"
    assert "menu" not in main_text(page) and main_text(page).startswith("Title")


def test_urls_like_version_blocks(spark, tmp_path):
    pages = [(1, "http://a/", "one"), (2, "filedesc:x", "two"), (3, "filedesc://pages.arc", "1 0 Archive\nURL IP"), (4, None, "one")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_pages(df).collect()}
    assert got == {1: ("response", None, 3), 2: ("response", None, 3), 3: ("response", None, 18), 4: ("revisit", 1, 3)}


def test_rows_without_ids_lie_in_all_blocks(spark):
    texts = [(None if i % 3 == 0 else i, f"text {i} here", "s") for i in range(6000)] + [(7, "the same", "s")] * 3000
    df = spark.createDataFrame(texts, "doc_id bigint, text string, source string").repartition(4)
    got = source_mixing.mix_sources(df, block_docs=100, budget_x=0.5).collect()
    sizes = Counter(r.block for r in got)
    assert len(got) == 9000 and len(sizes) == 90 and max(sizes.values()) < 200
    total = sum(r.n_tokens for r in got)
    used = sum(r.n_tokens * r["copies"] for r in got)
    assert total // 2 - 5 <= used <= total // 2


def test_sampled_texts_keep_within_their_bytes(spark):
    assert quality_classifier.within([(1, 0, 30), (2, 1, 90), (3, 0, 15), (4, 0, 5), (5, 1, 1)], 80) == [1, 2]
    assert quality_classifier.within([(1, 0, 30), (2, 0, 9), (3, 1, 40), (4, 0, 2)], 80) == [1, 2, 3]
    docs = [(i, ("good words here " if i % 2 else "zzz qqq xxx ") * 400) for i in range(24)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id bigint, quality int")
    model = quality_classifier.train(d, labels, most_bytes=30_000)
    score = {r.doc_id: r.score for r in quality_classifier.score_documents(d, model).collect()}
    assert sum((score[i] > 0.5) == bool(i % 2) for i in range(24)) > 20


def test_extraction_of_both_page_kinds_is_unchanged_by_repeats():
    page = "<body><article><h1>T</h1><p>" + "Words of it. " * 40 + "</p></article></body>"
    assert html_text.main_text(page) == html_text.main_text(page.replace("</p>", "</p></i></b>"))


def test_long_text_full_of_benchmark_passages(spark):
    from quirelight.llm import decontamination

    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"{item} " * 20_000), (2, "clean words only " * 50), (3, None)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(5, item), (6, f"{item} thirteen")], "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.mark_documents(d, b).collect()}
    assert got == {1: (240_000, 240_000, ["5", "6"]), 2: (150, 0, []), 3: (0, 0, [])}
