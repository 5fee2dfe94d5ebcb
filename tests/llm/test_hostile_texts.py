"""Long and hostile texts: results stay right, and time and memory stay in proportion."""

from __future__ import annotations

import resource
import time
import tracemalloc

import numpy as np
import pytest

from tracewright.llm import html_extract, quality_classifier, url_filter

MB = 1 << 20


@pytest.mark.parametrize("piece, tail", [
    ("<a ", ""), ("<i>", "</b>"), ("<div>", "</span>"), ('<a ">" ', ""), ("<a '>\" ", ""), ("<!", ""), ("<!--", ""), ("</p", ""),
    ("<svg>", ""), ("<p><table><article>", "</nav>"), ("<a href=x class='", ""), ("&amp", "")])
def test_html_pages_take_time_in_proportion(piece, tail):
    def seconds(size: int) -> float:
        n = size // len(piece + tail)
        page = "<article><p>Seen.</p></article>" + piece * n + tail * n
        t0 = time.process_time()
        html_extract.main_text(page, {})
        return time.process_time() - t0

    seconds(10_000)
    small = max(seconds(MB // 4), 0.05)
    assert seconds(MB) < 12 * small and small < 5


@pytest.mark.parametrize("noise", ["<a ", "<i>" * 5000 + "</b>" * 5000, "<a \">\" " * 5000 + ">"])
def test_html_article_before_noise(noise):
    assert html_extract.main_text(f"<article><p>One two.</p></article>{noise}", {}) == "One two."


def test_html_formulas_and_objects_are_text():
    def text(inner: str) -> str:
        return html_extract.main_text(f"<article>{inner}</article>", {})

    assert text("<p>Area is <math><mi>a</mi><mo>+</mo><mi>b</mi></math> squared.</p>") == "Area is a+b squared."
    assert text("<p>See</p><object data=x><p>The fallback.</p></object><p>End.</p>") == "See\nThe fallback.\nEnd."
    assert text("<p>One<svg><svg><text>no</text></svg><text>label</text></svg> two.</p><svg/><p>Three.</p>") == "One two.\nThree."


def test_html_unclosed_elements_stay_the_parents_blocks():
    page = "<main>" + "<div>" * 100 + "<p>Deep <a>down</a> here.</p>" + "</div>" * 100 + "<p>Up</main>"
    listed = html_extract.tokens(page)
    assert [t["key"] for t in listed if t["words"]] == ["w p", "w a", "w p", "w p"]
    assert html_extract.main_text(page, {}) == "Deep down here.\nUp"


def test_long_urls(spark):
    long = "seaview" * 15_000  # more than 100 000 letters
    rows = [(1, f"http://example.com/{long}", "<title>the sea view</title>"), (2, "http://seaview.example.com/", "<title>sea</title>"),
            (2, "http://seaview.example.com/", "<title>sea</title>"), (3, "http://example.com/" + "q" * 100_000, None),
            (4, "http://casinowin.example.com/" + "sea" * 500, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    t0 = time.time()
    got = {r.row.page_id: r for r in url_filter.judged(df, url_filter.unigrams(df)).collect()}
    assert time.time() - t0 < 120
    assert got[1].words == ["example", "com"] + ["sea", "view"] * 15_000
    assert got[2].words == ["sea", "view", "example", "com"]
    assert got[3].words == ["example", "com", "q" * 100_000]
    assert got[4].words[:2] == ["casino", "win"] and got[4].words[4:] == ["sea"] * 500
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["allow", "allow", "allow", "block"]


def test_windows_of_names_give_all_substrings(spark):
    """Words that lie across the edges of windows, against all substrings."""
    names = ["ab" * 300 + "xyz" + "c" * 252 + "abxyz", "q", "ab", "xyzq"]
    counts = {"ab": 3, "xyz": 2, "ca": 1, "q": 5, "babx": 4, "bxyzc": 1, "none": 2}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    table = spark.createDataFrame(list(counts.items()), "word string, count long")
    got = {r.name: {t["word"]: t["count"] for t in r.table or []} for r in url_filter.word_tables(df, table).collect()}
    assert got == {n: {w: c for w, c in counts.items() if w in n and (len(w) > 1 or len(n) == 1)} for n in names}


def test_contexts_of_long_texts(monkeypatch):
    index = quality_classifier.index_vectors()
    text = "One red house, 12 blue ones; " * 40
    whole = quality_classifier.context_sums([text], index)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(quality_classifier, "SLICE", size)
        assert np.array_equal(quality_classifier.context_sums([text, None, ""], index), whole)


def test_classifier_reads_long_texts_in_bounded_memory():
    text = "some words of a long text 12 " * (20 * MB // 29)
    index = quality_classifier.index_vectors()
    tracemalloc.start()
    quality_classifier.context_sums([text], index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1200 * MB, peak / MB
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 8 << 20  # kilobytes


def test_classifier_takes_one_text_of_a_repeated_id(spark):
    rows = [(i, "red " * 30 + ("### " * 30 if i % 2 else "")) for i in range(40)] + [(0, "zzz " * 30)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    got = quality_classifier.scored(df, quality_classifier.train(df, labels)).collect()
    assert len(got) == len(rows)
    assert all((r.score >= 0.5) == (r.row.doc_id % 2 == 0) for r in got if r.row.doc_id > 0)
