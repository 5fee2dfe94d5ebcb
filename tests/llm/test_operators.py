"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import check
import corpus_pipeline
from tracewright.llm import (
    components,
    decontaminate,
    hashing,
    html_extract,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    quality_classifier,
    quality_rules,
    queries,
    substring_dedup,
    url_filter,
)

SF = "/root/testdata/sf0.001"
# Columns whose names the operators use themselves.
DOCS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
    ("n_chars", T.LongType()), ("id", T.StringType()), ("key", T.LongType()), ("row", T.StringType()),
    ("score", T.DoubleType()), ("spans", T.StringType()), ("n_words", T.LongType()))])


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, empty, blank and long texts, repeated rows and a null id."""
    rng = random.Random(5)
    passage, long = words(rng, 70, 5000), words(rng, 6000, 3000)
    base = words(rng, 200, 5000)
    near = base.split()
    near[50], near[120] = "other", "words"
    texts = [base, " ".join(near), base, None, "", " \n\t ", words(rng, 30, 5000) + " " + passage, passage + "\n" + words(
        rng, 20, 5000), long, long + " tail", "One\nÉté à la\tplage", "one two three", "One two three", "same " * 400,
        "same " * 300, "The line of code number 1.\nThe line of code number 2.\nThe line of code, number 2.\nshort\nshort"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, base), (None, base), (40, passage), (40, passage)]
    return [(i, t, None if i in (1, None) else "en", "s" if i else None, None, "x", 1, "r", 0.5, "s", 3) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def pairs():
    return [(r[0], r[1]) for r in corpus()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_word_codes_tell_words_apart_and_do_not_hang_on_slices():
    text = " a b\tab  ba\x0ba é\x85é " + "long " * 5
    codes = hashing.word_codes(text)
    split = text.encode().split()
    assert len(codes) == len(split)
    assert len(set(codes.tolist())) == len(set(split))
    assert (hashing.word_codes("AÉ", lower=True) == hashing.word_codes("aÉ")).all()
    old, hashing._CHUNK = hashing._CHUNK, 8
    try:
        assert (hashing.word_codes(text) == codes).all()
    finally:
        hashing._CHUNK = old


def test_substring_dedup(docs):
    got = [tuple(r) for r in substring_dedup.digests(substring_dedup.without_repeats(docs)).collect()]
    same(got, substring_dedup.brute_force(pairs()))
    small = substring_dedup.digests(substring_dedup.without_repeats(docs, window=5, anchor=2, shard_chars=100)).collect()
    same(map(tuple, small), substring_dedup.brute_force(pairs(), window=5))


def test_ngram_join(docs):
    got = [tuple(r) for r in ngram_join.near_duplicates(docs).collect()]
    same(got, ngram_join.brute_force(pairs()))
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    least = {c for _, _, c in ngram_join.brute_force(pairs()) if c is not None}
    assert {r.doc_id for r in left.collect()} == least | {None}


def test_ngram_join_connects_chains_of_many_near_copies(spark):
    rng = random.Random(3)
    text, rows = words(rng, 60, 10**6).split(), []
    for i in range(60):
        rows.append((i, " ".join(text)))
        text[rng.randrange(60)] = f"new{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(map(tuple, ngram_join.near_duplicates(df).collect()), ngram_join.brute_force(rows))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100} | {200 + i: 100 for i in range(50)}


def test_decontamination(spark, docs):
    items = [(1, "Same same same"), (1, "w1"), (None, "one TWO three"), (3, None), (4, "..."), (5, corpus()[6][1]), (12, "é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.brute_force(pairs(), items)
    same(map(tuple, decontaminate.digests(decontaminate.find_items(docs, bench)).collect()), want)
    # Items in several blocks give the same.
    blocks = decontaminate.digests(decontaminate.find_items(docs, bench, block_bytes=200))
    same(map(tuple, blocks.collect()), want)
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup(spark, edits):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        line = "".join(rng.choice("abcé ") for _ in range(rng.randrange(18, 50)))
        text = [line]
        for _ in range(3):
            at = rng.randrange(len(line))
            line = line[:at] + rng.choice(["", "x", "xy"]) + line[at + rng.randrange(2):]
            text.append(line)
        rows.append((i, "\n".join(text) + "\n\nshort"))
    rows += [(50, None), (51, ""), (52, " "), (3, rows[3][1]), (60, rows[2][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, key int")
    out = line_dedup.without_lines(df, edits=edits)
    got = {(r.row.doc_id, r.row.text): r.gone for r in out.where("gone is not null").collect()}
    assert got == line_dedup.brute_force(rows, edits)
    assert out.count() == len(rows)
    assert out.select("row.*").columns == df.columns


def test_line_dedup_leaves_null_ids(docs):
    rows = line_dedup.without_lines(docs).collect()
    assert [r.gone for r in rows if r.row.doc_id is None] == [None]
    assert {(r.row.doc_id, r.n_lines, r.kept) for r in rows if r.row.text is None} == {(3, 0, None)}


def test_banded_edit_distance(spark):
    rng, rows = random.Random(1), [("", ""), ("", "a"), ("a", ""), ("ab", "ba"), ("x" * 40, "x" * 41)]
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 60)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = rng.choice(["", "a", "bé"])
        rows.append((a, "".join(b)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    df = spark.createDataFrame(rows, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select(line_dedup.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
        assert [r.w for r in got] == [distance(*r) <= edits for r in rows]


def test_quality_rules(docs):
    out = quality_rules.judged(docs).collect()
    by_id = {r.row.doc_id: r for r in out}
    assert len(out) == len(corpus())
    assert by_id[3].n_words == by_id[4].n_words == by_id[5].n_words == 0 and by_id[3].base_failed
    assert by_id[13].n_repeat_words == 400 and by_id[13].base_failed
    assert by_id[8].n_repeat_words == 0 and by_id[15].n_dup_lines == 1


def test_language_counts():
    text = "Été à 3 heures, ne pas courir !"
    want = language_id.brute_force_counts(text)
    got = language_id.bucket_counts(text, bits=20)
    assert sorted(got[got > 0].tolist()) == sorted(want.values())
    old, language_id.SLICE = language_id.SLICE, 4
    try:
        assert (language_id.bucket_counts(text, bits=20) == got).all()
    finally:
        language_id.SLICE = old


def test_language_id(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(w.split()) for _ in range(30)), lang) for i, (lang, w) in enumerate(
        [("xx", "the of and to"), ("yy", "der die und zu"), ("zz", "les et une pour")] * 20)]
    rows += [(100, None, "xx"), (101, "", "yy"), (102, "12 !!", "zz"), (103, "the and", None), (103, "und die", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("?"))
    model = language_id.train(df)
    got = language_id.predicted(df, model).collect()
    assert all(r.lang_pred == r.row.lang for r in got if r.row.doc_id < 100)
    assert [r.lang_pred for r in got if r.row.doc_id > 99] == ["und", "und", "und", "xx", "yy"]
    assert all(0 <= r.score <= 1 for r in got)
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 1)
    again = language_id.predicted(df, model).collect()
    assert [(r.lang_pred, round(r.score, 9)) for r in again] == [(r.lang_pred, round(r.score, 9)) for r in got]
    nothing = language_id.predicted(df, language_id.train(df.where("lang is null"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_quality_classifier(spark):
    rng = random.Random(4)
    rows = [(i, " ".join((rng.choice(["red", "blue", "sky", "tree"]) + ("###" if i % 2 else "")) for _ in range(40)))
            for i in range(80)] + [(200, None), (201, ""), (1, "red### sky###"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (61, None)], "doc_id long, quality int")
    got = quality_classifier.scored(df, quality_classifier.train(df, labels, per_class=25)).collect()
    assert all((r.score >= 0.5) == (r.row.doc_id % 2 == 0) for r in got if r.row.doc_id in range(2, 80))
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    one = quality_classifier.scored(df, quality_classifier.train(df, labels.where("quality = 1")))
    assert {r.score for r in one.collect()} == {1.0}
    none = quality_classifier.scored(df, quality_classifier.train(df, labels.where("false")))
    assert {r.score for r in none.collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) document.write("</p>")</script></head>
<body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>ly&nbsp;put<br>on two.</p><div class="ad">Buy</div><p>Second
<p>Third &lt;3<aside>Side</aside><form>Name</form><section id="comments"><p>I agree</p></section></article>
<footer>&copy; us</footer></body>"""


def test_html_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>only</p>"), (1, "u", PAGE), (5, "u", "<!-- x --><nav>m</nav>")]
    df = spark.createDataFrame(rows, "page_id long, main string, html string")
    got = {r.row.page_id: r.main for r in html_extract.extracted(df, html_extract.learn(df)).collect()}
    assert got == {1: "Head & line\nFirst boldly put on two.\nSecond\nThird <3", 2: "", 3: "", 4: "only", 5: ""}


def test_html_run_without_a_named_content():
    weights = {"w p": 2.0, "p": -0.1, "/p": -0.1, "w a": 0.05, "a": -3.0, "/a": -3.0, "li": -3.0, "/li": -3.0}
    page = "<li><a>one two three</a></li><p>The text of the page.</p><p>More.</p><li><a>four five</a></li>"
    assert html_extract.main_text(page, weights) == "The text of the page.\nMore."
    assert html_extract.best_run([-1.0, 2.0, -1.0, 3.0, -9.0, 4.0]) == (1, 4)
    assert html_extract.best_run([-1.0, 0.0]) == (0, 0)


@pytest.mark.parametrize("raw", [
    "<script>for(i=0;i<n;i++)f(i)</script>", "<SCRIPT>a<b&&'</p>'</Script >", "<style>p::before{content:'<b'}</style>",
    "<script>s='<!--'</script>", "<svg><style>a<b</style><path/></svg>", "<template><script>i<n</script><p>no</p></template>",
    "<textarea><x</textarea>", "<script>s='</scripts><q'</script>"])
def test_html_raw_elements_end_at_their_own_tag(raw):
    page = f"{raw}<article><p>One two.</p>{raw}<p>Three.</p></article>"
    assert html_extract.main_text(page, {}) == "One two.\nThree."
    assert html_extract.main_text("<p>Seen.</p><script>i<n", {}) == "Seen."


@pytest.mark.parametrize("around", [
    "<div class='overflow-hidden'>{}</div>", "<div class='row has-sidebar'>{}</div>", "<div class=no-sidebar>{}</div>",
    "<div class='with-banner'><div id='page-search'>{}</div></div>", "<div class='hidden'>{}</div>", "<form>{}</form>"])
def test_html_wrappers_of_the_article_stay(around):
    article = "<article class='post comments-open'><p>One two.</p><div class='Ad'>Buy</div></article>"
    comments = "<div class='comments'><article class='comment'><p>I agree with you</p></article></div>"
    related = "<aside><article>Teaser</article></aside>"
    for page in (around.format(article), around.format(article + comments), related + around.format(article)):
        assert html_extract.main_text(f"<nav>Menu</nav>{page}<div class='ad'>Buy this</div>", {}) == "One two."


def test_html_marks_inside_the_article_leave_out():
    page = "<main><p>One two.</p><div class='related'><article>Teaser</article></div><p>Three.</p></main>"
    assert html_extract.main_text(page, {}) == "One two.\nThree."


def test_html_extraction_of_the_table(spark):
    """Against the inner text of the article element, cut out by patterns that fit these pages."""
    got = {r.page_id: r.text for r in queries.QUERIES["op2_html_extraction"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_url_filter(spark):
    urls = {1: "HTTP://WWW.Casino-Win.example.org/en/1?x=://y", 2: "https://cheappills.example.com/", 3: "http://a.example.net/en/1",
            4: "http://a.example.net", 5: "http://a.net/x", 6: None, 7: "no scheme", 8: "http://example.com/de/", 9: "x://b.org/fr/q",
            10: "x://notnet/fr/", 11: "http://library.example.com#a/b", 12: "x://net/"}
    df = spark.createDataFrame([(i, u, "<title>The library of the sea</title>", "h") for i, u in urls.items()],
                               "page_id long, url string, html string, host string")
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(df, url_filter.unigrams(df)).collect()}
    assert got == {
        1: ("www.casino-win.example.org", "/en/1", None, "block"), 2: ("cheappills.example.com", "/", None, "block"),
        3: ("a.example.net", "/en/1", "example.net/en/", "allow"), 4: ("a.example.net", "", None, "allow"),
        5: ("a.net", "/x", "net/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("example.com", "/de/", "example.com/de/", "block"), 9: ("b.org", "/fr/q", "org/fr/", "allow"),
        10: ("notnet", "/fr/", None, "allow"), 11: ("library.example.com", "", None, "allow"), 12: ("net", "/", "net/", "block")}


def test_every_title_word_takes_part_in_the_segmentation(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    filler = " ".join("".join(rng.choice(letters) for _ in range(7)) for _ in range(120000))
    long = "winterlandschaftsfotografiekurse"
    rows = [(1, "http://winterhof.example.com/", f"<title>{filler} {filler}</title>"),
            (2, f"http://{long}.example.com/", f"<title>winter hof {long}</title>"), (3, "http://win.example.com/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.row.page_id: (r.words[:-2], r.verdict) for r in url_filter.judged(df, url_filter.unigrams(df)).collect()}
    assert got == {1: (["winter", "hof"], "allow"), 2: ([long], "allow"), 3: (["win"], "block")}


def test_segmentation_is_the_likeliest():
    model = {"a": -1.0, "ab": -1.5, "b": -2.0, "c": -3.0, "bc": -2.0, "": -9.0}
    assert url_filter.segmented("abbc", model) == ["ab", "bc"]
    assert url_filter.segmented("", model) == []
    assert url_filter.segmented("zyab", model) == ["zy", "ab"]
    assert url_filter.segmented("abc", {"ab": -1.0, "c": -1.0, "": -9.0}) == ["ab", "c"]


def test_mixing(spark, docs):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(1, 60)) + (" 2024" if i % 3 else ""), rng.choice(["en", "en", "en", "de"]),
             rng.choice("aaaab")) for i in range(2000)] + [(None, "x y", None, None), (1, None, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit(1))
    out = mixing.mixed_documents(df, given={"lang": {"de": 0.5}}, budget=0.4).cache()
    assert out.count() == len(rows) and out.select("row.*").columns == df.columns
    cells = out.where("tokens > 0").groupBy("row.lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t"))
    sums = {r.lang: r.t for r in cells.collect()}
    total = out.agg(F.sum("tokens")).first()[0]
    assert abs(sum(sums.values()) / total - 0.4) < 1e-6
    assert 0.9 < sums["de"] / sums["en"] < 1 + 1e-6  # the given share, but for what full cells leave
    kept = out.where("kept").agg(F.sum("tokens")).first()[0]
    assert abs(kept / total - 0.4) < 0.05
    assert mixing.mixed_documents(docs).count() == len(corpus())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    ok, line = check.compare(spark, check.connect(SF), SF, name)
    assert ok, line


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    lang = queries.QUERIES["op5_language_id"](spark, SF).join(truth, "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.95 * lang.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    quality = queries.QUERIES["op8_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out")
    assert quality.where("quality = predicted").count() >= 0.9 * quality.count()


@pytest.mark.parametrize("empty", ["documents", "all"])
def test_empty_tables(spark, tmp_path, empty):
    for name in ("documents", "pages", "benchmark", "labels"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df.where("false") if empty == "all" or name == "documents" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, run in queries.QUERIES.items():
        n = run(spark, str(tmp_path)).count()
        assert n == 0 or empty != "all" and name in ("op2_html_extraction", "op6_url_filter"), name


def test_pipeline(spark):
    """Each stage against brute force on what the one before has kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        kept[name] = [r.asDict() for r in rows]
    first, lines, one, clean, last = kept.values()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    assert all(quality.get(r["doc_id"], 1) == 1 for r in first)
    assert sum(quality.values()) - sum(quality.get(r["doc_id"], 0) for r in first) <= 1  # clean ones stay
    gone = line_dedup.brute_force([(r["doc_id"], r["text"]) for r in first])
    want = {}
    for r in first:
        split = r["text"].split("\n")
        left = [x for i, x in enumerate(split) if i not in gone.get((r["doc_id"], r["text"]), [])]
        if len(left) == len(split) or any(x.strip() for x in left):
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in lines} == want
    joined = ngram_join.brute_force([(r["doc_id"], r["text"]) for r in lines])
    assert {r["doc_id"] for r in one} == {c for _, _, c in joined}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = decontaminate.brute_force([(r["doc_id"], r["text"]) for r in one], items)
    assert {r["doc_id"] for r in clean} == {f[0] for f in found if not f[-1]}
    assert {r["doc_id"] for r in last} <= {r["doc_id"] for r in clean} and len(last) >= 0.6 * len(clean)
    assert set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}


def test_run_writes_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
