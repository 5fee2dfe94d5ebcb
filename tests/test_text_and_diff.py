"""Tokens, weights, differences, splits, results."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.operators import diff, evaluate, plans, split, text
from tracewright.sources import files


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_tokens(spark):
    df = docs(spark, " Mov , %  eax ( x\n\ty ) : $ $5 ", "", "É_1 a b2-c3 ñandú")
    ws = {r.doc_id: r.tokens for r in text.with_tokens(df, "id", "text").collect()}
    assert ws[0] == ["mov", "eax", "x", "y", "$5"] and ws[1] == []
    words = {r.doc_id: r.tokens for r in text.with_tokens(df, "id", "text", text.word_tokens).collect()}
    assert words[2] == ["é_1", "b2", "c3", "ñandú"]
    assert words[1] == []


def test_term_counts(spark):
    rng = random.Random(5)
    bodies = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    tokens = text.with_tokens(docs(spark, *bodies), "id", "text")
    got = {(r.doc_id, r.token): r.tf for r in text.term_freq(tokens).collect()}
    assert got == {(i, t): n for i, b in enumerate(bodies) for t, n in Counter(b.split()).items()}
    df = {r.token: r.df for r in text.doc_freq(tokens).collect()}
    assert df == Counter(t for b in bodies for t in set(b.split()))


def test_tfidf_against_formula(spark):
    bodies = ["a a b", "b c", "", "c c c d", "z"]
    got = {(r.doc_id, r.token): r.weight for r in text.tfidf_topk(docs(spark, *bodies), "id", "text", 3).collect()}
    df = {"b": 2, "c": 2, "a": 1}  # ties go to the first token
    idf = {t: math.log((1 + 5) / (1 + n)) + 1 for t, n in df.items()}
    for i, body in enumerate(bodies):
        raw = {t: n * idf[t] for t, n in Counter(body.split()).items() if t in df}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for t, v in raw.items():
            assert got.pop((i, t)) == pytest.approx(v / norm)
    assert not got
    dense = text.densify(text.tfidf_topk(docs(spark, *bodies), "id", "text", 3), 3, "weight", docs(spark, *bodies).withColumnRenamed("id", "doc_id"))
    for r in dense.collect():
        assert sum(x * x for x in r.features) == pytest.approx(0.0 if r.doc_id in (2, 4) else 1.0)


def test_large_vocabularies_are_joined(spark, monkeypatch):
    df = docs(spark, "a a b", "b c", "c c c d")
    small = sorted(map(tuple, text.tfidf_topk(df, "id", "text", 3).collect()))
    monkeypatch.setattr(text, "MAX_BROADCAST_TOKENS", 1)
    assert sorted(map(tuple, text.tfidf_topk(df, "id", "text", 3).select("doc_id", "token", "rank", "weight").collect())) == small


def test_line_and_positional_differences(spark):
    rows = [("p", "a\nb\n", "a\nc\nc\n\nd"), ("q", "xyz", "xaz!"), ("r", "long original", "lo"), ("s", "x", "x")]
    pairs = spark.createDataFrame([(p, f"{p}_1", c, o) for p, o, c in rows], "program string, sample_id string, content string, original string")
    lines = defaultdict(set)
    for r in diff.line_diff(pairs).collect():
        lines[r.program].add(r.line)
    # the original of p ends in a newline, so the empty line is one of its lines
    assert lines == {"p": {"c", "d"}, "q": {"xaz!"}, "r": {"lo"}}
    marks = {r.program: "".join(r.symbols) for r in diff.positional_diff_arrays(pairs).collect()}
    assert marks == {"p": "__c_c\n\nd", "q": "_a_!", "r": "__", "s": "_"}


def test_pairing(spark):
    names = ["foo", "foo_1", "foo_2", "bar", "baz_9"]
    samples = diff.with_program(spark.createDataFrame([(n, n.upper()) for n in names], "sample_id string, content string"))
    assert {r.sample_id for r in diff.originals(samples).collect()} == {"foo", "bar"}
    pairs = diff.variant_pairs(diff.originals(samples), diff.variants(samples), "sample_id")
    assert {(r.sample_id, r.original) for r in pairs.collect()} == {("foo_1", "FOO"), ("foo_2", "FOO")}


@pytest.mark.parametrize("separator", ["-", "."])
def test_prefixes_may_collide(spark, separator):
    s = separator
    programs = spark.createDataFrame([("foo",), (f"foo{s}bar",), ("fo",), ("none",)], "program string")
    samples = spark.createDataFrame([(f"foo{s}bar{s}1",), (f"foo{s}2",), ("foo",), (f"fo{s}",)], "sample_id string")
    got = {tuple(r) for r in diff.prefix_join(programs, samples, s).collect()}
    assert got == {("foo", f"foo{s}bar{s}1"), (f"foo{s}bar", f"foo{s}bar{s}1"), ("foo", f"foo{s}2"), ("fo", f"fo{s}")}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("tile", [1, 3, 512])
def test_mean_levenshtein(spark, tile):
    rng = random.Random(2)
    rows = [("hot", "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))) for _ in range(40)]
    rows += [("two", "kitten"), ("two", "sitting"), ("one", "x"), ("same", "y"), ("same", "y")]
    got = {r.g: (r.n, r.mean_distance) for r in diff.mean_levenshtein(spark.createDataFrame(rows, "g string, s string"), "g", "s", tile).collect()}
    for g in {"hot", "two", "one", "same"}:
        strings = [s for k, s in rows if k == g]
        pairs = list(itertools.combinations(strings, 2))
        total = sum(levenshtein(a, b) for a, b in pairs)
        want = 0.0 if not pairs else math.floor((200 * total + len(pairs)) / (2 * len(pairs))) / 100
        assert got[g] == (len(strings), want)


def test_fold_sizes(spark):
    samples = spark.createDataFrame([(i * 3,) for i in range(23)], "id int")
    rows = split.kfold_assign(samples, "id", 10).orderBy("id").collect()
    assert [r.fold for r in rows] == [f for f in range(10) for _ in range(3 if f < 3 else 2)]


def test_held_out_programs(spark):
    programs = spark.createDataFrame([(f"p{i:02d}",) for i in range(43)], "program string")
    got = defaultdict(list)
    for r in split.program_holdout(programs, 10).collect():
        got[r.cycle].append(r["rank"])
    assert sorted(got[None]) == [40, 41, 42]
    assert all(sorted(got[c]) == list(range(4 * c, 4 * c + 4)) for c in range(10))
    more = {(r["rank"], r.cycle) for r in split.program_holdout(programs, 5, cycles=6).collect()}
    # chunks of 8; the sixth cycle starts at 40 and has only 3 programs left
    assert {r for r, c in more if c == 5} == {40, 41, 42}


def predictions(spark):
    rows = [(8, f, c, p) for f in (0, 1) for c, p in [("JiVi", "ViJi"), ("JiVi", "JiFl"), ("Fl", "Fl"), ("Fl", "FlAr")]]
    return spark.createDataFrame(rows, "param int, fold int, class_name string, predicted string")


def test_confusion_and_accuracy(spark):
    trends = evaluate.trend_counts(predictions(spark))
    cells = evaluate.confusion_long(trends).collect()
    assert len(cells) == 25 and sum(r.n for r in cells) == 8
    modes = {r["mode"]: (r.correct, r.accuracy) for r in evaluate.accuracy_modes(trends).collect()}
    assert modes == {"strict": (2, 25.0), "viceversa": (4, 50.0), "jit": (6, 75.0), "both": (6, 75.0)}
    merged = evaluate.trend_merge(trends, trends)
    assert {r.n for r in merged.collect()} == {4}
    top = evaluate.trends_ordered(trends).first()
    assert (top.class_name, top.predicted) == ("Fl", "Fl")
    assert [r.accuracy for r in evaluate.fold_accuracy(predictions(spark)).collect()] == [0.25, 0.25]
    assert evaluate.sweep_curve(predictions(spark)).first()["mean_accuracy"] == 0.25


@pytest.mark.parametrize("by", [["param"], []])
@pytest.mark.parametrize("block", [1, 2, 1000])
def test_confusion_in_blocks_of_classes(spark, by, block):
    rng = random.Random(block)
    rows = [(p, f"c{rng.randrange(9)}", f"c{rng.randrange(3, 12)}") for p in (1, 2, 2, 3) for _ in range(20)]
    trends = evaluate.trend_counts(spark.createDataFrame(rows, "param int, class_name string, predicted string"), by)
    want = Counter()
    for p in {r[0] if by else None for r in rows}:
        mine = [r[1:] for r in rows if p in (None, r[0])]
        names = {c for r in mine for c in r}
        want.update({(p, *cell): 0 for cell in itertools.product(names, names)})
        for cell in mine:
            want[(p, *cell)] += 1
    got = evaluate.confusion_long(trends, by, block).collect()
    assert {(r.param if by else None, r.class_name, r.predicted): r.n for r in got} == dict(want) and len(got) == len(want)


def test_line_diff_steps(spark):
    rows = [("a", "x\ny\n\nx"), ("a_1", "x\nz\nz\n"), ("a_2", "y"), ("b_1", "orphan"), ("c", ""), ("c_1", "\n\nq")]
    samples = diff.with_program(spark.createDataFrame(rows, "sample_id string, content string"))
    lines = samples.select("program", "sample_id", F.explode(F.split("content", "\n")).alias("line"))
    got = diff.line_diff_steps(diff.originals(lines), diff.variants(lines), "sample_id")
    assert sorted(map(tuple, got.collect())) == [("a", "a_1", "z"), ("c", "c_1", "q")]
    whole = diff.line_diff(diff.variant_pairs(diff.originals(samples), diff.variants(samples), "sample_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select("program", "sample_id", "line").collect()))
    none = diff.line_diff_steps(diff.originals(lines).limit(0), diff.variants(lines), "sample_id")
    assert none.count() == 0


def test_dictionary_in_batches(spark, tmp_path):
    def entries(*texts):
        return text.dictionary_entries(text.with_tokens(docs(spark, *texts), "id", "text", text.whitespace_tokens))

    path = str(tmp_path / "dictionary")
    files.write_dictionary(entries("a b b", "b c"), path, "first")
    files.write_dictionary(entries("lost"), path, "second")
    files.write_dictionary(entries("b d", "", None), path, "second")  # the batch is run again
    stored = files.read_dictionary(spark, path)
    assert {r.token: (r.df, r.n) for r in stored.collect()} == {"a": (1, 5), "b": (3, 5), "c": (1, 5), "d": (1, 5)}
    unseen = text.with_tokens(docs(spark, "b b e", "e", "a"), "id", "text", text.whitespace_tokens)
    weights = {(r.doc_id, r.token): (r["rank"], r.weight) for r in text.tfidf_stored(unseen, stored, 2).collect()}
    assert weights == {(0, "b"): (1, 1.0), (2, "a"): (2, 1.0)}


def test_classes(spark):
    train = spark.createDataFrame([(2, "b"), (1, "c"), (3, "c")], "sample_id int, class_name string")
    test = spark.createDataFrame([(1, "z"), (2, "b"), (3, "a")], "sample_id int, class_name string")
    got = {r.class_name: r.class_idx for r in evaluate.class_index(train, test).collect()}
    assert got == {"c": 0, "b": 1, "z": 2, "a": 3}
    letters = {r.class_name: r.letter for r in evaluate.class_letters(train).collect()}
    assert letters == {"b": "A", "c": "B"}


def test_plans(spark):
    programs = spark.createDataFrame([("p", None), ("q", "Old")], "program string, label string")
    pool = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "x string")
    got = {(r.program, r.label) for r in plans.label_plans(programs, pool, 2).collect()}
    two = {f"{a}_{b}" for a, b in itertools.permutations("ABC", 2)}
    assert got == {("p", x) for x in two} | {("q", f"Old_{x}") for x in two} | {("p", "Ident"), ("q", "Ident")}


def test_diff_tokens(spark):
    assert text.symbol_tokens is not None
    df = docs(spark, "A_\n b")
    assert df.select(text.symbol_tokens(F.col("text"))).first()[0] == ["a", "_", "b"]


def test_plans_of_many_names(spark):
    programs = spark.createDataFrame([("p", "x"), ("q", None)], "program string, label string")
    pool = spark.createDataFrame([(f"n{i % 250}",) for i in range(300)] + [(None,)], "name string")
    got = [(r.program, r.steps, r.label) for r in plans.label_plans(programs, pool, 2).collect()]
    steps = [f"n{i}_n{j}" for i in range(250) for j in range(250) if i != j]
    want = [("p", s, f"x_{s}") for s in steps] + [("q", s, s) for s in steps] + [("p", "", "Ident"), ("q", "", "Ident")]
    assert sorted(got) == sorted(want)
    assert plans.label_plans(programs, pool.where("false"), 1).count() == 2
