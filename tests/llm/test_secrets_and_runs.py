"""Secret scans and periodic runs against brute force; raking against a plain one; corpora without words."""

import random
import re
import time
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, corpus, words
from tracewright.llm import common, mixing, periodic_runs, queries, secret_scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def digest(text):
    return sha256(text.encode()).hexdigest()


# ---- places --------------------------------------------------------------------------------------------


def test_sums_before(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(100) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 16, 17, 100, 1000)]
    got = spark.createDataFrame(rows, "x array<bigint>").select("x", common.sums_before(F.col("x")).alias("s")).collect()
    assert all(r.s == [sum(r.x[:i]) for i in range(len(r.x))] for r in got)


# ---- secrets -------------------------------------------------------------------------------------------


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


HEXED = "0123456789abcdef" * 2
BLOB = "x8Kq2LmZ7vQpR4tWs9Yb1Tn3"
TEXTS = [
    None, "", "nothing here at all", f"é password = \"hunter22\" and TOKEN:abc, Api_Key='x.y/z=+-' 😀 secret:{HEXED}",
    "token: token: abcdefgh", "passwordpasswd=abcdef", "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "A" * 15 + " AKIA" + "B" * 16,
    f"x{HEXED}AKIA{HEXED}", "a" * 23 + " " + "a" * 24 + " " + "a" * 40, f"see {BLOB} there", f"({BLOB})\n{BLOB} {HEXED}{BLOB}",
    "internationalization and characteristically", "MY_FUNCTION_FOR_INTERNATIONALIZATION", f"secret={BLOB}", "token=" * 3000, "a1b2 " * 3000,
]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    syllables = "the of tion ing er an re is to na li za for com mu ni ca".split()
    text = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 9))) for _ in range(300))) for i in range(30)]
    return secret_scan.model_of(spark.createDataFrame(text, "doc_id long, text string")), syllables


def test_secret_scan(spark, model):
    rows = [(i, t, "x", 1, "base") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None), (None, TEXTS[10], None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, markov int, row string")
    found = secret_scan.scanned(df, model[0])
    assert found.select("row.*").columns == df.columns
    got = found.select("row.text", "base", "markov").collect()
    for r in got:
        assert [(s.start, s.kind, s.end) for s in r.base] == base_spans(r.text), r.text[:80]
        assert [r.text[s.start:s.end] for s in r.markov] == re.findall(f"(?<![A-Za-z0-9]){BLOB}(?![A-Za-z0-9])", (r.text or "").replace(
            f"secret={BLOB}", "")), r.text[:80]
    by_id = {(r.doc_id, r.spans) for r in secret_scan.digests(found).collect()}
    assert (0, "") in by_id and (10, f"markov:4:{4 + len(BLOB)}") in by_id and len(got) == len(rows)


def test_secret_models_on_unseen_strings(spark, model):
    rng = random.Random(9)
    chars = secret_scan.ALPHABET
    secrets = ["".join(rng.choice(chars[:62]) for _ in range(rng.randrange(20, 40))) for _ in range(500)]
    names = []
    while len(names) < 500:
        name = "".join(rng.choice(model[1]) for _ in range(12))
        names.append(rng.choice([name, name.upper()]))
    df = spark.createDataFrame([(s, True) for s in secrets] + [(n, False) for n in names], "t string, secret boolean")
    likely = secret_scan.likeness(F.col("t"), model[0]) >= secret_scan.MARGIN * F.char_length("t")
    got = {(r.secret, r.likely): r["count"] for r in df.groupBy("secret", likely.alias("likely")).count().collect()}
    # Recall of 0.95 is what the margin promises; it is chosen to leave names alone.
    assert got.get((True, True), 0) >= 475 and got.get((False, True), 0) <= 2


def test_secret_scan_of_long_texts_ends(spark, model):
    n = 300_000
    rows = [(1, "a" * n), (2, "token=x " * (n // 8)), (3, f"{BLOB} " * (n // 25)), (4, "=" * n), (5, (HEXED + " ") * (n // 33))]
    began = time.time()
    got = {r.doc_id: (r.n_assign, r.n_hex, r.spans.count("markov")) for r in secret_scan.digests(secret_scan.scanned(
        spark.createDataFrame(rows, "doc_id long, text string"), model[0])).collect()}
    assert got[1][1] == 1 and got[2] == (0, 0, 0) and got[3][2] == n // 25 and got[5][1] == n // 33
    assert time.time() - began < 120


# ---- periodic runs -------------------------------------------------------------------------------------


def sequences():
    rng = random.Random(2)
    for _ in range(400):
        w = [f"w{rng.randrange(rng.choice([1, 2, 3, 30]))}" for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(4) if w else 0):
            a, p = rng.randrange(len(w)), rng.randrange(1, 60)
            w = w[:a] + w[a:a + p] * rng.randrange(1, 5) + w[a + p:]
        yield w
    a, b = ["a"], ["a", "b"]  # words of many overlapping runs
    for _ in range(10):
        a, b = b, b + a
        yield b
    yield ["ab"[bin(i).count("1") % 2] for i in range(256)]
    yield (["a"] * 99 + ["b"]) * 5


def test_runs_of_sequences():
    for w in sequences():
        text = " ".join(w)
        assert periodic_runs.find_runs(periodic_runs.word_numbers(text.encode().split())) == periodic_runs.brute_force(text), text


def test_runs_of_long_texts_end():
    began = time.time()
    for words_, runs in ((["same"] * 500_000, 1), ([f"w{i % 7}" for i in range(500_000)], 1),
                         ([f"w{i % 200_000}" for i in range(500_000)], 1), ((["a"] * 999 + ["b"]) * 100, 101)):
        assert len(periodic_runs.find_runs(periodic_runs.word_numbers([w.encode() for w in words_]))) == runs
    assert time.time() - began < 60


def plain_runs(doc_id, text):
    w = (text or "").encode().split()
    h, n = crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = periodic_runs.brute_force(b" ".join(w).decode())
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            digest(b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))


def test_runs_of_documents(spark, tmp_path):
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in corpus() if r[1] is None or len(r[1]) < 9000]
    rows += [(i, words(rng, rng.randrange(1, 200), 60)) for i in range(100, 200)] + [(None, None), (150, "")]
    spark.createDataFrame([(*r, None, None, 1, "runs", 2, "start", 0.5, "top", 3) for r in rows], DOCS).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_runs(*r)) for r in rows)
    assert sum(r.n_runs for r in got) > 10


# ---- raking --------------------------------------------------------------------------------------------


def plain_raking(cells, targets):
    weights = {k: float(v) for k, v in cells.items()}
    for _ in range(500):
        for d, shares in enumerate(targets):
            for value, share in shares.items():
                now = sum(w for k, w in weights.items() if k[d] == value)
                for k in weights:
                    if k[d] == value and now:
                        weights[k] *= share / now
    return weights


def test_raking_of_uneven_cells(spark):
    cells = {("a", "en"): 10000, ("a", "de"): 300, ("b", "en"): 300, ("b", "de"): 2000, ("c", "fr"): 700, ("c", "en"): 50, ("a", "fr"): 9}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, tokens long")
    total, targets = sum(cells.values()), []
    for d, power, given in ((0, 0.7, {}), (1, 0.8, {"de": 0.3})):
        sums = {}
        for k, v in cells.items():
            sums[k[d]] = sums.get(k[d], 0) + v
        own = {k: (v / total) ** power for k, v in sums.items()}
        rest = sum(v for k, v in own.items() if k not in given)
        targets.append({k: given.get(k, v * (1 - sum(given.values())) / rest) for k, v in own.items()})
    want = plain_raking(cells, targets)
    got = mixing.raked(df, {"source": 0.7, "lang": 0.8}, {"lang": {"de": 0.3}}).collect()
    assert all(abs(r.weight - want[r.source, r.lang]) < 1e-7 for r in got) and len(got) == len(cells)
    assert abs(sum(r.weight for r in got if r.lang == "de") - 0.3) < 1e-7


def test_raking_of_margins_that_contradict_each_other_ends(spark):
    df = spark.createDataFrame([("a", "en", 10), ("b", "de", 90)], "source string, lang string, tokens long")
    with pytest.warns(UserWarning, match="raking stopped"):
        assert mixing.raked(df, {"source": 0.5, "lang": 1.0}, most_rounds=3).count() == 2


def test_topics_in_either_case(spark):
    df = spark.createDataFrame([("COPYRIGHT 20",), ("All RIGHTS Reserved",), ("Licensed Under x",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(mixing.topic_of(F.col("t"))).collect()] == ["licence"] * 3 + ["prose"] * 2


def test_mixing_of_a_corpus_without_words(spark):
    df = spark.createDataFrame([(1, " "), (2, None), (3, "")], "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("s")})
    got = mixing.mixed_documents(df).collect()
    assert [r.probability for r in got] == [1.0] * 3 and all(r.kept for r in got)
