"""Files in and out."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import evaluate, traces
from tracewright.sources import files, logs
from tracewright.streaming import incremental


def write(folder, **contents):
    folder.mkdir(exist_ok=True)
    for name, text in contents.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_corpus_and_lines(spark, tmp_path):
    path = write(tmp_path / "c", a_1__seq="x\n\ny\n", b__seq="", a_1__label="L")
    got = {(r.sample_id, r.content) for r in files.read_corpus(spark, path, "seq").collect()}
    assert ("a_1", "x\n\ny\n") in got and all(s != "label" for s, _ in got)
    lines = files.line_scan(files.read_corpus(spark, path, "seq").filter("sample_id = 'a_1'").select("sample_id", "content"))
    assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == [(1, "x"), (2, ""), (3, "y"), (4, "")]


def test_lines_of_a_file_read_in_many_blocks(spark, tmp_path):
    path = write(tmp_path / "big", t__dyndis="".join(f"line {i}\n" for i in range(5000)), u__dyndis="one\ntwo")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.read_lines(spark, path, "dyndis")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort" not in plan and "Window" not in plan  # lines stay where they are
    got = lines.orderBy("sample_id", "line_no").collect()
    assert [(r.line_no, r.line) for r in got if r.sample_id == "t"] == [(i + 1, f"line {i}") for i in range(5000)]
    assert [(r.line_no, r.line) for r in got if r.sample_id == "u"] == [(1, "one"), (2, "two")]


def test_vectors(spark):
    df = spark.createDataFrame([(1, "[0.0, 0.57, 1e-3]"), (2, "[1, x]"), (3, "[7]")], "id int, content string")
    good, bad = files.quarantine(df.select("id", files.vector_from_text(F.col("content")).alias("features")))
    assert {r.id: r.features for r in good.collect()} == {1: [0.0, 0.57, 0.001], 3: [7.0]}
    assert [r.id for r in bad.collect()] == [2]
    numbers = files.scalar_lines(spark.createDataFrame([(1, "1\n\n2.5\n")], "id int, content string"))
    assert [(r.line_no, r.value) for r in numbers.orderBy("line_no").collect()] == [(1, 1.0), (3, 2.5)]


def test_nominal(spark):
    df = spark.createDataFrame([("[12, 0.5, 'Yes', 'No', 'abc']\n",)], "content string")
    assert df.select(files.nominal_vector(F.col("content"))).first()[0] == [12.0, 0.5, 1.0, 0.0, 0.0]
    assert df.select(files.nominal_vector_for_plots(F.col("content"))).first()[0] == ["12", "0.5", "1", "0", "'abc'"]


def test_symbol_prefix(spark):
    df = spark.createDataFrame([("ab\ncd\n",)], "content string")
    one = lambda n: df.select(files.symbol_prefix(F.col("content"), n)).first()[0]
    assert one(0) == list("abcd") and one(3) == list("abc") and one(9) == list("abcd")


def test_metadata(spark):
    rows = [
        ("['--Transform=Flatten', '--FlattenKinds=switch', '--Functions=main', '--Transform=Jit', '--AKind=b c', '--out=a.c']",),
        ("plain Ident",),
        ("['--Transform=X_', '--K=1', '--K=2']",),
    ]
    df = spark.createDataFrame(rows, "content string").select(
        files.metadata_class(F.col("content")).alias("c"), files.metadata_params(F.col("content")).alias("p")
    ).withColumn("full", files.full_class_name(F.col("c"), F.col("p")))
    got = [(r.c, {k.strip(): v for k, v in r.p.items()}, r.full) for r in df.collect()]
    assert got == [
        ("Flatten_Jit", {"FlattenKinds": "switch", "AKind": "b c"}, "Flatten_Jit_AKind_bc_FlattenKinds_switch"),
        ("Ident", {}, "Ident"),
        ("X_", {"K": "2"}, "X__K_2"),
    ]


def test_label(spark):
    df = spark.createDataFrame([("A_B_\nrest",), ("A",)], "content string")
    assert [r[0] for r in df.select(files.label_from_text(F.col("content"))).collect()] == ["A_B_", "A"]
    assert [r[0] for r in df.select(files.label_from_text(F.col("content"), True)).collect()] == ["A_B", "A"]


@pytest.mark.parametrize("run_length", [1, 2, 1000])
def test_testcase_arguments(spark, run_length):
    text = ["args : ['x --sym-args 1']", "object 0: data: 'no'", "object 0: name: n_args", "object 0: data: 'no'",
            "object 1: name: 'arg0'", "size 4", "object 1: data: 'ab'", "object 1: data: 'no'", "name: 'arg1'", "data: 'c d'"]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)], "file_id string, line_no bigint, line string")
    args = logs.testcase_args(lines, run_length)
    assert [r.arg for r in args.orderBy("line_no").collect()] == ["ab", "c d"]
    whole = logs.argument_text(args, run_length).orderBy("part").collect()
    assert "".join(r.args for r in whole) == "ab c d "


@pytest.mark.parametrize("run_length", [1, 3, 1000])
def test_prediction_logs(spark, run_length):
    def parse(text, experiment):
        lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(text)], "file_id int, line_no bigint, line string")
        return [tuple(r)[2:] for r in logs.parse_predictions(lines, experiment, run_length).orderBy("line_no").collect()]

    one = ["Class:Z,Predicted:Z", "Tree Depth: 8", "Class:A,Predicted:B", "noise", "Class:B,Predicted:B", "Target Dimensionality: 64",
           "Class:A,Predicted:A"]
    assert parse(one, "exp1") == [(8, "A", "B"), (8, "B", "B"), (64, "A", "A")]
    two = ["Experiment 2", "Depth: 8", "x/a_1.dyndis: Class: A, Predicted: B", "Dimensionality: 16", "y.t: Class: C_1, Predicted: C_1"]
    assert parse(two, "exp2") == [(8, "x/a_1.dyndis", "A", "B"), (16, "y.t", "C_1", "C_1")]
    with pytest.raises(ValueError):
        parse(two, "exp3")


def test_round_trips(spark, tmp_path):
    vectors = spark.createDataFrame([("a", "freq", [1.0, 2.5]), ("a", "hmm", [0.5])], "sample_id string, kind string, features array<double>")
    files.write_vectors(vectors, str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v"), "freq").first()["features"] == [1.0, 2.5]
    files.write_vector_text(vectors, str(tmp_path / "vt"))
    text = spark.read.json(str(tmp_path / "vt")).filter("kind = 'freq'").first()["content"]
    assert json.loads(text) == [1.0, 2.5]

    found = spark.createDataFrame([("exp1", 8, "B", "A"), ("exp1", 8, "B", "B"), ("exp1", 8, "A", "A")], "experiment string, param int, class_name string, predicted string")
    files.write_predictions(found, str(tmp_path / "p"))
    files.write_predictions(found, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 6
    matrix = evaluate.confusion_pivot(evaluate.confusion_long(evaluate.trend_counts(back)), ["A", "B"])
    files.write_confusion_csv(matrix, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["2,0", "2,2"]

    vocabulary = spark.createDataFrame([("x", 3)], "token string, df bigint")
    files.write_vocabulary(vocabulary, str(tmp_path / "d"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "d")).collect()] == [("x", 3)]

    lines = spark.createDataFrame([("p", "p_1", "x"), ("p", "p_1", "y"), ("p", "p_2", "x")], "program string, sample_id string, line string")
    assert [tuple(r) for r in files.write_differences(lines, str(tmp_path / "l")).collect()] == [("p", 2)]


def test_unprocessed_and_labels(spark):
    samples = spark.createDataFrame([(1, "a"), (2, "b")], "sample_id int, x string")
    done = spark.createDataFrame([(1, "L")], "sample_id int, class_name string")
    assert [r.sample_id for r in files.unprocessed(samples, done, "sample_id").collect()] == [2]
    assert [r.sample_id for r in files.labelled_only(samples, done, "sample_id").collect()] == [1]
    assert [tuple(r) for r in files.with_labels(samples, done, "sample_id").collect()] == [(1, "a", "L")]
    assert [tuple(r) for r in files.with_labels(samples, done, "sample_id", ["x"]).collect()] == [(1, "a", "L")]


def test_new_traces_are_processed_once(spark, tmp_path):
    trace = "Breakpoint 1\n=> 1 <main>:\tret\n"
    path = write(tmp_path / "in", a__dyndis=trace)
    where = dict(extension="dyndis", out=str(tmp_path / "out"), progress=str(tmp_path / "progress"))
    incremental.process_new_traces(spark, path, **where)
    write(tmp_path / "in", b__dyndis=trace)
    incremental.process_new_traces(spark, path, **where)
    incremental.process_new_traces(spark, path, **where)
    got = spark.read.parquet(where["out"]).orderBy("sample_id").collect()
    assert [(r.sample_id, r.step, r.opcode) for r in got] == [("a", 1, "ret"), ("b", 1, "ret")]


def test_runs(spark):
    df = spark.createDataFrame([("ok",), ("Failed",), ("Segmentation fault",)], "t string")
    assert [r.t for r in traces.successful_runs(df, "t").collect()] == ["ok"]


def test_escapes_of_arguments(spark):
    rows = [(r"a\x41\n\\\102\351", "aA\n\\B\u00e9"), (r"\q\x4", r"\q\x4"), ("plain", "plain"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(logs.unescaped(F.col("a")).alias("a"), "b").filter("a <> b").collect() == []
