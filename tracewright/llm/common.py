"""Words, rows and small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracewright.session import materialised

WHITE_SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ws_words(text: Column) -> Column:
    """The words between runs of space, tab, LF, VT, FF and CR; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, CAPITALS, CAPITALS.lower())


def either_case(pattern: str) -> str:
    """A pattern of a-z and other characters that takes each of these letters in either case, and no other letter."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in pattern)


def sums_before(numbers: Column) -> Column:
    """For each number of an array its sum with none but the ones before it; in about size ** 1.5 steps, not size ** 2.

    Sums of blocks of about sqrt(size) numbers come first; a place adds to those of its block what the block has before it.
    """

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)

    def of(x: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int")),
                             lambda j: total(F.slice(x, j * width + 1, width)))
        return let(blocks, lambda b: let(F.transform(b, lambda v, j: total(F.slice(b, 1, j))), lambda before: F.transform(
            x, lambda v, i: F.get(before, F.floor(i / width).cast("int")) + total(
                F.slice(x, F.floor(i / width).cast("int") * width + 1, i % width)))))

    none = F.array().cast("array<bigint>")
    return let(numbers.cast("array<bigint>"), lambda x: F.when(F.size(x) == 0, none).otherwise(
        let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda width: of(x, width))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for the row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def remainder_of_id(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def with_python_columns(
    df: DataFrame,
    inputs: dict[str, Column],
    fields: list[tuple[str, T.DataType]],
    fn: Callable[[Iterable[dict]], Iterator[dict]],
) -> DataFrame:
    """Each row of df as the struct `row`, with further columns that fn makes from the inputs.

    fn gets the rows of an Arrow batch as dictionaries of inputs and gives as many dictionaries of fields, in order.
    The row itself stays in Arrow and is never touched, so its columns may have any names and types.
    """
    types = [(name, to_arrow_type(kind)) for name, kind in fields]
    names = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i + 1) for i in range(len(names))]
            rows = ({n: c[i].as_py() for n, c in zip(names, columns)} for i in range(batch.num_rows))
            made = list(fn(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([m[n] for m in made], type=t) for n, t in types)],
                names=["row", *(n for n, _ in types)],
            )

    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
                       *(c.alias(f"in_{n}") for n, c in inputs.items()))
    schema = T.StructType([packed.schema["row"], *(T.StructField(n, t) for n, t in fields)])
    return packed.mapInArrow(run, schema)


SLICES = 64


def summed_numbers(df: DataFrame, count: Callable[[Iterable[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum of the `size` whole numbers that count makes of each task's rows.

    Slices of them are added up in tasks, and the driver gets each slice once, whatever the number of tasks. size is a
    multiple of SLICES.
    """
    schema = "slice int, numbers binary"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(batches).astype("<i8").reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([n.tobytes() for n in numbers], pa.binary())],
            names=["slice", "numbers"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, numbers in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[at] = sums.get(at, 0) + np.frombuffer(numbers.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([n.tobytes() for n in sums.values()], pa.binary())],
            names=["slice", "numbers"])

    total = np.zeros((SLICES, size // SLICES), np.int64)
    parts = df.mapInArrow(cut, schema).repartition(SLICES // 4, "slice").mapInArrow(add, schema)
    for r in parts.collect():  # 8 bytes a number, whatever the input: one job, not one for each partition
        total[r.slice] += np.frombuffer(r.numbers, "<i8")
    return total.reshape(-1)


FEW_ROWS = 1_000_000  # of short columns such as ids: at most some 16 MB


def few_or_joined(keys: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """keys, written once and counted; marked for broadcast if there are few, else left to a shuffled join."""
    keys = materialised(keys)
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys
