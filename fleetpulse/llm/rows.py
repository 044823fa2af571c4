"""Run a function of texts over the rows of a DataFrame, a slice of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_CHARS = 2 << 20  # texts handed to the function at a time, though never less than one text


def slices(texts: list, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def free_name(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that isn't taken."""
    while name.lower() in [t.lower() for t in taken]:
        name += "_"
    return name


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on Arrow batches of this session end at so many bytes, so that neither side holds many long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def with_results(docs: DataFrame, keep: list[str], text_col: str, results: str,
                 make: Callable[[], Callable[[list[str]], list]], drop: bool = False, most: int = SLICE_CHARS,
                 empty: str | bytes = "") -> DataFrame:
    """Columns ``keep`` as they are, and the columns ``results`` (DDL) computed from the texts.

    ``make()`` is called once per task and returns a function from a list of
    texts (null: ``empty``) to one list of values per result column. With ``drop``,
    the function returns, before these, a list of flags; False leaves a row out.
    """
    kept = docs.select(*keep)
    added = StructType.fromDDL(results)
    schema = StructType([*kept.schema.fields, *added.fields])
    types = [f.type for f in to_arrow_schema(added)]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            texts = [t or empty for t in batch.column(batch.num_columns - 1).to_pylist()]
            for low, high in slices(texts, most):
                part = batch.slice(low, high - low)
                columns = apply(texts[low:high])
                arrays = [part.column(i) for i in range(len(keep))]
                if drop:
                    flags, columns = columns[0], columns[1:]
                arrays += [pa.array(v, type=t) for v, t in zip(columns, types)]
                out = pa.RecordBatch.from_arrays(arrays, names=names)
                yield out.filter(pa.array(flags, pa.bool_())) if drop else out

    return docs.select(*keep, docs[text_col].alias(free_name("_text", keep))).mapInArrow(run, schema)


def words_of(text: str) -> list[bytes]:
    """ASCII-lower-cased words between \\x20 and \\x09-\\x0D, in UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


def input_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def over_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, list[int]], list], results: str,
                order: list[str] | None = None) -> DataFrame:
    """Brings rows with equal keys together and runs a function over many whole groups at a time.

    ``fn(rows, bounds)`` gets rows sorted by key (then by ``order``) and the
    bounds of the groups among them, and returns one list of values per result
    column. Keys are long columns; a group must fit in a task's memory.
    """
    schema = StructType.fromDDL(results)
    types, names = [f.type for f in to_arrow_schema(schema)], schema.names
    width = len(keys)

    def out(rows: pa.Table) -> pa.RecordBatch:
        changed = np.zeros(len(rows), bool)
        changed[:1] = True
        for i in range(width):
            column = rows.column(i).to_numpy()
            changed[1:] |= column[1:] != column[:-1]
        columns = fn(rows, [*np.flatnonzero(changed).tolist(), len(rows)])
        return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(i)[-1].as_py() for i in range(width)]
            same = np.ones(batch.num_rows, bool)
            for i in range(width):
                same &= batch.column(i).to_numpy(zero_copy_only=False) == last[i]
            cut_at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut_at:  # groups that end in this batch, with what was held of the first one
                yield out(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
                held = []
            elif held and [held[-1].column(i)[-1].as_py() for i in range(width)] != last:
                yield out(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield out(pa.Table.from_batches(held))

    others = [c for c in df.columns if c not in keys]
    dealt = df.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys, *(order or []))
    return dealt.mapInArrow(run, schema)
