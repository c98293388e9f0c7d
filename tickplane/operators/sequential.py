"""Recurrences over ordered streams, in bounded memory.

Where the next state depends on the chosen past, no window plan exists.  Streams
are dealt by key, sorted within partitions and folded batch by batch; what a
stream needs between batches is its state alone, however long it is.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def fold_sorted(df: DataFrame, key: list[str], order: list[str], needs: list[str], start: Callable[[], object], fold: Callable, made: list[T.StructField]) -> DataFrame:
    """All columns of ``df`` and those of ``made``.

    ``fold(state, *values)`` takes the columns ``needs`` of a stretch of a stream
    as lists and gives the next state and a list for each made column;
    ``start()`` is a stream's first state.  Other columns are passed on as they
    are.  Streams with a null key are streams.
    """
    names, schema = df.columns, T.StructType([*df.schema.fields, *made])
    kinds = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            of = lambda c: batch.column(names.index(c)).to_pylist()  # noqa: E731, B023
            keys, columns = list(zip(*map(of, key), strict=True)), [of(c) for c in needs]
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            values: list[list] = [[] for _ in made]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                if current is None or keys[a] != current:
                    current, state = keys[a], start()
                state, found = fold(state, *(c[a:b] for c in columns))
                for out, more in zip(values, found, strict=True):
                    out += more
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], schema.names)

    return df.repartition(*(F.col(k) for k in key)).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def bounded_groups(df: DataFrame, key: list[str], order: list[str], score: str, least: int, most: int, threshold: float) -> DataFrame:
    """Adds ``group_no`` and ``group_start``: groups of at most ``most`` rows.

    A row starts a group if the group before is full, or if it has ``least`` rows
    already and the row's score reaches ``threshold``.  A null score never does.
    """

    def fold(state, scores):
        number, first, place = state
        numbers, firsts = [], []
        for value in scores:
            size = place - first
            if place and (size >= most or (size >= least and value is not None and value >= threshold)):
                number, first = number + 1, place
            numbers.append(number)
            firsts.append(first)
            place += 1
        return (number, first, place), (numbers, firsts)

    made = [T.StructField("group_no", T.LongType()), T.StructField("group_start", T.LongType())]
    return fold_sorted(df, key, order, [score], lambda: (0, 0, 0), fold, made)


def keep_previous(df: DataFrame, key: list[str], order: list[str], score: str, margin: float) -> DataFrame:
    """Adds ``held``: the level last taken up, left only for one further off than ``margin``."""

    def fold(held, levels):
        out = []
        for value in levels:
            if held is None or value is None or abs(value - held) > margin:
                held = value
            out.append(held)
        return held, (out,)

    return fold_sorted(df, key, order, [score], lambda: None, fold, [T.StructField("held", T.DoubleType())])


def greedy_reference(df: DataFrame, key: list[str], order: list[str], members: str, least: float) -> DataFrame:
    """Adds ``span_no``: a row joins the span if its set is similar to the span's union.

    The similarity is the Jaccard index, 1 for two empty sets; below ``least`` the
    row starts a span.  The state is the span's union of members.
    """

    def fold(state, rows):
        number, union = state
        out = []
        for row in rows:
            own = set(row or ())
            if union is None:
                union = own
            else:
                shared = len(union & own)
                joint = len(union) + len(own) - shared
                if (shared / joint if joint else 1.0) >= least:
                    union = union | own
                else:
                    number, union = number + 1, own
            out.append(number)
        return (number, union), (out,)

    return fold_sorted(df, key, order, [members], lambda: (0, None), fold, [T.StructField("span_no", T.LongType())])
