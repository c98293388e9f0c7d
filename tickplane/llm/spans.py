"""Scanning whole texts for spans: shared by the secret and the PII scan."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickplane.llm.textkernel import Texts, text_chunks, tidy

#: (start, end, kind) in bytes of one text.
Span = tuple[int, int, str]
#: For the rows of a piece that have any, their spans by start and kind.
Scan = Callable[[Texts], dict[int, list[Span]]]

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def merged(base: dict[int, list[Span]], added: list[tuple[int, int, int]], kind: str, order: tuple[str, ...]) -> dict[int, list[Span]]:
    """Base spans with those added ones that overlap none of them.

    Added spans come in text order, and none overlaps another.
    """
    taken = {row: _joined(spans) for row, spans in base.items()}
    for row, start, end in added:
        starts, ends = taken.get(row, ([], []))
        if bisect.bisect_left(starts, end) == bisect.bisect_right(ends, start):
            base.setdefault(row, []).append((start, end, kind))
    rank = {k: i for i, k in enumerate((*order, kind))}
    return {row: sorted(spans, key=lambda x: (x[0], rank[x[2]], x[1])) for row, spans in base.items() if spans}


def _joined(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover together, in order."""
    starts, ends = [], []
    for start, end, _ in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def points(raw: bytes) -> np.ndarray:
    """Code points before each byte offset of a UTF-8 text."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=out[1:])
    return out


def points_at(raw: bytes, offsets: list[int]) -> dict[int, int]:
    """The same for some offsets, with no array as long as the text."""
    out, at, n = {}, 0, 0
    for offset in sorted(set(offsets)):
        n += len(raw[at:offset].decode())
        out[offset] = n
        at = offset
    return out


def find_spans(docs: DataFrame, scan: Scan, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and ``spans``: kind, start and end in code points."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("spans", SPANS, False)])
    source = docs.select(*keep, docs[text_col].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[tuple]] = [[]] * batch.num_rows
            for part in text_chunks(batch.column(len(keep))):
                for row, spans in scan(part).items():
                    at = points_at(part.bytes_of(row), [x for span in spans for x in span[:2]])
                    out[part.first + row] = [(kind, at[a], at[b]) for a, b, kind in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, _ARROW_SPANS)], schema.names)

    return source.mapInArrow(tidy(run), schema)


def replace_spans(docs: DataFrame, scan: Scan, text_col: str) -> DataFrame:
    """All columns of ``docs``; each span of the text becomes ``[KIND]``.

    Of overlapping spans, the one that starts first is replaced up to the end of
    the last of them.  A null text stays null.
    """
    names = docs.columns
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            changed: dict[int, str] = {}
            for part in text_chunks(texts):
                for row, spans in scan(part).items():
                    raw, pieces, at = part.bytes_of(row), [], 0
                    for start, end, kind in spans:
                        if start >= at:
                            pieces += [raw[at:start], f"[{kind.upper()}]".encode()]
                        at = max(at, end)
                    changed[part.first + row] = b"".join([*pieces, raw[at:]]).decode()
            if changed:
                values = texts.to_pylist()
                for row, value in changed.items():
                    values[row] = value
                texts = pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], texts, *batch.columns[place + 1 :]], names)

    return docs.mapInArrow(tidy(run), docs.schema)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, kinds: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """Counts by kind, a hash of the spans of these kinds, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(*keep, *(count(k) for k in kinds), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
