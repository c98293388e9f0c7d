"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

A window of an item's own number of words slides over the text.  Its 256-bit
SimHash is looked up by blocks of 32 bits: two fingerprints at most RADIUS bits
apart differ by at most REACH bits in one of the eight blocks, and so by at most
REACH // 4 bits in one byte of that block.  Byte tables give the items whose
byte is that near, their blocks are compared, and only then whole fingerprints;
nothing within RADIUS is passed over.  What is found is verified by the weighted
Jaccard similarity of the two bags of shingles.

Only windows that could reach the threshold are fingerprinted: the shingles
they share with an item are shingles of the benchmark, and a similarity of t
takes 2t / (1 + t) of a window's shingles.  That count is exact, so it loses
nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tickplane.llm.textkernel import Texts, grams, joined, mix64, text_chunks, tidy, words

THRESHOLD = 0.8
GRAM = 5
BITS = 256
#: At similarity 0.8 the fingerprints' angle is 0.476 rad: a distance of 38.8
#: bits on average; over 63 has a probability below 2e-5.
RADIUS = 63
BLOCKS = 8
REACH = RADIUS // BLOCKS
BLOCK_BYTES = BITS // BLOCKS // 8
#: Items, and characters of items, that one pass over the documents holds; a
#: larger benchmark takes more passes.
ITEMS_PER_PASS, CHARS_PER_PASS = 20_000, 16_000_000
#: Shingles of windows that are summed at once.
SUMMED = 1 << 14

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SALTS = np.random.default_rng(256).integers(0, 1 << 63, BITS // 64, dtype=np.uint64)


def bit_votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's fingerprint, as (n, BITS)."""
    spun = mix64(shingles[:, None] ^ _SALTS)
    return (np.unpackbits(spun.view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int8) << 1) - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Fingerprint bytes (n, BITS / 8) of summed bit votes (n, BITS)."""
    return np.packbits(sums > 0, axis=1)


@dataclass
class Items:
    """Items of one length in words, with their byte tables."""

    length: int
    gram: int
    ids: list = field(default_factory=list)
    bags: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    prints: np.ndarray | None = None
    #: tables[byte, value]: bits of the items whose byte is within REACH // 4 of the value.
    tables: np.ndarray | None = None


def bag(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: shared multiplicity over joint multiplicity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - shared
    return float(shared / whole) if whole else 0.0


class Index:
    """Items by length, and the set of their shingles by shingle size."""

    def __init__(self, rows: list[tuple]):
        by_length: dict[int, Items] = {}
        shingles: dict[int, list[np.ndarray]] = {}
        prints: dict[int, list[np.ndarray]] = {}
        for item, text in rows:
            hashes = words(joined([text.encode()])).hash
            n = len(hashes)
            if not n:
                continue
            k = min(GRAM, n)
            own = by_length.setdefault(n, Items(n, k))
            found = grams(hashes, k)
            own.ids.append(item)
            own.bags.append(bag(found))
            shingles.setdefault(k, []).append(found)
            prints.setdefault(n, []).append(fingerprints(bit_votes(found).sum(0, dtype=np.int32)[None]))
        near = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)] <= REACH // BLOCK_BYTES
        for n, own in by_length.items():
            own.prints = np.concatenate(prints[n])
            own.tables = np.stack([np.packbits(near[:, own.prints[:, byte]], axis=1) for byte in range(BITS // 8)])
        self.by_length = [by_length[n] for n in sorted(by_length)]
        self.shingles = {k: np.unique(np.concatenate(x)) for k, x in shingles.items()}


def block_candidates(items: Items, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs of which some block is within REACH, each once."""
    n = len(items.ids)
    every = np.zeros(0, np.int64)
    for block in range(BLOCKS):
        of = slice(BLOCK_BYTES * block, BLOCK_BYTES * (block + 1))
        near = np.bitwise_or.reduce([items.tables[byte, prints[:, byte]] for byte in range(of.start, of.stop)])
        window, item = np.nonzero(np.unpackbits(near, axis=1, count=n))
        close = _POPCOUNT[prints[window, of] ^ items.prints[item, of]].sum(1) <= REACH
        every = np.union1d(every, window[close] * n + item[close])
    return every // n, every % n


def candidates(items: Items, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs within RADIUS."""
    window, item = block_candidates(items, prints)
    near = _POPCOUNT[prints[window] ^ items.prints[item]].sum(1, dtype=np.int64) <= RADIUS
    return window[near], item[near]


def scan(texts: Texts, index: Index) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) of each row's best window of each item."""
    found = words(texts)
    bounds = found.bounds
    hits = {}
    for k, known in index.shingles.items():
        own = grams(found.hash, k)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[at] == own
        hits[k] = (own, np.concatenate(([0], np.cumsum(hit))), hit)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for items in index.by_length:
        own, sums, hit = hits[items.gram]
        width = items.length - items.gram + 1  # shingles in a window
        if len(own) < width:
            continue
        least = math.ceil(2 * THRESHOLD / (1 + THRESHOLD) * width - 1e-9)
        starts = np.flatnonzero(sums[width:] - sums[:-width] >= least)
        if not len(starts):
            continue
        row = np.searchsorted(bounds, starts, "right") - 1
        inside = starts + items.length <= bounds[row + 1]
        starts, row = starts[inside], row[inside]
        step = max(1, SUMMED // width)
        for low in range(0, len(starts), step):
            some, rows = starts[low : low + step], row[low : low + step]
            # A window's shingles stand side by side among the distinct ones, so running sums do.
            distinct = np.unique(some[:, None] + np.arange(width))
            sums = np.zeros((len(distinct) + 1, BITS), np.int32)
            np.cumsum(bit_votes(own[distinct]), 0, out=sums[1:])
            first = np.searchsorted(distinct, some)
            window, item = candidates(items, fingerprints(sums[first + width] - sums[first]))
            for w, i in zip(window.tolist(), item.tolist(), strict=True):
                at = int(some[w])
                value = similarity(bag(own[at : at + width]), items.bags[i])
                key = (int(rows[w]), items.ids[i])
                if value >= THRESHOLD and (value, -at) > (best.get(key, (0.0, 0, 0))[0], -best.get(key, (0.0, 0, 0))[1]):
                    best[key] = (value, at, items.length)
    for (r, item), (value, at, length) in sorted(best.items(), key=lambda x: x[0][0]):
        yield r, item, value, at - int(bounds[r]), length


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_col, similarity, first_word, n_words): benchmark passages in texts.

    One row for each document row and item whose best window of the item's size
    has a weighted shingle similarity of THRESHOLD or more; of equal windows the
    first.  Words are lower-cased (A-Z); items of fewer than five words are one
    shingle.  Null and empty texts and items match nothing; repeated document
    rows repeat their rows, repeated items (equal ids and texts) count once; a
    null id stays null; an empty table on either side gives no rows.

    A larger benchmark than ITEMS_PER_PASS or CHARS_PER_PASS is searched in
    several passes, each with the items of one hash range.
    """
    schema = T.StructType(
        [docs.schema[id_col], T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]
    )
    types = [to_arrow_type(benchmark.schema[item_col].dataType), pa.float64(), pa.int64(), pa.int64()]
    out = None
    for shared in _indexes(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                at, made = [], [[], [], [], []]
                for part in text_chunks(batch.column(1)) if index.by_length else ():
                    for row, *values in scan(part, index):
                        at.append(part.first + row)
                        for column, value in zip(made, values, strict=True):
                            column.append(value)
                columns = [pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], schema.names)

        found = docs.select(id_col, text_col).mapInArrow(tidy(run), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(benchmark: DataFrame, item_col: str, item_text: str) -> list:
    """The benchmark's index as broadcast variables, one for each pass over the documents.

    An index is built once, on the driver, and a worker reads it once; it holds
    at most about ITEMS_PER_PASS items and CHARS_PER_PASS characters, or one item.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("body")).where("body is not null").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("body")), F.lit(0)).alias("chars")).first()  # one row
    passes = max(1, math.ceil(1.2 * size["n"] / ITEMS_PER_PASS), math.ceil(1.2 * size["chars"] / CHARS_PER_PASS))
    context = benchmark.sparkSession.sparkContext
    out = []
    for turn in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(passes)) == turn).collect()
        out.append(context.broadcast(Index([(r["item"], r["body"]) for r in rows])))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark passage.

    Rules and cases are those of ``decontaminate``; null texts stay.
    """
    place, out = docs.columns.index(text_col), docs
    for shared in _indexes(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for part in text_chunks(batch.column(place)) if index.by_length else ():
                    clean[[part.first + row for row, *_ in scan(part, index)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(tidy(run), docs.schema)
    return out
