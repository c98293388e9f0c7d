"""A lossless pre-filter before a join: a bit table of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bit table has at most this many 64-bit words, whatever is asked for.
MAX_WORDS = 1 << 19


def _marked(rows: DataFrame, key: str, asked: DataFrame, asked_key: str, n_asked: int) -> DataFrame:
    """``rows`` with ``__maybe``: false only if the key is certainly not among ``asked``.

    The bit table is summed by word before anything moves and has at most
    MAX_WORDS rows of 16 bytes, which is what makes its broadcast safe at any
    input size; with very many keys it just marks more rows.
    """
    words = 1 << 10
    while words < MAX_WORDS and 2 * words < n_asked:
        words *= 2
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(words * 64))
    bits = asked.where(F.col(asked_key).isNotNull()).select(place(F.col(asked_key)).alias("p")).groupBy((F.col("p") / 64).cast("int").alias("__word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("__bits")
    )
    spread = rows.withColumn("__p", place(F.col(key))).withColumn("__word", (F.col("__p") / 64).cast("int"))
    met = spread.join(F.broadcast(bits), "__word", "left")
    maybe = F.col(key).isNotNull() & F.expr("coalesce(shiftright(__bits, cast(__p % 64 as int)) & 1L, 0L) = 1")
    return met.withColumn("__maybe", maybe).select(*rows.columns, "__maybe")


def maybe_among(rows: DataFrame, key: str, asked: DataFrame, asked_key: str, n_asked: int) -> DataFrame:
    """Rows whose key may be among ``asked``: all that are, and few others.

    A join that follows gives the same rows, but shuffles less.  Null keys are
    dropped.
    """
    return _marked(rows, key, asked, asked_key, n_asked).where("__maybe").drop("__maybe")


def without(rows: DataFrame, key: str, gone: DataFrame, gone_key: str, n_gone: int) -> DataFrame:
    """Rows whose key is not among ``gone``; only those that may be go through a join.

    Rows with a null key stay.  ``rows`` is read twice, which is why it should be
    a table.
    """
    marked = _marked(rows, key, gone, gone_key, n_gone)
    unsure = marked.where("__maybe").drop("__maybe")
    kept = unsure.join(gone.select(F.col(gone_key).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")
    return marked.where("not __maybe").drop("__maybe").unionByName(kept)
