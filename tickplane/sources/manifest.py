"""Corpus manifests: JSON documents to rows, with schemas declared by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a manifest says of each entry; fields that it lacks are null.
ENTRIES = (
    "format string, entries array<struct<id: string, structuralClass: string, generator: string, seed: bigint, grid: struct<columns: int, rows: int>, paletteDepth: int, cadence: string, frames: int, "
    "provenance: struct<license: string, creator: string, method: string>>>"
)


def manifest_entries(documents: DataFrame) -> DataFrame:
    """(path, id, structural_class, generator, seed, columns, rows, depth, cadence, frames, license) of parsed manifests (path, m)."""
    each = documents.select("path", F.explode("m.entries").alias("e"))
    return each.select(
        "path", F.col("e.id").alias("id"), F.col("e.structuralClass").alias("structural_class"), F.col("e.generator").alias("generator"), F.col("e.seed").alias("seed"), F.col("e.grid.columns").alias("columns"),
        F.col("e.grid.rows").alias("rows"), F.col("e.paletteDepth").alias("depth"), F.col("e.cadence").alias("cadence"), F.col("e.frames").alias("frames"), F.col("e.provenance.license").alias("license"),
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, m) of JSON files, one document each; ``m`` is null where a file is no such document."""
    whole = spark.read.format("binaryFile").load(path)
    return whole.select("path", F.from_json(F.decode("content", "UTF-8"), ENTRIES).alias("m"))
