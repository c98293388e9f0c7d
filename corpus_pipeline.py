"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver
writes it as Parquet and rereads it as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickplane.llm import language_id as language
from tickplane.llm.byte_bpe import byte_bpe
from tickplane.llm.decontamination import drop_contaminated
from tickplane.llm.near_duplicates import near_duplicates
from tickplane.llm.pii import redact_pii
from tickplane.operators.prefilter import without
from tickplane.tables import load, stage

#: Two documents are near duplicates from this share of their shingles on, in percent.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that every language's model rejects; ``lang`` is the prediction.

    Null, empty and letterless texts are rejected.
    """
    columns = docs.columns
    model = language.learn(docs.where(~language.held_out("doc_id")), "doc_id", "text", "lang")
    found = language.identify(docs, model, "text", tuple(columns), ("__lang", "__score", "__rejected"))
    return found.where(~F.col("__rejected")).withColumn("lang", F.col("__lang")).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, the one of the least id.

    Rows without an id come after all others, and of equal ids any one row stays.
    Texts without a word are alone, so each of their rows stays.
    """
    found = stage(near_duplicates(docs, percent=NEAR_PERCENT).select("doc_id", "kept"), "found")
    if not found.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return _drop_near_duplicate_rows(docs)
    gone = found.where(~F.col("kept")).select("doc_id")
    return without(docs, "doc_id", gone, "doc_id", gone.count())


def _drop_near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """The same where ids don't tell rows apart: each row gets a staged key."""
    rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, "__row", percent=NEAR_PERCENT).select("__row", "component_id").join(rows.select("__row", "doc_id"), "__row")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")
    first = found.groupBy("component_id").agg(F.min(order)["__row"].alias("first"))
    gone = stage(found.join(first, "component_id").where("__row <> first").select("__row"), "gone")
    return without(rows, "__row", gone, "__row", gone.count()).drop("__row")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the text by its kind, and count the characters again."""
    return redact_pii(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a hash of what they decode to."""
    import public_tokenizers

    return byte_bpe(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        keep=("doc_id", "lang", "source"),
        outputs=("n_tokens", "ids", "decoded_sha256"),
    )


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact),
    ("byte_bpe", tokenise),
]

#: Signatures, models and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each one's rows staged for the next."""
    docs = load(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
