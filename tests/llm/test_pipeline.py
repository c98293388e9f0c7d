"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tickplane.llm import byte_bpe, decontamination


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stage_names_and_columns(spark, docs, folder):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_language_stage_keeps_prose_and_drops_the_rest(spark, docs, folder):
    odd = spark.createDataFrame([(900001, "жщю фыв " * 30, None, "src0", 240), (900002, "1234 !!", None, "src0", 7), (900003, None, None, "src0", None)], docs.schema)
    kept = {r["doc_id"] for r in cp.identify_language(spark, docs.union(odd), folder).collect()}
    assert not kept & {900001, 900002, 900003} and len(kept) >= 0.98 * docs.count()


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs, folder):
    text = " ".join(f"word{i}" for i in range(200))
    copies = spark.createDataFrame([(800000 + i, text.replace("word50", f"other{i}"), "en", "src1", 1) for i in range(5)], docs.schema)
    kept = {r["doc_id"] for r in cp.drop_near_duplicates(spark, docs.union(copies), folder).collect()}
    assert {i for i in kept if i >= 800000} == {800000}


def test_near_duplicate_stage_keeps_one_row_of_null_and_repeated_ids(spark, docs, folder):
    texts = [" ".join(f"{name}{i}" for i in range(200)) for name in ("lone", "both", "twice")]
    planted = [(None, 0), (None, 0), (None, 0), (800001, 1), (None, 1), (None, 1), (800002, 2), (800002, 2), (800000, 2)]
    rows = [(i, texts[t] if n % 2 else texts[t].replace("50", "x"), "en", f"s{t}", 1) for n, (i, t) in enumerate(planted)]
    odd = spark.createDataFrame(rows + [(None, "", "en", "s3", 0)] * 2, docs.schema)
    kept = cp.drop_near_duplicates(spark, docs.union(odd), folder).collect()
    assert sorted((r["source"], r["doc_id"] or 0) for r in kept if r["source"] in ("s0", "s1", "s2", "s3")) == [("s0", 0), ("s1", 800001), ("s2", 800000), ("s3", 0), ("s3", 0)]
    plain = {r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, folder).collect()}
    assert {r["doc_id"] for r in kept if r["source"] not in ("s0", "s1", "s2", "s3")} == plain


def test_decontamination_stage_drops_leaks_only(spark, docs, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    leak = spark.createDataFrame([(700000 + i, f"some words before {r['text']} and after", "en", "src2", 1) for i, r in enumerate(items[:8])], docs.schema)
    index = decontamination.Index([(r["item_id"], r["text"]) for r in items])
    kept = {r["doc_id"] for r in cp.drop_benchmark_leaks(spark, docs.union(leak), folder).collect()}
    assert not {i for i in kept if i >= 700000} and len(index.by_length) > 0 and len(kept) >= 0.9 * docs.count()


def test_pii_stage_counts_characters_again(spark, docs, folder):
    got = cp.redact(spark, docs, folder)
    assert got.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count() == 0
    assert got.where("n_chars <> char_length(text)").count() == 0
    same = docs.where(~F.col("text").rlike("[0-9@]")).join(got.withColumnRenamed("text", "after"), "doc_id")
    assert same.where("text <> after").count() == 0


def test_token_stage_round_trip(spark, docs, folder):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = byte_bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    for r in random.Random(1).sample(cp.tokenise(spark, docs, folder).collect(), 20):
        assert b"".join(pieces[i] for i in r["ids"]).decode() == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])


def test_run_applies_all_stages(spark, docs, folder):
    got = cp.run(spark, folder).collect()
    stepped = docs
    for _, stage in cp.STAGES:
        stepped = stage(spark, stepped, folder)
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in stepped.collect())
    assert np.mean([r["n_tokens"] for r in got]) > 10


def test_stages_take_odd_tables(spark, docs, folder):
    odd = docs.limit(20).withColumns({"score": F.lit("x"), "rejected": F.lit(True), "lang_pred": F.lit(1), "component": F.lit(None).cast("string"), "id": F.lit(2)})
    odd = odd.unionByName(odd).unionByName(odd.limit(2).select(*(F.lit(None).cast(t).alias(c) for c, t in odd.dtypes)))
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, odd, folder)
        assert got.columns == odd.columns and got.count() > 0
    assert cp.tokenise(spark, odd, folder).count() == odd.count()
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), folder).count() == 0
