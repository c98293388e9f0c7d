"""The driver's contract."""

import importlib.util

import __spark_entry__


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_llm_queries_are_there_with_the_subpackage():
    found = {n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")}
    there = importlib.util.find_spec("tickplane.llm") is not None
    assert found == ({f"op{i}" for i in range(1, 11)} if there else set())
