"""Operators on small hand-made inputs, against plain Python."""

import random

from pyspark.sql import functions as F

from tickplane.operators import cells, measures, sequential, timeline
from tickplane.operators.components import connected_components
from tickplane.operators.prefilter import maybe_among, without


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5), (1, 2), (2, 1), (None, 4)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(y for y in linked if root(y) == root(x)) for x in linked}


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.where("a < 0")).count() == 0


def test_prefilter_loses_nothing(spark):
    rows = spark.range(5000).withColumn("x", F.col("id") % 7).unionByName(spark.sql("select cast(null as long) as id, 1L as x"))
    asked = spark.range(0, 5000, 11).withColumnRenamed("id", "k")
    n = asked.count()
    maybe = maybe_among(rows, "id", asked, "k", n)
    assert maybe.join(asked, F.col("id") == F.col("k")).count() == n
    assert maybe.count() < 4000
    left = without(rows, "id", asked, "k", n)
    assert left.count() == 5001 - n and left.where("id is null").count() == 1
    assert left.where("id % 11 = 0").count() == 0


def _machine(levels, enter, m, leave, h):
    """The detector as a state machine, one level after the other."""
    spans, low, high, start = [], 0, 0, None
    for i, v in enumerate(levels):
        if start is None:
            low = low + 1 if v <= enter else 0
            if low >= m:
                start, low, high = i - low + 1, 0, 0
        else:
            high = high + 1 if v >= leave else 0
            if high >= h:
                spans.append((start, i - high + 1))
                start, low, high = None, 0, 0
    return spans + ([(start, len(levels))] if start is not None else [])


def test_hysteresis_matches_the_state_machine(spark):
    rng = random.Random(5)
    streams = {k: [rng.choice((10, 30, 50, 55, 70, 90)) for _ in range(rng.randrange(1, 80))] for k in range(60)}
    rows = [(k, i, float(v)) for k, x in streams.items() for i, v in enumerate(x)]
    got = timeline.hysteresis_spans(spark.createDataFrame(rows, "k long, place long, v double"), ["k"], "place", "v", 40, 3, 60, 2)
    assert sorted(map(tuple, got.select("k", "start", "end").collect())) == sorted((k, a, b) for k, x in streams.items() for a, b in _machine(x, 40, 3, 60, 2))


def test_bounded_groups_start_where_expected(spark):
    scores = [0.0, 0.9, 0.5, 0.0, 0.0, 0.9]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "k long, i long, s double")
    got = sequential.bounded_groups(rows, ["k"], ["i"], "s", 2, 3, 0.4)
    assert sorted({r["group_start"] for r in got.collect()}) == [0, 2, 5]


def test_seek_carries_the_last_point_on(spark):
    points = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k long, t long, v string")
    targets = spark.createDataFrame([(1, 9), (1, 10), (1, 25), (2, 6), (3, 1)], "k long, t long")
    got = {(r["k"], r["t"]): (r["seek_at"], r["seek_v"]) for r in timeline.seek(points, targets, ["k"], "t", ["v"]).collect()}
    assert got == {(1, 9): (None, None), (1, 10): (10, "a"), (1, 25): (20, "b"), (2, 6): (5, "c"), (3, 1): (None, None)}


def test_complement_and_split(spark):
    spans = spark.createDataFrame([(1, 2, 4), (1, 6, 9)], "k long, a long, b long")
    lengths = spark.createDataFrame([(1, 12), (2, 3)], "k long, n long")
    assert sorted(map(tuple, timeline.complement(spans, lengths, ["k"], "a", "b", "n").collect())) == [(1, 0, 2), (1, 4, 6), (1, 9, 12), (2, 0, 3)]
    assert sorted(map(tuple, timeline.split(spans, ["k"], "a", "b", 2).collect())) == [(1, 2, 4), (1, 6, 8), (1, 8, 9)]


def test_plane_delta_between_frames(spark):
    planes = spark.createDataFrame([(1, 0, 5, 1), (1, 0, 6, 1), (1, 1, 5, 1), (1, 1, 7, 2), (1, 2, 5, 3)], "k long, f long, c long, v long")
    got = sorted(tuple(r) for r in cells.plane_delta(planes, ["k"], "f", "c", ["v"]).collect())
    assert got == [(1, 0, 5, "upsert"), (1, 0, 6, "upsert"), (1, 1, 6, "remove"), (1, 1, 7, "upsert"), (1, 2, 5, "upsert"), (1, 2, 7, "remove")]


def test_nearest_rank_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([(1, None), (2, 1.0), (2, 3.0), (2, 2.0)], "k long, v double")
    got = {r["k"]: r["p"] for r in measures.nearest_rank(rows, ["k"], "v", {"p": 0.5}).collect()}
    assert got == {1: 0.0, 2: 2.0}


def test_jaccard_of_empty_sets(spark):
    row = spark.sql("select array() as a, array() as b, array(1, 2) as c, array(2, 3) as d").select(cells.jaccard(F.col("a"), F.col("b")), cells.jaccard(F.col("c"), F.col("d"))).first()
    assert tuple(row) == (1.0, 1 / 3)
