"""Ranks, look-ups and lineage."""

import random

from pyspark.sql import functions as F

from meshwright.planning import lineage, ranking, skew


def test_spread_rank_is_a_permutation(spark):
    rows = [("hot", k) for k in range(500)] + [(None, k) for k in range(500, 520)] + [("b", 600)]
    df = spark.createDataFrame(rows, "g string, id long")
    got = ranking.spread_rank(df, ["g"], "id", buckets=7).collect()
    again = ranking.spread_rank(df.repartition(3), ["g"], "id", buckets=7).collect()
    assert {(r.g, r.id, r.rank0) for r in got} == {(r.g, r.id, r.rank0) for r in again}
    for g, n in (("hot", 500), (None, 20), ("b", 1)):
        assert sorted(r.rank0 for r in got if r.g == g) == list(range(n))
    assert ranking.spread_rank(df.limit(0), ["g"], "id").collect() == []


def test_look_up_of_hot_and_cold_keys(spark):
    rng = random.Random(1)
    keys = ["hot"] * 300 + [f"k{rng.randrange(40)}" for _ in range(200)] + ["absent", None]
    rows = spark.createDataFrame([(f"v{i}", k) for i, k in enumerate(keys)], "v string, k string")
    facts = spark.createDataFrame([("hot", 1, "x")] + [(f"k{i}", i + 10, "y") for i in range(40)], "k string, n long, t string")
    got = {tuple(r) for r in skew.look_up(rows, facts, "k", "v", hot=50).collect()}
    assert got == {(r.v, r.k, r.n, r.t) for r in rows.join(facts, "k", "left").collect()}


def test_materialised_tables_outlive_their_source(spark):
    df = lineage.materialise(spark.range(10).withColumn("x", F.col("id") * 2), "test")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().toString()
    lineage.discard(df)


def test_look_up_by_two_keys_and_without_a_hot_one(spark):
    rows = spark.createDataFrame([(1, k % 3, k) for k in range(60)] + [(2, None, 100)], "x long, k long, v long")
    facts = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "x long, k long, t string")
    want = {tuple(r) for r in rows.join(facts, ["x", "k"], "left").select("x", "k", "v", "t").collect()}
    for hot, most in ((5, None), (1000, None), (1000, 61)):
        assert {tuple(r) for r in skew.look_up(rows, facts, ["x", "k"], ["x", "v"], hot=hot, most=most).collect()} == want


def test_released_tables_are_gone(spark):
    import os

    since = lineage.mark()
    path = lineage.materialise(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    lineage.release(since)
    assert not os.path.exists(path) and lineage.mark() == since


def test_a_cluster_must_name_its_shared_folder():
    import pytest

    class Conf:
        def get(self, name, default=None):
            return "spark://host:7077" if name == "spark.master" else default

    class Session:
        conf = Conf()

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        lineage.shared_folder(Session())


def test_overlapping_boxes_of_any_size(spark):
    from meshwright.operators.ranges import overlapping

    rng = random.Random(6)
    box = lambda: (lambda y, x, h, w: (y, y + h, x, x + w))(rng.uniform(-60, 60), rng.uniform(-150, 150), 10 ** rng.uniform(-3, 1.8), 10 ** rng.uniform(-3, 1.8))
    a, b = ([(k, *box()) for k in range(80)] for _ in range(2))
    a += [(100, 0.0, 1.0, 0.0, 1.0), (101, None, 1.0, 0.0, 1.0)]
    b += [(100, 1.0, 2.0, 0.0, 1.0), (101, 0.5, 0.6, 0.5, 0.6)]
    named = lambda rows, k: spark.createDataFrame(rows, f"{k} int, south double, north double, west double, east double")
    got = {(r.a, r.b) for r in overlapping(named(a, "a"), named(b, "b")).collect()}
    want = {(p[0], q[0]) for p in a for q in b if None not in p and p[3] < q[4] and q[3] < p[4] and p[1] < q[2] and q[1] < p[2]}
    assert got == want and (100, 101) in got and (100, 100) not in got
