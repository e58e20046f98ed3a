"""Contraction groups, tied splits, overlaps and top items against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from meshwright.llm import contraction, groups, leakage, splits, topn


def components(pairs):
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {k: root(k) for k in list(up)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_whole_array_union_find(pairs):
    a, b = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    got = contraction._roots(a, b, 31)
    want = components(pairs)
    assert all(got[k] == want.get(k, k) for k in range(31))


@pytest.mark.parametrize("cell", [3, 40, 10_000])
def test_groups_of_chains_hubs_and_noise(spark, cell):
    rng = random.Random(7)
    rows = [("chain", k, k + 1) for k in range(150)] + [("hub", 5, k) for k in range(6, 150)]
    rows += [("noise|x", rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    odd = [(None, 1, 2), ("a", None, 2), ("a", 1, None), ("a", 3, 3), ("chain", 9, 8), ("chain", 9, 8)]
    df = spark.createDataFrame(rows + odd, "stem string, u long, v long").withColumn("root", F.lit("clash")).repartition(5)
    got = [tuple(r) for r in groups.match_groups(df, "stem", "u", "v", cell_links=cell).collect()]
    want = components([((s, a), (s, b)) for s, a, b in rows if a != b])
    assert len(got) == len(set(got)) and set(got) == {(s, k, w[1]) for (s, k), w in want.items()}


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([], "stem string, u long, v long")
    assert groups.match_groups(df, "stem", "u", "v").collect() == []
    assert groups.match_groups(spark.createDataFrame([("a", 1, 1)], df.schema), "stem", "u", "v").collect() == []


SITES = "site_key long, tiles array<string>, scene_id string"


def test_ties_over_spellings_and_scenes(spark):
    rows = [
        (1, ["a_b1_0", None], "sc1"), (2, ["Train/A B1 0-mask.png"], None), (3, ["./a-b1-0_sat.JPG", ""], "unknown"), (4, None, "sc1"),
        (5, [], "n/a"), (6, ["x_1"], "n/a"), (7, ["x_1_mask"], ""), (8, ["y_1"], "NONE"), (8, ["y_1"], "NONE"), (None, ["y_1"], "sc9"), (9, ["y_10"], "-"),
    ]
    df = spark.createDataFrame(rows, SITES)
    got = {(r.site_key, r.group_key) for r in splits.tied_groups(df, "site_key", "tiles", "scene_id", cell_links=2).filter("size > 1").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 6)}
    out = splits.assign_splits(df, "site_key", "tiles", "scene_id").collect()
    assert sorted(r.site_key for r in out) == list(range(1, 10))
    assert splits.assign_splits(df.limit(0), "site_key", "tiles", "scene_id").collect() == []


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=12))
def test_fill_covers_every_group_once_and_meets_targets(sizes):
    plan = splits.fill_splits(list(sizes.items()))
    seen, held = defaultdict(list), defaultdict(int)
    for size, lo, hi, name in plan:
        seen[size] += range(lo, hi)
        held[name] += size * (hi - lo)
    assert {s: sorted(r) for s, r in seen.items()} == {s: list(range(n)) for s, n in sizes.items()}
    total = sum(s * n for s, n in sizes.items())
    biggest = max(sizes, default=0)
    assert all(held[name] <= share * total + biggest for name, share in splits.SHARES)


def test_a_third_in_one_group(spark):
    rows = [(k, ["same_1"] if k % 3 == 0 else [f"own_{k}"], None) for k in range(3000)]
    out = splits.assign_splits(spark.createDataFrame(rows, SITES), "site_key", "tiles", "scene_id", cell_links=300)
    shares = {r.split: r["count"] / 3000 for r in out.groupBy("split").count().collect()}
    assert shares == pytest.approx({"train": 0.8, "val": 0.1, "test": 0.1}, abs=0.002)
    assert out.filter("site_key % 3 = 0").select("split").distinct().count() == 1


def test_cross_split_pairs(spark):
    rows = [
        (1, 50.0, 70.0, " TRAIN", "a"), (2, 50.0, 70.0, "Val.", "b"), (3, 50.0005, 70.0, "testing", None), (4, 50.01, 70.0, "val", "b"), (5, 0.0, 0.0, "train", "a"),
        (6, 0.0, 0.0, "test", "a"), (7, None, 70.0, "test", "a"), (8, 50.0, 70.0, None, "a"), (9, 50.0, 70.0, "hold-out", "a"), (2, 50.0, 70.0, "Val.", "b"), (10, 50.0, 70.0, "train", "c"),
    ]
    df = spark.createDataFrame(rows, "k long, lat double, lon double, split string, source string").withColumn("key", F.lit(0))
    args = ("k", "lat", "lon", "split", "source")
    got = {tuple(r)[:3] + (r.exact,) for r in leakage.cross_split_pairs(df, *args).collect()}
    assert got == {(1, 2, "val", True), (1, 3, "test", False), (10, 2, "val", True), (10, 3, "test", False)}
    report = {tuple(r) for r in leakage.overlap_report(df, *args).collect()}
    assert report == {("val", "b", 1, 1, 2), ("test", "", 1, 0, 2)}
    assert leakage.cross_split_pairs(df.limit(0), *args).collect() == []


@pytest.mark.parametrize("n", [1, 3, 10])
def test_top_items(spark, n):
    rng = random.Random(n)
    rows = [("hot", k, rng.choice([0.0, 0.25, 0.5, 0.999999, 1.0])) for k in range(4000)]
    rows += [(f"g{rng.randrange(50)}", 10_000 + k, rng.random()) for k in range(300)] + [("same", k, 0.5) for k in range(100)]
    odd = [(None, 1, 0.5), ("bad", 2, None), ("bad", 3, float("nan")), ("bad", 4, 1.5), ("bad", 5, -0.1)]
    df = spark.createDataFrame(rows + odd, "g string, i long, s double").withColumn("rnk", F.lit(9)).withColumn("least", F.lit(1))
    by = defaultdict(list)
    for g, i, s in rows:
        by[g].append((-s, i))
    want = {(g, i, k + 1) for g, v in by.items() for k, (_, i) in enumerate(sorted(v)[:n])}
    got = [(r.g, r.i, r.rnk) for r in topn.top_items(df, "g", "i", "s", n, buckets=8, salts=3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert topn.top_items(df.limit(0), "g", "i", "s").collect() == []


def test_vertices_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(contraction, "_order", lambda x, n: (n % 3).astype(np.uint64))
    x, n = np.array([1, 1, 2, 2, 1]), np.array([4, 1, 4, 7, 4])
    xs, ns, code = contraction._ranked(x, n)
    assert (xs[code] == x).all() and (ns[code] == n).all() and len(xs) == 4


def test_one_partition_a_cell(spark):
    """Blocks go to partitions one to one: no task gets two of them."""
    df = spark.range(5000).selectExpr("1L as ax", "id as an", "2L as bx", "id * 7 % 5000 as bn")
    spread = groups._grid(200)(df, 5000, 0)
    cells = spread.select(F.spark_partition_id().alias("p"), contraction.block("a", 0, 5).alias("a"), contraction.block("b", 0, 5).alias("b")).distinct().collect()
    assert len(cells) == 25 and all(r.p == r.a * 5 + r.b for r in cells)


def test_a_repeated_link_is_shuffled_once_a_run():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.full(1000, v)) for v in (1, 2, 1, 3)], list(contraction._NAMES))
    assert [b.num_rows for b in contraction._runs(iter([batch, batch]), 10**6, False)] == [1]
