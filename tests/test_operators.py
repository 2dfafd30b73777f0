"""Operators on small tables against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.functions.keys import common_prefix, decode_key, memcomparable_key, prefix_successor, text_successor
from tessel.operators import dml, kv, multimap, resolve, spans
from tessel.operators.txn import Staged


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=6), st.binary(max_size=6))
def test_prefix_successor(prefix, other):
    end = prefix_successor(prefix)
    inside = other >= prefix and (end is None or other < end)
    assert inside == other.startswith(prefix)


def test_text_successor():
    assert text_successor("ab") == "ac" and text_successor("a\U0010ffff") == "b" and text_successor("\U0010ffff") is None


def test_memcomparable_key(spark):
    rows = [(None, "a"), (-5, ""), (-5, None), (0, "a\x00b"), (0, "a"), (7, "é"), (1 << 40, "z"), (-(1 << 63), "q")]
    df = spark.createDataFrame(rows, "a long, b string")
    by_key = [tuple(r)[:2] for r in sorted(df.withColumn("k", memcomparable_key(df, "a", "b")).collect(), key=lambda r: bytes.fromhex(r.k))]
    assert by_key == [tuple(r) for r in df.orderBy(F.asc_nulls_first("a"), F.asc_nulls_first("b")).collect()]


def test_common_prefix(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), ("same", "same")], "a string, b string")
    assert [r[0] for r in df.select(common_prefix(F.col("a"), F.col("b"))).collect()] == ["ab", "", "same"]


def test_as_of(spark):
    rng = random.Random(3)
    probes = [(i, rng.randrange(3), rng.randrange(200)) for i in range(80)]
    points = [(rng.randrange(3), t, 1000 + t) for t in rng.sample(range(200), 60)]
    found = kv.as_of(spark.createDataFrame(probes, "id int, u int, at long"), spark.createDataFrame(points, "u int, at long, v int"), "u", "at", "at", "v", 17)
    expected = {i: max(((t, v) for w, t, v in points if w == u and t <= at), default=(0, None))[1] for i, u, at in probes}
    assert {r.id: r.v for r in found.collect()} == expected


def test_neighbours(spark):
    df = spark.createDataFrame([(k,) for k in "aceg"], "k string")
    one = lambda d: [r[0] for r in d.collect()]
    assert one(kv.less_than(df, "k", "e")) == ["c"] and one(kv.less_than(df, "k", "a")) == [None]
    assert one(kv.lower_bound(df, "k", "b")) == ["c"] and one(kv.upper_bound(df, "k", "c")) == ["e"]
    assert one(kv.seek_for_prev(df, "k", "f")) == ["e"] and one(kv.seek_for_prev(df, "k", "0")) == []
    assert one(kv.range_empty(df, "k", "d", "e")) == [True] and one(kv.range_empty(df, "k", "c", None)) == [False]


def state(ops):
    out = {}
    for _, op, key, hi, value in ops:
        if op == "put":
            out[key] = value
        elif op == "del":
            out.pop(key, None)
        else:
            out = {k: v for k, v in out.items() if not key <= k < hi}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_replay(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(resolve, "PIECES", 0)
    rng = random.Random(seed)
    ops = [(i, rng.choice(["put", "put", "put", "del", "range"]), k := rng.randrange(30), k + rng.randrange(8), rng.random()) for i in range(150)]
    log = spark.createDataFrame(ops, "seq int, op string, key int, key_hi int, value double")
    assert {r.key: r.value for r in resolve.replay(log).collect()} == state(ops)


def test_layers_and_tombstones(spark):
    put = lambda rows: spark.createDataFrame([(k, v, "put" if v else "del") for k, v in rows], "k long, v string, op string")
    layers = [(0, put([(i, f"t{i}") for i in range(10)])), (1, put([(2, "b2"), (3, None), (7, "b7")])), (2, put([(3, "w3"), (7, None)]))]
    ranges = spark.createDataFrame([(0, 3, 1), (8, 9, 2)], "lo long, hi long, prio int")
    merged = {r.k: r.v for r in resolve.merge(layers, "k", ranges).collect()}
    assert merged == {2: "b2", 3: "w3", 4: "t4", 5: "t5", 6: "t6", 9: "t9"}


def test_mutations(spark):
    base = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (4, "y")], "k int, v string")
    rows = lambda d: sorted((r.k, r.v) for r in d.collect())
    assert rows(dml.upsert(base, new, ["k"])) == [(1, "a"), (2, "x"), (3, "c"), (4, "y")]
    assert sorted(r.k for r in dml.insert_or_ignore(base, new, ["k"]).collect()) == [1, 2, 3, 4]
    assert rows(dml.update_existing(base.where("k <> 2"), new, ["k"])) == [(1, "a"), (3, "c")]
    with pytest.raises(dml.ConstraintError):
        dml.insert_unique(base, new, ["k"])
    with pytest.raises(dml.ConstraintError):
        dml.update_existing(base, new, ["k"], strict=True)
    with pytest.raises(dml.ConstraintError):
        dml.check_constraints(base, not_null=["v"])
    assert sorted(r.k for r in dml.delete_where(base, F.col("v") == "a").collect()) == [2, 3]
    assert {(r.k, r.old, r.new) for r in dml.replace_returning(base, new, "k", "v").collect()} == {(2, None, "x"), (4, None, "y")}
    assert dml.violations_unique(spark.createDataFrame([(None,), (None,), (1,)], "k int"), ["k"]).isEmpty()


def test_multimap(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (5, "x"), (40, "m"), (41, "n")], "k long, v string")
    found = {r.k: (r.next_key, r.next_first) for r in multimap.next_key(pairs, "k", "v", 10).collect()}
    assert found == {1: (5, "x"), 5: (40, "m"), 40: (41, "n"), 41: (None, None)}
    assert multimap.delete_pair(pairs, "k", "v", 1, "a").count() == 4 and multimap.delete_key(pairs, "k", 1).count() == 3


def test_nested_transactions(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    staged = Staged({"t": df(1)})
    staged["t"] = df(1, 2)
    staged.begin()
    staged["t"] = df(9)
    staged.fork("t", "copy")
    staged.abort()
    assert staged["t"].count() == 2 and "copy" not in staged
    staged.begin()
    del staged["t"]
    assert "t" not in staged
    staged.commit()
    assert staged.changes == {"t": None}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def covered(ranges, k):
    return max((o for lo, hi, o in ranges if lo <= k < hi), default=None)


@pytest.mark.parametrize("span", [5, 20_000])
def test_disjoint_ranges(spark, monkeypatch, span):
    monkeypatch.setattr(resolve, "RANGES", span)
    rng = random.Random(1)
    ranges = [(lo := rng.randrange(500), lo + rng.choice([0, 1, 5, 20, 300]), rng.randrange(6)) for _ in range(120)]
    pieces = sorted(map(tuple, resolve.flatten(spark.createDataFrame(ranges, "lo int, hi int, prio int")).collect()))
    assert all(a[1] <= b[0] for a, b in zip(pieces[:-1], pieces[1:], strict=True))
    assert [covered(pieces, k) for k in range(900)] == [covered(ranges, k) for k in range(900)]
    words = [(f"k{lo:03}", f"k{hi:03}", o) for lo, hi, o in ranges]
    monkeypatch.setattr(resolve, "PIECES", 0)
    entries = spark.createDataFrame([(f"k{k:03}", k % 6) for k in range(0, 900)] + [(None, 1)], "k string, prio int")
    left = {r.k for r in resolve.outside(entries, spark.createDataFrame(words, "lo string, hi string, prio int"), "k").collect()}
    assert left == {f"k{k:03}" for k in range(900) if (covered(ranges, k) or 0) <= k % 6} | {None}


def test_many_ranges_need_no_nested_loop(spark):
    ranges = spark.range(100_000).selectExpr("id * 10 as lo", "id * 10 + 4 as hi", "cast(id % 3 as int) as prio")
    entries = spark.range(1_000_000).selectExpr("id as k", "0 as prio")
    left = resolve.outside(entries, ranges, "k")
    assert "NestedLoop" not in plan(left) and "SinglePartition" not in plan(left) and "CartesianProduct" not in plan(left)
    assert left.count() == 1_000_000 - 4 * sum(i % 3 > 0 for i in range(100_000))
    following = multimap.next_key(entries.where("k % 2 = 0"), "k", "prio")
    assert "NestedLoop" not in plan(following) and "SinglePartition" not in plan(following)
    assert following.where("next_key = k + 2").count() == 499_999


def test_percentiles(spark):
    rng = random.Random(2)
    values = [round(rng.gauss(0, 100), 1) for _ in range(3000)] + [5.0] * 2000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = spans.percentiles(df, "v", [0.0, 0.25, 0.5, 0.999, 1.0], few=50)
    expected = df.agg(*(F.percentile("v", p) for p in (0.0, 0.25, 0.5, 0.999, 1.0))).first()
    assert [round(x, 9) for x in got] == [round(x, 9) for x in expected]
    assert spans.percentiles(df.limit(0), "v", [0.5]) == [None]


def test_keys_keep_order_and_come_back(spark):
    from decimal import Decimal

    rng = random.Random(3)
    texts = ["", "a", "a\x00", "a\x00b", "a\x01", "b", "é", "\x00\x00", "zz", None]
    numbers = [0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), float("nan"), None]
    rows = [(i, rng.choice(texts), x := rng.choice(numbers), x if x is None or abs(x) < 1e30 or x != x else None, None if rng.random() < 0.1 else Decimal(rng.randrange(-10**6, 10**6)) / 100, rng.choice([True, False, None]), rng.choice([None, bytes([rng.randrange(3)] * rng.randrange(4))]), rng.randrange(-9, 9) * (1 << 58), rng.randrange(-128, 128)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, s string, d double, f float, m decimal(10,2), b boolean, y binary, l long, t byte").withColumn("day", F.date_add(F.lit("1970-01-01"), F.col("t").cast("int") * 300)).withColumn("at", F.timestamp_micros(F.col("l") % 10**15))
    for name, kind in df.dtypes:
        keyed = df.select(name, memcomparable_key(df, name).alias("k"))
        odd = keyed.select(F.dense_rank().over(Window.orderBy(F.col(name).asc_nulls_first())).alias("a"), F.dense_rank().over(Window.orderBy("k")).alias("b")).where("a <> b")
        assert odd.isEmpty(), name
    kinds = dict(df.dtypes)
    back = df.select(F.struct(*(F.when(F.col(c) == 0, F.lit(0).cast(k)).otherwise(F.col(c)).alias(c) if k in ("float", "double") else F.col(c) for c, k in df.dtypes)).alias("old"), F.struct(*decode_key(memcomparable_key(df, *kinds), **kinds)).alias("new"))
    assert back.where(~F.col("old").eqNullSafe(F.col("new"))).collect() == []
    with pytest.raises(TypeError):
        memcomparable_key(spark.sql("select cast(1 as decimal(30,2)) as x"), "x")


def test_put_flags_and_moves(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 3), (2, 5)], "k int, v int")
    more = spark.createDataFrame([(1, 3), (1, 4), (9, 9)], "k int, v int")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(multimap.put(pairs, more, "k", "v")) == [(1, 1), (1, 3), (1, 4), (2, 5), (9, 9)]
    assert rows(multimap.put(pairs, more, "k", "v", "nooverwrite")) == [(1, 1), (1, 3), (2, 5), (9, 9)]
    assert rows(multimap.put(pairs, more, "k", "v", "alldups")) == [(1, 3), (1, 4), (2, 5), (9, 9)]
    for flag in ("nooverwrite", "nodupdata"):
        with pytest.raises(dml.ConstraintError):
            multimap.put(pairs, more, "k", "v", flag, strict=True)
    assert rows(multimap.set_lowerbound(pairs, "k", "v", 1, 2)) == [(1, 3)] and rows(multimap.set_upperbound(pairs, "k", "v", 1, 3)) == [(2, 5)]
    assert rows(multimap.move_next(pairs, "k", "v", 1, 3)) == [(2, 5)] and rows(multimap.move_prev(pairs, "k", "v", 2, 5)) == [(1, 3)]
    assert rows(multimap.first_dup(pairs, "k", "v", 1)) == [(1, 1)] and rows(multimap.last_dup(pairs, "k", "v", 1)) == [(1, 3)]
    assert rows(multimap.get_current(pairs, "k", "v", 1, 3)) == [(1, 3)]


def test_comparisons_with_the_constant_first_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert "LessThan(o_orderkey,5)" in plan(orders.where("5 > o_orderkey").select("o_orderkey"))
