"""Nearest in time against brute force, with ties, hot entities and edges."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tradeloom.llm.nearest_time import XFastTries, _bucket, nearest_in_time

SCHEMA = "{} long, who string, at timestamp_ntz, entity string, id string, window int"
T0 = datetime(2020, 1, 1)


def frame(spark, rows, name):
    return spark.createDataFrame([(i, w, t, "e", "i", 1) for i, w, t in rows], SCHEMA.format(name))


def run(spark, left, right, tolerance, **more):
    l, r = frame(spark, left, "l"), frame(spark, right, "r")
    got = nearest_in_time(l, r, "l", "r", F.col("who"), F.col("who"), F.col("at"), F.col("at"), tolerance, **more)
    return sorted((x["l"], x["r"]) for x in got.collect())


def brute(left, right, tolerance):
    out = []
    for i, w, t in left:
        near = [(abs(u - t), u, j) for j, x, u in right if w is not None and x == w and t is not None and u is not None and abs(u - t) <= timedelta(seconds=tolerance)]
        if near:
            out.append((i, min(near)[2]))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    when = lambda: rng.choice([None] + 12 * [T0 + timedelta(seconds=rng.randrange(0, 4_000_000, 500), microseconds=rng.choice([0, 0, 1]))])
    who = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left, right = [(i, who(), when()) for i in range(400)], [(i, who(), when()) for i in range(300)]
    for tolerance in (700, 50_000):
        assert run(spark, left, right, tolerance) == brute(left, right, tolerance)
        assert run(spark, left, right, tolerance, share=0.2) == brute(left, right, tolerance)


def test_ties_and_the_edge_of_the_tolerance(spark):
    s = lambda x: T0 + timedelta(seconds=x)
    right = [(5, "a", s(90)), (4, "a", s(90)), (1, "a", s(110)), (9, "b", s(200))]
    assert run(spark, [(1, "a", s(100)), (2, "b", s(100)), (2, "b", s(100)), (3, "b", s(99)), (4, "a", s(90))], right, 100) == [(1, 4), (2, 9), (2, 9), (4, 4)]


def test_empty(spark):
    one = [(1, "a", T0)]
    assert run(spark, [], one, 10) == [] and run(spark, one, [], 10) == []


def test_trie_neighbours():
    rng = np.random.default_rng(0)
    g, v = rng.integers(0, 5, 400), rng.integers(0, 1000, 400)
    t = XFastTries(g, v, 10)
    qg, qv = rng.integers(0, 6, 500), rng.integers(0, 1024, 500)
    before, after = t.neighbours(qg, qv)
    for a, x, b, c in zip(qg, qv, before, after):
        own = np.unique(v[g == a])
        low, high = own[own <= x], own[own >= x]
        assert (t.leaves[b] & 1023 if b >= 0 else None) == (low[-1] if len(low) else None)
        assert (t.leaves[c] & 1023 if c >= 0 else None) == (high[0] if len(high) else None)


def test_more_cells_than_fit_a_key_with_a_time():
    """2^21 cells in one bucket of the production tolerance: cell c has a right row c seconds after its left row."""
    n, tol, width = 1 << 21, 864_000_000_000, 6 * 864_000_000_000
    entity, zero = pa.array([f"e{i}" for i in range(n)]), pa.array(np.zeros(n, np.int32))
    ids, at = np.arange(n), np.full(n, 10**12)
    table = lambda ids, at: pa.table({"id": ids, "entity": entity, "at": at, "window": zero, "salt": zero})
    got = _bucket(tol, width)(table(ids, at), table(ids + 7, at + ids * 1_000_000))
    near = ids <= 864_000
    assert np.array_equal(np.sort(got["left_id"].to_numpy()), ids[near]) and np.array_equal(got["right_id"].to_numpy() - 7, got["left_id"].to_numpy())


def test_rounds_of_groups():
    rng = random.Random(9)
    rows = [(i, f"e{rng.randrange(40)}", rng.randrange(3000)) for i in range(900)]
    table = lambda rs: pa.table({"id": [r[0] for r in rs], "entity": [r[1] for r in rs], "at": [r[2] for r in rs], "window": pa.array([0] * len(rs), pa.int32()), "salt": pa.array([0] * len(rs), pa.int32())})
    whole, cut = (_bucket(100, 5000, g)(table(rows[:500]), table(rows[500:])) for g in (None, 7))
    assert sorted(whole.to_pylist(), key=str) == sorted(cut.to_pylist(), key=str) and whole.num_rows > 100
