import itertools
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspan.llm import cooccurrence, frequencies, neighbours

TERMS = "field_name string, record long, value string, term int, h string"


def test_frequencies(spark, rows):
    data = [("t", 1, " A\t"), ("t", 1, " A\t"), ("t", 1, "a"), ("t", 2, "A"), ("t", 2, None), ("t", 2, " \t"), ("t", None, "a"), ("c", 1, "a"), ("t", 3, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "h") for r in data], TERMS)
    assert rows(frequencies.frequencies(df)) == [("c", "a", 1, 1), ("t", "a", 3, 2), ("t", "x" * 100_000, 1, 1)]
    assert rows(frequencies.frequencies(df.limit(0))) == []


def test_oversized_partitions_are_split(spark, rows):
    hot = spark.range(20_000).select(F.lit("t").alias("field_name"), F.col("id").alias("record"), F.lit("hot").alias("value"))
    rest = spark.range(5_000).select(F.lit("t").alias("field_name"), (F.col("id") % 700).alias("record"), F.concat(F.lit("v"), F.col("id") % 900).alias("value"))
    df = hot.unionByName(rest)
    small = frequencies.frequencies(df, leaf_bytes=4_000, bits=2)
    assert rows(small) == rows(frequencies.frequencies(df))
    assert small.filter("term = 'hot'").first()["n_records"] == 20_000


def test_spill_leaves(tmp_path):
    spill = frequencies.Spill(str(tmp_path / "s"), leaf_bytes=3000, bits=2)
    table = pa.table({"h": pa.array(np.arange(5000) * (1 << 50), pa.int64()), "r": pa.array(range(5000), pa.int64())})
    sizes = [leaf.count_rows() for leaf in spill.leaves(iter([table]))]
    assert sum(sizes) == 5000 and max(sizes) * 16 <= 3000 and os.listdir(tmp_path / "s") == []


def test_a_row_that_is_most_rows(spark, rows):
    df = spark.range(300_000).select(F.lit("t").alias("field_name"), (F.col("id") % 3).cast("long").alias("record"), F.lit("Same").alias("value"))
    assert rows(frequencies.frequencies(df)) == [("t", "same", 3, 3)]


def test_marks(spark, rows):
    counts = spark.createDataFrame([("t", "a", 9, 2), ("t", "b", 9, 3), ("t", "c", 9, 11)], "field_name string, term string, n_rows long, n_records long")
    n = spark.createDataFrame([(100,)], "n_all long")
    assert [(r["term"], r["mark"]) for r in frequencies.marked(counts, n).orderBy("term").collect()] == [("a", "rare"), ("b", None), ("c", "common")]


VECTORS = "id long, v array<float>, m string, neighbour int, grp int"


def nearest(data, k, floor=-1.0):
    by = {}
    for i, v, m in data:
        if i is None or m is None or v is None or any(x is None for x in v):
            continue
        x = np.array(v, dtype=np.float64)
        if len(x) == 8 and np.isfinite(x).all() and x.any():
            by.setdefault(m, {})[i] = x / np.linalg.norm(x)
    out = []
    for rows in by.values():
        for i, x in rows.items():
            near = sorted(((-float(x @ y), j) for j, y in rows.items() if j != i), key=lambda p: (round(p[0], 12), p[1]))[:k]
            out += [(i, j, r) for r, (s, j) in enumerate(near, 1) if -s >= floor]
    return sorted(out)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist(), "m%d" % (i % 3)) for i in range(300)]
    data += [(1000 + i, data[0][1], "m0") for i in range(25)]  # copies: ties
    data += [(2000, None, "m0"), (2001, [1.0] * 7, "m0"), (2002, [0.0] * 8, "m0"), (2003, [float("nan")] + [1.0] * 7, "m0"), (2004, [None] + [1.0] * 7, "m0"), (2005, [1.0] * 8, None), (None, [1.0] * 8, "m0"), (2006, [float("inf")] + [1.0] * 7, "m1"), (2007, [1e-30] * 8, "m1"), (2008, [1e30] * 8, "m1"), (2009, [1.0] * 8, "only=%/one"), data[5], data[5]]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], VECTORS)
    got = neighbours.nearest(df, "id", "v", "m", k=10, dimensions=8).collect()
    assert sorted((r["id"], r["neighbour"], r["rank"]) for r in got) == nearest(data, 10)
    some = neighbours.nearest(df, "id", "v", "m", k=3, floor=0.5, dimensions=8, queries="id % 20 = 0").collect()
    assert sorted((r["id"], r["neighbour"], r["rank"]) for r in some) == [x for x in nearest(data, 3, 0.5) if x[0] % 20 == 0]
    assert neighbours.nearest(df.limit(0), "id", "v", "m", dimensions=8).count() == 0


def test_queries_beyond_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "HELD", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=8).astype(np.float32).tolist(), "m%d" % (i % 2), 1, 1) for i in range(150)]
    got = neighbours.nearest(spark.createDataFrame(data, VECTORS), "id", "v", "m", k=4, dimensions=8).collect()
    assert sorted((r["id"], r["neighbour"], r["rank"]) for r in got) == nearest([r[:3] for r in data], 4)


@pytest.mark.parametrize("dense", [0.0, 1.1])
def test_tiles_lose_nothing(monkeypatch, dense):
    monkeypatch.setattr(neighbours, "DENSE", dense)
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(500, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, 500)]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    q = neighbours.quantised(unit)
    best, done = neighbours.Best(500, 5, 0.6), 0
    for low in range(0, 500, 128):
        t = [x[low : low + 128] for x in q]
        done += neighbours.join_tile(best, *q, unit, *t, lambda low=low: unit[low : low + 128], np.arange(low, min(low + 128, 500)))
    sims = unit @ unit.T
    for i in range(500):
        expected = [j for j in np.lexsort((np.arange(500), -sims[i]))[:5] if sims[i, j] >= 0.6]
        assert best.row[i][np.isfinite(best.sim[i])].tolist() == expected
    assert dense == 0.0 or done < 100_000


def test_each_two_blocks_meet_once():
    for blocks in range(1, 12):
        met = [frozenset((b, o)) for b in range(blocks) for o in neighbours.ahead(b, blocks)]
        assert len(met) == len(set(met)) == blocks * (blocks - 1) // 2


@pytest.mark.parametrize(("dense", "strip"), [(0.0, 64), (1.1, 64), (1.1, 50)])
def test_one_product_serves_both_ends(monkeypatch, dense, strip):
    monkeypatch.setattr(neighbours, "DENSE", dense)
    monkeypatch.setattr(neighbours, "STRIP", strip)
    monkeypatch.setattr(neighbours, "WAITING", 100)
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(640, 64)) + 2 * rng.normal(size=(60, 64))[rng.integers(0, 60, 640)]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    basis, ids = neighbours.axes(unit), np.arange(640)
    q = neighbours.leading(unit @ basis, 24)
    assert (q @ q.T >= unit @ unit.T - 1e-5).all()
    best, done = neighbours.Best(640, 5, 0.75), 0
    lists = [[] for _ in ids]
    for low in range(0, 640, 128):
        part = slice(low, low + 128)
        back, n = neighbours.meet(best, unit, q, ids, unit[part], q[part], ids[part], low)
        done += n
        for i, place in zip(*np.nonzero(np.isfinite(back.sim)), strict=True):
            lists[low + i].append((-back.sim[i, place], back.row[i, place]))
    sims = unit @ unit.T
    for i in ids:
        both = lists[i] + [(-s, r) for s, r in zip(best.sim[i], best.row[i], strict=True) if np.isfinite(s)]
        assert [r for _, r in sorted(both)[:5]] == [j for j in np.lexsort((ids, -sims[i])) if j != i and sims[i, j] >= 0.75][:5]
    assert done < 640 * 639 // 2 / 4  # each pair once at most, and most are ruled out by the leading axes


@pytest.mark.parametrize("held", [40, 1 << 16])
def test_pairs_computed_once(spark, monkeypatch, held):
    monkeypatch.setattr(neighbours, "HELD", held)
    monkeypatch.setattr(neighbours, "TILE", 16)
    rng = np.random.default_rng(7)
    data = [(i, (rng.normal(size=8) + 3 * np.eye(8)[i % 5]).astype(np.float32).tolist(), ("m", "m%2/ü")[i % 3 == 0]) for i in range(900)]
    data += [(1000 + i, data[1][1], "m") for i in range(25)] + [(2000, [2.0] * 8, "alone"), (2001, None, "m")]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], VECTORS)
    got = neighbours.nearest(df, "id", "v", "m", k=4, floor=0.6, dimensions=8).collect()
    assert sorted((r["id"], r["neighbour"], r["rank"]) for r in got) == nearest(data, 4, 0.6)
    assert neighbours.nearest(df.limit(0), "id", "v", "m", floor=0.6, dimensions=8).count() == 0


BASKETS = "record long, item string, a int, n int"


def brute_pairs(data, least):
    baskets, items = {}, {}
    for r, i in set(data):
        if r is not None and i:
            baskets.setdefault(r, set()).add(i)
            items.setdefault(i, set()).add(r)
    out = {}
    for b in baskets.values():
        for p in itertools.combinations(sorted(b), 2):
            out[p] = out.get(p, 0) + 1
    return {(a, b, len(items[a]), len(items[b]), n, len(baskets)) for (a, b), n in out.items() if n >= least}


@pytest.mark.parametrize(("long", "least"), [(1024, 1), (12, 1), (12, 5), (30, 5)])
def test_pairs(spark, long, least):
    rng = np.random.default_rng(2)
    data = [(int(r), f"i{int(i)}") for r, i in zip(rng.integers(0, 60, 900), rng.zipf(1.5, 900) % 40, strict=True)]
    data += [(r, f"i{j}") for r in (100, 101, 102) for j in range(40)] + [(None, "i1"), (1, None), (1, ""), data[0], data[0]]
    df = spark.createDataFrame([(*x, 1, 2) for x in data], BASKETS)
    got = cooccurrence.together(df, "record", F.col("item"), least, long=long)
    assert {(r["item_a"], r["item_b"], r["n_a"], r["n_b"], r["n_ab"], r["n_records"]) for r in got.collect()} == brute_pairs(data, least)


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], BASKETS)
    assert cooccurrence.together(df, "record", F.col("item")).count() == 0
    assert cooccurrence.together(df.limit(0), "record", F.col("item")).count() == 0


def test_model_keeps_the_margins():
    counts, items, sizes, records = np.array([1.0, 3, 10]), np.array([20.0, 10, 2]), np.array([1.0, 2, 5]), np.array([20.0, 15, 4])
    x, y = cooccurrence.fit(counts, items, sizes, records)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert np.allclose((p * records).sum(axis=1), counts, rtol=1e-6) and np.allclose((p * items[:, None]).sum(axis=0), sizes, rtol=1e-6)


def test_bins(spark, monkeypatch):
    values = [1, 1, 2, 255, 256, 257, 258, 10_000, 10_020, 10**9]
    n, many = cooccurrence.binned(spark.createDataFrame([(v,) for v in values], "n long"))
    assert many.sum() == len(values) and (n * many).sum() == sum(values) and (np.diff(n) > 0).all()
    assert n[:4].tolist() == [1, 2, 255, 256] and n[-1] == 10**9
    x = np.array([0.1, 0.2, 4.0])
    assert np.allclose(cooccurrence.interpolated(np.array([1, 2, 8]), np.array([1.0, 2, 8]), x), x)
    with pytest.warns(UserWarning, match="within"):
        cooccurrence.fit(np.array([1.0, 3]), np.array([2.0, 2]), np.array([1.0, 2]), np.array([4.0, 2]), rounds=1)


def test_model_of_the_full_and_the_empty():
    # One item in all 10 records, one only in the two records that have all 12 items.
    counts, items = np.array([2.0, 4.8, 10]), np.array([1.0, 10, 1])
    sizes, records = np.array([1.0, 5, 12]), np.array([1.0, 7, 2])
    x, y = cooccurrence.fit(counts, items, sizes, records)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert np.allclose(p[2], 1) and np.allclose(p[:, 2], 1) and p[0, :2].max() < 1e-9 and p[:2, 0].max() < 1e-9
    assert cooccurrence.fit(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))[0].size == 0


def test_step_up_rule(spark):
    rng = np.random.default_rng(1)
    p = np.r_[10 ** rng.uniform(-9, -3, 40), rng.uniform(0, 1, 400)]
    df = spark.createDataFrame([(float(v),) for v in np.log10(p)], "log10_p double")
    for tests in (440, 5000):
        ranked = np.sort(p)
        ok = np.flatnonzero(ranked <= 0.05 * np.arange(1, len(p) + 1) / tests)
        limit = cooccurrence.rejection_limit(df, tests, 0.05)
        assert (np.log10(p) <= limit).sum() == (ok[-1] + 1 if len(ok) else 0)


def test_tail_against_the_exact_distribution():
    m, q = np.array([30, 12, 5]), np.array([0.02, 0.2, 0.5])
    exact = np.array([1.0])
    for many, p in zip(m, q, strict=True):
        for _ in range(many):
            exact = np.convolve(exact, [1 - p, p])
    n = np.array([1, 2, 4, 6, 8, 10, 14, 18, 25, 40])
    tail = np.log10([exact[i:].sum() for i in n])
    got = cooccurrence.log_tail(n, np.tile(q, (len(n), 1)), m.astype(float))
    assert np.abs(got - tail).max() < 0.25 and (np.abs(got - tail)[3:8] < 0.05).all()
    assert cooccurrence.log_tail(np.array([0, 48]), np.tile(q, (2, 1)), m.astype(float)).tolist() == [0.0, -np.inf]


def test_a_planted_pair_is_surprising(spark):
    rng = np.random.default_rng(8)
    data = [(r, f"i{int(i)}") for r in range(400) for i in rng.integers(0, 30, 4)] + [(r, x) for r in range(0, 400, 16) for x in ("p", "q")]
    df = spark.createDataFrame([(*x, 1, 2) for x in data], BASKETS)
    got = {(r["item_a"], r["item_b"]) for r in cooccurrence.together(df, "record", F.col("item"), 1).filter("significant").collect()}
    assert ("p", "q") in got and len(got) < 20
