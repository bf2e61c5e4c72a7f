"""Exact places, bottom-k samples and turns of splits, held against plain sorting and placing one by one."""

import hashlib
import random

import pytest

from vigil.operators import datasets as D
from vigil.operators import metrics as M
from vigil.operators import rows as R
from vigil.operators import selection as S


@pytest.mark.parametrize("most", [S.MOST, 300, 40])
def test_nearest_rank_in_cells(spark, most):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(4_000)] + [("a", 0.25)] * 1_500 + [("b", float(rng.randrange(7))) for _ in range(900)] + [(None, float(k)) for k in range(33)] + [("c", 1.5), ("d", None)]
    got = {r.g: (r.n, r.p50, r.p95) for r in M.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", "g", most=most).collect()}
    want = {}
    for g in ("a", "b", "c", None):
        v = sorted(x for h, x in rows if h == g and x is not None)
        want[g] = (len(v), v[len(v) // 2], v[min(len(v) * 95 // 100, len(v) - 1)])
    assert got == want


def test_places_shrink_though_one_value_is_common(spark):
    rows = [(1.0,)] * 5_000 + [(2.0 + k / 10_000,) for k in range(3_000)]
    df = spark.createDataFrame(rows, "v double").repartition(4)
    r = M.nearest_rank(df, "v", most=50).first()
    v = sorted(x for (x,) in rows)
    assert (r.n, r.p50, r.p95) == (8_000, v[4_000], v[7_600])


def test_latency_budget(spark):
    df = spark.createDataFrame([("x", 10.0)] * 97 + [("x", 80.0)] * 3 + [("y", 60.0)], "g string, v double")
    assert {r.g: r.passed for r in M.within_budget(df, "v", "g").collect()} == {"x": True, "y": False}


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


@pytest.mark.parametrize("most", [S.MOST, 20])
def test_samples_equal_sorting(spark, most):
    rows = [(k, k % 3 if k % 10 else None) for k in range(2_000)]
    df = spark.createDataFrame(rows, "id long, label int")
    want = sorted(sorted(range(2_000), key=lambda k: (md5(f"5:{k}"), k))[:100])
    assert sorted(r.id for r in M.audit_sample(df, 0.05, 5, most=most).collect()) == want
    got = R.stratified(df, "label", {0: 70, 1: 110, 2: 5_000}, 3, most=most).collect()
    for label, n in ((0, 70), (1, 110), (2, 5_000)):
        own = sorted((k for k, y in rows if y == label), key=lambda k: (md5(f"3:{k}"), k))[:n]
        assert sorted(r.id for r in got if r.label == label) == sorted(own)
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == sorted((r.id for r in got), key=lambda k: (md5(f"order 3:{k}"), k))
    assert [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(len(got)))
    assert M.audit_sample(df.limit(0), 0.05).count() == 0 and M.audit_sample(df.limit(3), 0.05).count() == 1


def one_by_one(sizes, ratios):
    total = sum(n * k for n, k in sizes)
    targets, have = [r * total for r in ratios.values()], [0] * len(ratios)
    out = {}
    for n, k in sizes:
        for _ in range(k):
            short = [(t - h) / t for t, h in zip(targets, have)]
            i = short.index(max(short))
            have[i] += n
            out[n, i] = out.get((n, i), 0) + 1
    return out


def test_turns_equal_placing_one_by_one():
    rng = random.Random(1)
    for _ in range(60):
        sizes = sorted({rng.randrange(1, 400): rng.choice([1, 2, 5, 300, 4_000]) for _ in range(rng.randrange(1, 9))}.items(), reverse=True)
        for ratios in (D.RATIOS, {"a": 0.5, "b": 0.5}, {"a": 0.9, "b": 0.06, "c": 0.04}):
            assert {(n, i): g for n, i, _, g in D.turns(sizes, ratios)} == one_by_one(sizes, ratios)


def test_turns_of_very_many_clusters():
    got = D.turns([(3, 10**9), (1, 10**11)])
    assert sum(g for n, _, _, g in got if n == 1) == 10**11
    rows = [sum(n * g for n, i, _, g in got if i == s) for s in range(3)]
    assert max(abs(r / sum(rows) - x) for r, x in zip(rows, D.RATIOS.values())) < 1e-9
