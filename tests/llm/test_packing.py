import random
from collections import Counter

import numpy as np

from rulewake.llm import packing


def contents(histogram, plan):
    key = plan.size * (1 << 44) + plan.start
    out = Counter()
    for s, n in histogram.items():
        r = np.arange(n)
        at = np.searchsorted(key, s * (1 << 44) + r, side="right") - 1
        assert (plan.size[at] == s).all()
        for c in plan.base[at] + (r - plan.start[at]) // plan.times[at]:
            out[int(c)] += s
    return out


def test_plan_places_every_item_and_overfills_nothing():
    r = random.Random(1)
    for capacity, n in ((16, 40), (100, 1000), (2048, 5000)):
        histogram = Counter(min(capacity, max(1, int(r.expovariate(5 / capacity)))) for _ in range(n))
        plan = packing.plan(histogram, capacity)
        filled = contents(histogram, plan)
        assert max(filled.values()) <= capacity and sorted(filled) == list(range(plan.containers))
        assert sum(filled.values()) == sum(s * k for s, k in histogram.items())


def test_plan_is_tight_where_lengths_fit():
    histogram = {1024: 500, 512: 400, 256: 800, 300: 700, 724: 100}
    plan = packing.plan(histogram, 2048)
    assert sum(s * n for s, n in histogram.items()) / 2048 / plan.containers > 0.97


def test_plan_of_nothing_and_of_one():
    assert packing.plan({}).containers == 0
    assert packing.plan({5: 1}, 8).containers == 1


def test_nnls_solves_and_stays_positive():
    rng = np.random.default_rng(0)
    a = rng.random((8, 12))
    x = np.maximum(rng.normal(size=12), 0)
    found = packing.nnls(a, a @ x)
    assert (found >= 0).all() and np.abs(a @ found - a @ x).max() < 1e-6


def test_containers_hold_all_tokens_once(spark):
    sizes = [(i, n) for i, n in enumerate([0, 1, 7, 8, 9, 30, 8, 8, 3, 3, 0, 25])]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    rows = packing.placed(df, 8).collect()
    per_doc, per_container = Counter(), Counter()
    for r in rows:
        per_doc[r.doc_id] += r.n_tokens
        per_container[r.container_id] += r.n_tokens
        assert r.container_id is not None
    assert {i: per_doc[i] for i, _ in sizes} == dict(sizes)
    assert max(per_container.values()) <= 8
    assert {r.doc_id for r in rows if r.piece > 0} == {4, 5, 11}


def test_empty_tables(spark):
    assert packing.placed(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0
    only = packing.placed(spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, n_tokens bigint")).collect()
    assert sorted((r.doc_id, r.container_id) for r in only) == [(1, 0), (2, 0)]


def test_fill_report(spark):
    df = packing.packed(spark.createDataFrame([(1, "a b c"), (2, None), (3, "x " * 50)], "doc_id bigint, text string"), 16)
    row = packing.fill(df, 16).first()
    assert row.largest <= 16 and 0 < row.fill <= 1
