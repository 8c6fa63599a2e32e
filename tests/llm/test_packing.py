import numpy as np
from hypothesis import given, settings, strategies as st

from tidemark.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_pack_respects_capacity_and_wastes_little(sizes):
    sizes = np.array(sizes, np.int64)
    place = packing.pack(sizes, 50)
    load = np.bincount(place, sizes, minlength=1) if len(sizes) else np.zeros(1)
    assert load.max() <= 50
    least = max(1, -(-int(sizes.sum()) // 50))
    assert len(load) <= 2 * least + 1


def test_assignments(spark):
    rows = [(i, (i * 37) % 90) for i in range(500)] + [(1000, 450), (1001, 200), (1002, 0), (7, 13), (7, 13), (None, 5), (1003, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, n_tokens bigint, shard string")
    got = packing.assignments(df, len(rows), capacity=100, shard_docs=200).collect()
    load, per = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.tokens
        per.setdefault(r.doc_id, []).append((r.piece, r.first_token, r.tokens))
    assert max(load.values()) <= 100 and set(per) == {r[0] for r in rows}
    assert sorted(per[1000]) == [(0, 0, 100), (1, 100, 100), (2, 200, 100), (3, 300, 100), (4, 400, 50)]
    assert sorted(per[1001]) == [(0, 0, 100), (1, 100, 100)] and per[1002] == [(0, 0, 0)] and len(per[7]) == 3
    assert sum(load.values()) == sum(n or 0 for _, n in rows)
    unused = packing.totals(packing.assignments(df, len(rows), 100, 200), 100).first()
    assert unused.unused_share < 0.05 and unused.containers == len(load)


def test_costs_are_balanced():
    sizes = np.array([40] * 20 + [5] * 80)
    place = packing.pack(sizes, 100)
    cost = np.bincount(place, packing.cost(sizes))
    assert cost.max() / cost.min() < 1.2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.assignments(df, 0).count() == 0
