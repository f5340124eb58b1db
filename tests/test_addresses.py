"""Relatives of a token are found within its sentence's row, also where ids have gaps or repeats."""

import pytest

from pyspark.sql import functions as F

from lexloom.operators import depgraph
from lexloom.plans import catalog

ARCS = {
    1: [(1, 0), (2, 1), (3, 1), (4, 3), (5, 3), (6, 3), (7, 6), (8, 9)],  # 9 is no token
    2: [(5, 2), (2, 0), (9, 5), (3, 5), (4, 5)],  # gaps
    3: [(1, 0), (2, 1), (2, 3), (3, 1)],  # 2 twice
    4: [(1, None), (2, 1)],
    5: [(4, 5), (5, 0), (6, 5)],  # from 4 on
}


def want(arcs):
    name = lambda k: f"w{k}"
    at = lambda i: [(j, h, name(k)) for k, (j, h) in enumerate(arcs) if j == i and i is not None] or [(None, None, None)]
    for k, (i, head) in enumerate(arcs):
        below = sorted(j for j, h in arcs if h == i and i > 0)
        left, right = [j for j in below if j < i], [j for j in below if j >= i][::-1]
        get = lambda x, n: x[n] if len(x) > n else None
        for h in at(head):
            for h2 in at(h[1]):
                for a in at(get(left, 0)):
                    for b in at(get(left, 1)):
                        for c in at(get(right, 0)):
                            for e in at(get(right, 1)):
                                yield i, name(k), h[2], h2[2], a[2], b[2], c[2], e[2]


def test_relatives_equal_brute_force(spark):
    rows = [(s, i, h, f"w{k}") for s, arcs in ARCS.items() for k, (i, h) in enumerate(arcs)]
    out = depgraph.address(spark.createDataFrame(rows, "s int, id int, head int, w string").repartition(3), ["s"], {"w": F.col("w")})
    got = [(r.s, r.id, r.self_w, r.h_w, r.h2_w, r.l_w, r.l2_w, r.r_w, r.r2_w) for r in out.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(((s, *r) for s, arcs in ARCS.items() for r in want(arcs)), key=key)


@pytest.mark.parametrize("name", ["f3_addresses"])
def test_addresses_join_nothing(spark, sf, name):
    assert "Join" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
