"""Queries without SQL, held against brute force on the smallest tables."""

import math

from cadastra.functions import s2
from cadastra.plans import kernel_queries, spatial_queries
from cadastra.plans.tables import boxes

import numpy as np

SF = "/root/testdata/sf0.001"


def test_tour_stops(spark):
    rows = sorted(((r.price, r.k, r.x0, r.y0) for r in boxes(spark, SF).collect()), key=lambda r: (-r[0], r[1]))
    want = []
    for price, k, x, y in rows:
        if len(want) < 10 and all(math.hypot(x - a, y - b) >= 120 for a, b, *_ in want):
            want.append((x, y, k, price))
    assert [tuple(r) for r in kernel_queries.tour_stops(spark, SF).collect()] == want


def test_ids_and_registry_one_row_after_another(spark):
    rows = sorted((r.key, r.locked_id, r.evidence) for r in spatial_queries.canon_rows(spark, SF)[2].collect())
    registry = {r.key: r.building_id for r in spatial_queries.registry(spark, SF).collect()}
    ids, taken = {}, set()

    def give(key, wanted, how):
        for i in wanted:
            if i is not None and i not in taken and key not in ids:
                ids[key] = (i, how)
                taken.add(i)

    for key, lock, _ in rows:
        give(key, [lock], "locked")
    for key, _, _ in rows:
        give(key, [registry.get(key)], "winner")
    for key, _, evidence in rows:
        give(key, [registry.get(e) for e in evidence], "evidence")
    got = {r.key: (r.building_id, r.how) for r in spatial_queries.stable_ids(spark, SF).collect()}
    assert got.keys() == {key for key, *_ in rows} and len({i for i, _ in got.values()}) == len(rows)
    assert {k: v for k, v in got.items() if v[1] != "new"} == ids and len(ids) > 300
    assert not {v[0] for v in got.values() if v[1] == "new"} & set(registry.values())
    after = {r.key: r.building_id for r in spatial_queries.registry_update(spark, SF).collect()}
    want = dict(registry)
    for key, _, evidence in rows:
        for k in (key, *evidence):
            want[k] = got[key][0]
    assert after == want


def test_cell_tokens_of_known_places():
    """Cells around the origin and two cities, as published tools print them."""
    leaf = s2.leaf_cells(np.array([0.0, 21.03, 10.77]), np.array([0.0, 105.85, 106.70]))
    assert [s2.token(c) for c in s2.parent(leaf, 4)][:2] == ["101", "313"]
    assert s2.token(s2.parent(leaf, 12)[0]) == "1000001" and s2.token(s2.parent(leaf, 6)[1]) == "3135"
