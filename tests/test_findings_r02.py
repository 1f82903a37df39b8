"""Findings of round 2: distances that degrees would round, and kernels that took one pair after another."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from cadastra.functions import geometry as G
from cadastra.plans import building_queries, diff, polygons, spatial_queries

SF = "/root/testdata/sf0.001"
PLACE = "bid long, mx double, my double, cx double, cy double, area double"


def at(bid, mx, my, area):
    return bid, mx, my, 105.8 + mx / G.M_PER_DEG, my / G.M_PER_DEG, area


def test_places_exactly_the_radius_apart_match(spark):
    a = [at(i, 40.0 * i, 997.5 + 113.5 * i, 36.0) for i in range(200)]
    b = [at(1000 + i, mx, my + 3, 36.0) for i, mx, my, *_ in a]
    got = diff.location_candidates(spark.createDataFrame(a, PLACE), spark.createDataFrame(b, PLACE)).collect()
    assert sorted(tuple(r) for r in got) == [(i, 1000 + i, 3.0) for i in range(200)]


def test_of_equal_distances_the_smaller_id_is_reidentified(spark):
    a = [at(i, 200.0 * i + 0.5, 1000.5 + 200 * i, 400.0) for i in range(100)]
    b = [at(1000 + 2 * i + k, mx + (4.0, -4.0)[k], my + (2.0, -2.0)[k], 400.0) for i, mx, my, *_ in a for k in (0, 1)]
    lone = lambda rows, status: spark.createDataFrame([(r[0], status) for r in rows], "bid long, status string")
    got = diff.reidentified(spark.createDataFrame(a, PLACE), spark.createDataFrame(b, PLACE), lone(a, "removed"), lone(b, "added")).collect()
    assert sorted(tuple(r) for r in got) == [(i, 1000 + 2 * i) for i in range(100)]


def test_distances_of_the_releases_are_those_of_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    near = "SELECT a, b, d FROM cand WHERE d <= least(50, greatest(3, 0.5 * sqrt(greatest(aa, ba)))) AND greatest(aa, ba) <= 2 * least(aa, ba)"
    want = {(a, b): d for a, b, d in con.sql(f"WITH {spatial_queries.LOCATION_SQL} {near}").fetchall()}
    got = {(r.a, r.b): r.d for r in diff.location_candidates(*spatial_queries.sides(spark, SF)).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-13


def shapes(n, seed):
    """Stars of either turn, with holes, of several parts, with very many edges, level ones, empty and null ones."""
    r = np.random.default_rng(seed)

    def star(k):
        turn, long, (x, y) = np.sort(r.uniform(0, 2 * np.pi, k)), r.uniform(3, 10, k), r.uniform(-8, 8, 2)
        return np.stack([x + long * np.cos(turn), y + long * np.sin(turn)], 1)[:: r.choice([1, -1])]

    def level():
        x, y, w, h = *r.integers(-9, 9, 2), *r.integers(2, 9, 2)
        return np.array([[x, y], [x + 2 * w, y], [x + 2 * w, y + h], [x + w, y + h], [x + w, y + 2 * h], [x, y + 2 * h]], float)

    make = (
        lambda: [[star(r.integers(3, 14))]], lambda: [[star(9), star(4) / 9]], lambda: [[star(5)], [star(6)]], lambda: [[star(100)]], lambda: [[level()]], lambda: [[level()], [level()]], lambda: [],
    )
    return [None if i % 17 == 16 else G.write_wkb(make[r.integers(len(make))]()) for i in range(n)]


def test_areas_of_many_pairs_are_those_of_one_pair_after_another():
    a, b = shapes(400, 1), shapes(400, 2)
    keeps = [lambda p, q: p & q, lambda p, q: p | q, lambda p, q: p & (p ^ q)]
    got = G.overlay_areas(a, b, *keeps)
    for i, (x, y) in enumerate(zip(a, b)):
        for areas, keep in zip(got, keeps):
            assert areas[i] == pytest.approx(G.overlay(G.read_wkb(x), G.read_wkb(y), keep)[0], abs=1e-9)
    assert all((areas > 0).sum() > 200 for areas in got) and not len(G.overlay_areas([], [], *keeps)[0])


def test_the_column_takes_whole_batches(monkeypatch):
    corners = np.array([[[x, 0], [x + 4, 0], [x + 4, 2], [x + 2, 2], [x + 2, 4], [x, 4]] for x in range(3)], float)
    a = pd.Series(polygons.rings_wkb(corners))
    monkeypatch.delattr(G, "overlay")
    assert polygons.overlap_area.func(a, a.shift(-1)).to_list() == [8.0, 8.0, 0.0]


def test_polygon_pairs_measure_each_pair_once(spark):
    plan = building_queries.polygon_pairs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[overlap_area(") == 1
