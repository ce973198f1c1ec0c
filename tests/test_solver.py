"""The solver on tables against the kernel's, and optimisation of small graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd

from petroloom.functions import posegraph as pg
from petroloom.operators import graph, solver

EDGE = "i long, j long, dx double, dy double, phi double, quality double"


def scene(n: int, rotation: bool, seed: int = 0):
    rng = np.random.default_rng(seed)
    true = np.stack([100.0 * (np.arange(n) % 3), 90.0 * (np.arange(n) // 3), rng.normal(0, 0.05, n) * rotation], axis=1)
    rows = []
    for i in range(n):
        for j in range(i + 1, n):
            if np.linalg.norm(true[j, :2] - true[i, :2]) < 150:
                d = pg.turn(true[i, 2]).T @ (true[j, :2] - true[i, :2]) + rng.normal(0, 0.4, 2)
                rows.append((i, j, *d.tolist(), float(true[j, 2] - true[i, 2] + rng.normal(0, 0.001) * rotation), 0.9))
    return true, rows


def table(spark, poses):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(poses)], "id long, x double, y double, theta double")


def test_converged_poses_are_the_kernels(spark):
    rotation, n = True, 4
    true, rows = scene(n, rotation)
    rows[2] = (*rows[2][:2], rows[2][2] + 30.0, *rows[2][3:])  # one edge far off
    edges = pd.DataFrame(rows, columns=["i", "j", "dx", "dy", "phi", "quality"])
    start = pg.integrate(n, edges, 0)
    want = pg.solve(start, edges, 700.0, rotation)
    p = solver.problem(table(spark, start), spark.createDataFrame(rows, EDGE), spark.createDataFrame([(0,)], "id long"), 700.0, rotation)
    got = {r["id"]: (r["x"], r["y"], r["theta"]) for r in solver.solve(p, rounds=8, steps=3 * n, tolerance=1e-5).collect()}
    assert len(got) == n and got[0] == tuple(start[0])
    for k in range(n):
        assert np.abs(np.array(got[k][:2]) - want[k, :2]).max() < 0.05 and abs(got[k][2] - want[k, 2]) < 5e-4


def test_optimisation_drops_outliers_and_parts(spark):
    """Two components, one wrong edge between far nodes, a pair too small to keep, and known poses in two frames."""
    true, rows = scene(6, False, 3)
    far = [(i + 10, j + 10, *rest) for i, j, *rest in rows if j < 3]
    nodes = spark.createDataFrame([(i,) for i in [*range(6), 10, 11, 12, 20, 21]], "id long")
    edges = spark.createDataFrame([*rows, *far, (2, 3, 300.0, 0.0, 0.0, 0.9), (20, 21, 5.0, 5.0, 0.0, 0.9)], EDGE)
    start = spark.createDataFrame([(k, 40.0 + float(true[k, 0]), float(true[k, 1]), 0.0, 1) for k in range(4)] + [(4, 9000.0, 0.0, 0.0, 2), (5, 9100.0, 0.0, 0.0, 2)], "id long, x double, y double, theta double, group int")
    found, left = solver.optimise(nodes, edges, 700.0, False, 7.0, start, rounds=2, steps=4, tolerance=1e-2)
    got = {r["id"]: r for r in found.collect()}
    assert [got[i]["component"] for i in (0, 5, 10, 12, 20)] == [0, 0, 1, 1, -1] and got[20]["x"] is None
    assert (2, 3) not in {(r["i"], r["j"]) for r in left.collect()}
    assert got[0]["x"] == 40.0  # the larger frame stays
    off = [np.hypot(got[k]["x"] - 40 - true[k, 0], got[k]["y"] - true[k, 1]) for k in range(6)]
    assert max(off) < 2


def test_integration_of_odd_graphs(spark):
    """Several edges of one pair, a loop on one node, a lone node, and a component with two roots."""
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
    edges = spark.createDataFrame([(1, 0, 2.0, 0.0, 0.5, 1.0), (1, 0, 1.0, 0.0, 0.5, 1.0), (1, 2, 3.0, 0.0, 0.0, 1.0), (3, 3, 1.0, 1.0, 1.0, 1.0), (4, 5, 1.0, 0.0, 0.0, 1.0), (5, 6, 1.0, 0.0, 0.0, 1.0)], EDGE)
    got = {r["id"]: (r["level"], round(r["x"], 6), round(r["y"], 6), r["theta"]) for r in graph.integrate(nodes, edges).collect()}
    c, s = np.cos(-0.5), np.sin(-0.5)
    assert got[0] == (0, 0, 0, 0) and got[3] == (0, 0, 0, 0)
    assert got[1] == (1, round(-c, 6), round(-s, 6), -0.5)  # the smaller of two edges, walked backwards
    assert got[2] == (2, round(2 * c, 6), round(2 * s, 6), -0.5)
    two = graph.integrate(nodes, edges, spark.createDataFrame([(4,), (6,)], "id long"))
    assert {(r["id"], r["level"], r["x"]) for r in two.collect()} == {(4, 0, 0.0), (6, 0, 0.0), (5, 1, 1.0)}
