"""Robust places of large components to convergence, without a matrix of their edges (near.Near) and with angles of 0.

The loss is that of the kernel, posegraph.solve(): soft L1 of each scalar residual. It is convex, so its least place does
not depend on the start. A round linearises at the present places and solves by conjugate gradients, x and y each by
steps of their own, until the residual has fallen by `ease`; the next rounds take up the rest. Beside the diagonal
stands a coarse matrix by cells, without which a shift takes a step for each cell that it has to cross. A step is one
sum over the edges, made in tiles, and a table with a row for each node; the driver holds cells only, MOST at most."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from petroloom.operators import graph
from petroloom.operators.near import Columns, Near, in_tiles, spread

AXES = ("x", "y")
MOST = 4096  # cells
Edges = tuple[np.ndarray, ...]


def _cells(points: DataFrame, radius: float) -> DataFrame:
    """(id, k): numbers of cells of a component, from 0; they are made larger until there are MOST at most. Where there are
    more components than that, these have no cells."""
    side = radius
    for _ in range(40):
        cell = [F.floor(F.col(a) / side).alias(f"c{a}") for a in AXES]
        found = points.filter("free = 1").select("label", *cell).distinct()
        if found.limit(MOST + 1).count() <= MOST:
            numbers = [(*r, k) for k, r in enumerate(found.collect())]
            if numbers:
                table = points.sparkSession.createDataFrame(numbers, "label long, cx long, cy long, k int")
                return points.filter("free = 1").select("id", F.col("label").cast("long").alias("label"), *cell).join(F.broadcast(table), ["label", "cx", "cy"]).select("id", "k")
            break
        side *= 2
    return points.select("id", F.lit(0).alias("k")).limit(0)


class Weighed(NamedTuple):
    """Residuals of a tile's edges at (zx, zy): w, and for each axis residual, root and curvature. The curvature is that of
    the loss or, with bound, of a parabola above it, whose least place never has a greater loss."""

    scale: float
    bound: bool

    def __call__(self, c: Columns, e: Edges) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        i, j, w, out = e[0], e[1], np.maximum(0.2, e[5]), []
        for a, d in zip(AXES, e[2:4], strict=True):
            r = c[f"z{a}"][j] - c[f"z{a}"][i] - d
            root = np.sqrt(1 + (w * r / self.scale) ** 2)
            out.append((r, root, w * w / (root if self.bound else root**3)))
        return w, out


def _sums(state: DataFrame, near: Near, columns: list[str], names: list[str], run: Callable) -> DataFrame:
    """state with the sums `names` at its nodes, stored."""
    found = Near(state.select("id", "x", "y", "tiles", *columns), near.rule).sums(None, names, run)
    return graph.stored(state.join(found, "id", "left").na.fill(0.0, names))


def _slopes(state: DataFrame, near: Near, weighed: Weighed) -> DataFrame:
    """state with the loss's downward slope r, its curvature g and each node's share l of the loss."""
    def run(c: Columns, e: Edges, out: list[np.ndarray]) -> None:
        (i, j), n = e[:2], len(out[0])
        w, axes = weighed(c, e)
        for a, (r, root, s) in enumerate(axes):
            u = w * w * r / root
            out[a] += np.bincount(i, u, n) - np.bincount(j, u, n)
            out[2 + a] += np.bincount(i, s, n) + np.bincount(j, s, n)
            out[4] += np.bincount(i, root - 1, n)

    found = _sums(state.drop("rx", "ry", "gx", "gy", "l"), near, ["zx", "zy"], ["rx", "ry", "gx", "gy", "l"], run)
    return graph.kept_with(found.withColumn("rx", F.col("rx") * F.col("free")).withColumn("ry", F.col("ry") * F.col("free")), found)


def _products(state: DataFrame, near: Near, weighed: Weighed) -> DataFrame:
    """state with the product q of the curvature and the direction p."""
    def run(c: Columns, e: Edges, out: list[np.ndarray]) -> None:
        (i, j), n = e[:2], len(out[0])
        for a, (_, _, s), q in zip(AXES, weighed(c, e)[1], out, strict=True):
            u = s * (c[f"p{a}"][j] - c[f"p{a}"][i])
            q += np.bincount(j, u, n) - np.bincount(i, u, n)

    found = _sums(state, near, ["zx", "zy", "px", "py"], ["qx", "qy"], run)
    return graph.kept_with(found.withColumn("qx", F.col("qx") * F.col("free")).withColumn("qy", F.col("qy") * F.col("free")), found)


class Cells(NamedTuple):
    """The curvature between cells: its diagonal, and what links pairs of cells."""

    diagonal: np.ndarray
    a: np.ndarray
    b: np.ndarray
    s: np.ndarray

    def solve(self, right: np.ndarray) -> np.ndarray:
        """By conjugate gradients too: a cell has eight neighbours at most."""
        n, r, x = len(right), right.copy(), np.zeros(len(right))
        z = p = r / self.diagonal
        rz = start = (r * z).sum()
        for _ in range(20 * n):
            if rz <= 1e-26 * start:
                break
            q = self.diagonal * p - np.bincount(self.a, self.s * p[self.b], n) - np.bincount(self.b, self.s * p[self.a], n)
            alpha = rz / (p * q).sum()
            x, r = x + alpha * p, r - alpha * q
            z = r / self.diagonal
            before, rz = rz, (r * z).sum()
            p = z + rz / before * p
        return x


def _coarse(state: DataFrame, near: Near, weighed: Weighed) -> list[Cells]:
    """For each axis the curvature between cells."""
    rule = near.rule

    def tile(c: Columns) -> Columns:
        k = c["k"].astype(np.int64)
        pairs, sums = [np.zeros(0, np.int64)], [np.zeros((2, 0))]
        for e in rule.edges(c):
            a, b = k[e[0]], k[e[1]]
            inner = np.minimum(a, b) >= 0
            at, where = np.unique((np.minimum(a, b) * MOST + np.maximum(a, b))[inner], return_inverse=True)
            pairs.append(at)
            sums.append(np.stack([np.bincount(where, s[inner], len(at)) for _, _, s in weighed(c, e)[1]]))
        at, where = np.unique(np.concatenate(pairs), return_inverse=True)
        sx, sy = (np.bincount(where, s, len(at)) for s in np.concatenate(sums, axis=1))
        return {"a": at // MOST, "b": at % MOST, "sx": sx, "sy": sy}

    own = state.filter("k >= 0").groupBy("k").agg(F.sum("gx"), F.sum("gy")).collect()
    between = in_tiles(spread(state.select("id", "x", "y", "tiles", "zx", "zy", "k")), tile, "a int, b int, sx double, sy double")
    between = between.groupBy("a", "b").agg(F.sum("sx"), F.sum("sy")).collect()
    a, b, sx, sy = np.array([tuple(r) for r in between], float).reshape(-1, 4).T
    a, b, made = a.astype(int), b.astype(int), []
    for axis, s in ((1, sx), (2, sy)):
        diagonal = np.zeros(len(own))
        for r in own:
            diagonal[r[0]] = r[axis]
        one = a == b
        made.append(Cells(diagonal - 2 * np.bincount(a[one], s[one], len(own)), a[~one], b[~one], s[~one]))
    return made


def _direction(state: DataFrame, near: Near, weighed: Weighed, cells: list[Cells], right: np.ndarray, rz: np.ndarray, ease: float, steps: int) -> DataFrame:
    """state with the change (cx, cy). right: sums of r by cell, rz: of r * r / g, for each axis."""
    spark = state.sparkSession

    def far(at: np.ndarray) -> np.ndarray:
        return np.stack([c.solve(v) for c, v in zip(cells, at, strict=True)])

    def led(df: DataFrame, by: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> DataFrame:
        """df a step further, with the next direction p. The numbers come as a table: plans stay the same, and so does their code."""
        small = [(-1, 0.0, 0.0, *alpha, *beta), *[(k, *v, *alpha, *beta) for k, v in enumerate(by.T)]]
        df = df.join(F.broadcast(spark.createDataFrame([(int(k), *map(float, v)) for k, *v in small], "k int, wx double, wy double, ax double, ay double, bx double, by double")), "k")
        c = lambda n, a: F.col(f"{n}{a}")
        df = df.select("*", *[(c("r", a) - c("a", a) * c("q", a)).alias(f"s{a}") for a in AXES])
        p = {a: F.col("free") * (c("s", a) / c("g", a) + c("w", a) + c("b", a) * c("p", a)) for a in AXES}
        return df.select(*kept, *[(c("c", a) + c("a", a) * c("p", a)).alias(f"c{a}") for a in AXES], *[c("s", a).alias(f"r{a}") for a in AXES], *[p[a].alias(f"p{a}") for a in AXES])

    kept, none = ("id", "x", "y", "tiles", "label", "free", "k", "zx", "zy", "gx", "gy"), np.zeros(2)
    by = far(right)
    rz = start = rz + (right * by).sum(axis=1)
    state = led(state.select("*", *[F.lit(0.0).alias(f"{v}{a}") for v in "cpq" for a in AXES]), by, none, none)
    before = None
    for _ in range(steps):
        live = rz > ease * ease * start
        if not live.any():
            break
        with_q = _products(state, near, weighed)
        if before is not None:
            graph.forget(before)
        dot = lambda u, v, by: [F.sum(F.col(f"{u}{a}") * F.col(f"{v}{a}") / (F.col(f"g{a}") if by else F.lit(1.0))) for a in AXES]
        sums = with_q.groupBy("k").agg(F.sum("qx"), F.sum("qy"), *dot("p", "q", False), *dot("r", "r", True), *dot("r", "q", True), *dot("q", "q", True)).collect()
        pq, rr, rq, qq = np.array([r[3:] for r in sums], float).sum(axis=0).reshape(4, 2)
        alpha = np.where(live & (pq > 0), rz / np.where(pq > 0, pq, 1), 0.0)
        moved = np.zeros_like(right)
        for r in sums:
            if r[0] >= 0:
                moved[:, r[0]] = r[1:3]
        right = right - alpha[:, None] * moved
        by = far(right)
        now = np.maximum(0.0, rr - 2 * alpha * rq + alpha * alpha * qq + (right * by).sum(axis=1))
        beta = np.where(live, now / np.where(rz > 0, rz, 1), 0.0)
        rz = np.where(live, now, 0.0)
        state, before = led(with_q, by, alpha, beta), with_q
    return state


def places(points: DataFrame, near: Near, labels: DataFrame, diameter: float, ease: float = 0.03, rounds: int = 60, steps: int = 200, still: float = 3e-4) -> DataFrame:
    """(label, id, x, y): the places of points (id, x, y) at which the loss of their edges near is least, each component's
    smallest id at the origin. labels: (id, label), components that have edges. Ends with a round that moves nothing by
    `still`; what is left is then about `ease` of that."""
    roots = points.select(F.col("id").alias("label"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    at = labels.select("id", "label").join(roots, "label")
    state = near.points.join(at, "id").withColumn("free", (F.col("id") != F.col("label")).cast("double"))
    state = state.select("id", "x", "y", "tiles", "label", "free", (F.col("x") - F.col("ox")).alias("zx"), (F.col("y") - F.col("oy")).alias("zy"))
    state = graph.stored(state)
    state = graph.stored(state.join(_cells(state, near.rule.radius), "id", "left").na.fill(-1, ["k"]))
    scale, cells = max(1.0, 0.002 * diameter), None

    def sloped(state: DataFrame, weighed: Weighed) -> tuple[DataFrame, float, np.ndarray, np.ndarray]:
        made = _slopes(state, near, weighed)
        rows = made.groupBy("k").agg(F.sum("l"), *[F.sum(f"r{a}") for a in AXES], *[F.sum(F.col(f"r{a}") * F.col(f"r{a}") / F.col(f"g{a}")) for a in AXES]).collect()
        right = np.zeros((2, sum(r[0] >= 0 for r in rows)))
        for r in rows:
            if r[0] >= 0:
                right[:, r[0]] = r[2:4]
        return made, sum(r[1] for r in rows), right, np.array([r[4:] for r in rows], float).sum(axis=0)

    weighed = Weighed(scale, False)
    made, now, right, rz = sloped(state, weighed)
    for _ in range(rounds):
        if cells is None:
            cells = _coarse(made, near, weighed)
        found = _direction(made, near, weighed, cells, right, rz, ease, steps)
        size = found.agg(F.max(F.greatest(F.abs("cx"), F.abs("cy")))).first()[0] or 0.0
        moved = found.select("id", "x", "y", "tiles", "label", "free", "k", *[(F.col(f"z{a}") + F.col(f"c{a}")).alias(f"z{a}") for a in AXES])
        then = sloped(moved, Weighed(scale, False))
        if then[1] <= now or size < still:
            made, now, right, rz = then
            weighed = Weighed(scale, False)
            if size < still:
                break
        elif weighed.bound:
            break  # the parabola's least place is no better than this one but for rounding
        else:
            weighed = Weighed(scale, True)
            made, now, right, rz = sloped(made.select("id", "x", "y", "tiles", "label", "free", "k", "zx", "zy"), weighed)
    return made.select("label", "id", F.col("zx").alias("x"), F.col("zy").alias("y"))
