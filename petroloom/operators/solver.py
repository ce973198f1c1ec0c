"""Robust poses of a whole graph by least squares on tables, without a matrix.

Edges (i, j, dx, dy, phi, quality) bind poses (id, x, y, theta). The loss is soft L1 of each scalar residual,
weighted by quality. A round linearises the residuals at the present poses, with the slope of the loss as weight,
and solves the normal equations by conjugate gradients with the diagonal as preconditioner. A step of those is
two joins of the edges with the direction, one sum per node and three sums over all nodes: its vectors are
tables in the shared folder, so no task holds a component, and what reaches the driver is three numbers a step.
Components are solved together; the fixed node of each keeps its pose. Edges are a table or near.Near: those are made
anew for each sum, inside tiles, and no table holds a row for an edge."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from petroloom.functions import geometry as g
from petroloom.operators import graph
from petroloom.operators.near import Columns, Near

AXES = ("x", "y", "t")


class Problem(NamedTuple):
    """Poses (id, x, y, theta, fixed), edges with weight w, scale of the loss, half of the diameter, which turns
    angles into pixels, and whether angles are free."""

    poses: DataFrame
    edges: DataFrame | Near
    scale: float
    arm: float
    rotate: bool


def problem(poses: DataFrame, edges: DataFrame | Near, fixed: DataFrame, diameter: float, rotate: bool) -> Problem:
    """fixed: (id), one node of each component."""
    theta = F.col("theta") if rotate else F.lit(0.0)
    p = poses.select("id", "x", "y", theta.cast("double").alias("theta")).join(fixed.select("id", F.lit(True).alias("fixed")), "id", "left").na.fill(False, ["fixed"])
    if isinstance(edges, DataFrame):
        edges = graph.stored(edges.select("i", "j", "dx", "dy", F.col("phi").cast("double").alias("phi"), F.greatest(F.lit(0.2), "quality").alias("w")))
    return Problem(graph.stored(p), edges, max(1.0, 0.002 * diameter), diameter / 2, rotate)


def _ends(edges: DataFrame, table: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """edges with the columns of table (id, ...) at either end, as <c>_i and <c>_j; left joins."""
    for end in "ij":
        edges = edges.join(table.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end, "left")
    return edges


def _raw(p: Problem, poses: DataFrame) -> DataFrame:
    """Edges with their residuals (rx, ry, rt) at the poses and the turned shift (mx, my)."""
    e = _ends(p.edges, poses.select("id", "x", "y", "theta"), ("x", "y", "theta"))
    mx, my = g.rotate(F.col("theta_i"), F.col("dx"), F.col("dy"))
    turn = F.lit(p.arm) * (F.col("theta_j") - F.col("theta_i") - F.col("phi")) if p.rotate else F.lit(0.0)
    return e.select("i", "j", "w", mx.alias("mx"), my.alias("my"), (F.col("x_j") - F.col("x_i") - mx).alias("rx"), (F.col("y_j") - F.col("y_i") - my).alias("ry"), turn.alias("rt"))


def _root(p: Problem, r: str) -> Column:
    return F.sqrt(1 + F.pow(F.col("w") * F.col(r) / p.scale, 2))


Terms = Callable[[Columns, tuple[np.ndarray, ...]], tuple]


def _terms(p: Problem) -> Terms:
    """_raw() and the roots of _root() on a tile's edges: (mx, my, w, residuals, roots)."""
    arm, scale, rotate = p.arm, p.scale, p.rotate

    def terms(c: Columns, e: tuple[np.ndarray, ...]) -> tuple:
        i, j, dx, dy, phi, quality = e
        w, mx, my, t = np.maximum(0.2, quality), dx, dy, np.zeros(len(i))
        if rotate:
            cos, sin = np.cos(c["zt"][i]), np.sin(c["zt"][i])
            mx, my, t = cos * dx - sin * dy, sin * dx + cos * dy, arm * (c["zt"][j] - c["zt"][i] - phi)
        r = c["zx"][j] - c["zx"][i] - mx, c["zy"][j] - c["zy"][i] - my, t
        return mx, my, w, r, tuple(np.sqrt(1 + (w * v / scale) ** 2) for v in r)

    return terms


def _held(poses: DataFrame) -> DataFrame:
    """Poses by names that leave (x, y) to the points themselves."""
    return poses.select("id", F.col("x").alias("zx"), F.col("y").alias("zy"), F.col("theta").alias("zt"))


def _at_ends(p: Problem) -> Callable:
    """As _gathered() on a tile: adds weighted values u of edges to the sums of either end."""
    arm, rotate = p.arm, p.rotate

    def add(out: list[np.ndarray], e: tuple[np.ndarray, ...], mx: np.ndarray, my: np.ndarray, u: tuple) -> None:
        n, (i, j) = len(out[0]), e[:2]
        for a in (0, 1):
            out[a] += np.bincount(j, u[a], n) - np.bincount(i, u[a], n)
        if rotate:
            out[2] += np.bincount(j, arm * u[2], n) + np.bincount(i, my * u[0] - mx * u[1] - arm * u[2], n)

    return add


def _near_right(p: Problem, poses: DataFrame) -> DataFrame:
    """(id, b, g): right side and diagonal of edges that are not stored."""
    terms, add, arm, rotate = _terms(p), _at_ends(p), p.arm, p.rotate

    def run(c: Columns, e: tuple[np.ndarray, ...], out: list[np.ndarray]) -> None:
        (mx, my, w, r, root), n, (i, j) = terms(c, e), len(out[0]), e[:2]
        s = tuple(w * w / v for v in root)
        add(out[:3], e, mx, my, tuple(-a * b for a, b in zip(s, r, strict=True)))
        for a in (0, 1):
            out[3 + a] += np.bincount(i, s[a], n) + np.bincount(j, s[a], n)
        if rotate:
            out[5] += np.bincount(i, my * my * s[0] + mx * mx * s[1] + arm * arm * s[2], n) + np.bincount(j, arm * arm * s[2], n)

    return p.edges.sums(_held(poses), [f"{n}{a}" for n in "bg" for a in AXES], run)


def _near_product(p: Problem, poses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    terms, add, arm, rotate = _terms(p), _at_ends(p), p.arm, p.rotate

    def run(c: Columns, e: tuple[np.ndarray, ...], out: list[np.ndarray]) -> None:
        (mx, my, w, _, root), (i, j) = terms(c, e), e[:2]
        d = [c[f"p{a}"][j] - c[f"p{a}"][i] for a in AXES]
        if rotate:
            d = [d[0] + my * c["pt"][i], d[1] - mx * c["pt"][i], arm * d[2]]
        add(out, e, mx, my, tuple(w * w / v * x for v, x in zip(root, d, strict=True)))

    return lambda v: p.edges.sums(_held(poses).join(v.select("id", "px", "py", "pt"), "id", "left").na.fill(0.0), [f"q{a}" for a in AXES], run)


def loss(p: Problem, poses: DataFrame) -> float:
    if isinstance(p.edges, Near):
        terms = _terms(p)
        return p.edges.total(_held(poses), lambda c, e: sum(float((v - 1).sum()) for v in terms(c, e)[4]))
    return _raw(p, poses).agg(F.sum(sum((_root(p, f"r{a}") - 1 for a in AXES), F.lit(0.0)))).first()[0] or 0.0


def _linear(p: Problem, poses: DataFrame) -> DataFrame:
    """Edges with residuals and the slope of the loss (sx, sy, st) for each."""
    e = _raw(p, poses)
    for a in AXES:
        e = e.withColumn(f"s{a}", F.col("w") * F.col("w") / _root(p, f"r{a}"))
    return graph.stored(e)


def _gathered(p: Problem, e: DataFrame, u: dict[str, Column], names: str) -> DataFrame:
    """Sums at the nodes of what the weighted values u of the edges give to either end."""
    e = e.select("i", "j", "mx", "my", *[u[a].alias(f"u{a}") for a in AXES])
    back = F.col("my") * F.col("ux") - F.col("mx") * F.col("uy") - p.arm * F.col("ut")
    at = lambda end, x, y, t: F.struct(F.col(end).alias("id"), x.alias(f"{names}x"), y.alias(f"{names}y"), t.alias(f"{names}t"))
    both = e.select(F.explode(F.array(at("i", -F.col("ux"), -F.col("uy"), back), at("j", F.col("ux"), F.col("uy"), p.arm * F.col("ut")))).alias("e")).select("e.*")
    return both.groupBy("id").agg(*[F.sum(f"{names}{a}").alias(f"{names}{a}") for a in AXES])


def _diagonal(p: Problem, e: DataFrame) -> DataFrame:
    x, y, t = (F.col(f"s{a}") for a in AXES)
    at = lambda end, k: F.struct(F.col(end).alias("id"), x.alias("gx"), y.alias("gy"), k.alias("gt"))
    back = F.col("my") * F.col("my") * x + F.col("mx") * F.col("mx") * y + p.arm * p.arm * t
    both = e.select(F.explode(F.array(at("i", back), at("j", p.arm * p.arm * t))).alias("e")).select("e.*")
    return both.groupBy("id").agg(*[F.sum(f"g{a}").alias(f"g{a}") for a in AXES])


def _dot(a: str, b: str, by: str = "") -> Column:
    axes = AXES
    return F.sum(sum((F.col(f"{a}{k}") * F.col(f"{b}{k}") / (F.col(f"{by}{k}") if by else F.lit(1.0)) for k in axes), F.lit(0.0)))


def _table_product(p: Problem, e: DataFrame) -> Callable[[DataFrame], DataFrame]:
    def product(v: DataFrame) -> DataFrame:
        at = _ends(e, v.select("id", "px", "py", "pt"), ("px", "py", "pt")).na.fill(0.0)
        d = {a: F.col(f"p{a}_j") - F.col(f"p{a}_i") for a in AXES}
        d["x"], d["y"], d["t"] = d["x"] + F.col("my") * F.col("pt_i"), d["y"] - F.col("mx") * F.col("pt_i"), p.arm * d["t"]
        return _gathered(p, at, {a: F.col(f"s{a}") * d[a] for a in AXES}, "q")

    return product


def system(p: Problem, poses: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], DataFrame | None]:
    """The linear system at poses: its right side and diagonal (id, b, g), its product with a direction (id, p) as
    (id, q), and the table behind both, if there is one."""
    if isinstance(p.edges, Near):
        return _near_right(p, poses), _near_product(p, poses), None
    e = _linear(p, poses)
    right = _gathered(p, e, {a: -F.col(f"s{a}") * F.col(f"r{a}") for a in AXES}, "b")
    return right.join(_diagonal(p, e), "id"), _table_product(p, e), e


def direction(p: Problem, right: DataFrame, product: Callable[[DataFrame], DataFrame], steps: int, tolerance: float) -> DataFrame:
    """(id, cx, cy, ct): the change of the poses that solves the linear system, after at most `steps` steps or once
    the preconditioned residual has fallen by tolerance."""
    v = p.poses.filter("NOT fixed").select("id").join(right, "id")
    if not p.rotate:
        v = v.withColumn("bt", F.lit(0.0)).withColumn("gt", F.lit(1.0))
    zero = F.lit(0.0)
    v = graph.stored(v.select("id", *[F.col(f"b{a}").alias(f"r{a}") for a in AXES], *[f"g{a}" for a in AXES], *[zero.alias(f"c{a}") for a in AXES], *[(F.col(f"b{a}") / F.col(f"g{a}")).alias(f"p{a}") for a in AXES]))
    start = rz = v.agg(_dot("r", "r", "g")).first()[0] or 0.0
    for _ in range(steps):
        if rz <= tolerance * tolerance * start or rz == 0.0:
            break
        q = product(v)
        with_q = graph.stored(v.join(q if p.rotate else q.withColumn("qt", F.lit(0.0)), "id"))
        graph.forget(v)
        pq, rq, qq = with_q.agg(_dot("p", "q"), _dot("r", "q", "g"), _dot("q", "q", "g")).first()
        alpha = rz / pq
        moved = with_q.select("id", *[f"g{a}" for a in AXES], *[f"p{a}" for a in AXES], *[(F.col(f"c{a}") + alpha * F.col(f"p{a}")).alias(f"c{a}") for a in AXES], *[(F.col(f"r{a}") - alpha * F.col(f"q{a}")).alias(f"r{a}") for a in AXES])
        now = max(0.0, rz - 2 * alpha * rq + alpha * alpha * qq)  # the residual's size after the step, by the same sums
        beta, rz = now / rz, now
        v = moved.select("id", *[f"{n}{a}" for n in "rgc" for a in AXES], *[(F.col(f"r{a}") / F.col(f"g{a}") + beta * F.col(f"p{a}")).alias(f"p{a}") for a in AXES])
        v = graph.kept_with(v, with_q)
    return v.select("id", "cx", "cy", "ct")


def solve(p: Problem, rounds: int = 40, steps: int = 200, tolerance: float = 1e-10) -> DataFrame:
    """Poses (id, x, y, theta) at which the loss is least. A step that does not lessen it is halved. With a tolerance of
    0 exactly so many rounds and steps are made."""
    poses, now = p.poses, loss(p, p.poses)
    for _ in range(rounds):
        right, product, table = system(p, poses)
        change = graph.stored(direction(p, right, product, steps, tolerance))
        if table is not None:
            graph.forget(table)
        size = change.agg(F.max(F.greatest(F.abs("cx"), F.abs("cy"), p.arm * F.abs("ct")))).first()[0] or 0.0
        by, before = 1.0, now
        while True:
            c = lambda a: by * F.coalesce(f"c{a}", F.lit(0.0))  # noqa: B023, E731
            then = poses.join(change, "id", "left").select("id", (F.col("x") + c("x")).alias("x"), (F.col("y") + c("y")).alias("y"), (F.col("theta") + c("t")).alias("theta"), "fixed")
            then = graph.stored(then)
            now = loss(p, then)
            if now <= before or by < 1e-3:
                break
            by /= 2
        if now > before:
            break
        poses = then
        if tolerance and (size * by < 1e-7 or before - now < 1e-12 * max(1.0, now)):
            break
    return poses.select("id", "x", "y", "theta")


def _known(labels: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The poses of start that share a frame, and one fixed node of each component.

    start: (id, x, y, theta, group); poses of one group were solved together. Where a component holds several groups,
    those of the largest are kept, the smallest group among equals."""
    held = labels.join(start.filter("x IS NOT NULL"), "id")
    size = held.groupBy("label", "group").agg(F.count("*").alias("n"))
    best = size.groupBy("label").agg(F.max(F.struct("n", (-F.col("group").cast("long")).alias("g"))).alias("b")).select("label", (-F.col("b.g")).alias("group"))
    kept = graph.stored(held.join(best, ["label", "group"]).select("label", "id", "x", "y", "theta"))
    roots = labels.select("label").distinct().join(kept.groupBy("label").agg(F.min("id").alias("first")), "label", "left")
    return kept.drop("label"), graph.stored(roots.select(F.coalesce("first", "label").alias("id")))


def optimise(nodes: DataFrame, edges: DataFrame | Near, diameter: float, rotate: bool, limit: float, start: DataFrame | None = None, most: int = 30, least: int = 3, **how: float) -> tuple[DataFrame, DataFrame | Near]:
    """Solves all components, drops the edges that stay further off than limit and half the largest, and begins anew until
    none does. Returns (id, component, x, y, theta), where components are numbered as by graph.ranked() and
    poses of those left out are null, and the edges that are left. start: poses (id, x, y, theta) to begin from, with a
    column `group` if they lie in several frames; nodes without one are reached along edges."""
    poses = start if start is None or "group" in start.columns else start.withColumn("group", F.lit(0))
    for turn in range(most):
        labels = graph.stored(graph.components(nodes, edges))
        known, roots = (None, labels.filter("id = label").select("id")) if poses is None else _known(labels, poses)
        if known is None or known.join(nodes.select("id"), "id", "right").filter("x IS NULL").limit(1).count():
            known = graph.integrate(nodes, edges, roots, known).drop("level")
        solved = solve(problem(known, edges, roots, diameter, rotate), **how)
        poses = solved.join(labels.select("id", F.col("label").alias("group")), "id")
        if turn == most - 1:
            break
        if isinstance(edges, Near):
            edges, found = edges.without_outliers(solved, limit)
        else:
            marked = graph.stored(graph.outlier_round(graph.residuals(edges, solved), limit))
            found = marked.filter("outlier").limit(1).count()
            edges = graph.stored(marked.filter("NOT outlier").drop("residual", "outlier")) if found else edges
        if not found:
            break
    ranked = graph.ranked(graph.components(nodes, edges), least).select("id", "component")
    at = [F.when(F.col("component") >= 0, F.col(c)).alias(c) for c in ("x", "y", "theta")]
    return ranked.join(solved, "id").select("id", "component", *at), edges
