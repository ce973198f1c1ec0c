"""Consensus among candidate matches between a segment and the main component."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from petroloom.functions import geometry as g
from petroloom.operators import graph


def mapped(theta: Column, tx: Column, ty: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    x, y = g.rotate(theta, cx, cy)
    return x + tx, y + ty


def agreeing(candidates: DataFrame, attempt: str, position_tol: float, rotation_deg: float = 1.0) -> DataFrame:
    """For each candidate (attempt, k, m, s, quality, theta, mx, my, with the mapped centre) those of its
    attempt that agree with it, itself included: count, quality and independent support. An attempt
    has a few dozen candidates."""
    b = candidates.select(F.col(attempt).alias("_a"), *[F.col(c).alias(f"_{c}") for c in ("m", "s", "quality", "theta", "mx", "my")])
    near = (F.abs(F.col("theta") - F.col("_theta")) < math.radians(rotation_deg)) & (F.hypot(F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")) < position_tol)
    both = candidates.join(b, (F.col(attempt) == F.col("_a")) & near)
    out = both.groupBy(attempt, "k").agg(F.count("*").alias("agree"), F.sum("_quality").alias("quality"), F.collect_set("_m").alias("ms"), F.collect_set("_s").alias("ss"))
    return out.select(attempt, "k", "agree", "quality", F.least(apart("ms"), apart("ss")).alias("support"))


def apart(ids: str) -> Column:
    """How many of a set of ids lie at least two apart, taken from the smallest on."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("last"))
    step = lambda a, x: F.when(a["last"].isNull() | (x - a["last"] >= 2), F.struct((a["n"] + 1).alias("n"), x.cast("long").alias("last"))).otherwise(a)
    return F.aggregate(F.array_sort(F.array_distinct(F.col(ids))), start, step, lambda a: a["n"])


def confirming(anchors: DataFrame, frames: DataFrame, main: DataFrame, reach: float, most: int = 4, by: tuple[str, ...] = ("segment",)) -> DataFrame:
    """Pairs that a right anchor must match as well. anchors: one row (segment, s0, m0, theta, tx, ty) for each
    value of `by`, which holds segment; frames: (segment, id, x, y); main: (id, x, y). Of the frames nearest to the
    anchor's in time, each has two main frames at most; those that share no frame with the anchor come first."""
    place = lambda *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    x, y = g.rotate(F.col("theta"), F.col("x"), F.col("y"))
    near = frames.join(anchors, "segment").withColumn("gap", F.abs(F.col("id") - F.col("s0"))).withColumn("_p", place("gap", "id")).filter(F.col("_p") <= 3 * most)
    near = near.select(*by, "s0", "m0", "gap", F.col("id").alias("s"), (x + F.col("tx")).alias("x"), (y + F.col("ty")).alias("y"))
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    # main frames in the nine cells around, by an equi-join
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    asked = near.withColumn("_cx", around("x")).withColumn("_cy", around("y"))
    there = main.select(F.col("id").alias("m"), F.col("x").alias("mx"), F.col("y").alias("my"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    away = F.hypot(F.col("mx") - F.col("x"), F.col("my") - F.col("y"))
    same = (F.col("m") == F.col("m0")).cast("int") + (F.col("s") == F.col("s0")).cast("int")
    pairs = asked.join(there, ["_cx", "_cy"]).withColumn("away", away).withColumn("same", same).filter((F.col("away") < reach) & (F.col("same") < 2))
    two = F.row_number().over(Window.partitionBy(*by, "s").orderBy("same", "gap", "away", "m"))
    return pairs.withColumn("_k", two).filter("_k <= 2").withColumn("place", place("same", "gap", "away", "s", "m")).filter(F.col("place") <= most)


def _near(a: str, b: str, tol: float, rotation_deg: float) -> Column:
    at = lambda t, c: F.col(f"{t}.{c}")
    return (F.abs(at(a, "theta") - at(b, "theta")) < math.radians(rotation_deg)) & (F.hypot(at(a, "mx") - at(b, "mx"), at(a, "my") - at(b, "my")) < tol)


def with_centres(candidates: DataFrame) -> DataFrame:
    """candidates (theta, tx, ty, cx, cy) with mx, my: where each sends the segment's centre."""
    x, y = mapped(F.col("theta"), F.col("tx"), F.col("ty"), F.col("cx"), F.col("cy"))
    return candidates.withColumn("mx", x).withColumn("my", y)


def consensus(candidates: DataFrame, tol: float, need: int, rotation_deg: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The best group of each attempt and what is left beside it.

    candidates: (attempt, k, m, s, quality, theta, tx, ty, px, py, cx, cy, mx, my), where p is the place of frame s in
    its segment and c the segment's centre. Returns them with `residual`, how far each puts its frame from where
    the mean transform of the best group does, and `inner`, for those of the group that lie within tol; and a row
    for each attempt: support of the inner ones, the rival's among all others, and whether the group is
    accepted. Attempts are independent, each has a few dozen candidates, so all are decided by the same joins."""
    best = agreeing(candidates, "attempt", tol, rotation_deg)
    first = Window.partitionBy("attempt").orderBy(F.desc("support"), F.desc(F.round("quality", 6)), "k")
    best = best.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("attempt", F.col("k").alias("best"))
    leader = candidates.join(best, "attempt").filter("k = best").select("attempt", "theta", "mx", "my")
    a, b = candidates.alias("a"), leader.alias("b")
    group = a.join(b, (F.col("a.attempt") == F.col("b.attempt")) & _near("a", "b", tol, rotation_deg)).select("a.*")
    mean = group.groupBy("attempt").agg(F.avg("theta").alias("mean"), F.avg("mx").alias("_gx"), F.avg("my").alias("_gy"))
    in_group = group.select("attempt", "k", F.lit(True).alias("_in"))
    c = candidates.join(mean, "attempt").join(in_group, ["attempt", "k"], "left")
    dx, dy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    ax, ay = g.rotate(F.col("mean"), dx, dy)
    bx, by = g.rotate(F.col("theta"), dx, dy)
    c = c.withColumn("residual", F.hypot(F.col("_gx") + ax - F.col("mx") - bx, F.col("_gy") + ay - F.col("my") - by))
    c = c.withColumn("inner", F.coalesce("_in", F.lit(False)) & (F.col("residual") <= tol)).drop("mean", "_gx", "_gy", "_in")
    of = lambda df: df.groupBy("attempt").agg(F.collect_set("m").alias("_ms"), F.collect_set("s").alias("_ss")).select("attempt", F.least(apart("_ms"), apart("_ss")).alias("support"))
    rival = agreeing(c.filter(~F.col("inner")), "attempt", tol, rotation_deg).groupBy("attempt").agg(F.max("support").alias("rival"))
    said = candidates.select("attempt").distinct().join(of(c.filter("inner")), "attempt", "left").join(rival, "attempt", "left").na.fill(0, ["support", "rival"])
    return c, said.withColumn("need", F.lit(need)).withColumn("accepted", (F.col("support") >= need) & (F.col("rival") < need))


def anchors_of(candidates: DataFrame, most: int = 6) -> DataFrame:
    """The candidates of each attempt that are worth trying alone, with their rank."""
    worth = F.col("quality") * F.greatest("ncc", F.lit(0.01))
    rank = F.row_number().over(Window.partitionBy("attempt").orderBy(F.desc(worth), "k"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= most)


def hypotheses(anchors: DataFrame, tests: DataFrame, tol: float, least: int = 2, rotation_deg: float = 1.0, test_tol: float | None = None) -> DataFrame:
    """(attempt, k, rank, tried, holds): anchors by what their tests (attempt, k, s, m, residual or null) say. An
    anchor holds if `least` of its tests, and half of them, lie within test_tol (by default tol). One that agrees with an anchor before it
    that holds is the same hypothesis and is not tried. A fold over the few anchors of an attempt."""
    good = tests.groupBy("attempt", "k").agg(F.count("*").alias("n"), F.count_if(F.col("residual") <= (test_tol or tol)).alias("ok"))
    a = anchors.join(good, ["attempt", "k"], "left").withColumn("passes", F.coalesce((F.col("ok") >= least) & (2 * F.col("ok") >= F.col("n")), F.lit(False)))
    row = F.struct("rank", "k", "passes", "theta", "mx", "my")
    start = F.array().cast("array<struct<rank:int,k:bigint,tried:boolean,holds:boolean,theta:double,mx:double,my:double>>")

    def judge(held: Column, x: Column) -> Column:
        same = F.exists(held, lambda h: h["holds"] & (F.abs(h["theta"] - x["theta"]) < math.radians(rotation_deg)) & (F.hypot(h["mx"] - x["mx"], h["my"] - x["my"]) < tol))
        return F.array_append(held, F.struct(x["rank"].alias("rank"), x["k"].alias("k"), (~same).alias("tried"), (~same & x["passes"]).alias("holds"), x["theta"].alias("theta"), x["mx"].alias("mx"), x["my"].alias("my")))

    folded = a.groupBy("attempt").agg(F.sort_array(F.collect_list(row)).alias("_rows")).select("attempt", F.explode(F.aggregate("_rows", start, judge)).alias("_h"))
    return folded.select("attempt", *[F.col(f"_h.{c}").alias(c) for c in ("k", "rank", "tried", "holds")])


def decided(candidates: DataFrame, said: DataFrame, judged: DataFrame, tests: DataFrame, tol: float, rotation_deg: float = 1.0, test_tol: float | None = None) -> tuple[DataFrame, DataFrame]:
    """What becomes of every candidate and test, and of every attempt.

    candidates and said: of consensus(); judged and tests: of hypotheses(), for attempts that were not accepted.
    Returns (attempt, source, s, m, status, residual) and (attempt, outcome, support, rival, held). An attempt is linked by
    consensus, or by the one hypothesis that holds: then with the candidates that agree with its anchor and lie
    within tol of it and the tests that it passed. Several that hold, or two groups, are ambiguous."""
    held = judged.groupBy("attempt").agg(F.count_if("holds").alias("held"), F.max(F.when(F.col("holds"), F.col("k"))).alias("anchor"))
    outcome = F.when(F.col("accepted"), "consensus").when(F.col("held") == 1, "anchor").when(F.col("held") > 1, "ambiguous anchors").otherwise("rejected")
    outcome = F.when((outcome == "rejected") & F.col("ambiguous"), "ambiguous groups").otherwise(outcome)
    ends = said.join(held, "attempt", "left").na.fill(0, ["held"]).withColumn("ambiguous", F.col("rival") >= F.col("need")).withColumn("outcome", outcome)
    c = candidates.join(ends.select("attempt", "outcome", "anchor"), "attempt")
    lead = c.filter("k = anchor AND outcome = 'anchor'").select("attempt", "theta", "mx", "my")
    a, b = c.alias("a"), lead.alias("b")
    dx, dy = F.col("a.px") - F.col("a.cx"), F.col("a.py") - F.col("a.cy")
    ax, ay = g.rotate(F.col("b.theta"), dx, dy)
    bx, by = g.rotate(F.col("a.theta"), dx, dy)
    off = F.hypot(F.col("b.mx") + ax - F.col("a.mx") - bx, F.col("b.my") + ay - F.col("a.my") - by)
    beside = a.join(b, (F.col("a.attempt") == F.col("b.attempt")) & _near("a", "b", tol, rotation_deg)).select("a.attempt", "a.k", off.alias("_off"))
    c = c.join(beside, ["attempt", "k"], "left")
    linked = (F.col("outcome") == "consensus") & F.col("inner") | (F.col("outcome") == "anchor") & F.coalesce(F.col("_off") <= tol, F.lit(False))
    status = F.when(linked, "accepted").when(F.col("outcome").isin("consensus", "anchor"), "outlier").otherwise("rejected")
    rows = c.select("attempt", F.lit("global").alias("source"), "s", "m", status.alias("status"), F.when(F.col("outcome") == "anchor", F.col("_off")).otherwise(F.col("residual")).alias("residual"))
    t = tests.join(judged.filter("tried").select("attempt", "k"), ["attempt", "k"]).join(ends.select("attempt", "outcome", "anchor"), "attempt")
    passed = (F.col("outcome") == "anchor") & (F.col("k") == F.col("anchor")) & F.coalesce(F.col("residual") <= (test_tol or tol), F.lit(False))
    checks = t.filter("outcome != 'consensus'").select("attempt", F.lit("verify").alias("source"), "s", "m", F.when(passed, "accepted").otherwise("verify-failed").alias("status"), "residual")
    return rows.unionByName(checks), ends.select("attempt", "outcome", "support", "rival", F.col("held").cast("int").alias("held"))


def realigned(pairs: Callable[[DataFrame, float], DataFrame], start: DataFrame, centres: DataFrame, wide: float, narrow: float, tol: float, least: int = 2, rotation_deg: float = 2.0) -> DataFrame:
    """Better transforms of components from two rounds of matches, for all of them at once.

    start: (component, theta, tx, ty); centres: (component, cx, cy). pairs(transforms, reach) pairs frames under
    transforms and matches them: (component, s, m, quality, theta, tx, ty). The wide round takes the mean of the
    largest group that agrees; the narrow one pairs anew under that mean, keeps what agrees with it and means those.
    Confirmed if `least` matches and half of them lie within tol of the result. Returns (component, theta, tx, ty, matched,
    consistent, confirmed); components without a wide match have no row."""
    def matches(transforms: DataFrame, reach: float) -> DataFrame:
        found = pairs(transforms, reach).join(centres, "component").withColumn("k", F.col("s") * 1000000 + F.col("m"))
        return graph.stored(with_centres(found))

    def mean(group: DataFrame) -> DataFrame:
        """(component, g_theta, g_mx, g_my)"""
        return group.groupBy("component").agg(*[F.avg(c).alias(f"g_{c}") for c in ("theta", "mx", "my")])

    def beside(found: DataFrame, at: DataFrame) -> DataFrame:
        near = (F.abs(F.col("theta") - F.col("g_theta")) < math.radians(rotation_deg)) & (F.hypot(F.col("mx") - F.col("g_mx"), F.col("my") - F.col("g_my")) < tol)
        return found.join(at, "component").withColumn("agrees", near)

    def transform(at: DataFrame) -> DataFrame:
        x, y = g.rotate(F.col("g_theta"), F.col("cx"), F.col("cy"))
        return at.join(centres, "component").select("component", F.col("g_theta").alias("theta"), (F.col("g_mx") - x).alias("tx"), (F.col("g_my") - y).alias("ty"))

    first = matches(start, wide)
    groups = agreeing(first, "component", tol, rotation_deg)
    order = Window.partitionBy("component").orderBy(F.desc("agree"), F.desc(F.round("quality", 6)), "k")
    best = groups.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("component", "k")
    lead = first.join(best, ["component", "k"]).select("component", F.col("theta").alias("g_theta"), F.col("mx").alias("g_mx"), F.col("my").alias("g_my"))
    one = graph.stored(mean(beside(first, lead).filter("agrees")))
    second = matches(transform(one), narrow)
    kept = mean(beside(second, one).filter("agrees"))
    two = graph.stored(one.select("component", *[F.col(f"g_{c}").alias(f"_{c}") for c in ("theta", "mx", "my")]).join(kept, "component", "left").select("component", *[F.coalesce(f"g_{c}", f"_{c}").alias(f"g_{c}") for c in ("theta", "mx", "my")]))
    counts = beside(second, two).groupBy("component").agg(F.count("*").alias("matched"), F.count_if("agrees").alias("consistent"))
    out = transform(two).join(counts, "component", "left").na.fill(0, ["matched", "consistent"])
    return out.withColumn("confirmed", (F.col("consistent") >= least) & (2 * F.col("consistent") >= F.col("matched")))


def worklist(sizes: DataFrame, matches: DataFrame, percent: int) -> DataFrame:
    """Attempts to link components (label, size) to the largest, which grows by each that links.

    matches: (a, b, n), both ways, how many matches components have with one another; one links if those with all that have
    joined so far are `percent` hundredths of its size. Each round scores all components that were not tried against the main one as
    it is, at once. The first that links, the largest and of equals the smallest label, joins; those before it
    have failed and are open again only because the main one has grown. The rounds end when none is open.
    Returns (round, label, size, main_size, matches, linked), a row for each attempt."""
    order = F.struct("size", (-F.col("label")).alias("_l"))
    top = sizes.agg(F.max(order).alias("t"))
    state = graph.stored(sizes.join(F.broadcast(top), F.lit(True)).select("label", "size", (order == F.col("t")).alias("main"), F.lit(0).cast("long").alias("tried")))
    done, number = None, 0
    while True:
        whole = state.filter("main").agg(F.sum("size")).first()[0] or 0
        number += 1
        joined = state.filter("main").select(F.col("label").alias("b"))
        score = matches.join(joined, "b").groupBy(F.col("a").alias("label")).agg(F.sum("n").cast("long").alias("matches"))
        open_ = state.filter(~F.col("main") & (F.col("tried") != whole)).join(score, "label", "left").na.fill(0, ["matches"]).withColumn("fits", 100 * F.col("matches") >= percent * F.col("size"))
        open_ = graph.stored(open_)
        if not open_.limit(1).count():
            break
        first = open_.filter("fits").agg(F.max(order).alias("f"))  # one row
        made = open_.join(F.broadcast(first), F.lit(True)).filter(F.col("f").isNull() | (order >= F.col("f")))
        made = graph.stored(made.select(F.lit(number).alias("round"), "label", "size", F.lit(whole).cast("long").alias("main_size"), "matches", F.coalesce(order == F.col("f"), F.lit(False)).alias("linked")))
        done = made if done is None else done.unionByName(made)
        after = state.join(made.select("label", "linked"), "label", "left")
        state = graph.stored(after.select("label", "size", (F.col("main") | F.coalesce("linked", F.lit(False))).alias("main"), F.when(F.col("linked").isNotNull(), F.lit(whole)).otherwise(F.col("tried")).cast("long").alias("tried")))
    empty = state.limit(0).select(F.lit(0).alias("round"), "label", "size", F.col("tried").alias("main_size"), F.col("tried").alias("matches"), F.col("main").alias("linked"))
    return empty if done is None else done


def over_gaps(poses: DataFrame, segment: str, gap: float, reach: float, keyframes: int = 3, tail: int = 4) -> DataFrame:
    """Pairs (i, j, dx, dy) of the last keyframes of a segment (numbered) and the first of the next, where the
    motion over its last `tail` ones, carried on for `gap`, puts them within reach."""
    w = Window.partitionBy(segment)
    e = poses.withColumn("_k", F.row_number().over(w.orderBy("id"))).withColumn("_back", F.row_number().over(w.orderBy(F.desc("id"))))
    speed = lambda c: (F.max_by(c, "id") - F.min_by(c, "id")) / F.greatest(F.max("id") - F.min("id"), F.lit(1))
    last = e.filter(F.col("_back") <= tail).groupBy(segment).agg(speed("x").alias("vx"), speed("y").alias("vy"), F.max_by("x", "id").alias("zx"), F.max_by("y", "id").alias("zy"))
    ends = e.filter(F.col("_back") <= keyframes).join(last, segment).select((F.col(segment) + 1).alias(segment), F.col("id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), "vx", "vy", "zx", "zy")
    first = e.filter("_k = 1").select(segment, F.col("x").alias("fx"), F.col("y").alias("fy"))
    starts = e.filter(F.col("_k") <= keyframes).join(first, segment).select(segment, F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), "fx", "fy")
    d = lambda c: F.col(f"z{c}") + F.col(f"v{c}") * gap + F.col(f"b{c}") - F.col(f"f{c}") - F.col(f"a{c}")
    pairs = ends.join(starts, segment).withColumn("dx", d("x")).withColumn("dy", d("y"))
    return pairs.filter(F.hypot("dx", "dy") - 0.5 * F.hypot(F.col("vx") * gap, F.col("vy") * gap) <= reach)
