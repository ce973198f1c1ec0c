"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens runs down a tree of domain, language and source. Each node shares what it gets among
its children by weight; a child can take at most what its documents hold, `epochs` times over. What
a child cannot take goes to its siblings by their weights, and only what all of them together
cannot take is left to their parent's siblings. A leaf then takes the prefix of its documents, in an
order seeded by epoch, whose tokens fit its budget: whole epochs first, then part of one.

The tree has a node for each domain, language and source that occurs, and its shares are worked out
on the driver; documents are ordered by one range shuffle of ids and token counts over the cluster,
so a source that holds a third of all rows is many partitions. mix() cuts the document that would cross its
leaf's budget at its token; select(), which keeps rows whole, leaves it and all after it out.

Tokens are runs between spaces or line ends, and one for the end. Nulls: a null text has one
token, a null language or source is a leaf of its own (shown as null), null ids are ordered by their texts.
Every row is taken by itself, repeated rows and rows that share an id too; of rows alike in id and
text as many are taken as fit. Weights that are missing are 1. An empty table gives no rows. Other
columns, whatever their names, are kept by select() and play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from petroloom.llm import shared

Leaf = tuple  # (domain, lang, source)

#: Sources make up domains by their number, in default of a column of their own.
DOMAIN = "concat('domain', coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int) % 4, 4))"
#: Target weights of nodes by path from the root; paths that are not named weigh 1.
WEIGHTS: dict[tuple, float] = {("domain0",): 3.0, ("domain1",): 2.0, ("domain2",): 2.0, ("domain3",): 1.0}
SHARE, EPOCHS = 0.5, 2  # of all tokens; times that a document may be taken


def tokens() -> Column:
    text = shared.empty_if_null()
    words = F.size(F.filter(F.split(text, "[ \n]+"), lambda w: w != F.lit("")))
    return (words + 1).cast("long")


def pour(budget: float, wants: list[float], most: list[int]) -> list[float]:
    """Shares a budget by weight under upper bounds: what one cannot take goes to the others."""
    got, left = [0.0] * len(wants), set(range(len(wants)))
    while left and budget > 1e-9:
        total = sum(wants[i] for i in left)
        by = {i: budget * (wants[i] / total if total else 1 / len(left)) for i in left}
        full = [i for i in left if got[i] + by[i] >= most[i]]
        if not full:
            for i in left:
                got[i] += by[i]
            break
        for i in full:
            budget -= most[i] - got[i]
            got[i] = float(most[i])
            left.discard(i)
    return got


def budgets(held: dict[Leaf, int], total: float, weights: dict[tuple, float], epochs: int = 1) -> dict[Leaf, int]:
    """Tokens for each leaf. held: the tokens of each leaf's documents."""
    most = {leaf: n * epochs for leaf, n in held.items()}

    def down(path: tuple, leaves: list[Leaf], budget: float) -> dict[Leaf, int]:
        depth = len(path)
        if depth == len(leaves[0]):
            return {leaves[0]: int(budget + 1e-6)}
        by: dict = {}
        for leaf in leaves:
            by.setdefault(leaf[depth], []).append(leaf)
        names = sorted(by, key=lambda x: (x is None, str(x)))
        got = pour(min(budget, sum(most[x] for x in leaves)), [weights.get((*path, n), 1.0) for n in names], [sum(most[x] for x in by[n]) for n in names])
        out: dict[Leaf, int] = {}
        for n, share in zip(names, got, strict=True):
            out |= down((*path, n), by[n], share)
        return out

    return down((), list(held), float(total)) if held else {}


KEYS = ("domain", "lang", "source")
RANK = ("_m_order", "doc_id", "_m_text")  # the order of a leaf's documents


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["domain"].eqNullSafe(b["domain"]) & a["lang"].eqNullSafe(b["lang"]) & a["source"].eqNullSafe(b["source"])


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "_m_whole", "doc_id", "_m_text")


def plan(docs: DataFrame, weights: dict[tuple, float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, text, domain, lang, source). Documents without texts in their leaf's order, with the whole
    epochs of the leaf (_m_whole), the tokens it takes of one more (_m_rest) and those before a row in
    that (_m_at); and one row for each leaf: domain, lang, source, _m_leaf, _m_whole, _m_rest."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *KEYS, tokens().alias("_m_tokens"), F.xxhash64("text").alias("_m_text"))
    rows = shared.materialize(rows, "mix")
    held = {tuple(r[k] for k in KEYS): int(r["n"]) for r in rows.groupBy(*KEYS).agg(F.sum("_m_tokens").alias("n")).collect()}  # a row for each leaf
    got = budgets(held, share * sum(held.values()), weights, epochs)
    whole = {x: (b // held[x], b % held[x]) for x, b in got.items()}
    leaves = spark.createDataFrame([(*x, int(w), int(r), k) for k, (x, (w, r)) in enumerate(sorted(whole.items(), key=str))], "domain string, lang string, source string, _m_whole int, _m_rest long, _m_leaf long")
    placed = rows.join(F.broadcast(leaves), _same(rows, leaves)).select(*[rows[c] for c in rows.columns], *[leaves[c] for c in ("_m_whole", "_m_rest", "_m_leaf")])
    placed = shared.materialize(placed.withColumn("_m_order", _order(seed)), "mix")
    ranked, _ = shared.running_totals(placed, ["_m_leaf", *RANK], "_m_tokens", "mix")
    starts = ranked.groupBy("_m_leaf").agg(F.min("_before").alias("_m_start"))  # a row for each leaf
    return ranked.join(F.broadcast(starts), "_m_leaf").withColumn("_m_at", F.col("_before") - F.col("_m_start")).drop("_before", "_m_start"), leaves


def select(docs: DataFrame, domain: str = DOMAIN, weights: dict[tuple, float] = WEIGHTS, share: float = SHARE, seed: int = 0) -> DataFrame:
    """The rows of docs that the mixture takes, each once and whole, with the columns of docs: a row that would
    cross its leaf's budget, and those after it, are left out. Texts stay where they are: only the last row
    that each leaf takes is sent to them, with how many of its copies are taken; only rows like that one are
    numbered."""
    frame, back = shared.set_aside(docs, ["doc_id", "text", "lang", "source"], domain=F.expr(domain))
    ranked, leaves = plan(frame, weights, share, 1, seed)
    fit = ranked.filter(F.col("_m_at") + F.col("_m_tokens") <= F.col("_m_rest"))
    last = fit.groupBy("_m_leaf").agg(F.max(F.struct(*_ranks())).alias("_m_last"))  # a row for each leaf
    times = fit.join(F.broadcast(last), "_m_leaf").filter(F.struct(*_ranks()) == F.col("_m_last")).groupBy("_m_leaf").agg(F.count("*").alias("_m_copies"))
    ends = shared.materialize(leaves.join(last, "_m_leaf", "left").join(times, "_m_leaf", "left"), "ends")
    named = ends.select(*[F.col(k).alias(f"_m_{k}") for k in KEYS], "_m_leaf", "_m_whole", "_m_last", "_m_copies")
    same = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in KEYS]
    joined = frame.join(F.broadcast(named), same[0] & same[1] & same[2]).withColumn("_m_text", F.xxhash64("text")).withColumn("_m_order", _order(seed)).withColumn("_m_rank", F.struct(*_ranks()))
    before = joined.filter((F.col("_m_whole") >= 1) | F.coalesce(F.col("_m_rank") < F.col("_m_last"), F.lit(False)))
    at = joined.filter((F.col("_m_whole") < 1) & F.coalesce(F.col("_m_rank") == F.col("_m_last"), F.lit(False))).withColumn("_m_one", F.lit(1).cast("long"))
    numbered = shared.running_by_key(shared.materialize(at, "last"), "_m_leaf", [], ["_m_one"], label="last").filter("_m_one_run <= _m_copies")
    return back(before).unionByName(back(numbered))


def _ranks() -> list[Column]:
    return [F.col("_m_order"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_m_id"), F.col("_m_text")]


def mix(docs: DataFrame, domain: str = DOMAIN, weights: dict[tuple, float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """A row for each time that a document is taken: doc_id, domain, lang, source, tokens (how many of its first
    ones), epoch. The document that crosses its leaf's budget is cut there, so every budget is spent to the token."""
    frame, _ = shared.set_aside(docs, ["doc_id", "text", "lang", "source"], domain=F.expr(domain))
    ranked, _ = plan(frame, weights, share, epochs, seed)
    more = F.greatest(F.lit(0).cast("long"), F.least("_m_tokens", F.col("_m_rest") - F.col("_m_at")))
    taken = ranked.withColumn("_m_more", more).withColumn("_m_times", F.col("_m_whole") + (F.col("_m_more") > 0).cast("int")).filter("_m_times > 0")
    each = taken.withColumn("epoch", F.explode(F.expr("sequence(0, _m_times - 1)")))
    return each.select("doc_id", *KEYS, F.when(F.col("epoch") < F.col("_m_whole"), F.col("_m_tokens")).otherwise(F.col("_m_more")).alias("tokens"), "epoch")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half as many tokens as all documents have, mixed by the weights of domains."""
    with shared.working(spark):
        return shared.materialize(mix(shared.table(spark, sf_dir, "documents")), "mixed", hold=True)
