"""N-gram Jaccard join by vertical partitioning.

One global order of all n-grams puts rare ones first: by the level of their cell in a sketch that counts
all n-grams of all sets, then by hash. The order is cut into fragments of about equal weight, and each
set into a segment for each fragment. The overlap of two sets is counted in each fragment by itself,
and the partial overlaps are summed for each pair.

Which pairs are counted at all follows from the same order. Two sets whose similarity reaches the
threshold share one of the first n-grams of both (their prefixes), and the first they share leaves both
enough n-grams behind it; of sets alike in size the prefixes even share several. N-grams of up to SHORT
sets make pairs of all of them. Of the pairs, sizes, places, the number of shared n-grams and parity
bitmaps rule out those that differ too much. Equal sets are one node from the start.

Families of near copies share whole prefixes, and all their pairs would grow with the square of a
family. So an n-gram of more sets names a hub, the set with the fewest n-grams before it, which is the least
altered copy; each set meets the HUBS hubs it shares most with, and verified links join sets into components; after HUB_ROUNDS such rounds, only sets outside their n-gram's largest
component are compared with those of other components. A pair is left out only if its two sets are
already in one component or differ too much, so the components are those of all links.

Nulls: a null text, or one without words, has no set and is linked with nothing; its component is
its own id. Equal texts are linked if they have a word. Repeated rows stay rows. Null ids link other
documents as any text does, but do not name a component; one of null ids alone has none. An empty table
gives no rows. Other columns play no part. Words and n-grams are compared by 64-bit hashes, sets by
128-bit ones. The sketch only orders n-grams: its size costs no links. Long texts are read in pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from petroloom.llm import shared

PERCENT, WIDTH = 85, 4
CELLS = 1 << 22  # of the sketch that orders n-grams
FRAGMENTS = 4
SHORT = 16  # sets of one n-gram that are all compared with each other
HOT = 100_000  # rows of one n-gram in a task; those of more are dealt over several
BITS = 64  # of the 128 that stand for a set, those that name it in joins; clashes are told apart
SEEN = 200_000  # sets that a task remembers, to pass over copies
HUB_ROUNDS = 2
HUBS = 3  # that a set meets in a round
SHARED = 4  # n-grams that prefixes must share, at most
BEFORE = 16  # n-grams before a place that are looked at, to make a pair once
WORDS = 8  # of 64 bits, of a set's parity bitmap
SEND = 1_000_000  # ids of candidates that may be broadcast: 8 MB
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


class Shingles(dict):
    """Sets of hashed word n-grams of texts as UTF-8."""

    def __init__(self, width: int = WIDTH, most: int = 200_000) -> None:
        super().__init__()
        self.width, self.most = width, most
        self.factors = np.array([_FACTORS[k % 8] + np.uint64(2 * (k // 8)) for k in range(width)], np.uint64)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def words(self, text: bytes) -> np.ndarray:
        """Hashes of the words of the lower-cased text."""
        parts, at, step = [], 0, 1 << 22
        while at < len(text):
            end = at + step
            if end < len(text):
                gap = re.compile(rb"[ \t-\r]").search(text, end)
                end = gap.start() if gap else len(text)
            words, at = text[at:end].lower().split(), end
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def of(self, text: bytes) -> np.ndarray:
        """The sorted distinct n-grams; of fewer words, all of them as one."""
        w = self.words(text)
        if not len(w):
            return w
        n = min(self.width, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h += w[k : len(w) - n + 1 + k] * self.factors[k]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.unique(h)


def _node(grams: np.ndarray, bits: int) -> tuple[int, int]:
    """128 bits that stand for a set; of the first 64 the upper `bits`."""
    found = xxhash.xxh3_128_digest(grams.tobytes())
    return int.from_bytes(found[:8], "little", signed=True) >> 64 - bits, int.from_bytes(found[8:], "little", signed=True)


def _ident(node: tuple[int, int], clashes: frozenset[int]) -> int:
    """A set's name in joins: the first 64 bits, or a mix of all 128 where other sets share those."""
    if node[0] not in clashes:
        return node[0]
    mixed = xxhash.xxh64_digest(b"".join(x.to_bytes(8, "little", signed=True) for x in node))
    return int.from_bytes(mixed, "little", signed=True)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and a key by which a row's text is found again."""
    text = shared.empty_if_null()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"), text.cast("binary").alias("text"))


def _bitmap(grams: np.ndarray) -> list[int]:
    """For each of 64 * WORDS cells whether it holds an odd number of n-grams: two sets differ in at
    least as many elements as their bitmaps do in bits."""
    odd = np.bincount((grams >> np.uint64(7)).astype(np.int64) & 64 * WORDS - 1, minlength=64 * WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).tolist()


_CELL = np.uint64(64 - CELLS.bit_length() + 1)
_MAPS = [f"b{k}" for k in range(WORDS)]
_SETS = ["doc_id", "key", "n_shingles", "high", "low", *_MAPS]


def _sets(width: int, bits: int) -> shared.Mapper:
    """For each document its set's size, hash and bitmap; for each task the sketch of its sets, as rows
    for shared.sum_vectors()."""
    names = [*_SETS, "name", "slice", "fan", "counts"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, sketch, seen = Shingles(width), np.zeros(CELLS, np.int32), set()
        for batch in rows:
            found: list[list] = [[] for _ in range(3 + WORDS)]
            for text in batch.column(2):
                grams = grams_of.of(text.as_py())
                node = _node(grams, bits) if len(grams) else (None, None)
                for column, x in zip(found, (len(grams), *node, *_bitmap(grams)), strict=True):
                    column.append(x)
                if node[0] is not None and node not in seen:
                    if len(seen) < SEEN:
                        seen.add(node)
                    np.add.at(sketch, (grams >> _CELL).astype(np.int32), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.int64()) for c in found), *(pa.nulls(batch.num_rows, t) for t in (pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=names)
        for counted in shared.vector_rows({"sketch": sketch}):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(counted.num_rows, pa.int64()) for _ in _SETS), *counted.columns], names=names)

    return run


class Order:
    """The global order, from the sketch: by level (an eighth of a doubling of the cell's count), then by
    hash. cuts: the first n-gram (level, hash) of each fragment but the first."""

    def __init__(self, sketch: np.ndarray, hot: int) -> None:
        self.levels, by_level = np.empty(len(sketch), np.uint8), np.zeros(256)
        for at in range(0, len(sketch), 1 << 16):
            some = sketch[at : at + (1 << 16)]
            self.levels[at : at + len(some)] = levels = np.floor(8 * np.log2(np.maximum(some, 1)))
            by_level += np.bincount(levels.astype(np.uint8), weights=some, minlength=256)
        # cells that hold far more than the mean are those of frequent n-grams
        self.hot = max(float(hot), 4 * float(sketch.sum()) / len(sketch))
        upto = np.cumsum(by_level) / max(1.0, by_level.sum())
        self.cuts = []
        for share in np.arange(1, FRAGMENTS) / FRAGMENTS:
            level = min(255, int(np.searchsorted(upto, share)))
            before = upto[level - 1] if level else 0.0
            inside = (share - before) / max(upto[level] - before, 1e-12)
            self.cuts.append((level, min(int(inside * 2**64), 2**64 - 1)))

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The levels of n-grams."""
        return self.levels[(grams >> _CELL).astype(np.int64)]

    def fragment(self, grams: np.ndarray) -> np.ndarray:
        levels, found = self.of(grams), np.zeros(len(grams), np.int64)
        for level, at in self.cuts:
            found += (levels > level) | ((levels == level) & (grams >= np.uint64(at)))
        return found

    def parts(self, levels: np.ndarray) -> np.ndarray:
        """Over how many tasks the sets of n-grams of these levels are dealt."""
        return np.ceil(np.exp2((levels.astype(np.float64) + 1) / 8) / self.hot).astype(np.int64)


def _prefixes(width: int, percent: int, order: Order, clashes: frozenset[int], bits: int) -> shared.Mapper:
    """The first n-grams of each set in the global order, with their places. part: -1, or to which part
    of a hot n-gram the row goes."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of, seen = Shingles(width), set()
        for batch in rows:
            out, nodes, sizes, counts = [], [], [], []
            for text in batch.column(0):
                grams = grams_of.of(text.as_py())
                if not len(grams) or (node := _node(grams, bits)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                keep = len(grams) - -(-percent * len(grams) // 100) + 1
                out.append(grams[np.argsort(order.of(grams), kind="stable")[:keep]])
                nodes.append(_ident(node, clashes))
                sizes.append(len(grams))
                counts.append(len(out[-1]))
            if out:
                grams, node = np.concatenate(out), np.repeat(np.array(nodes, np.int64), counts)
                parts = order.parts(order.of(grams))
                part = np.where(parts > 1, (node.view(np.uint64) >> np.uint64(20)).astype(np.int64) % np.maximum(parts, 1), -1)
                at = np.concatenate([np.arange(n) for n in counts])
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(node), pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(at.astype(np.int32))], names=["gram", "part", "node", "size", "at"])

    return run


def _possible(size_a: np.ndarray, at_a: np.ndarray, size_b: np.ndarray, at_b: np.ndarray, percent: int) -> np.ndarray:
    """Could two sets be linked of whose common n-grams one of the first SHARED has these places?"""
    both = size_a + size_b
    need = -(-percent * both // (100 + percent))
    return (np.minimum(size_a, size_b) * 100 >= np.maximum(size_a, size_b) * percent) & (np.minimum(size_a - at_a, size_b - at_b) + SHARED - 1 >= need)


def _runs(percent: int, short: int) -> shared.Mapper:
    """From rows sorted by n-gram, part, place and node: all possible pairs (a, b) of an n-gram of up to `short`
    sets, and the rows of others (gram, a, size, at), with a hub as b. Of rows of one n-gram only, none."""
    names = ["gram", "a", "b", "size", "at"]

    def made(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        gram, part, node, size, at = x
        starts = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
        lengths = np.diff(np.append(starts, len(gram)))
        whole = part[starts] < 0
        for n in range(2, short + 1):
            if len(first := starts[(lengths == n) & whole]):
                i, j = np.triu_indices(n, 1)
                i, j = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                ok = _possible(size[i], at[i], size[j], at[j], percent)
                i, j = i[ok], j[ok]
                none = pa.nulls(len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), none, none], names=names)
        long = (lengths > short) | ~whole
        pick, hub = np.repeat(long, lengths), np.repeat(node[starts], lengths)
        if pick.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[pick]) for c in (gram, node, hub, size, at)], names=names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in rows:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            # copies of one set in several tasks
            fresh = np.concatenate([[True], (x[:3, 1:] != x[:3, :-1]).any(axis=0)])
            if held and (held[-1][:3, -1] == x[:3, 0]).all():
                fresh[0] = False
            x = x[:, fresh]
            if not x.shape[1]:
                continue
            last = x[:2, -1]
            tail = int(np.flatnonzero((x[:2] != last[:, None]).any(axis=0))[-1]) + 1 if (x[:2, 0] != last).any() else 0
            if tail or (held and (held[-1][:2, -1] != x[:2, 0]).any()):
                yield from made(np.concatenate([*held, x[:, :tail]], axis=1))
                held = []
            held.append(x[:, tail:])
        if held:
            yield from made(np.concatenate(held, axis=1))

    return run


def _segments(width: int, order: Order, clashes: frozenset[int], bits: int) -> shared.Mapper:
    """The segments of each wanted node's set: its n-grams of each fragment of the order."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_of = Shingles(width)
        for batch in rows:
            out = []
            for text, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                grams = grams_of.of(text.as_py())
                if not len(grams) or _ident(_node(grams, bits), clashes) != want:
                    continue
                part = order.fragment(grams)
                out += [(want, f, grams[part == f].tobytes()) for f in np.unique(part).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["node", "fragment", "grams"])

    return run


def _overlaps(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial overlap of each pair in one fragment."""
    for batch in rows:
        left, right = batch.column(5), batch.column(6)
        n = [len(np.intersect1d(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), assume_unique=True)) for a, b in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(n, pa.int64())], names=[*batch.schema.names[:5], "n"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids: (node, label) for every node of an edge, label the smallest id of
    its component. Labels spread to neighbours and then jump to their label's label, so the
    number of rounds grows with the logarithm of a path's length."""
    both = shared.materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    hubs = shared.hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), "b", both.count())
    labels = shared.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    nodes = labels.count()
    while True:
        # a hub's links, and the rows of a large component's label, are joined as hot keys
        sent = shared.hot_join(both, labels.select(F.col("node").alias("b"), "label"), "b", hubs).groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(sent, labels["node"] == sent["a"]).select("node", F.col("label").alias("was"), F.least("label", "heard").alias("near"))
        near = shared.materialize(near, "labels")
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        now = shared.hot_join(near, far, "near", shared.hot_keys(near.groupBy("near").agg(F.count("*").alias("n")), "near", nodes))
        now = shared.materialize(now.select("node", "was", F.least("near", "far").alias("label")), "labels")
        done = not now.filter(F.col("was") != F.col("label")).limit(1).count()
        labels = now.drop("was")
        if done:
            return labels


def _members(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """For each row of docs: doc_id, key, n_shingles and label, its component's name; without a set, null."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    with shared.working(spark):
        texts = _texts(docs)
        kinds = ", ".join(f"{c} long" for c in _SETS) + ", " + shared.VECTORS
        found = shared.materialize(texts.mapInArrow(shared.lean(_sets(width, BITS)), kinds), "sets")
        order = Order(shared.sum_vectors(found.filter("counts IS NOT NULL").select("name", "slice", "fan", "counts"), {"sketch": CELLS})["sketch"], HOT)
        sets = found.filter("counts IS NULL")
        nodes = shared.materialize(sets.filter("high IS NOT NULL").groupBy("high", "low").agg(F.min("key").alias("key"), F.count("*").alias("n"), F.first("n_shingles").alias("size"), *[F.first(b).alias(b) for b in _MAPS]), "nodes")
        # sets that differ but share 64 bits: N * N / 2^65 are expected of N, some hundred of 1e11
        clashes = frozenset(r["high"] for r in nodes.groupBy("high").agg(F.count("*").alias("n")).filter("n > 1").collect())
        if clashes:
            few = nodes.filter(F.col("high").isin(*clashes)).select("high", "low").collect()
            named = F.broadcast(docs.sparkSession.createDataFrame([(r["high"], r["low"], _ident((r["high"], r["low"]), clashes)) for r in few], "high long, low long, other long"))
            by_name = lambda df: df.join(named, ["high", "low"], "left").select(*df.columns, F.coalesce("other", "high").alias("node"))
            nodes, sets = by_name(nodes), by_name(sets)
        else:
            nodes, sets = nodes.withColumn("node", F.col("high")), sets.withColumn("node", F.col("high"))
        labels = _labels(texts, nodes, percent, width, order, clashes)
        if labels is None:
            labels = nodes.select("node", F.col("node").alias("label")).limit(0)
        members = shared.hot_join(sets.filter("node IS NOT NULL").select("doc_id", "key", "n_shingles", "node"), nodes.select("node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "node", shared.hot_keys(nodes, "node", sets.count()))
        alone = sets.filter("node IS NULL").withColumn("label", F.lit(None).cast("long"))
        columns = ["doc_id", "key", "n_shingles", "label"]
        return shared.materialize(members.select(*columns).unionByName(alone.select(*columns)), "members", hold=True)


def _labels(texts: DataFrame, nodes: DataFrame, percent: int, width: int, order: Order, clashes: frozenset[int]) -> DataFrame | None:
    """(node, label) of all nodes that are linked; None if there are none."""
    postings = texts.select("text").mapInArrow(shared.lean(_prefixes(width, percent, order, clashes, BITS)), "gram long, part int, node long, size int, at int")
    runs = postings.repartition("gram", "part").sortWithinPartitions("gram", "part", "at", "node").mapInArrow(shared.lean(_runs(percent, SHORT)), "gram long, a long, b long, size long, at long")
    runs = shared.materialize(runs, "runs")
    rows = shared.materialize(runs.filter("gram IS NOT NULL").select("gram", F.col("a").alias("node"), F.col("b").alias("hub"), "size", "at"), "postings")
    # how many n-grams of short lists two sets share, and at most how many of long ones
    long = rows.groupBy("node").agg(F.count("*").alias("k"))
    short = runs.filter("gram IS NULL").groupBy("a", "b").agg(F.count("*").alias("k"))
    short = short.join(long.select(F.col("node").alias("a"), F.col("k").alias("k_a")), "a", "left").join(long.select(F.col("node").alias("b"), F.col("k").alias("k_b")), "b", "left")
    pairs = short.select("a", "b", (F.col("k") + F.coalesce(F.least("k_a", "k_b", F.when(F.col("k_a").isNull() | F.col("k_b").isNull(), 0)), F.lit(0))).alias("k"))
    pairs = pairs.unionByName(_met(rows.select("node", "hub")))

    # elements that two linked sets may differ in: all of both, less twice the least overlap
    both = F.col("size_a") + F.col("size_b")
    need = F.ceil(both * percent / (100 + percent))
    bits = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in _MAPS), F.lit(0))
    close = (F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent) & (bits <= both - 2 * need)
    # of a linked pair's common n-grams the first ones, so many, lie in both prefixes
    prefix = lambda x: F.col(x) - F.ceil(F.col(x) * percent / 100) + 1
    first = F.greatest(F.lit(1), F.least(F.lit(SHARED), *[prefix(x) - (F.col(x) - need) for x in ("size_a", "size_b")]))
    described = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", *_MAPS)])
    held = Segments(texts, nodes, width, order, clashes)
    labels = edges = verified = None
    for turn in range(HUB_ROUNDS + 2):
        if turn:
            at = rows.drop("hub")
            at = at.withColumn("label", F.col("node")) if labels is None else at.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            at = shared.materialize(at, "postings")
            first_of = ("at", "node") if turn == 1 else (F.xxhash64(F.lit(turn), "gram", "node"),)
            by = at.groupBy("gram", "label").agg(F.count("*").alias("k"), F.min_by("node", F.struct(*first_of)).alias("hub")).groupBy("gram").agg(F.sum("k").alias("n"), F.max_by(F.struct("label", "hub"), F.struct("k", "label")).alias("of"), F.count("*").alias("labels"))
            by = shared.materialize(by.filter("labels > 1").select("gram", "n", F.col("of.label").alias("largest"), "of.hub"), "grams")
            n = by.agg(F.sum("n")).first()[0]
            if not n:
                break
            hot = shared.hot_keys(by, "gram", int(n))
            rows = shared.materialize(shared.hot_join(at, by.select("gram", "largest", "hub"), "gram", hot), "postings")
            if turn <= HUB_ROUNDS:
                pairs = _met(rows.filter("label != largest").select("node", "hub"))
            else:
                pairs = _outside(rows, described, close, need)
            rows = rows.select("gram", "node", "size", "at", "hub")
        pairs = pairs.groupBy("a", "b").agg(F.max("k").alias("k"))
        if verified is not None:
            pairs = pairs.join(verified, ["a", "b"], "left_anti")
        pairs = pairs.join(described("a"), "a").join(described("b"), "b").filter(close & (F.col("k") >= first))
        pairs = shared.materialize(pairs.select("a", "b", F.col("size_a").cast("int"), F.col("size_b").cast("int")), "pairs")
        links = shared.materialize(_verify(pairs, held.of(pairs), percent), "links")
        seen = pairs.select("a", "b")
        verified = seen if verified is None else verified.unionByName(seen)
        edges = links if edges is None else edges.unionByName(links)
        if links.limit(1).count():
            labels = components(edges)
    return labels


def _outside(rows: DataFrame, described, close: Column, need: Column) -> DataFrame:
    """What is outside its n-gram's largest component, with all of other components: pairs (a, b) that may
    be linked. A pair is made at the first n-gram it shares, as far as the BEFORE n-grams before tell."""
    before = F.collect_list("gram").over(Window.partitionBy("node").orderBy("at", "gram").rowsBetween(-BEFORE, -1))
    rows = shared.materialize(rows.withColumn("before", before), "postings")
    whole = lambda df, x: df.withColumnsRenamed({c: f"{c}_{x}" for c in ("node", "label", "at", "before")}).drop("size", "hub").withColumnRenamed(f"node_{x}", x).join(described(x), x)
    one, two = whole(rows.filter("label != largest"), "a").drop("largest"), whole(rows, "b")
    apart = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("largest")) | (F.col("a") < F.col("b")))
    reach = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= need
    met = one.join(two, (one["gram"] == two["gram"]) & apart & reach & close & ~F.arrays_overlap("before_a", "before_b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(SHARED).cast("long").alias("k"))


def _met(rows: DataFrame) -> DataFrame:
    """rows (node, hub): each node's pairs (a, b) with the hubs that it shares most n-grams with."""
    shares = rows.filter("node != hub").groupBy("node", "hub").agg(F.count("*").alias("k"))
    best = shares.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "hub")), False), 1, HUBS).alias("best"))
    best = best.select("node", F.explode("best.hub").alias("hub"))
    return best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), F.lit(SHARED).cast("long").alias("k"))


class Segments:
    """The segments (node, fragment, grams) of sets that pairs have asked for, each cut once."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, width: int, order: Order, clashes: frozenset[int]) -> None:
        self.texts, self.nodes, self.cut = texts, nodes, _segments(width, order, clashes, BITS)
        self.fetched = self.table = None

    def of(self, pairs: DataFrame) -> DataFrame:
        """Those of all sets that pairs (a, b) name."""
        named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        named = shared.materialize(self.nodes.select("node", "key").join(named, "node", "left_semi"), "named")
        wanted = named if self.fetched is None else shared.materialize(named.join(self.fetched, "node", "left_anti"), "wanted")
        n = wanted.count()
        if n or self.table is None:
            by = F.broadcast(wanted) if n <= SEND else wanted  # else both sides shuffle
            found = shared.materialize(self.texts.join(by, "key").select("text", "node").mapInArrow(shared.lean(self.cut), "node long, fragment int, grams binary"), "segments")
            self.table = found if self.table is None else self.table.unionByName(found)
            self.fetched = wanted.select("node") if self.fetched is None else self.fetched.unionByName(wanted.select("node"))
        named = named.select("node")
        return self.table.join(F.broadcast(named) if named.count() <= SEND else named, "node", "left_semi")


def _verify(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: overlaps counted fragment by fragment, summed by pair."""
    one, two = (segments.select(F.col("node").alias(x), "fragment", F.col("grams").alias(f"grams_{x}")) for x in "ab")
    met = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", "size_a", "size_b", "fragment", "grams_a", "grams_b")
    parts = met.mapInArrow(shared.lean(_overlaps), "a long, b long, size_a int, size_b int, fragment int, n long").groupBy("a", "b", "size_a", "size_b", "fragment").agg(F.max("n").alias("n"))
    sums = parts.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("n")) * percent).select("a", "b")


def join(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles and component_id, where two documents are linked if
    the Jaccard similarity of their sets of word n-grams is at least percent / 100."""
    members = _members(docs, percent, width)
    linked = members.filter("label IS NOT NULL")
    least = shared.materialize(linked.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "least")
    named = shared.hot_join(linked, least.select("label", "component_id"), "label", shared.hot_keys(least, "label", linked.count()))
    alone = members.filter("label IS NULL").withColumn("component_id", F.col("doc_id"))
    return named.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under a similarity of 0.85 of their sets of four words."""
    return join(shared.table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row of each component, with the columns of docs: the one with the smallest id (a null id only
    where no other is), and of several texts under that id the one with the smallest hash; of repeated
    rows one stays. Rows without a set are linked with nothing and all stay."""
    docs, back = shared.set_aside(docs, ["doc_id", "text"])
    key = "_j_key"
    members = _members(docs, percent, width).filter("label IS NOT NULL")
    with shared.working(docs.sparkSession):
        rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
        best = members.groupBy("label").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
        best = shared.materialize(best.select("label", "best.*", "n"), "best")
        ranked = shared.hot_join(members, best.select("label", F.col("doc_id").alias("best_id"), F.col("key").alias("best_key")), "label", shared.hot_keys(best, "label", members.count()))
        is_best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("key") == F.col("best_key"))
        gone = shared.materialize(ranked.filter(~is_best).select("doc_id", "key").distinct(), "gone", hold=True)
        again = shared.materialize(ranked.filter(is_best).groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "key"), "again", hold=True)
    marked = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), shared.empty_if_null()))

    def split(df: DataFrame, by: DataFrame, how: str) -> DataFrame:
        by = by.select(F.col("doc_id").alias("_j_id"), F.col("key").alias("_j_of"))
        by = F.broadcast(by) if by.count() <= SEND else by  # else both sides shuffle
        return df.join(by, (F.col(key) == by["_j_of"]) & df["doc_id"].cast("long").eqNullSafe(by["_j_id"]), how)

    kept = split(marked, gone, "left_anti")
    if again.limit(1).count():
        kept = split(kept, again, "left_anti").unionByName(split(kept, again, "left_semi").dropDuplicates(["doc_id", key]))
    return back(kept)
