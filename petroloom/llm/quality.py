"""Quality by importance resampling.

Generative models of hashed n-grams, one of target text (labelled as good) and one of the raw corpus,
give each document a log weight. There is a model for each kind of n-gram: of two bytes, of four bytes,
and of marks that tell whether a word repeats the one before. A document's rate is the mean, over its
n-grams of a kind, of the log ratio of target to raw, summed over the kinds; its log weight is
TEMPERED times that rate, the log ratio of a passage of so many n-grams written as the document is.
Plain sums would grow with a document's length and bury the noise. At 32 the weights of good text
spread by less than the noise, while those of junk lie far below.

Gumbel noise added to the log weights and the k largest taken draws k documents without replacement
with chances in proportion to exp(weight) (Gumbel top-k). k is the caller's; by default it is the share
of labelled rows that are good, of all rows. The raw model counts every n-gram of every document; the
target model those of at most SAMPLE labelled rows (a bound on labels only).

Weights and noise are whole numbers (1 / 65536), so a document's key is the same wherever it is
computed. Ties at the k-th place go to the smaller id, nulls first; rows alike in key and id are drawn
together. Nulls: a null or very short text has no n-grams and weight 0; null ids are drawn like any
other. Repeated rows share an id's noise. Ids labelled twice count as good if one label says so. Without
good and poor labels every document stays. An empty table gives no rows. Long texts are read in pieces
of PIECE bytes. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from petroloom.llm import shared

ORDERS = (2, 4, 0)  # bytes of an n-gram; 0: marks of words that repeat the word before, three in a row
TEMPERED = 32  # n-grams that a document's log weight stands for
BUCKETS = {2: 1 << 14, 4: 1 << 14, 0: 8}
SAMPLE = 10_000  # labelled rows that the target model is fitted on, at most
PIECE = 1 << 18
UNIT = 65536.0
SMOOTH = 0.5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and each row's start, the end last."""
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary() if pa.types.is_binary(column.type) else column.type)
    offsets = np.frombuffer(column.buffers()[1] or bytes(8), np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _blocks(data: np.ndarray, starts: np.ndarray, order: int, piece: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of the buckets of all n-grams of `order` bytes: the first one's place, the buckets, and
    the places (from there) of those that run over the end of a row."""
    crossing = np.unique((starts[1:-1, None] - np.arange(1, order)).ravel()) if len(starts) > 2 else np.zeros(0, np.int64)
    for at in range(0, max(0, len(data) - order + 1), piece):
        block = data[at : at + piece + order - 1]
        n = len(block) - order + 1
        code = block[:n].astype(np.uint32)
        for k in range(1, order):
            code |= block[k : k + n].astype(np.uint32) << np.uint32(8 * k)
        code *= np.uint32(0x9E3779B1)
        code >>= np.uint32(18)
        lo, hi = np.searchsorted(crossing, (at, at + n))
        yield at, code, crossing[lo:hi] - at


def _counts(data: np.ndarray, starts: np.ndarray, order: int, piece: int = PIECE) -> np.ndarray:
    """How often each bucket occurs in all rows."""
    total = np.zeros(BUCKETS[order], np.int64)
    for _, code, crossing in _blocks(data, starts, order, piece):
        total += np.bincount(code, minlength=len(total))
        total -= np.bincount(code[crossing], minlength=len(total))
    return total


def _sums(data: np.ndarray, starts: np.ndarray, order: int, values: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The sum of its n-grams' values for each row."""
    total = np.zeros(len(starts) - 1, np.int64)
    for at, code, crossing in _blocks(data, starts, order, piece):
        found = values[code]
        found[crossing] = 0
        ends = np.concatenate([[0], np.cumsum(found)])
        total += np.diff(ends[np.clip(starts - at, 0, len(found))])
    return total


def _words(data: np.ndarray, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about `piece` bytes; a word is never cut."""
    at = 0
    while at < len(data):
        end = at + piece
        while end < len(data):
            if (gap := _SPACE[data[end : end + 4096]]).any():
                end += int(gap.argmax())
                break
            end += 4096
        yield data[at:end].tobytes().split()
        at = end


def marks(data: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Counts of the 8 marks: does a word repeat the one before it, do the two before it."""
    total, last, before = np.zeros(8, np.int64), None, np.zeros(2, np.uint8)
    for words in _words(data, piece):
        if words:
            same = np.concatenate([before, np.fromiter(map(operator.eq, words, chain((last,), words)), np.uint8, len(words))])
            total += np.bincount(same[2:] | same[1:-1] << 1 | same[:-2] << 2, minlength=8)
            last, before = words[-1], same[-2:]
    return total


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task: raw text, and that of rows labelled good."""
    found = {f"{kind}{o}": np.zeros(BUCKETS[o], np.int64) for kind in ("raw", "good") for o in ORDERS}
    for batch in rows:
        good = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        data, starts = joined(batch.column(0))
        for o in ORDERS:
            if o:
                found[f"raw{o}"] += _counts(data, starts, o)
                for i in good:
                    found[f"good{o}"] += _counts(data[starts[i] : starts[i + 1]], np.zeros(0, np.int64), o)
            else:
                each = [marks(data[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
                found["raw0"] += sum(each, np.zeros(8, np.int64))
                found["good0"] += sum((each[i] for i in good), np.zeros(8, np.int64))
    yield from shared.vector_rows(found)


class Ratios:
    """Log ratio of target to raw for each bucket, as whole numbers of 1 / 65536."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.by_order = {}
        for o in ORDERS:
            raw, good = counts[f"raw{o}"] + SMOOTH, counts[f"good{o}"] + SMOOTH
            # a target model from few rows leans on the raw one
            good = good + raw * (0.02 * good.sum() / raw.sum())
            ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
            self.by_order[o] = np.rint(ratio * UNIT).astype(np.int64) if counts[f"good{o}"].any() else np.zeros(BUCKETS[o], np.int64)

    def weights(self, column: pa.Array, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
        """The log weight of each row, and its number of n-grams."""
        data, starts = joined(column)
        lengths = np.diff(starts)
        weight, grams = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        for o, ratio in self.by_order.items():
            if o:
                total, n = _sums(data, starts, o, ratio, piece), np.maximum(lengths - o + 1, 0)
            else:
                each = np.array([marks(data[a:b], piece) for a, b in zip(starts, starts[1:], strict=False)], np.int64).reshape(-1, 8)
                total, n = each @ ratio, each.sum(axis=1)
            weight += total * TEMPERED // np.maximum(n, 1)
            grams += n
        return weight, grams


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Ratios, float]:
    """The models, and the share of labelled rows that are good. labels: doc_id, quality (1 is good)."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
    few = [(int(r["doc_id"]), int(r["label"])) for r in shared.bounded_rows(known, "doc_id", sample).collect()]
    good = sum(q == 1 for _, q in few)
    if not 0 < good < len(few):
        return Ratios({f"{k}{o}": np.zeros(BUCKETS[o], np.int64) for k in ("raw", "good") for o in ORDERS}), 1.0
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.empty_if_null().cast("binary").alias("text"))
    marked = marked.join(F.broadcast(spark.createDataFrame(few, "doc_id long, label int")), "doc_id", "left")
    marked = marked.select("text", (F.coalesce("label", F.lit(0)) == 1).alias("good"))
    counts = shared.sum_vectors(marked.mapInArrow(shared.lean(_count), shared.VECTORS), {f"{k}{o}": BUCKETS[o] for k in ("raw", "good") for o in ORDERS})
    return Ratios(counts), good / len(few)


class Names:
    """Names of added columns that no column of the input has."""

    def __init__(self, docs: DataFrame) -> None:
        tag = "" if not any(c.lower().startswith("_q_") for c in docs.columns) else uuid.uuid4().hex[:12]
        self.weight, self.grams, self.key = (f"_q_{tag}{c}" for c in ("weight", "grams", "key"))


def weigh(docs: DataFrame, ratios: Ratios, seed: int = 0, names: Names | None = None) -> DataFrame:
    """docs with log weight, number of n-grams and the noisy key."""
    names = names or Names(docs)
    at = docs.columns.index("text")
    extra = T.StructType([*docs.schema.fields, T.StructField(names.weight, T.LongType()), T.StructField(names.grams, T.LongType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            weight, n = ratios.weights(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight), pa.array(n)], names=[*batch.schema.names, names.weight, names.grams])

    shared.bound_batches(docs.sparkSession)
    return docs.mapInArrow(shared.lean(run), extra).withColumn(names.key, F.col(names.weight) + noise(seed))


def noise(seed: int) -> Column:
    """Gumbel noise of an id under a seed, in units of 1 / 65536."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(2**52)) + 0.5) / float(2**52)
    return F.floor(-F.log(-F.log(u)) * UNIT)


def top_k(weighed: DataFrame, names: Names, k: int | None, share: float) -> Column:
    """The condition under which a row of a table made by weigh() is among the k largest keys."""
    key, doc = F.col(names.key), F.col("doc_id").cast("long")
    ranked, total = shared.running_totals(weighed.select((-key).alias("down"), doc.alias("doc_id"), F.lit(1).cast("long").alias("one")), ["down", "doc_id"], "one", "ranked")
    k = round(share * total) if k is None else k
    if k >= total:
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    at = ranked.filter(F.col("_before") == k - 1).select("down", "doc_id").first()
    tie = doc.isNull() if at["doc_id"] is None else F.coalesce(doc <= at["doc_id"], F.lit(True))
    return (-key < at["down"]) | ((-key == at["down"]) & tie)


def draw(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0, sample: int = SAMPLE) -> tuple[DataFrame, Names]:
    """The documents that are drawn, with log weight, number of n-grams and key."""
    ratios, share = fit(docs, labels, sample)
    names = Names(docs)
    weighed = shared.materialize(weigh(docs, ratios, seed, names), "weighed")
    return weighed.filter(top_k(weighed, names, k, share)), names


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """The documents that are drawn, with the columns of docs."""
    frame, back = shared.set_aside(docs, ["doc_id", "text"])
    return back(draw(frame, labels, k, seed)[0])


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are drawn, with their weights."""
    docs, labels = shared.table(spark, sf_dir, "documents").select("doc_id", "text"), shared.table(spark, sf_dir, "labels")
    ratios, share = fit(docs, labels)
    names = Names(docs)
    scores = shared.materialize(weigh(docs, ratios, names=names).drop("text"), "scores")
    return scores.filter(top_k(scores, names, None, share)).select("doc_id", F.col(names.grams).alias("n_grams"), (F.col(names.weight) / UNIT).alias("log_weight"), (F.col(names.key) / UNIT).alias("noisy_weight"))
