"""Toxicity of deobfuscated text.

A noisy channel may have written letters as look-alikes, repeated them or set them apart. For a word
that shows any of this a lattice is built, of the letters that each run of characters may stand for,
and the Viterbi path under a character trigram model of the whole corpus is the restored word; any
other word's lattice has one path, the word itself. A doubled letter may stay, at no cost, or stand
for one. What lies between letters that are set apart may be skipped or end a word. Restored words are then scored: features (the
word and its beginnings) that occur far more often in labelled toxic documents carry weights, and
a logistic function of a document's sum over distinct words, fitted on the same rows, gives the score.

The trigram model counts all documents. Labels come from at most SAMPLE ids, of the training
fold only, and of rows with one id the least text is read; ids, languages and sources are never looked at for a score. Nulls: a null or empty text has
no evidence and the score that goes with none. Equal texts have equal scores, repeated rows each have a row.
Without labels of both classes the score is the toxic share of the sample, or 0. An empty table
gives no rows. Other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from petroloom.llm import shared

SAMPLE = 12_000  # labelled rows that weights are fitted on, at most
LEAST_DOCS, LEAST_RATIO = 4, 3.0  # a feature counts from so many toxic documents, and this log ratio, on
UNIT = 1024
PREDICT = 0.7

# Letters for which a character may stand.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "l", "+": "t", "(": "c", "€": "e", "£": "l"}

#: Symbols of the character model: 0 for what is no letter, 1 to 26 for a to z, 27 for a byte of any other letter.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27
_SYMBOLS_OF = bytes(_SYMBOL.tolist())
SYMBOLS = 28
_CELLS = SYMBOLS**3

_PART = rf"\w{re.escape(''.join(c for c in LOOKALIKES if not c.isalnum()))}"  # what may be a letter, once _ is replaced
_SPACED = re.compile(rf"(?<![{_PART}])[{_PART}](?:[^{_PART}]+[{_PART}]){{2,}}(?![{_PART}])")
_ODD = re.compile(r"[0-9@$!|+(€£]|([^\W\d_])\1|(.)\2\2|[^\W_][.\-_*·]+[^\W_]")
_EDGES = ".,;:!?\"'()[]{}<>«»“”‘’*#%&|~`^=-_/\\"


def _trigrams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task's character trigrams; two blanks stand before every text and after the last."""
    from petroloom.llm.quality import PIECE, joined

    counts = np.zeros(_CELLS, np.int64)
    for batch in rows:
        data, starts = joined(batch.column(0))
        s = np.append(np.insert(_SYMBOL[data], np.repeat(starts[:-1], 2), 0), np.zeros(2, np.uint8))
        for at in range(0, len(s) - 2, PIECE):
            x = s[at : at + PIECE + 2].astype(np.int32)
            counts += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=_CELLS)
    yield from shared.vector_rows({"trigrams": counts})


class Decoder:
    """Restores words. cost[p, q, c]: the negative log probability of symbol c after p and q."""

    def __init__(self, counts: np.ndarray) -> None:
        cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.0
        pair = cube.sum(axis=0)
        backed = (pair + 0.1) / (pair + 0.1).sum(axis=1, keepdims=True)
        seen = cube + 5.0 * backed[None]
        self.cost = (-np.log(seen / seen.sum(axis=2, keepdims=True))).tolist()
        self.known: dict[str, str] = {}

    @staticmethod
    def lattice(word: str) -> list[list[tuple[str, float]]]:
        """For each run of one character, what it may stand for and what that costs."""
        out, i = [], 0
        while i < len(word):
            c, j = word[i], i
            while j < len(word) and word[j] == c:
                j += 1
            run, i = j - i, j
            if c.isalpha():
                out.append([(c, 0.0)] if run == 1 else [(c * 2, 0.0), (c, 1.0)] if run == 2 else [(c, 0.5), (c * 2, 0.8)])
            elif c in LOOKALIKES:
                out.append([(x * k, 1.0 + (k - 1) * 0.5) for x in LOOKALIKES[c] for k in ((1,) if run == 1 else (1, 2))])
                if c in "!|+(":
                    out[-1].append(("", 2.0))
            elif c in "'-" and run == 1:
                out.append([("", 0.5)])
            else:
                # a separator is skipped or ends a word; several blanks do the one as easily as the other
                while i < len(word) and not (word[i].isalnum() or word[i] in LOOKALIKES):
                    i, run = i + 1, run + 1
                out.append([("", 0.5), (" ", 1.5 if run == 1 else 0.5)])
        return out

    def decode(self, word: str) -> str:
        """The cheapest path through a word's lattice."""
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in self.lattice(word):
            now: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (p, q), (cost, path) in states.items():
                for text, channel in options:
                    a, b, c = p, q, cost + channel
                    for s in text.encode().translate(_SYMBOLS_OF):
                        c += self.cost[a][b][s]
                        a, b = b, s
                    if (a, b) not in now or c < now[a, b][0]:
                        now[a, b] = (c, (path, text))
            states = now
        path = min(((c + self.cost[p][q][0], t) for (p, q), (c, t) in states.items()), key=lambda x: x[0])[1]
        parts = []
        while path:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts))

    def restore(self, chunk: str) -> str:
        """A lower-case chunk between white space as a word: clean ones lose outer punctuation only."""
        word = chunk.strip(_EDGES)
        if word.isalpha() and not _ODD.search(word):
            return word
        inner = chunk.strip(_EDGES.translate({ord(c): None for c in LOOKALIKES}))
        if not any(c.isalpha() for c in inner) or not _ODD.search(inner):
            return word
        if (found := self.known.get(inner)) is None:
            # punctuation at the end may be a letter or not: the cheaper reading by symbol wins
            found = min({self.decode(x): 0 for x in dict.fromkeys((inner, word))}, key=self._mean)
            if len(inner) <= 64:  # longer ones are not kept
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[inner] = found
        return found

    def _mean(self, word: str) -> float:
        s = [0, 0, *word.encode().translate(_SYMBOLS_OF), 0]
        return sum(self.cost[a][b][c] for a, b, c in zip(s, s[1:], s[2:], strict=False)) / len(s)


def features(word: str) -> list[int]:
    """Hashes of a word and its beginnings, each with its length or the mark of a whole word."""
    return [xxhash.xxh64_intdigest(f"{k}:{word[:k]}") >> 1 for k in (4, 5, 6) if len(word) >= k] + [xxhash.xxh64_intdigest(f"w:{word}") >> 1]


class Words(dict):
    """Value of each chunk of lower-case text, by the restored word, as made by `of`."""

    def __init__(self, decoder: Decoder, of, most: int = 200_000) -> None:
        super().__init__()
        self.decoder, self.of, self.most = decoder, of, most

    def __missing__(self, chunk: str):
        value = self.of(self.decoder.restore(chunk))
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = value
        return value

    def values_of(self, text: bytes) -> list:
        """One value for each distinct chunk and each run of letters and look-alikes set apart by anything else."""
        chunks = text.decode("utf-8", "replace").lower()
        out = list(map(self.__getitem__, set(chunks.split())))
        for run in {m[0] for m in _SPACED.finditer(chunks.replace("_", "-"))}:
            out += [self.of(w) for w in set(self.decoder.decode(run).split()) if len(w) > 2]
        return out


def _evidence(decoder: Decoder, weights: dict[int, int]) -> shared.Mapper:
    """Replaces column 1, the text, by a document's evidence."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(decoder, lambda w: max((weights.get(f, 0) for f in features(w)), default=0))
        for batch in rows:
            total = [sum(words.values_of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], names=["doc_id", "evidence"])

    return run


def _counted(decoder: Decoder) -> shared.Mapper:
    """(feature, toxic, docs) of one task's labelled documents."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(decoder, features, 100_000), {0: Counter(), 1: Counter()}
        for batch in rows:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[toxic].update({f for some in words.values_of(text.as_py()) for f in some})
                for k, c in counts.items():
                    if len(c) > 400_000:
                        yield _rows(k, c)
                        c.clear()
        for k, c in counts.items():
            if c:
                yield _rows(k, c)

    return run


def _rows(toxic: int, c: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()), pa.array(np.full(len(c), toxic, np.int32)), pa.array(list(c.values()), pa.int64())], names=["feature", "toxic", "docs"])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit, lightly held to small slopes, by Newton's method."""
    w, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + np.array([1e-2, 1e-4]) * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text) with scores in 0 to 1, by labels (doc_id, toxic): doc_id, evidence, score."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.empty_if_null().cast("binary").alias("text"))
    counts = shared.sum_vectors(texts.select("text").mapInArrow(shared.lean(_trigrams), shared.VECTORS), {"trigrams": _CELLS})["trigrams"]
    decoder = Decoder(counts)
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = spark.createDataFrame([tuple(r) for r in shared.bounded_rows(known, "doc_id", sample).collect()], "doc_id long, toxic int")
    once = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    marked = shared.materialize(once.select("toxic", "text"), "labelled")
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    weights: dict[int, int] = {}
    slope, intercept = 0.0, math.log((toxic + 1e-9) / (clean + 1e-9)) if toxic + clean else -30.0
    if clean and toxic:
        by = marked.mapInArrow(shared.lean(_counted(decoder)), "feature long, toxic int, docs long").groupBy("feature").agg(F.sum(F.col("docs") * F.col("toxic")).alias("t"), F.sum(F.col("docs") * (1 - F.col("toxic"))).alias("c"))
        ratio = F.log((F.col("t") + 0.1) / toxic) - F.log((F.col("c") + 0.5) / clean)
        told = by.withColumn("ratio", ratio).filter((F.col("t") >= LEAST_DOCS) & (F.col("ratio") >= LEAST_RATIO))
        weights = {r["feature"]: int(r["ratio"] * UNIT) for r in told.collect()}
        fitted = marked.select(F.col("toxic").cast("long").alias("doc_id"), "text").mapInArrow(shared.lean(_evidence(decoder, weights)), "doc_id long, evidence long").collect()  # a row for each of the sample
        slope, intercept = logistic(np.array([r["evidence"] / UNIT for r in fitted]), np.array([r["doc_id"] for r in fitted], float))
    found = texts.mapInArrow(shared.lean(_evidence(decoder, weights)), "doc_id long, evidence long")
    return found.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") / UNIT * slope + intercept))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from two of three folds of the labelled ids."""
    labels = shared.table(spark, sf_dir, "labels").filter(shared.fold("doc_id", 3) != 1)
    return score(shared.table(spark, sf_dir, "documents"), labels).select("doc_id", (shared.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "evidence")
