"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are read in windows of STEPS bytes, all windows of a batch in step with each other. Each
direction is a gated recurrent unit over bytes; at every position both states together give the
probabilities of the languages, and a document's are the means over all its positions. The network is
trained in numpy, by backpropagation through time with Adam, on windows from at most PER_LANGUAGE
documents of each language: a bound on labelled rows, not on the texts that are labelled.

Language, source and id are never inputs of a prediction. `und` and score 0 are given to a text that
is null or has no letter, and to every text if nothing could be learnt. Repeated rows each have
their row, equal texts equal results. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from petroloom.llm import shared

HIDDEN = 8
STEPS = 96
TOGETHER = 2048  # windows in step
PER_LANGUAGE = 250  # documents of each language that are trained on, at most
WINDOWS = 6  # of each
EPOCHS, BATCH, RATE = 10, 128, 0.02
UNKNOWN = "und"


def windows(texts: list[bytes], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """[steps, windows] bytes of all texts, the last window of each filled up with 0; and the
    number of windows of each text."""
    counts = np.array([-(-len(t) // steps) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(t.ljust(int(n) * steps, b"\0") for t, n in zip(texts, counts, strict=True)), np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, steps).T), counts


class Network:
    """Weights by name; f and b for the directions. Gates are r, z and the candidate, HIDDEN rows each."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        n, self.labels, self.hidden = len(labels), labels, hidden
        self.w = {"out": rng.normal(0, 0.3, (n, 2 * hidden)), "bias": np.zeros((n, 1))}
        for d in "fb":
            self.w[f"in_{d}"] = rng.normal(0, 0.3, (3 * hidden, 256))
            self.w[f"rec_{d}"] = rng.normal(0, 0.3, (3 * hidden, hidden))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def states(self, x: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """The states of one direction at every step, [steps, hidden, windows]."""
        h_n, table, rec = self.hidden, self.w[f"in_{d}"], self.w[f"rec_{d}"]
        steps, n = x.shape
        out = np.empty((steps, h_n, n), np.float32)
        h = np.zeros((h_n, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = np.take(table, x[t], axis=1)
            g = rec @ h
            gates = a[: 2 * h_n]
            gates += g[: 2 * h_n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            r, z, c = gates[:h_n], gates[h_n:], a[2 * h_n :]
            c += r * g[2 * h_n :]
            np.tanh(c, out=c)
            before = h
            h = out[t]
            np.subtract(before, c, out=h)
            h *= z
            h += c
            if tape is not None:
                tape.append((t, before, r, z, c, g[2 * h_n :]))
        return out

    def probabilities(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """[steps, labels, windows]"""
        half = self.hidden
        p = np.matmul(self.w["out"][:, :half], f)
        p += np.matmul(self.w["out"][:, half:], b)
        p += self.w["bias"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over real positions, and its gradients."""
        tapes: dict[str, list] = {"f": [], "b": []}
        f, b = self.states(x, "f", tapes["f"]), self.states(x, "b", tapes["b"])
        p, real, half = self.probabilities(f, b), (x > 0).astype(np.float32)[:, None, :], self.hidden
        right = np.take_along_axis(p, np.broadcast_to(y[None, None], (len(x), 1, len(y))), axis=1)
        total = max(1.0, float(real.sum()))
        loss = float(-(np.log(right + 1e-9) * real).sum() / total)
        error = p.copy()
        np.put_along_axis(error, np.broadcast_to(y[None, None], (len(x), 1, len(y))), right - 1, axis=1)
        error *= real / total
        out = {"out": np.concatenate([np.einsum("tln,thn->lh", error, s) for s in (f, b)], axis=1), "bias": error.sum(axis=(0, 2))[:, None]}
        for d, part in (("f", self.w["out"][:, :half]), ("b", self.w["out"][:, half:])):
            rec = self.w[f"rec_{d}"]
            into, recurrent, carried = np.zeros_like(self.w[f"in_{d}"]), np.zeros_like(rec), np.zeros((half, x.shape[1]), np.float32)
            for t, before, r, z, c, g in reversed(tapes[d]):
                dh = part.T @ error[t] + carried
                dz = dh * (before - c) * z * (1 - z)
                dc = dh * (1 - z) * (1 - c * c)
                dr = dc * g * r * (1 - r)
                da = np.concatenate([dr, dz, dc])
                dg = np.concatenate([dr, dz, dc * r])
                carried = dh * z + rec.T @ dg
                recurrent += dg @ before.T
                np.add.at(into.T, x[t], da.T)
            out[f"in_{d}"], out[f"rec_{d}"] = into, recurrent
        return loss, out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> float:
        """x: [steps, windows]; y: the label of each window. Returns the last epoch's loss."""
        rng, step, last = np.random.default_rng(seed), 0, 0.0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        batches = max(1, -(-x.shape[1] // BATCH))
        for _ in range(epochs):
            losses = []
            for some in np.array_split(rng.permutation(x.shape[1]), batches):
                loss, grads = self.gradients(np.ascontiguousarray(x[:, some]), y[some])
                losses.append(loss)
                step += 1
                rate = RATE * (1 - step / (epochs * batches + 1))
                norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads.values()))))
                for k, g in grads.items():
                    g = g / norm
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            last = float(np.mean(losses))
        return last

    def label(self, texts: list[bytes]) -> np.ndarray:
        """[texts, labels]: the mean probabilities over all positions; 0 for an empty text."""
        x, counts = windows(texts)
        sums = np.zeros((x.shape[1], len(self.labels)))
        for i in range(0, x.shape[1], TOGETHER):
            part = np.ascontiguousarray(x[:, i : i + TOGETHER])
            p = self.probabilities(self.states(part, "f"), self.states(part, "b"))
            if not part[-1].all():
                p *= (part > 0)[:, None, :]
            sums[i : i + TOGETHER] = p.sum(axis=0, dtype=np.float64).T
        ends = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([np.zeros((1, len(self.labels))), np.cumsum(sums, axis=0)])
        found = total[ends[1:]] - total[ends[:-1]]
        return found / np.maximum(found.sum(axis=1, keepdims=True), 1e-12)


def _bytes(text: bytes) -> bytes:
    """What the network reads: zero bytes are kept for filling."""
    return text.lower().replace(b"\0", b" ")


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 0) -> DataFrame:
    """At most `per_language` ids of each language, by a seeded hash: doc_id, lang."""
    spark = docs.sparkSession
    known = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    known = known.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    counts = known.groupBy("lang").agg(F.count("*").alias("_n"))  # a row for each language
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**52)) / float(2**52)
    near = known.join(F.broadcast(counts), "lang").withColumn("_u", u).filter(F.col("_u") * F.col("_n") < 1.5 * per_language + 50).collect()  # about that many of each
    by: dict[str, list] = {}
    for r in sorted(near, key=lambda r: (r["_u"], r["doc_id"])):
        if len(by.setdefault(r["lang"], [])) < per_language:
            by[r["lang"]].append(r["doc_id"])
    rows = {d: lang for lang in sorted(by) for d in by[lang]}
    return spark.createDataFrame(list(rows.items()), "doc_id long, lang string")


def _windows_of(count: int, steps: int) -> shared.Mapper:
    """Some windows of each text, from all over it, chosen by a hash of the text."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in rows:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = _bytes(text.as_py())
                n = -(-len(data) // steps)
                mixed = xxhash.xxh64_digest(data)
                for k in range(min(count, n)):
                    i = xxhash.xxh64_intdigest(mixed, seed=k) % n if n > count else k
                    out.append((lang, data[i * steps : (i + 1) * steps].ljust(steps, b"\0")))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary())], names=["lang", "bytes"])

    return run


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 0) -> Network | None:
    """A network trained on documents with a language; None if there are none."""
    chosen = sample(docs, per_language, seed)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.empty_if_null().cast("binary").alias("text"))
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # of rows with one id, the least text
    rows = once.select("lang", "text").mapInArrow(shared.lean(_windows_of(WINDOWS, STEPS)), "lang string, bytes binary").collect()  # bounded by languages x per_language x WINDOWS
    rows = sorted((r["lang"], bytes(r["bytes"])) for r in rows)
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    x = np.ascontiguousarray(np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(-1, STEPS).T)
    net = Network(labels, seed=seed)
    net.train(x, np.array([labels.index(lang) for lang, _ in rows]), seed=seed)
    return net


def _label(net: Network | None) -> shared.Mapper:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for some in shared.batches(batch, "text", 1 << 21):
                texts = some.column(1).to_pylist()
                real = [any(c.isalpha() for c in t) for t in texts]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if net and any(real):
                    at = [i for i, r in enumerate(real) if r]
                    p = net.label([_bytes(texts[i].encode()) for i in at])
                    for i, best, value in zip(at, p.argmax(axis=1), p.max(axis=1), strict=True):
                        names[i], scores[i] = net.labels[best], round(min(1.0, float(value)), 4)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs (doc_id, text): doc_id, lang_pred, score."""
    shared.bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.empty_if_null().alias("text")).mapInArrow(shared.lean(_label(net)), "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from three of four folds of ids."""
    docs = shared.table(spark, sf_dir, "documents")
    net = fit(docs.filter(shared.fold("doc_id", 4) != 2))
    return identify(docs, net).select("doc_id", (shared.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
