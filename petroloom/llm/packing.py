"""Best-fit packing by exact-complement hashing.

Lengths, not documents, are what a plan is made of: a histogram has at most one entry for
each length up to the capacity, so it is small at any corpus size. An index of the sums of
single lengths, pairs and triples is kept under availability counts; from the longest length
down, a combination that fills the gap exactly is consumed as many times as its scarcest
length allows. What no combination completes goes to its best fit, the open sequence with the
least room that takes it. Pieces are then matched to the plan by their rank among all
pieces in order of length.

Nulls: a null text is an empty one (its end token alone makes a piece). Repeated rows, ties
and null ids are packed as any other row. An empty table gives no rows. Other columns of the
input play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from petroloom.llm import shared

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"

# The pieces that the tokenizer file's own rule makes of lower-case text.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+"
#: Characters for which that rule needs no Unicode tables and lower-casing maps one to one.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ſ]+")


def _byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes stand for
    themselves, the others follow from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Words(dict):
    """Ids of white-space separated chunks, as little-endian bytes. Chunks are composed from
    their pieces, and only pieces not met before reach the tokenizer's model. Either table starts
    anew when full, so a worker's memory is bounded; pieces still asked for move over from the table
    before, chunks are composed again."""

    def __init__(self, path: str, chunks: int = 250_000, pieces: int = 450_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.chunks, self.pieces = Tokenizer.from_file(path), chunks, pieces
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.seen: dict[str, bytes] = {}
        self.old_seen: dict[str, bytes] = {}
        self.split = re.compile(_PIECE).findall

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.old_seen.get(piece)
        if ids is None:
            word = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        if len(self.seen) >= self.pieces:
            self.old_seen, self.seen = self.seen, {}
        self.seen[piece] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 48 or "<|" in chunk or not _PLAIN.fullmatch(chunk):
            return self._encode(chunk)
        seen, lower = self.seen, chunk.lower()
        if lower.isalpha():
            ids = seen.get(lower) or self._piece(lower)
        else:
            ids = b"".join([seen.get(x) or self._piece(x) for x in self.split(lower)])
        if len(self) >= self.chunks:
            self.clear()
        self[chunk] = ids
        return ids

    def ids(self, text: str) -> Iterator[bytes]:
        """The ids of a whole text, in parts that end at white space."""
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # white space to Python alone
        at, step = 0, 1 << 20
        while at < len(text):
            end = at + step
            if end < len(text):
                gap = re.compile(r"[ \n\t\r]").search(text, end)
                end = gap.start() if gap else len(text)
            part, at = text[at:end], end
            yield b"".join(map(self.__getitem__, [w for w in re.split(r"[ \n\t\r]+", part) if w] if odd else part.split()))


def _pieces(path: str, capacity: int, end_id: int) -> shared.Mapper:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, step, last = _Words(path), 4 * capacity, end_id.to_bytes(4, "little")
        for batch in rows:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, piece = bytearray(), 0
                for part in words.ids(text.as_py() or ""):
                    held += part
                    while len(held) > step:  # a piece that is exactly full may be the last
                        out.append((doc_id, piece, piece * capacity, capacity, zlib.crc32(held[:step])))
                        del held[:step]
                        piece += 1
                held += last
                while held:
                    now = bytes(held[:step])
                    out.append((doc_id, piece, piece * capacity, len(now) // 4, zlib.crc32(now)))
                    del held[:step]
                    piece += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class _Index:
    """Which lengths, and which sums of two, are available. `ways[s]` counts the pairs of
    available lengths that add up to s; a triple is a length and a pair."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.astype(np.int64).copy()
        self.capacity = len(counts) - 1
        here = (self.n > 0).astype(np.int64)
        ordered = np.convolve(here, here)[: self.capacity + 1]
        twins = np.zeros(self.capacity + 1, np.int64)
        twins[::2] = here[: self.capacity // 2 + 1]
        able = np.zeros(self.capacity + 1, np.int64)
        able[::2] = self.n[: self.capacity // 2 + 1] >= 2
        self.ways = (ordered - twins) // 2 + able

    def take(self, lengths: Counter, times: int) -> None:
        for length, k in lengths.items():
            before = self.n[length]
            after = before - k * times
            twice = 2 * length
            if twice <= self.capacity and before >= 2 > after:
                self.ways[twice] -= 1
            self.n[length] = after
            if before > 0 and after == 0:
                others = np.flatnonzero(self.n[: max(0, self.capacity - length) + 1] > 0)
                others = others[others != length]
                self.ways[length + others] -= 1

    def _single(self, gap: int, used: Counter) -> tuple | None:
        return (gap,) if 0 < gap and self.n[gap] > used[gap] else None

    def _pair(self, gap: int, used: Counter) -> tuple | None:
        if gap < 2 or not self.ways[gap]:
            return None
        high = np.arange((gap + 1) // 2, gap)
        for a in high[(self.n[high] > 0) & (self.n[gap - high] > 0)][::-1]:
            want = used + Counter((int(a), int(gap - a)))
            if all(self.n[x] >= k for x, k in want.items()):
                return int(a), int(gap - a)
        return None

    def _triple(self, gap: int, used: Counter) -> tuple | None:
        if gap < 3:
            return None
        first = np.arange((gap + 2) // 3, gap - 1)
        for a in first[(self.n[first] > 0) & (self.ways[gap - first] > 0)][::-1]:
            with_a = used + Counter((int(a),))
            if self.n[a] >= with_a[int(a)] and (rest := self._pair(gap - int(a), with_a)):
                return int(a), *rest
        return None

    def complement(self, length: int) -> tuple | None:
        """Lengths that fill exactly what one of `length` leaves: one, else two, else three."""
        gap, used = self.capacity - length, Counter((length,))
        return self._single(gap, used) or self._pair(gap, used) or self._triple(gap, used)


def plan(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """counts[n]: pieces of length n, up to the capacity. Returns (times, [(length, run)]): so
    many sequences that hold `run` pieces of each length in turn. Each step uses up a length or a
    group of open sequences, so the plan's size depends on the capacity and not on the corpus."""
    capacity, out = len(counts) - 1, []
    index = _Index(counts)
    if full := int(index.n[capacity]):
        out.append((full, [(capacity, 1)]))
        index.n[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while index.n[length] > 0 and (rest := index.complement(length)):
            want = Counter((length, *rest))
            times = int(min(index.n[x] // k for x, k in want.items()))
            index.take(want, times)
            out.append((times, list(want.items())))
    open_by_gap: list[list] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)

    def put(times: int, held: list, gap: int) -> None:
        if times:
            open_by_gap[gap].append((times, held))
            some[gap] = True

    for length in range(capacity - 1, 0, -1):
        n = int(index.n[length])
        while n:
            at = np.flatnonzero(some[length:])
            gap = length + int(at[0]) if len(at) else capacity
            times, held = open_by_gap[gap].pop() if len(at) else (n, [])
            if len(at):
                some[gap] = bool(open_by_gap[gap])
            run = gap // length
            whole = min(times, n // run)
            put(whole, [*held, (length, run)], gap - run * length)
            n -= whole * run
            if n < run and n and (whole < times):
                put(1, [*held, (length, n)], gap - n * length)
                whole, n = whole + 1, 0
            if len(at):
                put(times - whole, held, gap)
    return out + [x for group in open_by_gap for x in group]


def places(made: list, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The plan by rank: pieces sorted by length, from `key` on, go to `sequence` and onwards,
    `run` to each, from `offset` on."""
    firsts = np.concatenate([[0], np.cumsum(counts)])
    used, rows, sequence = np.zeros(len(counts), np.int64), [], 0
    for times, held in made:
        offset = 0
        for length, run in held:
            rows.append((firsts[length] + used[length], sequence, offset, run))
            used[length] += times * run
            offset += length * run
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {k: table[:, i].copy() for i, k in enumerate(("key", "sequence", "offset", "run"))}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most `capacity` tokens: a row for each
    piece of a document. Only documents that are longer than a sequence are cut."""
    spark = docs.sparkSession
    shared.bound_batches(spark)
    pieces = shared.materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(shared.lean(_pieces(tokenizer_path, capacity, end_id)), PIECES), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # a row for each length
        counts[r["length"]] = r["count"]
    at = places(plan(counts), counts)
    ranked, _ = shared.running_totals(pieces.withColumn("_one", F.lit(1).cast("long")), ["length", "doc_id", "piece", "ids_crc32"], "_one", "pieces")

    def place(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            rank, length = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("_before", "length"))
            i = np.searchsorted(at["key"], rank, "right") - 1
            over = rank - at["key"][i]
            found = (at["sequence"][i] + over // at["run"][i], at["offset"][i] + over % at["run"][i] * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, found)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_before").mapInArrow(shared.lean(place), PACKED)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
