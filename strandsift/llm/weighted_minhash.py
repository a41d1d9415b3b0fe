"""Document fingerprints by consistent weighted sampling.

A text is a set of words, each weighted by how often it occurs and by its
length (short words say little). For sample k and word w, three numbers are
drawn that depend on (k, w) only: r and c from Gamma(2, 1), b from U(0, 1).
With weight S: t = floor(ln S / r + b), ln a = ln c - r (t - b + 1). The
word with the least a is the sample, together with its t. Two texts agree in
a sample with probability sum(min(S, S')) / sum(max(S, S')), the generalised
Jaccard similarity of their weights; a fingerprint keeps 16 bits a sample.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import shuffle_parts, sliced, texts, tuned

SAMPLES = 128
#: A word's weight is count * min(length, LONG) ** POWER.
POWER, LONG = 2.0, 12
#: Words whose draws a worker keeps.
_HELD = 60_000
#: Words or pairs whose draws are computed at a time: what fits a core's cache.
_STEP = 512

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Sampler:
    """Fingerprints texts; keeps the draws of the words that it has met lately."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        k = np.arange(samples, dtype=np.uint64)
        self.salts = _mixed(k * _U(0x9E3779B97F4A7C15) + _U(1))
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        n = _HELD
        self.hashes = np.zeros(n, np.uint64)
        self.sizes = np.zeros(n, np.float32)
        self.r, self.b, self.c = (np.zeros((n, self.samples), np.float32) for _ in range(3))

    def _learn(self, words: list[str]) -> None:
        a, z = len(self.index), len(self.index) + len(words)
        while z > len(self.hashes):  # one batch of texts may hold more words than are kept between batches
            for name in ("hashes", "sizes", "r", "b", "c"):
                v = getattr(self, name)
                setattr(self, name, np.concatenate([v, np.zeros_like(v)]))
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        x = _mixed(h[:, None] ^ self.salts[None, :])
        y = x * _U(0xD6E8FEB86659FD93)
        u = lambda v, at: (v >> _U(at) & _U(0x1FFFFF)).astype(np.int32).astype(np.float32) * np.float32(2**-21) + np.float32(2**-22)
        self.r[a:z] = -np.log(u(x, 43) * u(x, 22))
        self.c[a:z] = np.log(-np.log(u(x, 1) * u(y, 43)))
        self.b[a:z] = u(y, 22)
        self.hashes[a:z] = h
        self.sizes[a:z] = np.log(np.minimum(np.fromiter(map(len, words), np.float32, len(words)), LONG)) * np.float32(POWER)
        self.index.update(zip(words, range(a, z)))

    def codes(self, batch: list[str]) -> np.ndarray:
        """[texts, samples] of uint16. A text without words has the code 0 throughout; others never hold 0."""
        bags = [Counter(t.lower().split()) for t in batch]
        out = np.zeros((len(batch), self.samples), np.uint16)
        if len(self.index) > _HELD * 3 // 4:
            self._clear()
        at = 0
        while at < len(bags):  # as many texts at once as fill some ten thousand pairs
            end, n = at, 0
            while end < len(bags) and (end == at or n < 20_000):
                n += len(bags[end])
                end += 1
            self._some(bags[at:end], out[at:end])
            at = end
        return out

    def _some(self, bags: list[Counter], out: np.ndarray) -> None:
        words = set().union(*bags)
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > _HELD and self.index:
            self._clear()
            new = list(words)
        for i in range(0, len(new), _STEP):
            self._learn(new[i : i + _STEP])
        sizes = [len(b) for b in bags]
        n = sum(sizes)
        if not n:
            return
        term = np.fromiter(map(self.index.__getitem__, chain.from_iterable(bags)), np.int64, n)
        count = np.fromiter(chain.from_iterable(b.values() for b in bags), np.int64, n)
        pairs, where = np.unique(term << 32 | count, return_inverse=True)
        at = 0
        values, steps = self._pairs(pairs)
        owner = self.hashes[pairs >> 32]
        for i, size in enumerate(sizes):
            if size:
                rows = where[at : at + size]
                best = rows[values[rows].argmin(0)]
                k = np.arange(self.samples)
                t = steps[best, k].astype(np.int64).view(np.uint64)
                code = _mixed(owner[best] ^ _mixed(t + _U(0x632BE59BD9B4E019)) ^ self.salts)
                out[i] = np.maximum(code >> _U(48), _U(1)).astype(np.uint16)
                at += size

    def _pairs(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ln a and t of each (word, count) for each sample."""
        values = np.empty((len(pairs), self.samples), np.float32)
        steps = np.empty_like(values)
        for i in range(0, len(pairs), _STEP):
            some = pairs[i : i + _STEP]
            term = some >> 32
            size = (np.log(some & 0xFFFFFFFF).astype(np.float32) + self.sizes[term])[:, None]
            r, b = self.r[term], self.b[term]
            t = np.floor(size / r + b)
            steps[i : i + _STEP] = t
            values[i : i + _STEP] = self.c[term] - r * (t - b + np.float32(1))
        return values, steps


@cache
def _sampler() -> Sampler:
    """One a worker process: the draws that it keeps serve its later tasks too."""
    return Sampler()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples: an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(-1)


def text_of(codes: np.ndarray) -> str:
    """A fingerprint as hexadecimal text, four digits a sample."""
    return codes.astype(">u2").tobytes().hex()


def edited(text: str, after: str) -> str:
    """``text`` whose last quarter (rounded down) gives way to as many first code points of ``after``."""
    q = len(text) // 4
    return text[: len(text) - q] + after[:q]


def with_next(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, int]:
    """((bucket, peek, doc_id, text), buckets): ranges of ascending doc_id, each followed by the next range's first row (peek = 1).

    Range bounds are ids that occur, so the row that a range needs from the
    next one is known beforehand: one shuffle of the texts gives every row
    its successor, and the last range gets the first row of all.
    """
    spark = docs.sparkSession
    n = buckets or 2 * shuffle_parts(spark)
    probs = [i / n for i in range(1, n)]
    got = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", probs or [0.5], F.lit(20 * n)).alias("q")).first()
    bounds = sorted({got["least"], *(got["q"] or [])} - {None})
    n = max(1, len(bounds))
    # two short searches rather than a long one: the chunk of bounds, then the bound in it
    step = max(1, math.isqrt(n))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[0]]
    coarse = F.from_json(F.lit(json.dumps([c[0] for c in chunks])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(chunks)), "array<array<bigint>>")
    upto = lambda a: F.size(F.filter(a, lambda e: e <= F.col("doc_id")))
    rows = docs.select("doc_id", "text", upto(coarse).alias("chunk"))
    rows = rows.select("doc_id", "text", "chunk", F.element_at(fine, F.col("chunk")).alias("bounds"))
    rows = rows.select("doc_id", "text", ((F.col("chunk") - 1) * step + upto(F.col("bounds")) - 1).alias("own"), F.array_contains("bounds", F.col("doc_id")).alias("first"))
    place = lambda b, p: F.struct(b.cast("int").alias("bucket"), F.lit(p).alias("peek"))
    places = F.when(F.col("first"), F.array(place(F.col("own"), 0), place((F.col("own") + n - 1) % n, 1))).otherwise(F.array(place(F.col("own"), 0)))
    rows = rows.select(F.explode(places).alias("at"), "doc_id", "text").select("at.bucket", "at.peek", "doc_id", "text")
    return rows.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "peek", "doc_id", "text"), n


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler = _sampler()
    last: tuple[int, int, str] | None = None  # bucket, doc_id, text that still lacks its successor
    code: np.ndarray | None = None  # its fingerprint
    done = -1  # the bucket whose first peek row has been used

    for b in sliced(it, max_bytes=4 << 20):
        new = list(zip(*(b.column(k).to_pylist() for k in range(4))))
        plan: list[tuple[int, str, str]] = []  # doc_id, text, edited text
        both: list[str] = []  # each text, then the edited text of the row before it: they share most words
        own: list[int | None] = []  # where the fingerprint of a planned row's text is; None: in code
        at: list[int] = []  # where its successor is; the edited text follows
        held = None  # the place of last's text in both; None: an earlier batch
        for bucket, peek, doc, text in new:
            if peek and bucket == done:
                continue
            place = len(both)
            both.append(text)
            if last is not None and last[0] == bucket:
                changed = edited(last[2], text)
                plan.append((last[1], last[2], changed))
                own.append(held)
                at.append(place)
                both.append(changed)
            if peek:
                last, done, held = None, bucket, None
            else:
                last, held = (bucket, doc, text), place
        codes = sampler.codes(both)
        if plan:
            mine = np.array([code if k is None else codes[k] for k in own])
            after, other = codes[at], codes[[k + 1 for k in at]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in plan], pa.int64()),
                    pa.array([len(t) for _, t, _ in plan], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for _, _, t in plan]),
                    pa.array([text_of(c) for c in mine]),
                    pa.array([text_of(c) for c in other]),
                    pa.array(likeness(mine, other)),
                    pa.array(likeness(mine, after)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
        if held is not None:
            code = codes[held]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Every text's fingerprint beside that of its edited text and the likeness to it and to the next document.

    A null text is the empty text; the fingerprint of a text without words is
    all zeros and like that of its kind only. Rows without id take no part.
    Rows that share an id follow each other in the order of their texts. The
    only document of a table is its own successor; an empty table gives none.
    """
    tuned(docs.sparkSession)
    rows, _ = with_next(texts(docs, id_col, text_col), buckets)
    return rows.mapInArrow(_compared, _OUT)


def op1_weighted_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
