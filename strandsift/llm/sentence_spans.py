"""Substring dedup by sliding spans of sentences.

A text is cut into sentences: after a word that ends in one of . ! ? or an
ellipsis. Only a sentence of more than LONG words is divided further, after
each word whose hash is the least of some GAP neighbouring words, so that it
is cut alike wherever it stands, but for the first and last GAP words that two
texts share. From every sentence on, and back from every one that no such run
ends with, the shortest run of at least SPAN sentences (or parts of a long
one) and MIN_WORDS words is hashed. Two texts that share 3 * LONG + MIN_WORDS
- 1 = 55 words share a run; fewer do nearly always. A run that occurs in
several documents stays in the one with the smallest id; everywhere else, and
from its second occurrence in a document on, all its sentences are removed.
White space, line ends too, and case do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import forget, materialised, plain_names, sliced, texts, tidied, tuned

SPAN, MIN_WORDS = 2, 20
#: Sentences of up to LONG words are never divided; parts of longer ones have GAP words at most.
LONG, GAP = 12, 9
#: Of the runs' two hashes, modulo 2 ** 64; 5 modulo 8 gives the longest period.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D)
_CLOSED = frozenset(".!?…")
_QUOTES = "\"')]}»”’"


class Cutter:
    """Cuts texts into pieces; remembers the words' hashes, which depend on the word only."""

    def __init__(self) -> None:
        self.hashes: dict[str, int] = {}
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in BASES]

    def hash(self, word: str) -> int:
        """Even if the word ends a sentence, else odd."""
        tail = word.rstrip(_QUOTES)
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        return h ^ 1 if tail and tail[-1] in _CLOSED else h

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(the lower-case words' hashes, the number of words up to the end of each piece)."""
        held = self.hashes
        if len(held) > 500_000:
            held.clear()
        words = text.lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new = set(words).difference(held)
        held.update((w, self.hash(w)) for w in new)
        hashes = np.fromiter(map(held.__getitem__, words), np.uint64, n)
        for w in new:
            if len(w) > 64:
                del held[w]
        ends = hashes & np.uint64(1) == 0
        stops = np.flatnonzero(ends) + 1
        sizes = np.diff(np.concatenate([np.zeros(1, np.int64), stops, np.full(1, n)]))
        if sizes.max() > LONG:
            # a word is the least of some window if its rank is the greatest minimum of the windows that hold it
            v = np.where(ends, np.uint64(0), hashes)
            least = _slide(np.minimum, v)
            edge = np.zeros(GAP - 1, np.uint64)
            ends |= (_slide(np.maximum, np.concatenate([edge, least, edge])) == v) & np.repeat(sizes > LONG, sizes)
        ends[-1] = True
        return hashes, np.flatnonzero(ends) + 1

    def hashed(self, words: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: int) -> np.ndarray:
        """sum(hash of word k * base ** k) over each run, moved to start at the power 0, and mixed."""
        powers, inverse = self.powers[which]
        while len(powers) < len(words):
            base, n = BASES[which], len(powers)
            powers = np.concatenate([powers, powers * np.uint64(pow(base, n, 1 << 64))])
            inverse = np.concatenate([inverse, inverse * np.uint64(pow(pow(base, -1, 1 << 64), n, 1 << 64))])
            self.powers[which] = powers, inverse
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)])])
        h = (upto[stops] - upto[starts]) * inverse[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(64 bits of hash, 32 bits of another, first pieces, pieces past the last) of the runs, by their first pieces."""
        words, stops = self.pieces(text)
        n = len(stops)
        if n < SPAN:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), stops])[:n]
        firsts = np.arange(n)
        lasts = np.maximum(firsts + SPAN, np.searchsorted(stops, starts + MIN_WORDS) + 1)
        firsts, lasts = firsts[lasts <= n], lasts[lasts <= n]
        # the runs back from the ends that none of these has
        hit = np.zeros(n + 1, bool)
        hit[lasts] = hit[0] = True
        more = np.flatnonzero(~hit)
        back = np.minimum(more - SPAN, np.searchsorted(starts, stops[more - 1] - MIN_WORDS, "right") - 1)
        firsts, lasts = np.concatenate([firsts, back[back >= 0]]), np.concatenate([lasts, more[back >= 0]])
        order = np.argsort(firsts, kind="stable")
        firsts, lasts = firsts[order], lasts[order]
        h, g = (self.hashed(words, starts[firsts], stops[lasts - 1], k) for k in (0, 1))
        return h.view(np.int64), (g >> np.uint64(32)).astype(np.uint32).view(np.int32), firsts, lasts


def _slide(of: np.ufunc, v: np.ndarray) -> np.ndarray:
    """``of`` over each window of GAP neighbours."""
    out, width = v, 1
    while width < GAP:
        step = min(width, GAP - width)
        out = of(out[: len(out) - step], out[step:])
        width += step
    return out


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = Cutter()
    for b in sliced(it):
        hs, gs, ds = [], [], []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h, g, _, _ = cutter.spans(t)
            if len(h):
                _, at = np.unique(h, return_index=True)
                if len(at) < len(h):
                    _, at = np.unique(np.stack([h, g]), axis=1, return_index=True)
                    h, g = h[at], g[at]
                hs.append(h)
                gs.append(g)
                ds.append(np.full(len(h), d, np.int64))
        if hs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(gs)), pa.array(np.concatenate(ds))], names=["h", "g", "doc_id"])


def without(cutter: Cutter, text: str, seen: set[tuple[int, int]]) -> str:
    """``text`` without the sentences of runs whose hashes are in ``seen`` or have come before in the text itself."""
    hs, gs, firsts, lasts = cutter.spans(text)
    if not seen and len(np.unique(hs)) == len(hs):
        return text
    own: dict[tuple[int, int], int] = {}  # the end of a run's first occurrence
    gone: set[int] = set()
    for key, a, z in zip(zip(hs.tolist(), gs.tolist()), firsts.tolist(), lasts.tolist()):
        if key in seen:
            gone.update(range(a, z))
        elif key in own:
            gone.update(range(max(a, own[key]), z))
        else:
            own[key] = z
    if not gone:
        return text
    _, stops = cutter.pieces(text)
    starts = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
    kept, at = [], 0
    for i, stop in enumerate(stops.tolist()):
        if i not in gone:
            kept.append(text[starts[at] if at else 0 : starts[stop]])
        at = stop
    return "".join(kept).rstrip()


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, seen array<struct<h, g>>) of (doc_id, text): the runs that a document shares with one of a smaller id, by 96 bits of hash."""
    tuned(docs.sparkSession)
    spans = materialised(docs.mapInArrow(tidied(_hashed), "h bigint, g int, doc_id bigint"), "spans")
    # counts and minima are formed before the shuffle, so a common passage costs one row a task
    shared = spans.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g", "first")
    # a table of its own: a join of two plain exchanges is one whose hot keys can be split
    shared = materialised(shared, "shared")
    later = spans.join(shared, ["h", "g"]).where(F.col("doc_id") > F.col("first"))
    seen = materialised(later.groupBy("doc_id").agg(F.collect_set(F.struct("h", "g")).alias("seen")), "seen")  # at most a document's own runs
    for table in (spans, shared):
        forget(table)
    return seen


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of the text and n_chars set anew; all other columns stay.

    Every row stays, if need be with an empty text. Null texts stay null;
    rows without id are not compared with others. Rows that share an id count
    as one document: what they share with each other is kept. An empty table
    gives an empty one. Very long texts are taken whole.
    """
    seen = repeated(texts(docs, id_col, text_col)).select(F.col("doc_id").alias("span_doc"), F.col("seen").alias("span_seen"))
    plain = plain_names(docs)
    place = {name: k for k, name in enumerate(docs.columns)}
    doc, text, chars = place[id_col], place[text_col], place.get(chars_col)
    rows = plain.join(seen, F.col(f"c{doc}").cast("long") == F.col("span_doc"), "left").drop("span_doc")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for b in sliced(it, f"c{text}"):
            *cols, hits = b.columns
            new = [t if t is None else without(cutter, t, {(x["h"], x["g"]) for x in s or ()}) for t, s in zip(cols[text].to_pylist(), hits.to_pylist())]
            cols[text] = pa.array(new, pa.string())
            if chars is not None:
                cols[chars] = pa.array([0 if t is None else len(t) for t in new], pa.int64()).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return rows.mapInArrow(tidied(cut), plain.schema).toDF(*docs.columns)


def op2_sentence_spans(spark, sf_dir: str) -> DataFrame:
    """doc_id, text, n_chars, n_removed (code points) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.length("text").cast("long").alias("n_before"))
    out = remove_repeats(docs)
    return out.select("doc_id", "text", "n_chars", (F.col("n_before") - F.col("n_chars")).alias("n_removed"))
