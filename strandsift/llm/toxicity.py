"""Toxicity by a linear classifier that identity terms cannot move.

A document is the set of its words and of their first four, five and six
letters (an insult keeps its stem under any ending). The features that part
the classes best, and every identity term, get weights by regularised
logistic regression. For every labelled sentence that names a group of
people, a twin is made in which the name is swapped for another of its kind.
A labelled text that names none gets one such name, and its twins another,
in one of its sentences, so that the rule also holds for names that the
labels never show. The loss adds the squared difference between the scores of
a sentence and its twin, so that naming a group is neither toxic nor harmless.
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
from strandsift.llm.quality import training_ids

#: The labelled rows that a model is fitted on, at most: those whose md5(doc_id) comes first.
MAX_TRAINING_ROWS = 20_000
#: A feature's least number of training documents and least distance between the classes, in standard deviations.
LEAST_DOCS, LEAST_Z = 3, 3.5
RIDGE, TWIN_WEIGHT, STEPS = 0.02, 4.0, 400

#: The usual identity terms, in lower case; those of one row are swapped for each other.
IDENTITIES = tuple(
    tuple(x.split())
    for x in (
        "man woman boy girl", "men women boys girls", "christian muslim jewish hindu buddhist atheist", "christians muslims jews hindus buddhists atheists",
        "black white asian latino african european", "gay straight lesbian bisexual heterosexual", "immigrant native refugee foreigner", "immigrants natives refugees foreigners",
        "hombre mujer", "hombres mujeres", "cristiano musulmán judío", "homme femme", "hommes femmes", "chrétien musulman juif", "mann frau", "männer frauen", "christ moslem jude",
    )
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features_of(word: str) -> list[str]:
    n = len(word)
    return ["=" + word] + [word[:k] for k in (4, 5, 6) if n >= k]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class Swaps:
    """The twins of texts' sentences by a table of identity terms."""

    def __init__(self, identities=IDENTITIES):
        self.rows = [tuple(t.lower() for t in row) for row in identities if len(row) > 1]
        self.row_of = {t: row for row in self.rows for t in row}

    def next(self, term: str, shift: int) -> str:
        row = self.row_of[term]
        return row[(row.index(term) + shift) % len(row)]

    def __call__(self, text: str) -> Iterator[tuple[str, str]]:
        """(sentence, twin), both whole and in lower case: each way to swap, and one name put in if there is none."""
        if not self.rows:
            return
        sentences = [m[0] for m in _SENTENCE.finditer(text.lower()) if _WORD.search(m[0])]
        named = [x for x in sentences if not self.row_of.keys().isdisjoint(_WORD.findall(x))]
        if sentences and not named:
            h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
            row = self.rows[h % len(self.rows)]
            named = [f"{row[h // 64 % len(row)]} {sentences[h // 4096 % len(sentences)]}"]
        for x in named:
            twins = {_WORD.sub(lambda m: self.next(m[0], shift) if m[0] in self.row_of else m[0], x) for shift in (1, 2)}  # noqa: B023
            yield from ((x, twin) for twin in sorted(twins) if twin != x)


class Linear:
    def __init__(self, weights: dict[str, float], bias: float, twins: int = 0):
        self.weights, self.bias, self.twins = weights, bias, twins  # twins: pairs of sentences that it was fitted on
        self.memo: dict[str, tuple[str, ...] | None] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "twins": self.twins, "memo": {}}

    def active(self, text: str) -> set[str]:
        memo, weights, on = self.memo, self.weights, set()
        if len(memo) > 500_000:
            memo.clear()
        for w in words_of(text):
            try:
                hit = memo[w]
            except KeyError:
                hit = memo[w] = tuple(f for f in features_of(w) if f in weights) or None
            if hit:
                on.update(hit)
        return on

    def score(self, text: str) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, sorted(self.active(text))))
        return 1 / (1 + float(np.exp(-min(35.0, max(-35.0, z)))))


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents of class 1, of class 0), summed over what this task reads."""
    held: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64())], names=["feature", "ones", "zeros"]
        )

    for b in sliced(it):
        for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            for f in {f for w in words_of(text) for f in features_of(w)}:
                held.setdefault(f, [0, 0])[label] += 1
            if len(held) > 300_000:
                yield out()
                held.clear()
    if held:
        yield out()


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows, features) of all rows' features."""
    return np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.array([i for x in rows for i in x], np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int], int]], n: int, twin_weight: float = TWIN_WEIGHT) -> tuple[np.ndarray, float]:
    """Weights and bias of the regularised logistic loss plus the twins' mean squared score differences (Adam, full batch).

    A pair is the features of a sentence, those of its twin, and how often they occur.
    """
    r, c = _flat(rows)
    sides = [_flat([p[k] for p in pairs]) for k in (0, 1)]
    share = np.array([p[2] for p in pairs], np.float64)
    share /= max(share.sum(), 1.0)
    rate = (y.sum() + 1) / (len(y) + 2)
    w, bias = np.zeros(n), float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return w, bias
    m1, m2, b1, b2 = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, STEPS + 1):
        d = (_sigmoid(bias + np.bincount(r, w[c], len(rows))) - y) / len(y)
        g, gb = np.bincount(c, d[r], n) + RIDGE * w / max(n, 1), d.sum()
        if len(pairs) and twin_weight:
            p, q = (_sigmoid(bias + np.bincount(at, w[f], len(pairs))) for at, f in sides)
            for (at, f), s, sign in zip(sides, (p, q), (1.0, -1.0)):
                slope = 2 * twin_weight * sign * share * (p - q) * s * (1 - s)
                g += np.bincount(f, slope[at], n)
                gb += slope.sum()
        lr = 0.1 * (1 - 0.9 * t / STEPS)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        k1, k2 = 1 - 0.9**t, 1 - 0.999**t
        w -= lr * (m1 / k1) / (np.sqrt(m2 / k2) + 1e-8)
        bias -= lr * (b1 / k1) / (np.sqrt(b2 / k2) + 1e-8)
    return w, bias


def train(
    docs: DataFrame, labels: DataFrame, held_out, label_col: str = "toxic", limit: int = MAX_TRAINING_ROWS, identities=IDENTITIES, twin_weight: float = TWIN_WEIGHT, id_col: str = "doc_id", text_col: str = "text"
) -> Linear:
    """A model of the labelled documents that are not held out, ``limit`` at most.

    Only these rows and what is counted over them reaches the driver, so
    ``limit`` bounds it. An id labelled both ways is not learnt from; of texts
    that share an id the least is. Null texts are empty. Without labels of
    both classes, the score is a constant. ``identities`` is the table of
    terms; its words count as features however rare they are.
    """
    tuned(docs.sparkSession)
    some = training_ids(labels, label_col, lambda c: ~held_out(c), limit=limit, id_col=id_col)
    # limit rows at most, so it may be broadcast; the texts are kept as three passes read them
    sample = texts(docs, id_col, text_col).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    sample = materialised(sample, "labelled")
    ones, zeros = (sample.where(F.col("label") == k).count() for k in (1, 0))
    counts = sample.mapInArrow(tidied(_counted), "feature string, ones bigint, zeros bigint").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    p, q = F.col("ones") / F.lit(max(ones, 1)), F.col("zeros") / F.lit(max(zeros, 1))
    both = (F.col("ones") + F.col("zeros")) / F.lit(max(ones + zeros, 1))
    z = F.abs(p - q) / F.sqrt(both * (1 - both) * F.lit(1 / max(ones, 1) + 1 / max(zeros, 1)) + F.lit(1e-12))
    best = counts.where((F.col("ones") + F.col("zeros") >= LEAST_DOCS) & (z >= LEAST_Z))
    swaps = Swaps(identities)
    names = sorted({x[0] for x in best.select("feature").collect()} | {"=" + t for t in swaps.row_of})  # of limit documents
    index = {f: i for i, f in enumerate(names)}
    probe = Linear(dict.fromkeys(names, 0.0), 0.0)

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = lambda t: sorted(index[f] for f in probe.active(t))
        for b in sliced(it):
            ts = b.column(1).to_pylist()
            twins = [[{"a": on(x), "b": on(y)} for x, y in swaps(t)] for t in ts]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(map(on, ts), ints), pa.array(twins, pa.list_(pa.struct([("a", ints), ("b", ints)])))], names=["doc_id", "label", "on", "twins"]
            )

    rows = materialised(sample.mapInArrow(tidied(encoded), "doc_id bigint, label int, on array<int>, twins array<struct<a:array<int>,b:array<int>>>"), "encoded")
    got = rows.select("doc_id", "label", "on").toPandas().sort_values("doc_id", kind="stable")
    # twins of the same features count once, with their number
    pairs = rows.select(F.explode("twins").alias("t")).groupBy("t.a", "t.b").agg(F.count(F.lit(1)).alias("n")).collect()
    pairs = sorted((list(p.a), list(p.b), p.n) for p in pairs)
    w, bias = fit([list(x) for x in got["on"]], got["label"].to_numpy(np.float64), pairs, len(names), twin_weight)
    for table in (sample, rows):
        forget(table)
    return Linear({f: float(w[i]) for f, i in index.items()}, bias, sum(p[2] for p in pairs))


def score(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document that has an id; null or empty texts score like a text without known words."""
    tuned(docs.sparkSession)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it):
            s = np.array([model.score(t) for t in b.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(tidied(scored), "doc_id bigint, score double, predicted int")


def keep_clean(docs: DataFrame, model: Linear, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``; one pass, no shuffle."""
    tuned(docs.sparkSession)
    rows, text = plain_names(docs), f"c{docs.columns.index(text_col)}"

    def clean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, text):
            at = b.schema.get_field_index(text)
            yield b.filter(pa.array([model.score(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return rows.mapInArrow(tidied(clean), rows.schema).toDF(*docs.columns)


def op8_counterfactual_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = lambda c: F.crc32(c.cast("string")) % 5 == 0
    out = score(docs, train(docs, labels, held))
    return out.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", "predicted")
