"""Quality by a generalised additive model with pairwise interactions.

Each text becomes a few dozen numbers. Every number is cut into quantile bins;
boosted shallow trees, one feature after the other in cycles, are summed into
one lookup table a feature, then the pairs of features that explain most of
what is left get tables of two dimensions in the same way. A score is a sum of
table entries: vectorised additions, and every entry can be read and plotted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import field, materialised, sliced, texts, tuned

#: The labelled rows that a model is fitted on, at most: those whose md5(doc_id) comes first.
MAX_TRAINING_ROWS = 20_000
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 60, 8, 0.1

FEATURES = (
    "log_words word_length distinct_words repeats_before top_word symbols capitals digits marks exclamations bare_symbols sentence_words "
    "distinct_lines line_length longest_word short_words capital_words longest_run new_words vowels symbol_words distinct_pairs first_line odd_letters"
).split()
_ENDS = re.compile(r"[.!?]+(?=\s|$)")
_LOW, _CAP, _DIGIT, _SPACE, _MARK, _SYMBOL, _OTHER = range(7)


def _classes() -> np.ndarray:
    kind = np.full(0x3000, _OTHER, np.uint8)
    for i in range(0x3000):
        ch = chr(i)
        if ch.islower():
            kind[i] = _LOW
        elif ch.isupper():
            kind[i] = _CAP
        elif ch.isdigit():
            kind[i] = _DIGIT
        elif ch.isspace():
            kind[i] = _SPACE
        elif ch in ".,;:!?'\"-()’‘“”«»–—¡¿":
            kind[i] = _MARK
        elif not ch.isalpha():
            kind[i] = _SYMBOL
    return kind


_KIND = _classes()
_VOWEL = np.zeros(0x3000, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUYàáâäãèéêëìíîïòóôöõùúûüÿÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ"]] = True


def measure(text: str) -> list[float]:
    """The FEATURES of a whole text; all 0 for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.minimum(points, 0x2FFF)
    kinds = np.bincount(_KIND[points], minlength=7)
    size = len(points)
    letters = max(1, kinds[_LOW] + kinds[_CAP] + kinds[_OTHER])
    seen = Counter(words)
    lengths = list(map(len, words))
    same = list(map(eq, words, words[1:]))
    run = longest = 0
    if any(same):
        for s in same:
            run = run + 1 if s else 0
            longest = max(longest, run)
    lines = [x for x in text.split("\n") if x.strip()]
    sentences = max(1, len(_ENDS.findall(text)))
    bare = sum(1 for w in seen if not any(map(str.isalnum, w)))
    half = set(words[: n // 2])
    second = set(words[n // 2 :])
    symbol_words = sum(k for w, k in seen.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?'\"-)”’»")
    return [
        float(np.log1p(n)),
        sum(lengths) / n,
        len(seen) / n,
        sum(same) / n,
        max(seen.values()) / n,
        kinds[_SYMBOL] / size,
        kinds[_CAP] / letters,
        kinds[_DIGIT] / size,
        kinds[_MARK] / size,
        text.count("!") / n,
        bare / n if bare < 3 else sum(seen[w] for w in seen if not any(map(str.isalnum, w))) / n,
        n / sentences,
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(size / max(1, len(lines)))),
        float(max(lengths)),
        sum(1 for x in lengths if x <= 3) / n,
        sum(k for w, k in seen.items() if len(w) > 1 and w.isupper()) / n,
        longest / n,
        len(second - half) / max(1, len(second)),
        float(np.count_nonzero(_VOWEL[points])) / letters,
        symbol_words / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        len(lines[0]) / size if lines else 0.0,
        kinds[_OTHER] / letters,
    ]


def _measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(it):
        x = np.array([measure(t) for t in b.column(1).to_pylist()], np.float32)
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column(0), values], names=["doc_id", "x"])


class Additive:
    """Lookup tables of single features and of pairs, over quantile bins."""

    def __init__(self, edges: list[np.ndarray], base: float, single: np.ndarray, pairs: list[tuple[int, int]], double: np.ndarray):
        self.edges, self.base, self.single, self.pairs, self.double = edges, base, single, pairs, double

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(np.nan_to_num(x))
        out = np.full(len(x), self.base)
        for j in range(b.shape[1]):
            out += self.single[j][b[:, j]]
        for k, (i, j) in enumerate(self.pairs):
            out += self.double[k][b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float = 2.0) -> tuple[float, int]:
    """(gain, cut) of the split of a row of bins with the largest gain; cut is 0 for none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = 0
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of a tree of up to four leaves over a row of bins."""
    out = np.zeros(len(g))
    _, cut = _best_cut(g, h)
    for a, b in ((0, cut), (cut, len(g))) if cut else ((0, len(g)),):
        _, mid = _best_cut(g[a:b], h[a:b])
        for c, d in ((a, a + mid), (a + mid, b)) if mid else ((a, b),):
            out[c:d] = -g[c:d].sum() / (h[c:d].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of the better of two trees: rows then columns, or columns then rows."""
    found = (0.0, np.zeros(g.shape))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        gain, cut = _best_cut(a.sum(1), b.sum(1), 1.0)
        out = np.zeros(a.shape)
        for lo, hi in ((0, cut), (cut, len(a))) if cut else ((0, len(a)),):
            more, mid = _best_cut(a[lo:hi].sum(0), b[lo:hi].sum(0), 1.0)
            gain += more
            for c, d in ((0, mid), (mid, a.shape[1])) if mid else ((0, a.shape[1]),):
                out[lo:hi, c:d] = -a[lo:hi, c:d].sum() / (b[lo:hi, c:d].sum() + 1)
        if gain > found[0]:
            found = (gain, out.T if flip else out)
    return found


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits on rows ``x`` with labels 0/1. With no row, or a single class, the score is a constant."""
    x = np.nan_to_num(x.astype(np.float64))
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return Additive([], base, np.zeros((0, BINS)), [], np.zeros((0, BINS, BINS)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = Additive(edges, base, np.zeros((x.shape[1], BINS)), [], np.zeros((0, BINS, BINS)))
    b = model.bins(x)
    f = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(x.shape[1]):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, j], g, BINS), np.bincount(b[:, j], h, BINS))
            model.single[j] += step
            f += step[b[:, j]]
    g, h = slopes()

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, i] * BINS + b[:, j], v, BINS * BINS).reshape(BINS, BINS)

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_pair_tree(grid(*p, g), grid(*p, h))[0])
    model.pairs = ranked[:PAIRS]
    model.double = np.zeros((len(model.pairs), BINS, BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            model.double[k] += step
            f += step[b[:, i], b[:, j]]
    return model


def training_ids(labels: DataFrame, label_col: str, learn, id_col: str = "doc_id", limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, label) of the ids that may be learnt from: ``limit`` at most, by md5(doc_id), one row each; ids labelled both ways are left out."""
    rows = labels.select(field(id_col).cast("long").alias("doc_id"), field(label_col).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    return rows.select("doc_id", "label").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)


def classify(docs: DataFrame, labels: DataFrame, held_out, label_col: str = "quality", limit: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Additive]:
    """((doc_id, held_out, score, predicted) of every document that has an id, the model).

    ``held_out`` maps a doc_id column to a boolean: labels of those rows are
    not learnt from. Null or empty texts have all features 0 and a score;
    repeated rows are scored each. Labels other than 0 and 1 are ignored, as
    are ids labelled both ways; of texts that share a labelled id the one of
    least features is learnt from, once. Without labels of both classes, the
    score is a constant. ``limit`` bounds what reaches the driver.
    """
    tuned(docs.sparkSession)
    rows = materialised(texts(docs, id_col, text_col).mapInArrow(_measured, "doc_id bigint, x array<float>"), "features")
    some = training_ids(labels, label_col, lambda c: ~held_out(c), id_col, limit)
    # limit rows at most, so it may be broadcast, and collected by id
    got = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("label").alias("label")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    model = fit(x, got["label"].to_numpy(np.float64))

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            s = model.score(flat.reshape(b.num_rows, len(FEATURES)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = rows.mapInArrow(scored, "doc_id bigint, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"), model


def op6_additive_quality(spark, sf_dir: str) -> DataFrame:
    held = lambda c: F.crc32(c.cast("string")) % 3 == 1
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), held)[0]
