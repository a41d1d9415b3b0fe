"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are dealt to parts of bounded size. In a part, each dimension's values
are quantised to levels; a level's vectors form a posting segment. For a query
a segment's impact is the most that it can add above the dimension's least
contribution. Segments of all dimensions are processed by descending impact,
adding to accumulators. A vector can reach at most what it has plus the
impact of the next segment for each dimension not yet met. Processing stops
when few vectors can still reach the k-th best sure score, and those are
scored exactly, so the result is exact wherever it stops.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandsift.llm.common import field, materialised, tuned

LEVELS = 32
#: Vectors and queries that one task holds.
PART, QUERIES = 32_768, 8_192
#: Looks at the bounds while a query's segments are processed.
LOOKS = 12


class Index:
    """The posting segments of a part."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        self.ids, self.x = ids, x
        n, dims = x.shape
        self.dims = dims
        least, most = x.min(0), x.max(0)
        width = np.maximum(1, -(-(most - least + 1) // levels))
        code = (x - least) // width
        self.post = np.argsort(code, axis=0, kind="stable").T.astype(np.int32).ravel()  # by dimension, then level
        sizes = np.stack([np.bincount(code[:, d], minlength=levels) for d in range(dims)])
        low = least[:, None] + width[:, None] * np.arange(levels)
        keep = sizes.ravel() > 0
        starts = np.concatenate(([0], np.cumsum(sizes.ravel())))[:-1]
        self.dim = np.repeat(np.arange(dims), levels)[keep]
        self.low, self.high = low.ravel()[keep], np.minimum(low + width[:, None] - 1, most[:, None]).ravel()[keep]
        self.start, self.size = starts[keep], sizes.ravel()[keep]
        self.least, self.most, self.width = least, most, width

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors but the row of id ``own`` that is the query itself: by score, then smaller id."""
        n = len(self.ids)
        same = np.arange(*np.searchsorted(self.ids, [own, own + 1]))
        same = same[(self.x[same] == query).all(1)]
        mine = int(same[0]) if len(same) else -1
        live = n - (mine >= 0)
        if live <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        largest = float(np.abs(query).astype(np.float64) @ np.maximum(np.abs(self.least), np.abs(self.most)).astype(np.float64))
        if largest >= 2.0**62:
            raise OverflowError("scores beyond 62 bits")
        if largest >= 2.0**50:  # accumulators are doubles: beyond their exact range every vector is scored
            return self.best(np.arange(n), query, mine, k)
        q = query[self.dim]
        floor = np.minimum(query * self.least, query * self.most)
        impact = np.maximum(q * self.low, q * self.high) - floor[self.dim]
        order = np.argsort(-impact, kind="stable")
        order = order[query[self.dim[order]] != 0]  # dimensions without a say
        dims = int(np.count_nonzero(query))
        blur = int((np.abs(query) * (self.width - 1)).sum())  # between an accumulator and the least it can stand for
        acc = np.zeros(n, np.float64)
        met = np.zeros(n, np.float64)
        sizes = self.size[order]
        ends = np.cumsum(sizes)
        rank = min(k, live)
        maybe = np.arange(n)
        at = 0
        for look in range(1, LOOKS + 1):
            upto = int(np.searchsorted(ends, look * ends[-1] / LOOKS)) + 1 if len(ends) else 0
            some = order[at:upto]
            if len(some):
                ids = np.concatenate([self.post[a : a + b] for a, b in zip(self.start[some].tolist(), self.size[some].tolist())])
                acc += np.bincount(ids, np.repeat(impact[some].astype(np.float64), self.size[some]), n)
                met += np.bincount(ids, minlength=n)
            at = max(at, upto)
            left = float(impact[order[at]]) if at < len(order) else 0.0
            if mine >= 0:
                acc[mine] = -np.inf
            sure = np.partition(acc, n - rank)[n - rank] - blur
            maybe = np.flatnonzero(acc + (dims - met) * left >= sure)
            if len(maybe) <= max(4 * k, n // 64) or at >= len(order):
                break
        return self.best(maybe, query, mine, k)

    def best(self, maybe: np.ndarray, query: np.ndarray, mine: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        maybe = maybe[maybe != mine]
        exact = self.x[maybe] @ query
        best = np.lexsort((self.ids[maybe], -exact))[:k]
        return self.ids[maybe][best], exact[best]


def _vectors(it):
    for b in it:
        ids, vs = [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i is None or v is None or None in v:
                continue
            x = np.floor(1024.0 * np.asarray(v, np.float64))
            if np.isfinite(x).all():
                if len(x) and np.abs(x).max() >= 2.0**62:
                    raise OverflowError(f"a component of vector {i} is beyond 62 bits")
                ids.append(i)
                vs.append(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.binary())], names=["vec_id", "v"])


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    rows = [np.frombuffer(r, "<i8") for r in col.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", part: int = PART, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (of its id) marks, the k rows of highest inner product.

    Components count as floor(1024 * x). Vectors that are null or hold null
    or non-finite components, and rows without id, take no part; a shorter
    vector is filled up with zeros, an empty one is all zeros. The query's own
    row is no candidate; other vectors of its id are. Repeated rows of one id
    and vector count once. Different vectors of an id that is a query are
    queries each, with ranks of their own. Ties go to the smaller id. Fewer
    than k candidates give as many rows; an empty table none. Components and
    scores of 62 bits and more raise OverflowError; scores beyond the doubles'
    exact range are found by scoring every vector.
    """
    spark = tuned(vectors.sparkSession)
    narrow = vectors.select(field(id_col).cast("long").alias("vec_id"), field(vector_col).cast("array<double>").alias("v"))
    rows = materialised(narrow.mapInArrow(_vectors, "vec_id bigint, v binary").dropDuplicates(["vec_id", "v"]), "vectors")
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query(F.col("vec_id")), 1))).first()
    parts, sets = max(1, -(-n // part)), max(1, -(-m // queries))
    spread = lambda c, to: F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias(c)
    place = lambda salt, to: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(to)).cast("int")
    # a grid: every part of the vectors meets every set of the queries, both of bounded size
    data = rows.select("vec_id", "v", place(1, parts).alias("part"), spread("set", sets))
    asked = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("asks"), F.col("v").alias("q"), F.xxhash64("v").alias("key"), place(2, sets).alias("set"), spread("part", parts))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        q, w, s, i = [], [], [], []
        if left.num_rows and right.num_rows:
            x, ids = _matrix(left["v"]), left["vec_id"].to_numpy()
            y, asks = _matrix(right["q"]), right["asks"].to_numpy()
            d = max(x.shape[1], y.shape[1])
            x, y = (np.pad(z, ((0, 0), (0, d - z.shape[1]))) for z in (x, y))
            order = np.argsort(ids, kind="stable")
            index = Index(ids[order], np.ascontiguousarray(x[order]))
            for a, key, v in zip(asks.tolist(), right["key"].to_pylist(), y):
                best, score = index.top(v, a, k)
                q.append(np.full(len(best), a))
                w.append(np.full(len(best), key))
                i.append(best)
                s.append(score)
        flat = lambda z: pa.array(np.concatenate(z).astype(np.int64) if z else np.zeros(0, np.int64))
        return pa.table({"query_id": flat(q), "key": flat(w), "vec_id": flat(i), "score": flat(s)})

    found = data.groupBy("set", "part").cogroup(asked.groupBy("set", "part")).applyInArrow(met, "query_id bigint, key bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op4_impact_ordered(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: c % 100 == 0)


OP4_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.vec_id AS query_id, a.e AS asked, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND (a.vec_id <> b.vec_id OR a.e <> b.e)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""
