"""Optimal length buckets and token-budget batches.

The histogram of lengths over all documents (one row a distinct length) is
the only thing that leaves the executors. Dynamic programming over it finds
the bucket boundaries with the least padding, when every document is padded
to its bucket's boundary. Inside a bucket, documents in hashed order fill
batches of floor(budget / boundary) rows (one at least), so that no padded
batch exceeds the budget unless a single document does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandsift.llm import token_files
from strandsift.llm.common import field, materialised, texts, tuned

BUCKETS = 12
BUDGET = 16384
#: Rows that are ranked in one task.
RANKED = 100_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper lengths of at most ``buckets`` buckets with the least total padding.

    Dynamic programming, layer by layer: best(b, j) = min over i < j of
    best(b - 1, i) + padding(i, j). The best i does not fall as j grows
    (the padding satisfies the quadrangle inequality), so each layer is
    filled by halving: O(buckets * n log n). Ties go to the smallest i.
    """
    order = np.argsort(lengths)
    x = np.asarray(lengths, np.int64)[order]
    c = np.asarray(counts, np.int64)[order]
    n = len(x)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(c)))
    mass = np.concatenate(([0], np.cumsum(c * x)))
    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far, np.int64)
    best[0] = 0
    back = []
    for _ in range(min(buckets, n)):
        new, arg = np.full(n + 1, far, np.int64), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + x[j - 1] * (rows[j] - rows[i]) - (mass[j] - mass[i])
            k = int(np.argmin(cost))
            new[j], arg[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        back.append(arg)
        best = np.minimum(new, far)
    out, j = [], n
    for arg in reversed(back):
        if j == 0:
            break
        out.append(int(x[j - 1]))
        j = int(arg[j])
    return out[::-1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    length_col: str | None = None,
    vocabulary: str | None = None,
    end_id: int = token_files.END_ID,
) -> DataFrame:
    """(doc_id, n_tokens, bucket, boundary, batch, slot) of every document that has an id.

    n_tokens is the number of ids that token_files writes for the text, its
    end id included (whichever ``end_id`` is), so an empty or null text has length 1; or it is
    ``length_col``, a null of which is 0. Very long texts count whole.
    Repeated rows are packed each; ties are ordered by hash, then doc_id, and
    among equal ids by length. bucket counts from 0, batch and slot from 0 in
    each bucket. An empty table gives an empty one.
    """
    spark = tuned(docs.sparkSession)
    if length_col:
        rows = docs.where(field(id_col).isNotNull()).select(field(id_col).cast("long").alias("doc_id"), F.coalesce(field(length_col).cast("long"), F.lit(0).cast("long")).alias("n_tokens"))
    else:
        rows = token_files.lengths(texts(docs, id_col, text_col), vocabulary or token_files.vocabulary_path())
    rows = materialised(rows, "lengths")  # two numbers a document; texts are read once
    hist = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()  # one row a distinct length
    if not len(hist):
        return spark.createDataFrame([], "doc_id bigint, n_tokens bigint, bucket int, boundary bigint, batch bigint, slot bigint")
    ends = boundaries(hist["n_tokens"].to_numpy(), hist["n"].to_numpy(), buckets)
    parts = max(1, int(-(-int(hist["n"].sum()) // RANKED)))
    edges = F.array(*[F.lit(e).cast("long") for e in ends])
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("n_tokens"))))
    rows = rows.withColumn("boundary", F.element_at(edges, F.col("bucket") + 1))
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(17))).withColumn("part", F.shiftrightunsigned(F.col("h"), 33) % F.lit(parts))
    # rank in the bucket = rows of the bucket's earlier parts + rank in the part
    before = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")
    )
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("h", "doc_id", "n_tokens")) - 1)
    rows = rows.join(before.select("bucket", "part", "before"), ["bucket", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("boundary", F.lit(1))).cast("long"))
    return rows.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(F.col("rank") / per).cast("long").alias("batch"), (F.col("rank") % per).cast("long").alias("slot"))


def op9_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
