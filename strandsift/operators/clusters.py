"""Cluster membership and its text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def membership(annotated: DataFrame, mates: int) -> DataFrame:
    """(mate, cluster_ord, cluster_id, member_ord, member_id, is_head) of rows with ord, id1[, id2] and head_ord."""
    ids = [f"id{m}" for m in range(1, mates + 1)]
    heads = annotated.where(F.col("ord") == F.col("head_ord")).select(F.col("ord").alias("h"), *[F.col(i).alias("head_" + i) for i in ids])
    rows = annotated.join(heads, F.col("head_ord") == F.col("h"))
    # both mates from one pass over the join
    return rows.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("mate"), F.col("head_ord").alias("cluster_ord"), F.col("head_" + i).alias("cluster_id"), F.col("ord").alias("member_ord"), F.col(i).alias("member_id"), (F.col("ord") == F.col("head_ord")).alias("is_head")
                    )
                    for m, i in enumerate(ids, 1)
                ]
            )
        )
    )


def cluster_line(member_id, is_head):
    """'id' for a head, '--id' for a member."""
    return F.concat(F.when(is_head, F.lit("")).otherwise(F.lit("--")), member_id)

