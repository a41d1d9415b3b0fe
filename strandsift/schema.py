"""Fixed schemas: reads, pairs, clusters, summary."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

READ = StructType(
    [
        StructField("ord", LongType(), False),
        StructField("id", StringType(), False),
        StructField("seq", StringType(), False),
        StructField("sep", StringType()),
        StructField("qual", StringType()),
    ]
)
READ_PAIR = StructType([StructField("ord", LongType(), False), StructField("r1", READ, False), StructField("r2", READ, False)])
CLUSTERS = StructType(
    [
        StructField("mate", IntegerType(), False),
        StructField("cluster_ord", LongType(), False),
        StructField("cluster_id", StringType(), False),
        StructField("member_ord", LongType(), False),
        StructField("member_id", StringType(), False),
        StructField("is_head", BooleanType(), False),
    ]
)
SUMMARY = StructType([StructField("total", LongType(), False), StructField("duplicates", LongType(), False), StructField("unmatched", LongType())])
