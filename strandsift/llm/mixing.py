"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Source s holds a share of the corpus' characters; its target weight asks for
another. Every document of s is repeated Poisson(rate_s) times, where
rate_s = target share * corpus characters / characters of s, so that the
expected characters per source meet the targets and the corpus keeps its
size. The draw inverts the Poisson distribution function at a uniform number
that is a hash of (seed, doc_id): no random state, the same result on every
run and retry. Copies are then dealt to partitions by another hash and sorted
by it inside them, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import field, materialised

SEED = "mix-1"
#: Targets are (share of characters) ** EXPONENT, normalised: small sources gain, large ones lose.
EXPONENT = 0.7


def _uniform(seed: str, *parts: Column) -> Column:
    """52 bits of an md5 as a number in [0, 1): the same in any engine that has md5."""
    text = F.concat_ws("|", F.lit(seed), *parts)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: DataFrame | None = None, exponent: float = EXPONENT) -> DataFrame:
    """(source, n_docs, n_chars, target, rate, cdf): one row a source.

    ``weights`` (source, weight) names the targets; without it they follow
    ``exponent``. Sources that it does not name get rate 0. cdf[k] is
    P(count <= k) up to the last k that a double tells from 1.
    """
    per = docs.groupBy(F.coalesce(field(source_col).cast("string"), F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.length(field(text_col).cast("string")), F.lit(0)).cast("long")).alias("n_chars")
    )
    if weights is None:
        per = per.withColumn("weight", F.pow(F.col("n_chars").cast("double"), F.lit(float(exponent))))
    else:
        w = weights.select(field("source").cast("string").alias("source"), field("weight").cast("double").alias("weight"))
        per = per.join(w, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    per = materialised(per, "sources")  # one row a source; the corpus is read once for it
    all_chars, all_weight = per.agg(F.sum("n_chars"), F.sum("weight")).first()
    per = per.withColumn("all_chars", F.lit(all_chars or 0)).withColumn("target", F.col("weight") / F.lit(all_weight) if all_weight else F.lit(0.0))
    # a source without any text cannot meet a share of characters: its documents are drawn once each
    per = per.withColumn("rate", F.when(F.col("n_chars") > 0, F.col("target") * F.col("all_chars") / F.col("n_chars")).otherwise(1.0))
    # log-probabilities by their recurrence, then their running sum
    per = per.withColumn(
        "cdf",
        F.expr(
            """aggregate(
                sequence(0, cast(ceil(rate + 12 * sqrt(rate) + 30) as int)),
                named_struct('out', cast(array() as array<double>), 'logp', -rate, 'sum', cast(0 as double)),
                (s, k) -> named_struct(
                    'out', array_append(s.out, s.sum + exp(s.logp)),
                    'logp', s.logp + ln(rate) - ln(k + 1),
                    'sum', s.sum + exp(s.logp)),
                s -> s.out)"""
        ),
    ).withColumn("cdf", F.when(F.col("n_chars") == 0, F.array(F.lit(0.0), F.lit(1.0))).when(F.col("rate") > 0, F.col("cdf")).otherwise(F.array(F.lit(1.0))))
    return per.select("source", "n_docs", "n_chars", "target", "rate", "cdf")


def replicate(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: DataFrame | None = None, exponent: float = EXPONENT, seed: str = SEED
) -> DataFrame:
    """The rows of ``docs``, each as often as its draw says, with ``copy`` (from 1) and ``shuffle_key``, in shuffled order.

    All columns of the input are kept (one named copy or shuffle_key is
    replaced). Null sources are one source of their own (''), null texts are
    empty; rows without id take no part; repeated rows share one draw and
    are repeated each; documents of a source without any text stay once; an
    empty table gives an empty one.
    """
    docs = docs.where(field(id_col).isNotNull())
    table = rates(docs, source_col, text_col, weights, exponent).select(F.col("source").alias("__mix_source"), F.col("cdf").alias("__mix_cdf"))
    keep = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key", "__mix_source", "__mix_cdf", "__mix_u")]
    # the draw is made before the join: inside the filter it would be made anew for each element
    drawn = docs.withColumn("__mix_source", F.coalesce(field(source_col).cast("string"), F.lit(""))).withColumn("__mix_u", _uniform(seed, field(id_col).cast("string")))
    out = drawn.join(table, "__mix_source")
    count = F.size(F.filter(F.col("__mix_cdf"), lambda p: p <= F.col("__mix_u")))
    out = out.withColumn("__mix_n", count).where(F.col("__mix_n") > 0)
    out = out.select(*[field(c) for c in keep], F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias("copy"))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed + "-order"), field(id_col).cast("string"), F.col("copy").cast("string"))))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op10_poisson_mix(spark, sf_dir: str) -> DataFrame:
    return replicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rows by another engine's functions.
OP10_SQL = f"""
WITH docs AS (SELECT *, coalesce(source, '') AS src FROM documents WHERE doc_id IS NOT NULL),
per AS (SELECT src, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM docs GROUP BY src),
tgt AS (SELECT src, chars, pow(chars, {EXPONENT}) / sum(pow(chars, {EXPONENT})) OVER () AS target, sum(chars) OVER () AS all_chars FROM per),
rate AS (SELECT src, chars, CASE WHEN chars > 0 THEN target * all_chars / chars ELSE 1.0 END AS r FROM tgt),
pmf AS (SELECT src, k, CASE WHEN chars > 0 THEN exp(-r + k * ln(r) - lgamma(k + 1)) ELSE (k = 1)::INTEGER END AS p
        FROM rate, LATERAL (SELECT unnest(generate_series(0, ceil(r + 12 * sqrt(r) + 30)::BIGINT)) AS k) WHERE r > 0),
cdf AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM pmf),
drawn AS (SELECT d.doc_id AS id, d.src AS s, ('0x' || substr(md5('{SEED}|' || d.doc_id), 1, 13))::BIGINT / {2**52}.0 AS u FROM (SELECT DISTINCT doc_id, src FROM docs) d),
n AS (SELECT id, s, count(*) AS times FROM drawn JOIN cdf ON cdf.src = s AND cdf.c <= u GROUP BY id, s)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INTEGER AS copy,
       md5('{SEED}-order|' || d.doc_id || '|' || c.copy) AS shuffle_key
FROM docs d JOIN n ON n.id = d.doc_id AND n.s = d.src, LATERAL (SELECT unnest(generate_series(1, n.times)) AS copy) c
"""
