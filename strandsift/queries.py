"""One query per operator over reads derived from the driver's tables, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.functions.sequences import hamming, is_valid, prefix_compatible, prefix_compatible_pair
from strandsift.functions.tags import read_tag
from strandsift.operators.exact import first_of_each
from strandsift.operators.storage import delete_at_end, forget, materialised, new_path
from strandsift.plans.dedup import Options, dedup
from strandsift.sources.reads import read_reads
from strandsift.sources.sink import record_text, write_ordered

_HEX, _BASES = "0123456789abcdef", "ACGT" * 4


def _dna(text: str) -> Column:
    return F.expr(f"translate(md5({text}), '{_HEX}', '{_BASES}')")


def _reads(spark: SparkSession, sf_dir: str, seq: str, mate: int = 1, header: str | None = None) -> DataFrame:
    """Reads of orders: seq is base, vseq (varying length) or hseq (varying tail)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = _dna("cast(o_custkey as string)" if mate == 1 else "concat('r', cast(o_custkey % 700 as string))")
    k = F.col("o_orderkey")
    if seq == "vseq":
        base = base.substr(F.lit(1), (24 + (k + mate - 1) % 9).cast("int"))
    elif seq == "hseq":
        one = lambda c: F.lit("ACGT").substr((1 + c).cast("int"), F.lit(1))
        base = F.concat(base.substr(1, 30), one(k % 4), one(F.expr("o_orderkey div 4") % 4)) if mate == 1 else F.concat(base.substr(1, 31), one(k % 3))
    head = F.expr(header) if header else F.concat(F.lit("@"), k.cast("string"))
    return o.select(k.alias("ord"), head.alias("id"), base.alias("seq"), F.lit("+").alias("sep"), base.alias("qual"))


def _sql(seq: str, mate: int = 1) -> str:
    base = f"translate(md5({'o_custkey::VARCHAR' if mate == 1 else 'concat(chr(114), (o_custkey % 700)::VARCHAR)'}), '{_HEX}', '{_BASES}')"
    if seq == "vseq":
        return f"substr({base}, 1, (24 + (o_orderkey + {mate - 1}) % 9)::INTEGER)"
    if seq == "hseq":
        one = lambda x: f"substr('ACGT', (1 + {x})::INTEGER, 1)"
        return f"substr({base}, 1, 30) || {one('o_orderkey % 4')} || {one('(o_orderkey // 4) % 4')}" if mate == 1 else f"substr({base}, 1, 31) || {one('o_orderkey % 3')}"
    return base


def _result(spark, sf, seq, pairs=False, **options):
    return dedup(_reads(spark, sf, seq), _reads(spark, sf, seq, 2) if pairs else None, Options(**options))


def _kept(seq: str, pairs: bool, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = _result(spark, sf_dir, seq, pairs, **options).kept
        return kept.select("ord", *(["s1", "s2"] if pairs else ["s1"]))

    return run


def _rows(seq: str, pairs: bool) -> str:
    return f"SELECT o_orderkey AS ord, {_sql(seq)} AS s1" + (f", {_sql(seq, 2)} AS s2" if pairs else "") + " FROM orders"


def _distinct_sql(seq: str, pairs: bool) -> str:
    keys = "s1, s2" if pairs else "s1"
    return f"SELECT ord, {keys} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ord) AS k FROM ({_rows(seq, pairs)})) WHERE k = 1"


def _loose_heads(pairs: bool) -> str:
    keys = ["s1", "s2"] if pairs else ["s1"]
    dup = " AND ".join(f"starts_with({k}, lag({k}) OVER w)" for k in keys)
    order = ", ".join(keys)
    return f"""a AS (SELECT *, CASE WHEN coalesce({dup}, false) THEN NULL ELSE ord END AS own FROM r WINDOW w AS (ORDER BY {order}, ord)),
h AS (SELECT *, last_value(own IGNORE NULLS) OVER (ORDER BY {order}, ord ROWS UNBOUNDED PRECEDING) AS head FROM a)"""


def _hamming_heads(pairs: bool, d: int) -> str:
    keys = ["s1", "s2"] if pairs else ["s1"]
    order = ", ".join(keys)
    far = " OR ".join(f"length(lag({k}) OVER w) <> length({k}) OR hamming(lag({k}) OVER w, {k}) > {2 * d}" for k in keys)
    near = " AND ".join(f"hamming(n.{k}, f.ref_{k}) <= {d}" for k in keys)
    refs = ", ".join(f"{k} AS ref_{k}" for k in keys)
    step = ", ".join(f"CASE WHEN {near} THEN f.ref_{k} ELSE n.{k} END" for k in keys)
    return f"""b AS (SELECT *, CASE WHEN lag(ord) OVER w IS NULL THEN 1 WHEN {far} THEN 1 ELSE 0 END AS brk FROM r WINDOW w AS (ORDER BY {order}, ord)),
s AS (SELECT *, sum(brk) OVER (ORDER BY {order}, ord ROWS UNBOUNDED PRECEDING) AS seg FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY {order}, ord) AS k FROM s),
h AS (SELECT seg, k, ord, {order}, {refs}, ord AS head FROM n WHERE k = 1
      UNION ALL SELECT n.seg, n.k, n.ord, {', '.join('n.' + k for k in keys)}, {step}, CASE WHEN {near} THEN f.head ELSE n.ord END FROM h f JOIN n ON n.seg = f.seg AND n.k = f.k + 1)"""


def _heads_sql(seq: str, pairs: bool, heads: str) -> str:
    return f"WITH RECURSIVE r AS ({_rows(seq, pairs)}), {heads} SELECT ord, {'s1, s2' if pairs else 's1'} FROM h WHERE head = ord"


def _clusters(seq: str, pairs: bool, **options):
    return lambda spark, sf: _result(spark, sf, seq, pairs, **options).clusters


def _clusters_sql(seq: str, pairs: bool, heads: str) -> str:
    one = lambda m: f"SELECT {m} AS mate, head AS cluster_ord, '@' || head AS cluster_id, ord AS member_ord, '@' || ord AS member_id, head = ord AS is_head FROM h"
    return f"WITH RECURSIVE r AS ({_rows(seq, pairs)}), {heads} {one(1)}" + (f" UNION ALL {one(2)}" if pairs else "")


def _tight_heads(pairs: bool) -> str:
    return f"h AS (SELECT *, min(ord) OVER (PARTITION BY {'s1, s2' if pairs else 's1'}) AS head FROM r)"


def _file(rows: DataFrame, read: str, fmt: str, ending: str, *order: str) -> DataFrame:
    """The reads of a column, in ``order``, as the file that they are written to holds them."""
    spark = rows.sparkSession
    path = new_path(spark, "file") + ending
    write_ordered(rows, record_text(read, fmt), path, *order)
    delete_at_end(spark, path)
    return read_reads(spark, path, fmt)


def _scan(seq: str, fmt: str, ending: str):
    """All orders' reads, written to one file by descending order number and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reads = _reads(spark, sf_dir, seq, header=f"concat('{'@' if fmt == 'fastq' else '>'}', o_orderkey, ' x')")
        back = _file(reads.select((-F.col("ord")).alias("later"), F.struct(*reads.columns).alias("r1")), "r1", fmt, ending, "later")
        return back.select("ord", "id", "seq", *(["sep", "qual"] if fmt == "fastq" else []))

    return run


def _scan_sql(seq: str, fmt: str) -> str:
    rest = f", '+' AS sep, {_sql(seq)} AS qual" if fmt == "fastq" else ""
    return f"SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS ord, '{'@' if fmt == 'fastq' else '>'}' || o_orderkey || ' x' AS id, {_sql(seq)} AS seq{rest} FROM orders"


def _written(seq: str, pairs: bool, **options):
    """The surviving reads as the output files hold them, with their place."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = _result(spark, sf_dir, seq, pairs, **options)
        kept = materialised(result.kept, "kept")
        files = [_file(kept, f"r{m}", "fastq", ".fastq", *result.order) for m in range(1, result.mates + 1)]
        forget(kept)
        out = None
        for m, f in enumerate(files, 1):
            f = f.select(F.col("ord").alias("place"), F.col("id").alias(f"id{m}"), F.col("seq").alias(f"s{m}"))
            out = f if out is None else out.join(f, "place")
        return out

    return run


def _written_sql(seq: str, pairs: bool, heads: str, order: str) -> str:
    cols = "'@' || ord AS id1, s1" + (", '@' || ord AS id2, s2" if pairs else "")
    return f"WITH RECURSIVE r AS ({_rows(seq, pairs)}), {heads} SELECT row_number() OVER (ORDER BY {order}) - 1 AS place, {cols} FROM h WHERE head = ord"


def _summary(seq: str, pairs: bool, **options):
    return lambda spark, sf: _result(spark, sf, seq, pairs, **options).summary


def _summary_sql(seq: str, pairs: bool, heads: str) -> str:
    unmatched = "0::BIGINT" if pairs else "NULL::BIGINT"
    return f"WITH RECURSIVE r AS ({_rows(seq, pairs)}), {heads} SELECT count(*) AS total, count(*) FILTER (head <> ord) AS duplicates, {unmatched} AS unmatched FROM h"


def _header(side: str, every: int) -> str:
    """Reads of two orders share a tag; one read in ``every`` has a tag that the other side lacks."""
    return f"concat('@x.', CASE WHEN o_orderkey % {every} = 0 THEN concat('{side}', o_orderkey) ELSE cast(o_orderkey div 2 as string) END, ' 1')"


def _unordered_result(spark, sf):
    left = _reads(spark, sf, "base", 1, header=_header("a", 5))
    right = _reads(spark, sf, "base", 2, header=_header("b", 7))
    return dedup(left, right, Options(fast=True, unordered=True))


def unordered_pe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unordered_result(spark, sf_dir).kept.select("tag", F.col("n").cast("int").alias("n"), F.col("r1.ord").alias("ord1"), F.col("r2.ord").alias("ord2"))


def _side_sql(name: str, ord_: str, key: str, mate: int, side: str, every: int) -> str:
    rows = f"SELECT o_orderkey AS {ord_}, {_sql('base', mate)} AS {key}, CASE WHEN o_orderkey % {every} = 0 THEN '{side}' || o_orderkey ELSE (o_orderkey // 2)::VARCHAR END AS tag FROM orders"
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY {ord_}) AS n FROM ({rows}))"


_MATCHED = f"""
{_side_sql('l', 'ord1', 's1', 1, 'a', 5)},
{_side_sql('g', 'ord2', 's2', 2, 'b', 7)},
m AS (SELECT l.tag, l.n, ord1, ord2, s1, s2 FROM l JOIN g ON l.tag = g.tag AND l.n = g.n),
k AS (SELECT *, row_number() OVER (PARTITION BY s1, s2 ORDER BY tag, n) AS first FROM m)"""

_HEADERS = "CASE o_orderkey % 4 WHEN 0 THEN concat('@SRR.', o_orderkey, ' len=9') WHEN 1 THEN concat('@r', o_orderkey, ' x') WHEN 2 THEN concat('@r', o_orderkey) ELSE concat('>a b.', o_orderkey) END"


def tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("ord"), read_tag(F.expr(_HEADERS)).alias("tag"))


_TAG_SQL = f"""
WITH h AS (SELECT o_orderkey AS ord, {_HEADERS} AS h FROM orders),
r AS (SELECT ord, CASE WHEN strpos(h, '.') > 0 THEN substr(h, strpos(h, '.') + 1) ELSE substr(h, 2) END AS r FROM h)
SELECT ord, CASE WHEN strpos(r, ' ') > 0 THEN split_part(r, ' ', 1) ELSE r || chr(10) END AS tag FROM r"""

_ODD = "CASE WHEN o_orderkey % 11 = 0 THEN concat({0}, 'acgt') WHEN o_orderkey % 13 = 0 THEN concat({0}, 'N') WHEN o_orderkey % 17 = 0 THEN '' ELSE {0} END"


def alphabet_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = _ODD.format(f"translate(md5(cast(o_custkey as string)), '{_HEX}', '{_BASES}')")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("ord"), is_valid(F.expr(seq)).alias("valid"))


def hamming_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _reads(spark, sf_dir, "base"), _reads(spark, sf_dir, "base", 2)
    both = left.select("ord", F.col("seq").alias("a")).join(right.select("ord", F.col("seq").alias("b")), "ord")
    return both.select("ord", hamming(F.col("a"), F.col("b")).alias("distance"))


def prefix_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose comparison of each read with another of its customer's length and letters, cut or changed by the order's number, single and as pairs."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, b, c, d = (F.expr(x) for x in _PREFIX_READS)
    return o.select(
        F.col("o_orderkey").alias("ord"), prefix_compatible(a, b).alias("own"), prefix_compatible(c, d).alias("mate"), prefix_compatible_pair(a, c, b, d).alias("pair"), prefix_compatible_pair(a, d, b, c).alias("crossed")
    )


def _prefix_reads(base: str, key: str) -> list[str]:
    part = lambda k, m: f"substr({base}, 1, cast(20 + ({key} + {k}) % {m} as int))"
    odd = lambda x, m: f"CASE WHEN {key} % {m} = 0 THEN concat('T', {x}) ELSE {x} END"
    return [part(0, 9), odd(part(3, 7), 3), part(1, 5), odd(part(2, 11), 4)]


_PREFIX_READS = _prefix_reads(f"translate(md5(cast(o_custkey as string)), '{_HEX}', '{_BASES}')", "o_orderkey")


def _prefix_sql() -> str:
    a, b, c, d = _prefix_reads(_sql("base"), "o_orderkey")
    both = "(starts_with({0}, {1}) OR starts_with({1}, {0}))"
    # of a pair, both reads of the first side extend or equal those of the second, or both of the second are longer
    pair = "((starts_with({0}, {2}) AND starts_with({1}, {3})) OR (starts_with({2}, {0}) AND starts_with({3}, {1}) AND length({2}) > length({0}) AND length({3}) > length({1})))"
    rows = f"SELECT o_orderkey AS ord, {a} AS a, {b} AS b, {c} AS c, {d} AS d FROM orders"
    return f"SELECT ord, {both.format('a', 'b')} AS own, {both.format('c', 'd')} AS mate, {pair.format('a', 'c', 'b', 'd')} AS pair, {pair.format('a', 'd', 'b', 'c')} AS crossed FROM ({rows})"


_PREFIX_SQL = _prefix_sql()


def dedup_documents_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ord"), F.col("text").alias("s1"))
    return first_of_each(d).select(F.col("ord").alias("doc_id"))


def zip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _result(spark, sf_dir, "base", True, fast=True).rows
    return rows.select("ord", "s1", "s2")


def events_fast_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = _dna("concat(event_type, cast(user_id as string))")
    return first_of_each(e.select(F.col("event_id").alias("ord"), seq.alias("s1")), validate=True).select("ord", "s1")


_EVENTS_SQL = f"""SELECT ord, s1 FROM (SELECT event_id AS ord, translate(md5(event_type || user_id::VARCHAR), '{_HEX}', '{_BASES}') AS s1 FROM events)
QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY ord) = 1"""

#: name: (query, SQL)
_ALL = {
    "fast_se": (_kept("base", False, fast=True), _distinct_sql("base", False)),
    "fast_pe": (_kept("base", True, fast=True), _distinct_sql("base", True)),
    "tight_se": (_kept("vseq", False), _distinct_sql("vseq", False)),
    "tight_pe": (_kept("vseq", True), _distinct_sql("vseq", True)),
    "loose_se": (_kept("vseq", False, compare="loose"), _heads_sql("vseq", False, _loose_heads(False))),
    "loose_pe": (_kept("vseq", True, compare="loose"), _heads_sql("vseq", True, _loose_heads(True))),
    "hamming_se_d1": (_kept("hseq", False, compare="tail-hamming", distance=1), _heads_sql("hseq", False, _hamming_heads(False, 1))),
    "hamming_se_d2": (_kept("hseq", False, compare="tail-hamming", distance=2), _heads_sql("hseq", False, _hamming_heads(False, 2))),
    "hamming_pe_d1": (_kept("hseq", True, compare="tail-hamming", distance=1), _heads_sql("hseq", True, _hamming_heads(True, 1))),
    "clusters_tight": (_clusters("base", False), _clusters_sql("base", False, _tight_heads(False))),
    "clusters_tight_pe": (_clusters("base", True), _clusters_sql("base", True, _tight_heads(True))),
    "clusters_loose": (_clusters("vseq", False, compare="loose"), _clusters_sql("vseq", False, _loose_heads(False))),
    "clusters_loose_pe": (_clusters("vseq", True, compare="loose"), _clusters_sql("vseq", True, _loose_heads(True))),
    "clusters_hamming": (_clusters("hseq", False, compare="tail-hamming", distance=1), _clusters_sql("hseq", False, _hamming_heads(False, 1))),
    "clusters_hamming_pe": (_clusters("hseq", True, compare="tail-hamming", distance=1), _clusters_sql("hseq", True, _hamming_heads(True, 1))),
    "scan_fastq": (_scan("vseq", "fastq", ".fastq"), _scan_sql("vseq", "fastq")),
    "scan_fastq_gzip": (_scan("vseq", "fastq", ".fastq.gz"), _scan_sql("vseq", "fastq")),
    "scan_fasta": (_scan("base", "fasta", ".fa"), _scan_sql("base", "fasta")),
    "written_fast_se": (_written("base", False, fast=True), _written_sql("base", False, _tight_heads(False), "ord")),
    "written_tight_se": (_written("vseq", False), _written_sql("vseq", False, _tight_heads(False), "s1, ord")),
    "written_loose_pe": (_written("vseq", True, compare="loose"), _written_sql("vseq", True, _loose_heads(True), "s1, s2, ord")),
    "unordered_pe": (unordered_pe, f"WITH {_MATCHED} SELECT tag, n::INTEGER AS n, ord1, ord2 FROM k WHERE first = 1"),
    "zip_pairs": (zip_pairs, _rows("base", True)),
    "tag_extract": (tag_extract, _TAG_SQL),
    "alphabet_check": (alphabet_check, f"SELECT o_orderkey AS ord, regexp_full_match({_ODD.format(_sql('base'))}, '[ACGTN]*') AS valid FROM orders"),
    "hamming_distance": (hamming_distance, f"SELECT o_orderkey AS ord, hamming({_sql('base')}, {_sql('base', 2)})::INTEGER AS distance FROM orders"),
    "prefix_test": (prefix_test, _PREFIX_SQL),
    "summary_tight_se": (_summary("base", False), _summary_sql("base", False, _tight_heads(False))),
    "summary_loose_pe": (_summary("vseq", True, compare="loose"), _summary_sql("vseq", True, _loose_heads(True))),
    "summary_hamming_se": (_summary("hseq", False, compare="tail-hamming", distance=1), _summary_sql("hseq", False, _hamming_heads(False, 1))),
    "summary_unordered_pe": (
        lambda spark, sf: _unordered_result(spark, sf).summary,
        f"WITH {_MATCHED} SELECT count(*) AS total, count(*) FILTER (first > 1) AS duplicates, (SELECT count(*) FROM l) + (SELECT count(*) FROM g) - 2 * count(*) AS unmatched FROM k",
    ),
    "dedup_documents_exact": (dedup_documents_exact, "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"),
    "events_fast_se": (events_fast_se, _EVENTS_SQL),
}


def queries() -> dict:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items()}
