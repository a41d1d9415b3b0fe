"""The relational forms against plain loops on random reads; the same rows for any number of partitions."""

import random

import pytest
from pyspark.sql import functions as F

from strandsift.operators.prefix import loose_heads
from strandsift.operators.exact import distinct_units
from strandsift.plans.dedup import Options, annotated


def near(a, b, d):
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= d


def loop(rows, compare, d):
    """{ord: head ord} by a scan in sorted order, with a reference that the mode replaces or not."""
    out, ref, head = {}, None, None
    for o, *s in sorted(rows, key=lambda r: (*r[1:], r[0])):
        if ref is None:
            dup = False
        elif compare == "tight":
            dup = s == ref
        elif compare == "loose":
            pre = all(a.startswith(b) or b.startswith(a) for a, b in zip(s, ref))
            longer = all(len(r) <= len(x) for r, x in zip(ref, s))
            shorter = all(len(r) > len(x) for r, x in zip(ref, s))
            dup = pre and (longer or shorter)
        else:
            dup = all(near(a, b, d) for a, b in zip(s, ref))
        if not dup:
            head, ref = o, s
        elif compare == "loose" and all(len(r) <= len(x) for r, x in zip(ref, s)):
            ref = s
        out[o] = head
    return out


@pytest.mark.parametrize("mates", [1, 2])
@pytest.mark.parametrize("compare,d", [("tight", 0), ("loose", 0), ("tail-hamming", 0), ("tail-hamming", 1), ("tail-hamming", 2)])
def test_against_loop(spark, compare, d, mates):
    rng = random.Random(f"{compare}{d}{mates}")
    rows = [(k, *("".join(rng.choice("ACG") for _ in range(rng.randint(1, 5))) for _ in range(mates))) for k in range(400)]
    df = spark.createDataFrame(rows, "ord long, s1 string" + (", s2 string" if mates == 2 else ""))
    want = loop(rows, compare, d)
    for parts in (1, 3, 8):
        got = annotated(df.repartition(parts), Options(compare=compare, distance=d))
        assert {r.ord: r.head_ord for r in got.collect()} == want


def test_loose_strategies_agree(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("AC") for _ in range(rng.randint(3, 9)))) for k in range(500)]
    units = distinct_units(spark.createDataFrame(rows, "ord long, s1 string"))
    get = lambda s: {(r.s1, r.head_ord) for r in loose_heads(units, s).collect()}
    assert get("prefix") == get("range")


@pytest.mark.parametrize("compare", ["tight", "loose", "tail-hamming"])
@pytest.mark.parametrize("mates", [1, 2])
def test_null_sequences_equal_each_other_only(spark, compare, mates):
    rows = [(0, "ACGT", "A"), (1, None, "C"), (2, None, "C"), (3, "TTTT", None), (4, "TTTT", None), (5, "", "A"), (6, None, None), (7, "GG", "A")]
    df = spark.createDataFrame([r[: mates + 1] for r in rows], "ord long, s1 string" + (", s2 string" if mates == 2 else ""))
    got = {r.ord: r.head_ord for r in annotated(df.repartition(3), Options(compare=compare, distance=1)).collect()}
    want = {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 1 if mates == 1 else 6, 7: 7}
    if compare == "loose":  # the empty read comes before ACGT and is its prefix
        want[0] = 5
    assert got == want


def test_strict_pairs(spark):
    from strandsift.plans.dedup import dedup

    reads = [spark.createDataFrame([(k, f"@{k}", "ACGT") for k in range(n)], "ord long, id string, seq string") for n in (3, 2)]
    assert dedup(*reads).summary.first().unmatched == 1
    assert dedup(reads[0], reads[0], Options(strict=True)).kept.count() == 1
    with pytest.raises(ValueError):
        dedup(*reads, Options(strict=True))


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
def test_gaps(monkeypatch, stretch):
    import pyarrow as pa

    from strandsift.operators import ordered

    monkeypatch.setattr(ordered, "_STRETCH", stretch)
    rng = random.Random(stretch)
    seqs = [None if rng.random() < 0.1 else "".join(rng.choice("AC") for _ in range(rng.choice([0, 3, 3, 3, 9]))).encode() for _ in range(300)]
    prev = [None, *seqs[:-1]]
    want = [None if a is None or b is None or len(a) != len(b) else sum(x != y for x, y in zip(a, b)) for a, b in zip(seqs, prev)]
    assert ordered._gaps(pa.array(seqs, pa.binary()), pa.array(prev, pa.binary())).to_pylist() == want


def test_empty(spark):
    df = spark.createDataFrame([], "ord long, s1 string")
    for compare in ("tight", "loose", "tail-hamming"):
        assert annotated(df, Options(compare=compare)).count() == 0


def test_stream_keeps_one_read_a_sequence(spark, tmp_path):
    from strandsift.streaming.distinct import distinct_stream

    path = str(tmp_path / "in")
    spark.createDataFrame([(k, "ACGT"[k % 3]) for k in range(30)], "ord long, seq string").write.parquet(path)
    stream = distinct_stream(spark.readStream.schema("ord long, seq string").parquet(path))
    q = stream.writeStream.format("memory").queryName("distinct_reads").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert sorted(r.seq for r in spark.table("distinct_reads").collect()) == ["A", "C", "G"]
    finally:
        q.stop()


def test_every_query_has_sql(spark):
    import __spark_entry__ as e

    from strandsift.queries import queries

    assert set(queries()) <= set(e.queries()) and set(queries()) <= set(e.oracle_sql())


@pytest.mark.parametrize("header,tag", [("@SRR.12 len=3", "12"), ("@r1 x", "r1"), ("@r1", "r1\n"), (">a b.c d", "c"), ("@", "\n")])
def test_tags(spark, header, tag):
    from strandsift.functions.tags import read_tag

    assert spark.range(1).select(read_tag(F.lit(header))).first()[0] == tag


@pytest.mark.parametrize("mates", [1, 2])
@pytest.mark.parametrize("d", [1, 2])
def test_hamming_over_many_ranges(spark, d, mates):
    """Clusters that begin in one range of the order and end in another, also past ranges without a sure break."""
    rng = random.Random(f"{d}{mates}")
    part = lambda n: "".join(rng.choice("AC") for _ in range(n))
    rows = [(k, *(rng.choice(["GGGGTTTT", "TGTGTTTT"]) + part(6) for _ in range(mates))) for k in range(150)]
    rows += [(k, *(part(rng.randint(1, 8)) for _ in range(mates))) for k in range(150, 200)]
    df = spark.createDataFrame(rows, "ord long, s1 string" + (", s2 string" if mates == 2 else ""))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        for parts in (2, 12):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = annotated(df, Options(compare="tail-hamming", distance=d))
            assert {r.ord: r.head_ord for r in got.collect()} == loop(rows, "tail-hamming", d)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("compare", ["tight", "loose", "tail-hamming"])
def test_clusters_of_pairs_read_each_side_once(spark, compare):
    from strandsift.plans.dedup import dedup

    rng = random.Random(compare)
    rows = [(k, "".join(rng.choice("ACG") for _ in range(rng.randint(8, 11))), "".join(rng.choice("AC") for _ in range(rng.randint(2, 3)))) for k in range(300)]
    rows += [(k + 300, *r[1:]) for k, r in enumerate(rows[:100])]
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def side(m):
        def count(it):
            for b in it:
                seen[m - 1].add(b.num_rows)
                yield b

        df = spark.createDataFrame([(r[0], f"@{m}.{r[0]}", r[m]) for r in rows], "ord long, id string, seq string")
        return df.mapInArrow(count, df.schema)

    got = dedup(side(1), side(2), Options(compare=compare, distance=1)).clusters.collect()
    want = loop(rows, compare, 1)
    assert sorted(map(tuple, got)) == sorted((m, h, f"@{m}.{h}", o, f"@{m}.{o}", o == h) for o, h in want.items() for m in (1, 2))
    assert [s.value for s in seen] == [len(rows)] * 2


@pytest.mark.parametrize("least", [3, 9])
def test_loose_heads_read_the_rows_once(spark, least):
    """Choice of strategy included: least length, largest prefix, windows or ranges."""
    from strandsift.plans.dedup import heads

    rng = random.Random(least)
    rows = [(k, "".join(rng.choice("AC") for _ in range(rng.randint(least, least + 2)))) for k in range(200)]
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "ord long, s1 string")
    got = heads(df.mapInArrow(count, df.schema), Options(compare="loose")).collect()
    want = loop(rows, "loose", 0)
    assert {r.ord: r.head_ord for r in got} == {r.ord: want[r.ord] for r in got}
    assert len(got) == len({s for _, s in rows}) and seen.value == len(rows)
