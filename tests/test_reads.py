"""Golden outputs, byte for byte, and error paths, through the command line."""

import gzip

import pytest

from strandsift.cli import main

A = "0001:ATGCTAGCTA 0002:CGTACGTAGC 0003:TTGACCGTAA 0004:ATGCTAGCTA 0005:GGCATACGTT 0006:CGTACGTAGC 0007:AACGTTGGCA 0008:TTGACCGTAA 0009:TTAACCGGTT 0010:GGCATACGTT"
B = "0001:TAGCTAGCAT 0002:GCTACGTACG 0003:TTACGGTCAA 0004:TAGCTAGCAA 0005:AACGTATGCC 0006:GCTACGTACG 0007:TGCCAACGTT 0008:TTACGGTCAA 0009:AACCGGTTAA 0010:AACGTATGCC"


def records(text, ids=None):
    rows = [x.split(":") for x in text.split()]
    if ids is not None:
        d = dict(rows)
        rows = [(i, d[i]) for i in ids]
    return rows


def fasta(rows):
    return "".join(f">{i}\n{s}\n" for i, s in rows)


def fastq(rows):
    return "".join(f"@{i}\n{s}\n+junk {i}\n{'@' * len(s)}\n" for i, s in rows)


def number(*ks):
    return [f"{k:04d}" for k in ks]


def run(tmp, left, right=None, args=(), fmt="fasta", ending=".fa"):
    make = fasta if fmt == "fasta" else fastq
    argv = ["--format", fmt, *args]
    for k, (rows, i, o) in enumerate(((left, "-i", "-o"), (right, "-u", "-p"))):
        if rows is None:
            continue
        path = tmp / f"in{k}{ending}"
        data = rows if isinstance(rows, bytes) else make(rows).encode()
        path.write_bytes(gzip.compress(data) if ending.endswith(".gz") else data)
        argv += [i, str(path), o, str(tmp / f"out{k}{ending}")]
    code = main(argv)
    read = lambda p: (gzip.decompress(p.read_bytes()) if ending.endswith(".gz") else p.read_bytes()).decode()
    return code, [read(p) for k in (0, 1) if (p := tmp / f"out{k}{ending}").exists()]


TIGHT = records("00001:GGATAGA 00002:GGATAGA 00003:GGATCGA")
LOOSE = records("00001:GGATAGA 00002:GGATAGACCT 00003:GGATCGA 00004:GGATAGACCTG")
HAMMING = records("00001:GGATAGA 00002:GGATAGT 00003:GGATATC 00004:TGATAGA")


@pytest.mark.parametrize(
    "rows,args,kept",
    [
        (TIGHT, [], ["00001", "00003"]),
        (LOOSE, ["--compare-seq", "loose"], ["00001", "00003"]),
        (HAMMING, ["--compare-seq", "tail-hamming", "--distance", "1"], ["00001", "00003", "00004"]),
        (HAMMING[:1] + HAMMING[3:], ["--compare-seq", "tail-hamming", "--distance", "1"], ["00001"]),
        (records("1:A 2:AC 3:ACG 4:AG"), ["--compare-seq", "loose"], ["1", "4"]),
        (records("1:AAAA 2:AAAAC 3:AAAT"), ["--compare-seq", "tail-hamming", "--distance", "1"], ["1", "2", "3"]),
        (records(A), ["--fast"], number(1, 2, 3, 5, 7, 9)),
    ],
)
def test_single(spark, tmp_path, rows, args, kept):
    code, (out,) = run(tmp_path, rows, args=args)
    assert code == 0
    d = dict(rows)
    assert out == fasta([(i, d[i]) for i in kept])


def test_paired_tight(spark, tmp_path):
    r1 = records("00001:GGATAGA 00002:GGATAGA 00003:GGATAGA 00004:GGATCGA")
    r2 = records("00001:TCAGATT 00002:TCAGATT 00003:GCAGATT 00004:TCACCTT")
    code, outs = run(tmp_path, r1, r2)
    assert code == 0
    assert outs == [fasta([(i, dict(r)[i]) for i in ("00003", "00001", "00004")]) for r in (r1, r2)]


@pytest.mark.parametrize("fmt,ending", [("fasta", ".fa"), ("fastq", ".fq"), ("fastq", ".fq.gz")])
def test_paired_fast(spark, tmp_path, fmt, ending):
    code, outs = run(tmp_path, records(A), records(B), ["--fast"], fmt, ending)
    assert code == 0
    make = fasta if fmt == "fasta" else fastq
    assert outs == [make(records(x, number(1, 2, 3, 4, 5, 7, 9))) for x in (A, B)]


@pytest.mark.parametrize(
    "left,right,kept",
    [
        (range(1, 11), (4, 7, 5, 2, 3, 1, 6, 10, 8, 9), (1, 2, 3, 4, 5, 7, 9)),
        (range(1, 11), range(4, 11), (4, 5, 6, 7, 8, 9)),
        ((1, 2, 3, 7, 8, 9, 10), range(1, 11), (1, 2, 3, 7, 9, 10)),
        ((1, 2, 3, 8, 9, 10), range(3, 9), (3,)),
        (range(1, 6), range(6, 11), ()),
        ((1, 5), (2, 3, 5), (5,)),
    ],
)
def test_unordered(spark, tmp_path, left, right, kept):
    code, outs = run(tmp_path, records(A, number(*left)), records(B, number(*right)), ["--fast", "--unordered"])
    assert code == 0
    assert outs == [fasta(records(x, number(*kept))) for x in (A, B)]


def test_repeated_tags_pair_one_to_one(spark, tmp_path, capsys):
    code, outs = run(tmp_path, [("1", "AA"), ("1", "CC")], [("1", "GG"), ("1", "TT"), ("1", "AC")], ["--fast", "--unordered", "-v"])
    assert code == 0
    assert outs[0].count(">") == 2
    assert "2 valid read pairs processed, out of which 0 duplicates" in (text := capsys.readouterr().out) and "1 Non-matching" in text


@pytest.mark.parametrize("args,rows,want", [(["--compare-seq", "loose"], LOOSE, ">00001\n-->00002\n-->00004\n>00003\n"), (["--compare-seq", "tail-hamming", "--distance", "1"], HAMMING, ">00001\n-->00002\n>00003\n>00004\n"), ([], TIGHT, ">00001\n-->00002\n>00003\n")])
def test_clusters(spark, tmp_path, args, rows, want):
    code, _ = run(tmp_path, rows, args=[*args, "--write-clusters"])
    assert code == 0
    assert (tmp_path / "out0.fa.clusters").read_text() == want


def test_loose_pairs_compare_with_the_neighbour(spark, tmp_path):
    left, right = [("1", "A"), ("2", "AC"), ("3", "ACG")], [("1", "GATT"), ("2", "CCCC"), ("3", "GATTA")]
    code, outs = run(tmp_path, left, right, ["--compare-seq", "loose"])
    assert code == 0 and outs[0] == fasta(left)


@pytest.mark.parametrize(
    "data,args",
    [
        (b">1\nacgt\n", ["--fast"]),
        (b">1\nACGT\r\n", ["--fast"]),
        (b"1\nACGT\n", []),
        (b">1\nACGT\n\n", []),
        (b">1\nACGT\nACGT\n", []),
        (b"", []),
        (b">1\nACGT\n", ["--mem-limit", "100"]),
        (b">1\nACGT\n", ["--fast", "--distance", "1"]),
        (b">1\nACGT\n", ["--fast", "--write-clusters"]),
        (b">1\nACGT\n", ["--unordered", "--fast"]),
        (b">1\nACGT\n", ["--compare-seq", "none"]),
    ],
)
def test_errors(spark, tmp_path, data, args, capsys):
    code, _ = run(tmp_path, data, args=args)
    assert code == 1
    assert capsys.readouterr().err


def test_fastq_errors(spark, tmp_path):
    assert run(tmp_path, b"@1\nACGT\n+\n###\n", fmt="fastq")[0] == 1
    assert run(tmp_path, b"@1\nACGT\n+\n", fmt="fastq")[0] == 1


def test_same_paths_and_missing_file(spark, tmp_path):
    assert main(["-i", "a", "-u", "a", "-o", "b", "-p", "c"]) == 1
    assert main(["-i", "a", "-u", "b", "-o", "c", "-p", "c"]) == 1
    assert main(["-i", "a", "-u", "b", "-o", "c"]) == 1
    assert main(["-o", "c"]) == 1
    assert main(["-i", str(tmp_path / "none.fa"), "-o", str(tmp_path / "x.fa")]) == 1


def test_help(capsys):
    assert main(["-h"]) == 1
    assert capsys.readouterr().err.startswith("usage: strandsift")


def test_no_final_line_feed_keeps_the_last_record(spark, tmp_path):
    code, (out,) = run(tmp_path, b">1\nAC\n>2\nGT")
    assert code == 0 and out == ">1\nAC\n>2\nGT\n"


@pytest.mark.parametrize("fmt", ["fasta", "fastq"])
@pytest.mark.parametrize("split", [1, 7, 23, 64, 1000])
@pytest.mark.parametrize("final", [True, False])
def test_byte_ranges_frame_every_record_once(spark, tmp_path, fmt, split, final):
    from strandsift.sources.reads import read_reads

    rows = [(f"{i}", "ACGT"[i % 4] * (i % 5 + (fmt == "fasta"))) for i in range(9)]
    text = (fasta if fmt == "fasta" else fastq)(rows)
    path = tmp_path / "x"
    path.write_text(text if final else text[:-1])
    if not final and text.endswith("\n\n"):
        return
    got = read_reads(spark, str(path), fmt, split if split > 5 else split * 40).orderBy("ord").collect()
    assert [(r.ord, r.id[1:], r.seq) for r in got] == [(k, i, s) for k, (i, s) in enumerate(rows)]
