"""FASTQ and single-line FASTA files as DataFrames of reads.

Plain files are cut into byte ranges that are read in parallel. A first pass
counts the line ends of every range; with the counts of the ranges before it,
each range knows the number of its first line, so records are framed exactly
(four lines, or two) wherever a range begins, with no guess from a '@', and
``ord`` is dense from 0 in file order without a sort. gzip files have a
single range. The bytes of all lines are kept as they are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandsift.schema import READ
from strandsift.shipping import ship

LINES = {"fastq": 4, "fasta": 2}
MARK = {"fastq": b"@", "fasta": b">"}
SPLIT_BYTES = 64 << 20
_BUFFER = 4 << 20
_ROWS = 8192


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(path).scheme:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _ranges(path: str, split: int) -> list[tuple[str, int, int]]:
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(f"File does not exist or cannot be opened! {path}")
    if path.endswith(".gz"):
        return [(path, 0, -1)]
    return [(path, a, min(a + split, info.size)) for a in range(0, info.size, split)]


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        n = []
        for path, start, end in zip(*(b.column(k).to_pylist() for k in range(3))):
            fs, at = _open(path)
            total = 0
            with fs.open_input_file(at) as f:
                f.seek(start)
                while start < end:
                    part = f.read(min(_BUFFER, end - start))
                    total += part.count(b"\n")
                    start += len(part)
            n.append(total)
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64())], names=["start", "n"])


def _lines(f, start: int) -> Iterator[bytes]:
    """All lines from ``start`` on, without their line feed; the caller takes as many as it owns."""
    rest = b""
    f.seek(start)
    while part := f.read(_BUFFER):
        rows = (rest + part).split(b"\n")
        rest = rows.pop()
        yield from rows
    if rest:
        yield rest


def _records(lines: Iterator[bytes], skip: int, limit: int | None, kind: str, path: str) -> Iterator[list[bytes]]:
    """Records from the ``skip``-th line on; ``limit`` of them at most."""
    n, mark = LINES[kind], MARK[kind]
    for _ in range(skip):
        next(lines, None)
    done = 0
    while limit is None or done < limit:
        first = next(lines, None)
        if first is None:
            return
        if not first.startswith(mark):
            raise ValueError(f"{path}: a record must begin with '{mark.decode()}', not with {first[:40]!r}")
        row = [first]
        for _ in range(n - 1):
            x = next(lines, None)
            if x is None:
                raise ValueError(f"{path}: the last record is cut off: {first[:40]!r}")
            row.append(x)
        if kind == "fastq" and len(row[1]) != len(row[3]):
            raise ValueError(f"{path}: sequence and quality differ in length: {first[:40]!r}")
        yield row
        done += 1


def _parse(kind: str):
    per = LINES[kind]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, start, end, first, count in zip(*(b.column(k).to_pylist() for k in range(5))):
                fs, at = _open(path)
                if end < 0:
                    with fs.open_input_stream(at, compression="gzip") as raw:
                        f = io.BufferedReader(raw, _BUFFER)
                        yield from _batches(_records((x.rstrip(b"\n") if x.endswith(b"\n") else x for x in f), 0, None, kind, path), 0, kind)
                    continue
                # The range owns the records whose first line begins in it. Its first bytes may
                # belong to a line that began before: lines are numbered by the feeds before them.
                with fs.open_input_file(at) as f:
                    middle = False
                    if start:
                        f.seek(start - 1)
                        middle = f.read(1) != b"\n"
                    number = first + (1 if middle else 0)  # of the first line that begins here
                    owned = count + (0 if middle else 1)  # lines that begin here, if a line begins after the last feed
                    if end and owned:
                        f.seek(end - 1)
                        if f.read(1) == b"\n":
                            owned -= 1
                    skip = -number % per
                    limit = -(-(owned - skip) // per) if owned > skip else 0
                    if limit > 0:
                        lines = _lines(f, start)
                        if middle:
                            next(lines, None)
                        yield from _batches(_records(lines, skip, limit, kind, path), (number + skip) // per, kind)

    return run


def _batches(records: Iterator[list[bytes]], base: int, kind: str) -> Iterator[pa.RecordBatch]:
    held: list[list[bytes]] = []

    def out() -> pa.RecordBatch:
        text = lambda k: pa.array([r[k] for r in held], pa.binary()).cast(pa.string())
        none = pa.nulls(len(held), pa.string())
        ords = pa.array(range(base, base + len(held)), pa.int64())
        cols = [ords, text(0), text(1), *((text(2), text(3)) if kind == "fastq" else (none, none))]
        return pa.RecordBatch.from_arrays(cols, names=READ.names)

    for r in records:
        held.append(r)
        if len(held) == _ROWS:
            yield out()
            base += len(held)
            held = []
    if held:
        yield out()


def read_reads(spark: SparkSession, path: str, fmt: str = "fastq", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(ord, id, seq, sep, qual) of a file. Wrapped FASTA, a bad first byte, a trailing empty line and unequal lengths are errors; an empty file has no rows."""
    if fmt not in LINES:
        raise ValueError(f"unknown format: {fmt}")
    ranges = _ranges(path, split_bytes)
    ship(spark)
    if not ranges:
        return spark.createDataFrame([], READ)
    if ranges[0][2] < 0:
        rows = [(*ranges[0], 0, 0)]
    else:
        splits = spark.createDataFrame(ranges, "path string, start bigint, end bigint").repartition(len(ranges))
        count = {r["start"]: r["n"] for r in splits.mapInArrow(_count, "start bigint, n bigint").collect()}  # a number a range
        rows, first = [], 0
        for p, a, z in ranges:
            rows.append((p, a, z, first, count[a]))
            first += count[a]
    splits = spark.createDataFrame(rows, "path string, start bigint, end bigint, first bigint, count bigint")
    if len(rows) > 1:
        splits = splits.repartitionByRange(len(rows), F.col("start"))
    return splits.mapInArrow(_parse(fmt), READ)
