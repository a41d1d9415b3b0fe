"""Command line: python -m strandsift -i in.fastq -o out.fastq [...]."""

from __future__ import annotations

import argparse
import sys

from strandsift.plans.dedup import COMPARE, Options, dedup

VERSION = "0.1.0"
MEMORY_MB = (500, 10240)


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise ValueError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="strandsift", add_help=False, description=f"strandsift {VERSION}: removes duplicate sequencing reads")
    p.add_argument("-h", "--help", action="store_true", help="show this text and exit with 1")
    p.add_argument("-v", "--verbose", action="store_true", help="print counts")
    p.add_argument("-i", "--input-1", help="first input")
    p.add_argument("-u", "--input-2", help="second input of pairs")
    p.add_argument("-o", "--output-1", help="first output")
    p.add_argument("-p", "--output-2", help="second output of pairs")
    p.add_argument("-m", "--mem-limit", type=int, default=2048, help="MB, 500 to 10240; checked only: Spark manages memory itself")
    p.add_argument("--format", default="fastq", choices=("fastq", "fasta"))
    p.add_argument("--compare-seq", choices=COMPARE, help="default: tight")
    p.add_argument("--distance", type=int, help="for tail-hamming, default 2")
    p.add_argument("--write-clusters", action="store_true", help="write <output>.clusters")
    p.add_argument("--fast", action="store_true", help="exact duplicates, in input order")
    p.add_argument("--unordered", action="store_true", help="pair the inputs by read tag")
    return p


def checked(args: argparse.Namespace) -> argparse.Namespace:
    if not args.input_1 or not args.output_1:
        raise ValueError("--input-1 and --output-1 are required")
    if bool(args.input_2) != bool(args.output_2):
        raise ValueError("--input-2 and --output-2 go together")
    if args.input_2 and (args.input_1 == args.input_2 or args.output_1 == args.output_2):
        raise ValueError("the two inputs and the two outputs must differ")
    if {args.input_1, args.input_2} & {args.output_1, args.output_2} - {None}:
        raise ValueError("an output must not be an input")
    if not MEMORY_MB[0] <= args.mem_limit <= MEMORY_MB[1]:
        raise ValueError(f"--mem-limit must lie in {MEMORY_MB[0]} to {MEMORY_MB[1]}")
    if args.distance is not None and args.distance < 0:
        raise ValueError("--distance must not be negative")
    if args.fast and (args.compare_seq or args.distance is not None or args.write_clusters):
        raise ValueError("--fast excludes --compare-seq, --distance and --write-clusters")
    if args.unordered and not (args.fast and args.input_2):
        raise ValueError("--unordered needs --fast and two inputs")
    return args


def run(args: argparse.Namespace) -> str:
    """Does the work; the summary's text."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from strandsift.operators.clusters import cluster_line, membership
    from strandsift.operators.storage import forget, materialised
    from strandsift.sources.reads import read_reads
    from strandsift.sources.sink import record_text, write_ordered

    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("strandsift").getOrCreate()
    sides = [materialised(read_reads(spark, p, args.format), "input") for p in (args.input_1, args.input_2) if p]
    for path, side in zip((args.input_1, args.input_2), sides):
        if not side.limit(1).count():
            raise ValueError(f"no record in {path}")
    options = Options(compare=args.compare_seq or "tight", distance=2 if args.distance is None else args.distance, fast=args.fast, unordered=args.unordered)
    result = dedup(sides[0], sides[1] if len(sides) > 1 else None, options)
    kept, listed = materialised(result.kept, "kept"), None
    for m, path in enumerate((args.output_1, args.output_2)[: len(sides)], 1):
        write_ordered(kept, record_text(f"r{m}", args.format), path, *result.order)
    if args.write_clusters:
        keys = [k for k in result.order if k != "ord"]
        annotated = materialised(result.annotated, "annotated")  # four readers
        listed = membership(annotated.select("ord", "head_ord", *[F.col(f"r{m}.id").alias(f"id{m}") for m in range(1, len(sides) + 1)]), len(sides))
        listed = listed.join(annotated.select(F.col("ord").alias("member_ord"), *keys), "member_ord")
        heads = annotated.where("is_head").select(F.col("ord").alias("cluster_ord"), *[F.col(k).alias("head_" + k) for k in keys])
        listed = materialised(listed.join(heads, "cluster_ord").withColumn("later", (~F.col("is_head")).cast("int")), "clusters")
        forget(annotated)
        for m, path in enumerate((args.output_1, args.output_2)[: len(sides)], 1):
            rows = listed.where(F.col("mate") == m)
            write_ordered(rows, cluster_line(F.col("member_id"), F.col("is_head")), path + ".clusters", *["head_" + k for k in keys], "cluster_ord", "later", *keys, "member_ord", packed=False)
    s = result.summary.first() if args.verbose else None
    for table in (*sides, kept, listed):
        if table is not None:
            forget(table)
    if s is None:
        return ""
    what = "reads" if len(sides) == 1 else "valid read pairs" if args.unordered else "read pairs"
    text = f"{s['total']} {what} processed, out of which {s['duplicates']} duplicates were removed."
    if args.unordered:
        text += f"\n{s['unmatched']} Non-matching entries from both files were skipped."
    return text


def main(argv: list[str] | None = None) -> int:
    """0 when all went well; 1 after the help text or any error."""
    p = parser()
    try:
        args = p.parse_args(argv)
        if args.help:
            print(p.format_help(), file=sys.stderr)
            return 1
        text = run(checked(args))
    except Exception as e:  # the command line's contract: one line and exit code 1
        print(f"error: {e}", file=sys.stderr)
        return 1
    if text:
        print(text)
    return 0
