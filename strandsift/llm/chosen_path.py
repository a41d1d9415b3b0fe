"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its word shingles, hashed to 64 bits; equal sets are
one node from the start. Documents are branched by minwise tokens: a tree's
root picks positions of the signature, and all documents that hold the same
token there meet in a child; a child that holds too many documents, and fewer
than its parent did, picks positions of its own and branches again. The documents
of a small node, or of one that branching does not shrink, are compared by
their signatures; independent trees repeat this until the recall is met.

What may be linked forms loose clusters. Inside a cluster, full sets decide:
linked are documents whose sets meet the similarity exactly. Components of
linked documents are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import field, forget, materialised, scratch, sliced, texts, tidied, tuned
from strandsift.llm.components import places, spanning_links

#: Tokens of a signature, independent trees, positions that a node picks.
TOKENS, TREES, CHILDREN = 64, 4, 2
#: A node of up to LEAF documents is compared, as is one that keeps SHRINK of its parent or lies DEPTH deep.
LEAF, SHRINK, DEPTH = 64, 0.7, 8
#: Signatures must agree in the similarity less SLACK standard deviations.
SLACK = 4.0

_U = np.uint64
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) << _U(1)) | _U(1)
_B = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Hashed sets of word shingles. Words are runs without ASCII white space, A-Z in lower case."""

    def __init__(self, width: int):
        self.width, self.memo, self.held = width, {}, 0

    def __call__(self, text: str) -> np.ndarray:
        """The sorted hashes of the distinct shingles; of a shorter text, its whole sequence; none without words."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > 300_000 or self.held > 32 << 20:  # words that are remembered, and their bytes
            memo.clear()
            self.held = 0
        new = set(words).difference(memo)
        self.held += sum(map(len, new))
        memo.update(zip(new, map(xxhash.xxh3_64_intdigest, new)))
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
        w = min(self.width, n)
        out = np.full(n - w + 1, w, np.uint64)
        for k in range(w):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : n - w + 1 + k])
        return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens of a set, 32 bits each."""
    best = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 4096):
        part = s[i : i + 4096, None] * _A[None, :] + _B[None, :]
        best = np.minimum(best, (part >> _U(32)).astype(np.uint32).min(0))
    return best


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signed(width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in sliced(it):
            n, h1, h2, sig = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle(t)
                n.append(len(s))
                a, z = _digest(s)
                h1.append(a)
                h2.append(z)
                sig.append(signature(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"]
            )

    return run


def _children(level: int):
    """mapInArrow from (grp, size, id, sig) to (grp, up, id): the nodes below, and how many documents their parent held."""
    picks = CHILDREN

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            grp = b.column(0).to_numpy().view(np.uint64)
            sig = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).reshape(-1, TOKENS)
            rows = np.arange(len(sig))
            keys = []
            for k in range(picks):  # a tree's first positions follow those of the tree before; a node's are drawn by its key
                if level:
                    drawn = _mix(grp + _U(level))
                    at = (drawn + _U(k) * (_mix(drawn) | _U(1))) % _U(TOKENS)
                else:
                    at = (grp * _U(picks) + _U(k)) % _U(TOKENS)
                keys.append(_mix(_mix(grp + _U(k + 1) * _U(0x632BE59BD9B4E019)) + sig[rows, at.astype(np.int64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.concat_arrays([b.column(1)] * picks), pa.concat_arrays([b.column(2)] * picks)], names=["grp", "up", "id"]
            )

    return run


def _by_signature(least: float, ratio: float):
    def of(ns: np.ndarray, data: list[bytes]):
        sig = np.frombuffer(b"".join(data), np.uint32).reshape(-1, TOKENS)
        return lambda i: ((sig == sig[i]).mean(1) >= least) & (np.minimum(ns, ns[i]) >= ratio * np.maximum(ns, ns[i]))

    return of


def _by_set(percent: int):
    def of(ns: np.ndarray, data: list[bytes]):
        flat = np.frombuffer(b"".join(data), np.uint64)
        _, at = np.unique(flat, return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(ns)[:-1]))
        ends = starts + ns
        on = np.zeros(int(at.max()) + 1, bool)

        def near(i: int) -> np.ndarray:
            own = at[starts[i] : ends[i]]
            on[own] = True
            both = np.add.reduceat(on[at].astype(np.int64), starts)
            on[own] = False
            return 100 * both >= percent * (ns + ns[i] - both)

        return near

    return of


def _by_prefix(percent: int):
    """For spanning_links: which tokens of a set decide. Tokens that few pivots hold come first.

    Of two linked sets, the first token in this order that both hold stands
    at place p of a set of n, so that they share n - p tokens at most;
    100 * common >= percent * all bounds p, and the other's size.
    """

    def of(pivots: list[bytes]):
        common, count = np.unique(np.frombuffer(b"".join(pivots), np.uint64), return_counts=True)

        def order(data: bytes) -> tuple[list[int], list[int]]:
            s = np.frombuffer(data, np.uint64)
            n = len(s)
            known = np.zeros(n, np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                known = np.where(common[at] == s, count[at], 0)
            first = np.lexsort((s, known))[: n - (percent * n + 99) // 100 + 1]
            most = ((n - np.arange(len(first))) * (100 + percent) - percent * n) // percent
            return s[first].view(np.int64).tolist(), most.tolist()

        return order

    return of


def _sets(width: int):
    """mapInArrow from (id, text, grp, size, bytes, node, h1, h2) to the sets of the nodes' texts; other texts of the same id go."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in sliced(it):
            sets = [shingle(t) for t in b.column(1).to_pylist()]
            own = [_digest(s) == h for s, h in zip(sets, zip(b.column(6).to_pylist(), b.column(7).to_pylist()))]
            n, data = pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())
            out = pa.RecordBatch.from_arrays([b.column(2), b.column(5), n, data, b.column(3), b.column(4)], names=["grp", "id", "n", "data", "size", "bytes"])
            yield out.filter(pa.array(own, pa.bool_()))

    return run


def _loose_links(reps: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect all nodes (id, n, sig) that some tree brings together and whose signatures are alike."""
    j = percent / 100
    least = j - SLACK * float(np.sqrt(j * (1 - j) / TOKENS))
    near_of = _by_signature(least, j)
    level = 0
    # the roots: every document stands in each tree
    nodes = reps.select(F.explode(F.array(*[F.lit(t).cast("long") for t in range(TREES)])).alias("grp"), F.lit(-1).cast("long").alias("size"), "id", "sig")
    found = []
    while True:
        keys = materialised(nodes.mapInArrow(tidied(_children(level)), "grp bigint, up bigint, id bigint"), "nodes")
        # a table of its own: a join of two plain exchanges is one whose hot keys can be split
        sizes = materialised(keys.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.max("up").alias("up")).where("size > 1"), "sizes")
        met = keys.select("grp", "id").join(sizes, "grp")
        met = materialised(met.join(reps, "id").select("grp", "size", "up", "id", "n", "sig"), "met")
        forget(keys)
        level += 1
        final = F.lit(True) if level >= DEPTH else (F.col("size") <= LEAF) | ((F.col("up") > 0) & (F.col("size") >= SHRINK * F.col("up")))
        found.append(met.where(final).select("grp", "id", "n", F.col("sig").alias("data"), "size", (F.col("size") * (4 * TOKENS)).alias("bytes")))
        nodes = met.where(~final).select("grp", "size", "id", "sig")
        if level >= DEPTH or nodes.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return spanning_links(out, near_of)


def groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): linked are documents with 100 * common >= percent * all shingles.

    component_id is the smallest doc_id that links reach. Null and empty
    texts have no shingles, are linked with nothing and stay (kept). Rows
    without id take no part. Rows that share an id are linked, whatever their
    texts (but for texts without shingles), and are one result each. Very
    long texts count whole; blocks of them are cut by bytes. An empty table
    gives an empty one.
    """
    tuned(docs.sparkSession)
    with scratch() as keep:
        return _groups(texts(docs, id_col, text_col), width, percent, keep)


def _groups(all_texts: DataFrame, width: int, percent: int, keep) -> DataFrame:
    signed = materialised(all_texts.mapInArrow(tidied(_signed(width)), "doc_id bigint, n bigint, h1 bigint, h2 bigint, sig binary"), "signed")
    # documents of one set are one node; minima are formed before the shuffle, whatever the copies
    same = signed.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id())
    same = materialised(same, "same")
    key = ["h1", "h2", "n"]
    placed = keep(materialised(signed.select("doc_id", *key).join(same, key, "left").select("doc_id", "n", "node", "rep"), "placed"))
    own = signed.withColumnRenamed("doc_id", "rep").join(same, [*key, "rep"]).dropDuplicates([*key, "rep"])
    reps = materialised(own.select(F.col("node").alias("id"), "n", "sig"), "reps")
    clusters = places(_loose_links(reps, percent))
    sizes = materialised(clusters.join(reps.select("id", "n"), "id").groupBy("up").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("n") * 8).alias("bytes")), "sizes")
    members = clusters.join(sizes, "up").join(same, F.col("id") == F.col("node"))
    members = materialised(members.select(F.col("rep").alias("doc_id"), F.col("up").alias("grp"), "size", "bytes", "node", "h1", "h2"), "members")
    # by sorting at any size, so that the disk taken grows with the texts from the start
    chosen = all_texts.join(members.hint("merge"), "doc_id").select("doc_id", "text", "grp", "size", "bytes", "node", "h1", "h2")
    sets = materialised(chosen.mapInArrow(tidied(_sets(width)), "grp bigint, id bigint, n bigint, data binary, size bigint, bytes bigint"), "sets")
    links = spanning_links(sets, _by_set(percent), _by_prefix(percent))
    # the nodes of one id
    several = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    several = materialised(several.select("doc_id", "a"), "several")
    links = links.union(several.join(placed, "doc_id").select("a", F.col("node").alias("b")))
    comps = materialised(places(links).join(same.select(F.col("node").alias("id"), "rep"), "id").select("id", "up", "rep"), "comps")
    least = materialised(comps.groupBy("up").agg(F.min("rep").alias("first")), "least")
    firsts = keep(materialised(comps.join(least, "up").select(F.col("id").alias("node"), "first"), "firsts"))
    comp = F.coalesce("first", "rep", "doc_id").alias("component_id")
    return placed.join(firsts, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), comp).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their group, with all their columns; rows without id stay, rows that share an id go together."""
    out = groups(docs, width, percent, id_col, text_col)
    gone = out.where(~F.col("kept")).select(F.col("doc_id").alias("__path_gone")).distinct()
    return docs.join(gone, field(id_col).cast("long") == F.col("__path_gone"), "left_anti")


def op7_chosen_path(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
