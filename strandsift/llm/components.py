"""Connected components, and links inside groups of any size without all their pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandsift.llm.common import forget, materialised, scratch, tidied

#: Rows of a block, and bytes of its data, about; two blocks are compared in memory at a time.
BLOCK, BLOCK_BYTES = 64, 16 << 20
#: Blocks that make one wide block, in which the rest of a group meets the group.
WIDE = 4

#: For items with sizes and data: a function of an item that marks the items that it is linked with.
Near = Callable[[np.ndarray, list[bytes]], Callable[[int], np.ndarray]]


def connected_components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in the links (a, b): comp is the least id that can be reached.

    Links of an id with itself, and those with a null end, say nothing; an
    empty table gives an empty one.
    """
    with scratch() as keep:
        total = places(links)
        least = materialised(total.groupBy("up").agg(F.min("id").alias("comp")), "least")
        return keep(materialised(total.join(least, "up").select("id", "comp"), "components"))


def places(links: DataFrame) -> DataFrame:
    """(id, up) of every id in the links (a, b): up is the same number for the ids of a component, and another for each.

    Ids are ranked by a hash. Every round, each id goes up to its neighbour
    of least rank, if that is less than its own, and up to that one's and so
    on; then links are drawn between where their ends have gone, and those
    inside one place go. A round without links ends it. Each round is a table
    in the shared folder.
    """
    with scratch() as keep:
        return keep(_labels(links))


def _rank(c: str) -> Column:
    return F.xxhash64(c, F.lit(5))  # one to one on 64 bits


def _labels(links: DataFrame) -> DataFrame:
    proper = links.where("a <> b")
    edges = materialised(proper.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None  # (id, up)
    while True:
        rank = _rank if total is None else F.col
        both = edges.union(edges.select("b", "a"))
        # minima are formed before the shuffle, so an id with many neighbours costs a row a task
        up = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("id"), rank("a").alias("v"), F.least(rank("a"), "m").alias("up"))
        up = materialised(up, "up")
        more = lambda t, s: t.join(s.select(F.col("v").alias("v2"), F.col("up").alias("up2")), F.col("up") == F.col("v2"))
        twice = more(up, up).select("id", "v", F.col("up2").alias("up"))
        up = materialised(more(twice, twice).select("id", "v", F.col("up2").alias("up")), "up")
        ends = edges.select(rank("a").alias("a"), rank("b").alias("b"))
        for end in ("a", "b"):
            ends = ends.join(up.select(F.col("v").alias(end), F.col("up").alias("u" + end)), end)
        new = ends.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        new = materialised(new, "edges")
        if total is None:
            total = up.select("id", "up")
        else:
            total = total.join(up.select("v", F.col("up").alias("above")), F.col("up") == F.col("v"), "left").select("id", F.coalesce("above", "up").alias("up"))
        forget(edges)
        edges = new
        if new.isEmpty():
            break
    return materialised(total, "places")


def label_by_search(n: int, near: Callable[[int], np.ndarray]) -> np.ndarray:
    """Component numbers of n items, where near(i) marks the items that i is linked with.

    An item is compared only while some item of its group is not yet placed,
    so that a group of near copies costs about one comparison with each.
    """
    label = np.full(n, -1)
    left = n
    for i in range(n):
        if label[i] >= 0:
            continue
        label[i] = i
        left -= 1
        queue = [i]
        while queue and left:
            hit = np.flatnonzero(near(queue.pop()) & (label < 0))
            label[hit] = i
            left -= len(hit)
            queue.extend(hit.tolist())
    return label


def _grouped(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of rows sorted by their first ``keys`` columns, one key at a time."""
    key, held = None, []
    for b in it:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def _emitted(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)
    for r in rows:
        out.append(r)
        if len(out) >= most:
            yield flush()
            out.clear()
    if out:
        yield flush()


def _hubs(near_of: Near):
    """mapInArrow from (grp, sub, id, n, data, pivot), pivots first, to (grp, a, b, rest).

    A row b goes to a, the head of what it is linked with here: a pivot where
    there is one, else the first row. Rest are rows that do not reach the
    most common component of the pivots alone, which every task of a group
    finds alike. Pivots' own rows come from sub 1. rest is null in what
    links two pivots only, and in groups without pivots that are whole here.
    """

    def of(rows: Iterator[tuple[tuple, list[tuple]]]) -> Iterator[tuple]:
        for (grp, sub), held in rows:
            ids = [x[0] for x in held]
            n, p = len(held), sum(x[3] for x in held)
            near = near_of(np.array([x[1] for x in held]), [x[2] for x in held])
            label = label_by_search(n, near).tolist()
            if sub == 0:  # the whole group
                yield from ((grp, ids[k], ids[i], None) for i, k in enumerate(label) if k != i)
                continue
            own = label_by_search(p, lambda i: near(i)[:p]).tolist()
            root = max(set(own), key=lambda k: (own.count(k), -k)) if p else -1
            head: dict[int, int] = {}  # of a component: the root if it is in it, else its first pivot's head, else its first row
            for i in range(n):
                k = own[i] if i < p else i
                if k == root or label[i] not in head:
                    head[label[i]] = k
            for i in range(n):
                to = head[label[i]]
                if i >= p:
                    yield grp, ids[to], ids[i], to != root
                elif sub == 1:
                    yield grp, ids[own[i]], ids[i], own[i] != root
                if i < p and own[i] == i != to:
                    yield grp, ids[to], ids[i], None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted(of(_grouped(it, 2)), ["grp", "a", "b", "rest"], [pa.int64()] * 3 + [pa.bool_()])

    return run


def _across(near_of: Near):
    """mapInArrow from (grp, part, wide, id, n, data, right, head) to links (a, b) of heads that are not linked by others of the pair of blocks."""

    def of(rows: Iterator[tuple[tuple, list[tuple]]]) -> Iterator[tuple]:
        for _, held in rows:
            right = np.array([x[3] for x in held])
            if right.all() or not right.any():
                continue
            heads, head = np.unique([x[4] for x in held], return_inverse=True)
            near = near_of(np.array([x[1] for x in held]), [x[2] for x in held])
            for i in np.flatnonzero(~right).tolist():
                other = right & (head != head[i])
                if other.any():
                    for k in np.unique(head[near(i) & other]).tolist():
                        yield int(heads[min(k, head[i])]), int(heads[max(k, head[i])])
                        head[head == k] = head[i]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted(of(_grouped(it, 3)), ["a", "b"], [pa.int64()] * 2)

    return run


def _tokens(prefix: Callable):
    """mapInArrow from (grp, sub, id, n, data, pivot, part, wide) to (grp, token, part, wide, most, least).

    The tokens of each row of the block that another row needs one of to be
    linked with it, by ``prefix``: one row a token, side and wide block, with the
    largest size of a partner and the least size of its own rows.
    """

    def of(rows: Iterator[tuple[tuple, list[tuple]]]) -> Iterator[tuple]:
        for (grp, sub), held in rows:
            order = prefix([x[2] for x in held if x[3]])
            best: dict[tuple, list[int]] = {}
            for _, n, data, pivot, part, wide in held:
                if pivot and sub != 1:
                    continue
                for token, most in zip(*order(data)):
                    for key in ((token, None, wide), (token, part, None))[: 1 + (part is not None)]:
                        seen = best.setdefault(key, [most, n])
                        seen[0], seen[1] = max(seen[0], most), min(seen[1], n)
            yield from ((grp, *key, *v) for key, v in best.items())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emitted(of(_grouped(it, 2)), ["grp", "token", "part", "wide", "most", "least"], [pa.int64()] * 6)

    return run


def spanning_links(rows: DataFrame, near_of: Near, prefix: Callable | None = None, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b): links that connect what is linked inside each group of (grp, id, n, data, size, bytes).

    size and bytes are the number of rows and of bytes of data of the group.
    A group of up to two blocks is compared at once. A larger one is cut into
    blocks along a hash of the id, and every block is compared together with
    block 0, the pivots: each row gets one link, to the head of what it is
    linked with. Rows that do not reach the pivots' most common component are
    the rest; wide blocks of the rest are compared with all wide blocks, but
    only across different heads, and each link found joins two heads. Pairs
    of two rows that are not of the rest need no look, and no link is missed.
    So a group has about as many links as rows. What is compared grows with
    rest times group, and the rows copied for it with that over WIDE * block:
    a group without a common core is the dear case.

    With ``prefix``, wide blocks of the rest meet only those with which they share
    a token that a link needs. prefix(data of the pivots) gives a function
    from a row's data to (tokens, largest sizes of a partner whose first
    common token is this one).

    Rows without id, group or data take no part; an empty table gives an empty one.
    """
    with scratch() as keep:
        return _spanning(rows.where(F.col("grp").isNotNull() & F.col("id").isNotNull() & F.col("data").isNotNull()), near_of, prefix, block, block_bytes, keep)


def _spanning(rows: DataFrame, near_of: Near, prefix: Callable | None, block: int, block_bytes: int, keep) -> DataFrame:
    place = F.pmod(_rank("id"), F.lit(1 << 30))
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(block)), F.ceil(F.col("bytes") / F.lit(block_bytes))).cast("long")
    rows = rows.withColumn("place", place).withColumn("blocks", blocks)
    rows = rows.withColumn("block", F.when(F.col("blocks") > 2, F.shiftright(F.col("place") * F.col("blocks"), 30)))
    one = lambda c: F.array(c.cast("long"))
    sub = F.when(F.col("block").isNull(), one(F.lit(0))).when(F.col("block") == 0, F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)).otherwise(one(F.col("block")))
    pivot = F.coalesce(F.col("block") == 0, F.lit(False)).alias("pivot")

    def with_pivots(df: DataFrame, *more: str) -> DataFrame:
        """Rows by group and block, the pivots first in each."""
        df = df.withColumn("sub", F.explode(sub)).select("grp", "sub", "place", "id", "n", "data", pivot, *more)
        return df.repartition("grp", "sub").sortWithinPartitions("grp", "sub", "place", "id").drop("place")

    # the pivots' places come first, as blocks follow the places
    first = keep(materialised(with_pivots(rows).mapInArrow(tidied(_hubs(near_of)), "grp bigint, a bigint, b bigint, rest boolean"), "links"))
    links = first.where("a <> b").select("a", "b")
    rest = first.where("rest").select("grp", F.col("b").alias("id"))
    if rest.isEmpty():
        return links
    # a table of its own, as are those below: joins of plain exchanges are joins whose hot keys can be split
    left = materialised(rest.groupBy("grp").agg(F.count(F.lit(1)).alias("left")), "rest")
    heads = materialised(first.where("rest is not null").select("grp", F.col("b").alias("id"), F.col("a").alias("head"), "rest").join(left, "grp"), "heads")
    large = rows.where("block is not null").join(heads, ["grp", "id"])
    wides = F.greatest(F.ceil(F.col("size") / F.lit(WIDE * block)), F.ceil(F.col("bytes") / F.lit(block_bytes))).cast("long")
    large = large.withColumn("wides", wides).withColumn("wide", F.shiftright(F.col("place") * F.col("wides"), 30))
    parts = F.ceil(F.col("left") * F.col("wides") / F.col("size")).cast("long")
    large = large.withColumn("parts", parts).withColumn("part", F.when(F.col("rest"), F.pmod(F.xxhash64("id", F.lit(6)), F.col("parts"))))
    large = materialised(large.drop("rest", "left"), "large")
    if prefix is None:
        until = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        pairs = large.groupBy("grp").agg(F.max("parts").alias("parts"), F.max("wides").alias("wides"))
        pairs = pairs.withColumn("part", until("parts")).withColumn("wide", until("wides")).select("grp", "part", "wide")
    else:
        found = with_pivots(large, "part", "wide").mapInArrow(tidied(_tokens(prefix)), "grp bigint, token bigint, part bigint, wide bigint, most bigint, least bigint")
        found = found.groupBy("grp", "token", "part", "wide").agg(F.max("most").alias("most"), F.min("least").alias("least"))
        found = materialised(found, "tokens")
        by_wide = found.where("wide is not null").select("grp", "token", "wide", F.col("most").alias("most2"), F.col("least").alias("least2"))
        pairs = found.where("part is not null").drop("wide").join(by_wide, ["grp", "token"])
        pairs = pairs.where("most >= least2 and most2 >= least").select("grp", "part", "wide").distinct()
    pairs = materialised(pairs, "pairs")
    cols = ["grp", "part", "wide", "place", "id", "n", "data"]
    as_left = large.where("part is not null").drop("wide").join(pairs, ["grp", "part"]).select(*cols, F.lit(False).alias("right"), "head")
    as_right = large.drop("part").join(pairs, ["grp", "wide"]).select(*cols, F.lit(True).alias("right"), "head")
    both = as_left.union(as_right).repartition("grp", "part", "wide").sortWithinPartitions("grp", "part", "wide", "right", "place", "id").drop("place")
    second = both.mapInArrow(tidied(_across(near_of)), "a bigint, b bigint")
    return links.union(keep(materialised(second.distinct(), "links")))
