"""Token ids in files of byte-aligned variable-length codes with separate control bytes.

Ids are replaced by their rank in the corpus' frequency order, so that the
commonest 256 take one byte. A rank takes one to four bytes, low byte first;
four two-bit lengths form one control byte, and control bytes are kept apart
from data bytes, so numpy decodes with table lookups and no branch.

A file (all numbers little-endian):
  magic b"SSVB0001", docs u32, then per document i64 id, u32 tokens, u32 data bytes,
  then per document its control bytes (tokens / 4, rounded up), then per document its data bytes.
``ranks.bin`` beside the files is the id of each rank as u32. Documents are in
ascending id order in and across files; one task writes consecutive files of
about FILE_TOKENS tokens.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandsift.llm.common import forget, materialised, new_path, sliced, texts, tidied, tuned

END_ID = 2
FILE_TOKENS = 4 << 20
_MAGIC = b"SSVB0001"
#: Tasks that read files back, at most; a task reads its files one by one.
READERS = 10_000
#: Bytes of text that are encoded at once, about.
ENCODED_BYTES = 4 << 20
#: Chunks of text whose ids a worker keeps, about; beyond that it forgets those that came once.
_HELD = 500_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The ids of texts by the tokenizers library.

    The tokenizer's pieces never cross ASCII white space (its pattern excludes
    it and its normaliser composes nothing across it), nor the end of a word
    before punctuation, so each distinct run between those is encoded once and
    its ids are reused.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.again = np.zeros(1 << 16, bool)  # chunks that have come again since they were learnt or kept

    def _learn(self, chunks: list[str]) -> None:
        words = [c for c in chunks if c.isalpha() and (c.isascii() or c.translate(_LATIN).isascii())]
        pieces: dict[str, list[int]] = {}
        for e in range(0, len(words), 256):  # words have one piece each, whose last id is a word's end
            some = words[e : e + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            ids = ids.tolist()
            if len(cuts) != len(some):
                raise ValueError("the tokenizer splits words")
            pieces.update(zip(some, (ids[a:b] for a, b in zip([0] + cuts, cuts))))
        rest = [c for c in chunks if c not in pieces]
        for e in range(0, len(rest), 10_000):
            some = rest[e : e + 10_000]
            pieces.update(zip(some, (x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))))
        ids = [pieces[c] for c in chunks]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(chunks, sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))

    def _add(self, chunks: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, k, m = len(ids), len(self.index), len(chunks)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + m > len(self.starts):
            self.starts, self.sizes, self.again = (np.concatenate([v, np.zeros_like(v)]) for v in (self.starts, self.sizes, self.again))
        self.flat[self.used : self.used + n] = ids
        self.starts[k : k + m] = self.used + np.cumsum(sizes) - sizes
        self.sizes[k : k + m] = sizes
        self.used += n
        self.index.update(zip(chunks, range(k, k + m)))

    def _forget(self) -> None:
        """Keeps the chunks that came again in later texts; none, if those are many."""
        kept = np.flatnonzero(self.again[: len(self.index)])
        sizes = self.sizes[kept]
        if len(kept) > _HELD // 2 or sizes.sum() > 8 * _HELD:
            self.clear()
            return
        names = list(self.index)  # in the order of their places
        ids = self._ids(kept)
        self.clear()
        self._add([names[i] for i in kept.tolist()], sizes, ids)

    def _ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of the chunks at these places, one after the other."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(at) else 0
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(n)]

    def _placed(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        """(the place of each chunk of all texts in the index, where each text's chunks begin and the last one's end)."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special token, so case and cuts before marks change nothing
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), _MARKS, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        names = chunks.dictionary.to_pylist()
        if len(self.index) > _HELD or self.used > 16 * _HELD:
            self._forget()
        known = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        self.again[known[known >= 0]] = True
        new = np.flatnonzero(known < 0)
        if len(new):
            k = len(self.index)
            self._learn([names[i] for i in new.tolist()])
            known[new] = np.arange(k, len(self.index))
        return known[chunks.indices.to_numpy()], (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        at, stops = self._placed(texts)
        return [self._ids(at[a:z]) for a, z in zip(stops, stops[1:])]  # text by text: the arrays stay in a core's cache

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        at, stops = self._placed(texts)
        return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes[at])])[stops])


#: Letters of Western European languages: lower-casing and composing keep each a letter.
_LATIN = {i: "a" for i in range(0xC0, 0x100) if chr(i).isalpha()}
#: A run of marks from a letter or digit to white space or the end is a piece of its own.
_MARKS = r"([\pL\pN])([.,;:!?|*#$%&]+)([ \t\n\r\f\v]|$)"


@cache
def _encoder(path: str) -> Encoder:
    """One a worker process: what it has learnt serves its later tasks too."""
    return Encoder(path)


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, about ENCODED_BYTES of text at once: the more, the fewer look-ups a distinct run costs."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in sliced(it):
        held.append(b)
        size += b.column(1).nbytes
        if size >= ENCODED_BYTES:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
            yield from rows
            size = 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def tokens(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the ids of each text and the end id, as little-endian u16 where all fit and u32 otherwise (wide)."""

    def encoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in _blocks(it):
            wide, ids = [], []
            for x in enc.encode(b.column(1)):
                x = np.append(x, np.uint32(end_id))
                wide.append(bool(x.max() > 0xFFFF))
                ids.append(x.astype("<u4" if wide[-1] else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wide), pa.array(ids, pa.binary())], names=["doc_id", "wide", "ids"])

    return docs.mapInArrow(tidied(encoded), "doc_id bigint, wide boolean, ids binary")


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens): the number of ids that tokens() gives for each text, its end id included; no ids are formed."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in _blocks(it):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.lengths(b.column(1)) + 1)], names=["doc_id", "n_tokens"])

    return docs.mapInArrow(tidied(counted), "doc_id bigint, n_tokens bigint")


def _ids(wide: bool, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.int64)


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << 16, np.int64)
    for b in it:
        for wide, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            c = np.bincount(_ids(wide, raw))
            if len(c) > len(n):
                n = np.concatenate([n, np.zeros(len(c), np.int64)])
            n[: len(c)] += c
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])


def packed(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of a document's ranks."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-n // 4) * 4, np.uint8)
    quads[:n] = size - 1
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    four = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), four[np.arange(4)[None, :] < size[:, None]].tobytes()


_SIZES = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], 1).astype(np.int64)


def unpacked(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks of one document: lengths by table lookup, then one gather a byte position."""
    size = _SIZES[control].reshape(-1)[:n]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _load(fs: pafs.FileSystem, top: str) -> np.ndarray:
    with fs.open_input_stream(f"{top}/ranks.bin") as f:
        return np.frombuffer(f.read(), "<u4")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (doc_id, wide, ids), ordered in partitions, to files; (part, seq, path, docs, tokens) of each file.

    A repeated attempt of a task writes files of its own name; the rows that
    come back name the files of the attempt that counts.
    """

    def written(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _store(folder)
        by_rank = _load(fs, top).astype(np.int64)
        rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank[by_rank] = np.arange(len(by_rank))
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        docs: list[tuple[int, int, bytes, bytes]] = []
        seq = total = 0

        def flush() -> pa.RecordBatch:
            path = f"{top}/part-{part:06d}-{seq:06d}-{attempt}.svb"
            index = np.zeros(len(docs), np.dtype([("id", "<i8"), ("n", "<u4"), ("size", "<u4")]))
            index["id"], index["n"], index["size"] = [d[0] for d in docs], [d[1] for d in docs], [len(d[3]) for d in docs]
            with fs.open_output_stream(path) as f:
                f.write(_MAGIC + np.uint32(len(docs)).astype("<u4").tobytes() + index.tobytes())
                f.write(b"".join(d[2] for d in docs))
                f.write(b"".join(d[3] for d in docs))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "docs": [len(docs)], "tokens": [total]})

        for b in it:
            for doc, wide, raw in zip(*(b.column(k).to_pylist() for k in range(3))):
                r = rank[_ids(wide, raw)]
                docs.append((doc, len(r), *packed(r)))
                total += len(r)
                if total >= FILE_TOKENS:
                    yield flush()
                    docs, total, seq = [], 0, seq + 1
        if docs:
            yield flush()

    return rows.mapInArrow(tidied(written), "part bigint, seq bigint, path string, docs bigint, tokens bigint")


def read_file(fs: pafs.FileSystem, path: str, by_rank: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of each document of a file."""
    with fs.open_input_file(path) as f:
        head = f.read(12)
        if head[:8] != _MAGIC:
            raise ValueError(f"{path} is no token file")
        n = int(np.frombuffer(head[8:], "<u4")[0])
        index = np.frombuffer(f.read(16 * n), np.dtype([("id", "<i8"), ("n", "<u4"), ("size", "<u4")]))
        controls = np.frombuffer(f.read(int((-(-index["n"].astype(np.int64) // 4)).sum())), np.uint8)
        data = np.frombuffer(f.read(), np.uint8)
    c = d = 0
    for doc, k, size in index.tolist():
        q = -(-k // 4)
        yield doc, by_rank[unpacked(controls[c : c + q], data[d : d + size], k)]
        c, d = c + q, d + size


def read_back(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of (part, seq, path, docs, tokens)."""

    def decoded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _store(folder)
        by_rank = _load(fs, top)
        for b in it:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: list[tuple[int, int, int, int]] = []
                for doc, ids in read_file(fs, path, by_rank):
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a file: the only table that is ordered as a whole
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    at = files.select("path", F.coalesce(F.sum("tokens").over(order), F.lit(0)).cast("long").alias("start"))
    at = at.repartition(max(1, min(files.count(), READERS)))
    return at.mapInArrow(tidied(decoded), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def export(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """(files, folder): writes the ids of all texts; see read_back().

    A null or empty text is the end id alone. Rows without id take no part;
    rows that share an id are written each, in the order of their ids' bytes.
    An empty table writes no file but ranks.bin.
    """
    spark = tuned(docs.sparkSession)
    folder = folder or new_path(spark, "tokens")
    rows = materialised(tokens(texts(docs, id_col, text_col), vocabulary or vocabulary_path(), end_id), "ids", "zstd")
    counts = rows.mapInArrow(tidied(_counted), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    order = counts.orderBy(F.desc("n"), "id").select("id").toPandas()["id"].to_numpy(np.int64)  # a row an id of the vocabulary
    fs, top = _store(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/ranks.bin") as f:
        f.write(order.astype("<u4").tobytes())
    # ids rather than codes are shuffled: sampling the ranges then costs a look at doc_id alone
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    files = materialised(write_files(placed, folder), "token-files")
    forget(rows)
    return files, folder


def op3_control_byte_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, folder = export(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_back(files, folder)
