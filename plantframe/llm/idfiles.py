"""Token ids in files of compressed bit planes, one file per range of documents, with an index of chunks.

A file holds chunks of a fixed number of ids. A chunk's ids, as 32-bit integers, are transposed into 32 bit planes or
4 byte planes, each compressed with zstandard. Behind them stand the documents (id, number of ids) and the index of
chunks (places and lengths of planes); the last 32 bytes say where these are. Integers are little-endian.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantframe.session import scratch_path, stage

from .bpe import byte_characters, encode_texts
from .words import text_bytes

MAGIC = b"IDPLANE1"
CHUNK_IDS = 1 << 16
#: Distinct words that the library encodes before their ids are put together.
WORDS_AT_ONCE = 1 << 15
MANIFEST = "shard int, file string, n_docs long, n_ids long"


def planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """The transposed bits (``bits``: 32 rows) or bytes (``bytes``: 4 rows) of 32-bit ids, least significant first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bytes":
        return np.ascontiguousarray(rows.T)
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")


def unplaned(rows: np.ndarray, n: int) -> np.ndarray:
    """Ids from their planes."""
    if len(rows) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little", count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class Writer:
    def __init__(self, stream, kind: str, chunk_ids: int = CHUNK_IDS):
        from zstandard import ZstdCompressor

        self.stream, self.kind, self.chunk_ids, self.at = stream, kind, chunk_ids, 0
        self.pack = ZstdCompressor(level=1).compress
        self.left: list[np.ndarray] = []
        self.waiting = 0
        self.chunks: list[list] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def _chunk(self, ids: np.ndarray) -> None:
        at = self.at
        self.chunks.append([at, len(ids), [self._put(self.pack(row.tobytes())) for row in planes(ids, self.kind)]])

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents in their order, null ids as the least integer, and all their token ids."""
        self.docs.append((doc_ids.astype("<i8"), lengths.astype("<i8")))
        self.left.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.chunk_ids:
            every = np.concatenate(self.left)
            whole = len(every) // self.chunk_ids * self.chunk_ids
            for i in range(0, whole, self.chunk_ids):
                self._chunk(every[i : i + self.chunk_ids])
            self.left, self.waiting = [every[whole:]], len(every) - whole

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids written."""
        if self.waiting:
            self._chunk(np.concatenate(self.left))
        lists = [np.concatenate([d[i] for d in self.docs]) if self.docs else np.zeros(0, "<i8") for i in (0, 1)]
        docs_at = self.at
        self._put(self.pack(lists[0].tobytes() + lists[1].tobytes()))
        index_at = self.at
        self._put(self.pack(json.dumps({"planes": self.kind, "docs": len(lists[0]), "chunks": self.chunks}).encode()))
        self._put(docs_at.to_bytes(8, "little") + index_at.to_bytes(8, "little") + self.at.to_bytes(8, "little") + MAGIC)
        return len(lists[0]), int(lists[1].sum())


class Reader:
    """Reads a file by its index; any range of ids needs only the chunks that it touches."""

    def __init__(self, source):
        from zstandard import ZstdDecompressor

        self.source, self.unpack = source, ZstdDecompressor().decompress
        tail = self._get(source.size() - 32, 32)
        if tail[24:] != MAGIC:
            raise ValueError("not a file of token ids")
        docs_at, index_at, end = (int.from_bytes(tail[i : i + 8], "little") for i in (0, 8, 16))
        index = json.loads(self.unpack(self._get(index_at, end - index_at)))
        self.chunks, n = index["chunks"], index["docs"]
        lists = np.frombuffer(self.unpack(self._get(docs_at, index_at - docs_at)), "<i8") if n else np.zeros(0, "<i8")
        self.doc_ids, self.lengths = lists[:n], lists[n:]
        self.ends = np.cumsum([c[1] for c in self.chunks])

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.chunks[k]
        data, rows = self._get(at, sum(sizes)), []
        for size in sizes:
            rows.append(np.frombuffer(self.unpack(data[:size]), np.uint8))
            data = data[size:]
        return unplaned(np.stack(rows), n)

    def documents(self, most_ids: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of documents: their ids, their numbers of token ids, and these one after the other."""
        begin, ends = 0, np.cumsum(self.lengths)
        k, held, low = 0, np.zeros(0, "<u4"), 0
        while begin < len(ends):
            high = max(begin + 1, int(np.searchsorted(ends, low + most_ids, "right")))
            parts = [held]
            while sum(map(len, parts)) < ends[high - 1] - low:
                parts.append(self.chunk(k))
                k += 1
            held = np.concatenate(parts)
            n = int(ends[high - 1] - low)
            yield self.doc_ids[begin:high], self.lengths[begin:high], held[:n]
            held, low, begin = held[n:], int(ends[high - 1]), high


NULL_ID = np.iinfo(np.int64).min


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def library_words(path: str):
    """Ids of distinct pre-tokens by the tokenizers library's model. They are not split further, so all that is left to
    do before is to write their bytes as the characters that stand for them."""
    character = {byte: c for c, byte in byte_characters().items()}

    def of(distinct: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths, tokenize = [], [], _library(path).model.tokenize
        for low in range(0, len(distinct), WORDS_AT_ONCE):
            data, offsets = text_bytes(distinct.slice(low, WORDS_AT_ONCE).view(pa.string()))
            text, at = data.tobytes().decode("latin-1").translate(character), offsets.tolist()
            found = [[t.id for t in tokenize(text[i:j])] for i, j in zip(at, at[1:])]
            ids.append(np.fromiter(chain.from_iterable(found), np.int64))
            lengths += map(len, found)
        return np.concatenate([*ids, np.zeros(0, np.int64)]), np.append(0, np.cumsum(lengths)).astype(np.int64)

    return of


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", kind: str = "bytes") -> DataFrame:
    """Encode texts and write their ids, each document's with ``end_id`` behind, in ascending order of document ids.

    Documents are dealt out by ranges of ids, each range is written as one file below the shared folder, and the
    result has a row for each file: ``shard`` (its place in the order), ``file``, ``n_docs``, ``n_ids``. A task that
    runs again writes a file of its own, and only the files in the result count. Null texts count as empty, null ids
    come first, repeated ids and rows are all written (those of an id in the order of their texts' hashes). An empty
    table gives no files.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    folder = scratch_path(spark, "ids")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        words, special = library_words(tokenizer), {t.content: i for i, t in _library(tokenizer).get_added_tokens_decoder().items()}
        shard, writer = TaskContext.get().partitionId(), None
        store, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            if writer is None:
                store.create_dir(place, recursive=True)
                own = f"{shard:06d}-{uuid.uuid4().hex}.ids"
                name, stream = f"{folder}/{own}", store.open_output_stream(f"{place}/{own}")
                writer = Writer(stream, kind)
            ids, at = encode_texts(batch.column(1), words, special)
            ends = at[1:] + np.arange(1, len(at))
            out = np.empty(len(ids) + batch.num_rows, np.uint32)
            whole = np.ones(len(out), bool)
            whole[ends - 1] = False
            out[whole], out[~whole] = ids, end_id
            writer.add(batch.column(0).fill_null(NULL_ID).to_numpy(), np.diff(at) + 1, out)
        if writer is not None:
            n_docs, n_ids = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Documents of the files of a manifest: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` (binary: 32-bit little-endian integers). Each file is read by one task, run by run of documents."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).cast("long").alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                store, name = fs.FileSystem.from_uri(file)
                with store.open_input_file(name) as source:
                    for doc_ids, lengths, ids in Reader(source).documents():
                        at = np.append(0, np.cumsum(lengths))
                        data = pa.py_buffer(np.ascontiguousarray(ids.astype("<u4")))
                        values = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((at * 4).astype(np.int32)), data])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(doc_ids, mask=doc_ids == NULL_ID), "start": pa.array(start + at[:-1]),
                                "n_tokens": pa.array(lengths), "ids": values,
                            }
                        )
                        start += int(at[-1])

    return files.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
