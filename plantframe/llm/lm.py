"""Bigram language model in a sharded Elias-Fano trie, built and read by Spark tasks.

The first level holds the words, the second, per context word, the successors seen in training. A shard of the second
level has the contexts, pointers to where each one's successors begin, and the successors' numbers made monotone by
adding the last value of the context before: three Elias-Fano sequences, and a quantised probability per successor. A
look-up finds the context, then its range, then the successor within it. Files are mapped into memory where the shared
folder is mounted, and read otherwise.

P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)) and P(w | h) = (c(h, w) + m P(w)) / (c(h) + m), with training counts c. A text
is its words, A-Z in lower case, and one end; the end also stands before the first word.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantframe.session import scratch_path, stage

from .eliasfano import EliasFano
from .words import Words, pieces, slices, text_bytes

#: The end of a text; no word holds white space.
END = "\n"
ADD = 0.1
#: Weight of the word's own probability in that after a context.
PRIOR = 20.0
#: Quantisation step of log10 probabilities.
STEP = 16 / 65535
#: Distinct words of a vocabulary file; training tokens whose pairs a file of the second level holds.
WORDS_PER_FILE, TOKENS_PER_FILE = 1 << 19, 1 << 21
#: Bytes of text whose pairs are counted or scored at once.
PART_BYTES = 8 << 20
#: Contexts seen more often have their successors spread over so many parts.
HOT, PARTS = 1 << 20, 64
SCORES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays to a new file below a folder that all executors share; its address."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    own, spec, at = f"{name}-{uuid.uuid4().hex}.lm", [], 0
    for key, a in arrays.items():
        spec.append([key, a.dtype.str, at, len(a)])
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(spec).encode()
    with store.open_output_stream(f"{place}/{own}") as out:
        out.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    return f"{folder}/{own}"


@lru_cache(maxsize=256)
def read_arrays(file: str) -> dict[str, np.ndarray]:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file)
    if isinstance(store, fs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r")
    else:
        with store.open_input_file(path) as source:
            data = np.frombuffer(source.read(), np.uint8)
    n = int.from_bytes(data[:8].tobytes(), "little")
    begin = 8 + -(-n // 8) * 8
    out = {}
    for key, kind, at, length in json.loads(data[8 : 8 + n].tobytes()):
        out[key] = data[begin + at : begin + at + length * np.dtype(kind).itemsize].view(kind)
    return out


def hashes(words: pa.StringArray) -> np.ndarray:
    from xxhash import xxh64_intdigest

    data, at = text_bytes(words)
    raw, at = data.tobytes(), at.tolist()
    return np.array([xxh64_intdigest(raw[i:j]) for i, j in zip(at[:-1], at[1:])], np.uint64)


@lru_cache(maxsize=64)
def _sequences(file: str) -> tuple[EliasFano, EliasFano, EliasFano, np.ndarray]:
    a = read_arrays(file)
    return *(EliasFano([a[f"{name}{i}"] for i in range(4)]) for name in ("contexts", "pointers", "successors")), a["chance"]


@dataclass(frozen=True)
class Model:
    """Addresses of the model's files and its totals: a few bytes per file."""

    words: tuple[str, ...]
    first: tuple[int, ...]
    pairs: tuple[str, ...]
    n: int
    v: int
    prior: float
    hot: int = HOT
    tokens_per_file: int = TOKENS_PER_FILE

    @cached_property
    def bits(self) -> int:
        return max(0, len(self.words) - 1).bit_length()

    def ids(self, words: pa.StringArray) -> np.ndarray:
        """Numbers of words, -1 for unknown ones."""
        out = np.full(len(words), -1, np.int64)
        if not self.v or not len(words):
            return out
        h = hashes(words)
        of = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        for shard in np.unique(of):
            held = read_arrays(self.words[shard])
            if not len(held["hash"]):
                continue
            rows = np.flatnonzero(of == shard)
            at = np.searchsorted(held["hash"], h[rows])
            texts = pa.LargeStringArray.from_buffers(len(held["hash"]), pa.py_buffer(held["at"]), pa.py_buffer(held["text"]))
            own = words.take(pa.array(rows)).cast(pa.large_string())
            while len(rows):  # words of equal hash stand one after the other
                on = at < len(held["hash"])
                on[on] = held["hash"][at[on]] == h[rows[on]]
                rows, at, own = rows[on], at[on], own.filter(pa.array(on))
                if not len(rows):
                    break
                same = pc.equal(texts.take(pa.array(at)), own).to_numpy(zero_copy_only=False)
                out[rows[same]] = self.first[shard] + at[same]
                rows, at, own = rows[~same], at[~same] + 1, own.filter(pa.array(~same))
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of words, 0 for unknown ones."""
        out = np.zeros(len(ids), np.int64)
        of = np.searchsorted(self.first, ids, "right") - 1
        for shard in np.unique(of[ids >= 0]):
            rows = np.flatnonzero((of == shard) & (ids >= 0))
            out[rows] = read_arrays(self.words[shard])["count"][ids[rows] - self.first[shard]]
        return out

    def alone(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by the words' counts."""
        return (counts + ADD) / (self.n + ADD * (self.v + 1))

    def file_of(self, context: np.ndarray, count: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Number of the file that holds a pair."""
        bits = max(0, len(self.pairs) - 1).bit_length() if self.pairs else self.pair_bits
        part = np.where(count > self.hot, successor % PARTS, 0)
        mixed = (context * PARTS + part).astype(np.uint64) * _MIX
        return (mixed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(context), np.int64)

    @cached_property
    def pair_bits(self) -> int:
        return max(0, -(-self.n // self.tokens_per_file) - 1).bit_length()

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: the numbers of all tokens, ends included; which of them are ends; and the rows' numbers of tokens."""
        found, rows = [], []
        for low, high in pieces(offsets):
            part = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            found.append(part.array())
            rows.append(np.diff(part.rows))
        n = (np.concatenate(rows) if rows else np.zeros(0, np.int64)) + 1
        coded = pa.chunked_array([*found, pa.array([END])], pa.string()).dictionary_encode().unify_dictionaries()
        ids = self.ids(coded.chunk(0).dictionary)
        flat = ids[np.concatenate([c.indices.to_numpy() for c in coded.chunks])]
        end = np.zeros(int(n.sum()), bool)
        end[np.cumsum(n) - 1] = True
        out = np.full(len(end), flat[-1], np.int64)
        out[~end] = flat[:-1]
        return out, end, n

    def before(self, tokens: np.ndarray) -> np.ndarray:
        """The token before each one; texts follow each other, so an end stands before every first word."""
        return np.append(tokens[-1:], tokens[:-1])

    def after(self, context: np.ndarray, successor: np.ndarray, context_count: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """log10 P(w | h) of distinct pairs."""
        out = np.log10(self.prior * alone / (context_count + self.prior))
        known = np.flatnonzero((context >= 0) & (successor >= 0))
        of = self.file_of(context[known], context_count[known], successor[known])
        order = np.argsort(of, kind="stable")
        known, of = known[order], of[order]
        for low, high in zip(*(lambda b: (b, np.append(b[1:], len(of))))(np.flatnonzero(np.append(True, of[1:] != of[:-1]))) if len(of) else ((), ())):
            contexts, pointers, successors, chance = _sequences(self.pairs[of[low]])
            rows = known[low:high]
            distinct, which = np.unique(context[rows], return_inverse=True)
            rank = contexts.find(distinct.astype(np.uint64))
            seen = rank >= 0
            begin, end = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            begin[seen], end[seen] = pointers[rank[seen]], pointers[rank[seen] + 1]
            base = np.zeros(len(rank), np.uint64)
            later = begin > 0
            base[later] = successors[begin[later] - 1]
            ask = np.flatnonzero(seen[which])
            at = successors.find(base[which[ask]] + successor[rows[ask]].astype(np.uint64), begin[which[ask]], end[which[ask]])
            hit = at >= 0
            out[rows[ask[hit]]] = chance[at[hit]] * -STEP
        return out

    def scores(self, texts: pa.Array) -> list[np.ndarray]:
        """Per text: tokens, known tokens, the sum of log10 P(w) and that of log10 P(w | h)."""
        tokens, end, n = self.tokens(*text_bytes(texts))
        distinct, which = np.unique(tokens, return_inverse=True)
        count = self.counts(distinct)
        row = np.repeat(np.arange(len(n)), n)
        alone = self.alone(count)
        base = np.bincount(row, np.log10(alone)[which], len(n))
        known = np.bincount(row, (count > 0)[which], len(n)).astype(np.int64)
        pair, of = np.unique(self.before(which) * len(distinct) + which, return_inverse=True)
        h, w = pair // len(distinct), pair % len(distinct)
        after = self.after(distinct[h], distinct[w], count[h], alone[w])
        return [n, known, base, np.bincount(row, after[of], len(n))]


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys with their counts, as compressed byte planes of gaps."""
    from zstandard import ZstdCompressor

    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return ZstdCompressor(level=1).compress(gaps.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    from zstandard import ZstdDecompressor

    raw = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 12
    gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel()


def _vocabulary(train: DataFrame, folder: str, prior: float, words_per_file: int, **sizes: int) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            found = [Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).array() for i, j in pieces(offsets)]
            tally = pc.value_counts(pa.chunked_array(found, pa.string()))
            words = pa.concat_arrays([tally.field(0), pa.array([END])])
            numbers = pa.concat_arrays([tally.field(1), pa.array([batch.num_rows], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(hashes(words).view(np.int64)), words, numbers], ["h", "word", "n"])

    counted = train.mapInArrow(count, "h long, word string, n long").groupBy("h", "word").agg(F.sum("n").alias("n")).filter("n > 0")
    counted = stage(counted, "words")
    bits = max(0, -(-counted.count() // words_per_file) - 1).bit_length()

    def build(group: pa.Table) -> pa.Table:
        group = group.append_column("u", pa.array(group["h"].to_numpy().view(np.uint64)))
        group = group.sort_by([("u", "ascending"), ("word", "ascending")]).combine_chunks()
        text, at = text_bytes(group["word"].combine_chunks())
        n = group["n"].to_numpy()
        file = write_arrays(folder, "words", {"hash": group["u"].to_numpy(), "count": n, "at": at, "text": text})
        return pa.table({"shard": group["shard"][:1], "file": [file], "n_words": [len(n)], "n_tokens": [int(n.sum())]})

    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    files = counted.select(shard.alias("shard"), "h", "word", "n").groupBy("shard").applyInArrow(build, "shard int, file string, n_words long, n_tokens long")
    rows = {r.shard: r for r in stage(files, "word-files").collect()}  # a row per file
    names, first, total, n = [], [], 0, 0
    for i in range(1 << bits):
        names.append(rows[i].file if i in rows else write_arrays(folder, "words", {"hash": np.zeros(0, np.uint64), "count": np.zeros(0, np.int64), "at": np.zeros(1, np.int64), "text": np.zeros(0, np.uint8)}))
        first.append(total)
        total += rows[i].n_words if i in rows else 0
        n += rows[i].n_tokens if i in rows else 0
    return Model(tuple(names), tuple(first), (), n, total, prior, **sizes)


def fit(train: DataFrame, text_column: str = "text", prior: float = PRIOR, words_per_file: int = WORDS_PER_FILE, tokens_per_file: int = TOKENS_PER_FILE, hot: int = HOT) -> Model:
    """Learn from all texts of a table; null ones count as empty (their end is still a token).

    Words, then pairs, are counted within batches, summed by Spark, and written as one file per range or hash of
    bounded size. The driver sees the files' addresses and totals only. An empty table gives a model without words.
    """
    spark = train.sparkSession
    folder = scratch_path(spark, "lm")
    texts = train.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    words = _vocabulary(texts, folder, prior, words_per_file, hot=hot, tokens_per_file=tokens_per_file)
    if not words.n:
        return words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (part for batch in batches for part in slices(batch.column(0), PART_BYTES)):
            tokens, _, _ = words.tokens(*text_bytes(texts))
            if not len(tokens):
                continue
            keys, n = np.unique(words.before(tokens).astype(np.uint64) * np.uint64(words.v) + tokens.astype(np.uint64), return_counts=True)
            context, successor = (keys // np.uint64(words.v)).astype(np.int64), (keys % np.uint64(words.v)).astype(np.int64)
            change = np.append(True, context[1:] != context[:-1])
            often = words.counts(context[change])[np.cumsum(change) - 1]
            of = words.file_of(context, often, successor)
            order = np.argsort(of, kind="stable")
            keys, n, of = keys[order], n[order], of[order]
            begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            blobs = [_pack(keys[i:j], n[i:j]) for i, j in zip(begin, np.append(begin[1:], len(of)))]
            yield pa.RecordBatch.from_arrays([pa.array(of[begin], pa.int32()), pa.array(blobs, pa.binary())], ["shard", "pairs"])

    def build(group: pa.Table) -> pa.Table:
        parts = [_unpack(b) for b in group["pairs"].to_pylist()]
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, n = keys[begin], np.add.reduceat(n, begin)
        context, successor = (keys // np.uint64(words.v)).astype(np.int64), (keys % np.uint64(words.v)).astype(np.int64)
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        last = np.append(first[1:], len(context)) - 1
        bases = np.append(0, np.cumsum(successor[last])[:-1])
        size = last - first + 1
        often = np.repeat(words.counts(context[first]), size)
        chance = (n + words.prior * words.alone(words.counts(successor))) / (often + words.prior)
        arrays = {}
        for name, values in (("contexts", context[first]), ("pointers", np.append(first, len(context))), ("successors", successor + np.repeat(bases, size))):
            arrays |= {f"{name}{i}": a for i, a in enumerate(EliasFano.build(values).arrays())}
        arrays["chance"] = np.round(-np.log10(chance) / STEP).astype(np.uint16)
        return pa.table({"shard": group["shard"][:1], "file": [write_arrays(folder, "pairs", arrays)]})

    files = texts.mapInArrow(count, "shard int, pairs binary").groupBy("shard").applyInArrow(build, "shard int, file string")
    rows = {r.shard: r.file for r in stage(files, "pair-files").collect()}  # a row per file
    none = np.zeros(0, np.int64)
    empty = {f"{name}{i}": a for name, values in (("contexts", none), ("pointers", np.zeros(1, np.int64)), ("successors", none)) for i, a in enumerate(EliasFano.build(values).arrays())}
    spare = write_arrays(folder, "pairs", empty | {"chance": np.zeros(0, np.uint16)}) if len(rows) < 1 << words.pair_bits else ""
    return replace(words, pairs=tuple(rows.get(i, spare) for i in range(1 << words.pair_bits)))


def score(text: Column, model: Model) -> Column:
    """Struct of ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (log10 probabilities) of a text.

    Null counts as empty: one end. Unknown words have the probability of a word never seen.
    """

    @F.arrow_udf(SCORES)
    def of(texts: pa.Array) -> pa.Array:
        n, known, base, after = (np.concatenate(x) for x in zip(*(model.scores(part) for part in slices(texts, PART_BYTES))))
        columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(after)]
        return pa.StructArray.from_arrays(columns, SCORES.fieldNames())

    return of(text)
