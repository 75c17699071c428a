"""SimHash near-duplicates by fuzzy Golay keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantframe.session import stage

from .graph import components
from .words import Words, pieces, text_bytes

BITS = 64
#: Bytes of text whose shingles are hashed at once.
PIECE_BYTES = 1 << 18
#: Bits of the three segments of a fingerprint.
SEGMENTS = (22, 21, 21)
#: Fingerprints that differ in at most so many bits are linked; the keys are made for this number.
RADIUS = 2
#: Fingerprints of a key that are compared pair by pair; those of larger keys meet at the words between them.
PAIRWISE = 64


def fingerprint(text: Column, words: int = 3, seed: int = 42) -> Column:
    """64-bit SimHash (bigint) of the text's word shingles, repeats included.

    Words are runs of other than ASCII white space, A-Z in lower case. A bit is set if it is set in more than half of
    the shingles' XXH64. Fewer words than a shingle has: the whole sequence is the only shingle. No words (or null): 0.
    """

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest

        data, offsets = text_bytes(texts)
        out = np.zeros(len(texts), np.int64)
        for low, high in pieces(offsets, PIECE_BYTES):
            part = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            buffer, starts, ends = part.spaced()
            n_words = np.diff(part.rows)
            n = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
            full = np.flatnonzero(n)
            if not len(full):
                continue
            begin = np.cumsum(n) - n
            first = np.repeat(part.rows[:-1] - begin, n) + np.arange(n.sum())
            last = np.minimum(first + words, np.repeat(part.rows[1:], n)) - 1
            spans = zip(starts[first].tolist(), ends[last].tolist())
            hashes = np.array([xxh64_intdigest(buffer[i:j], seed) for i, j in spans], np.uint64)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, begin[full], axis=0, dtype=np.int32)
            mark = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little")
            out[low + full] = np.ascontiguousarray(mark).view("<i8").ravel()
        return pa.array(out)

    return of(text)


def fuzzy_keys(fingerprints: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint, padded with -1; two that differ in at most two bits share one.

    Of three segments one at least holds none of two errors, and any other holds at most two. A key is one segment
    as it is with the index of a code word near the next segment.
    """
    from .golay import code_keys

    words = fingerprints.astype(np.int64).view(np.uint64)
    segments, shift = [], 0
    for width in SEGMENTS:
        segments.append((words >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    keys = []
    for i, exact in enumerate(segments):
        near = code_keys(segments[(i + 1) % len(segments)])
        keys.append(np.where(near < 0, -1, (i << 40) + (exact[:, None] << 12) + near))
    return np.concatenate(keys, axis=1)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _keys(fingerprints: pa.Array) -> pa.Array:
    keys = fuzzy_keys(fingerprints.to_numpy(zero_copy_only=False))
    real = keys >= 0
    at = np.zeros(len(keys) + 1, np.int32)
    np.cumsum(real.sum(axis=1), out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(keys[real]))


def near_pairs(fingerprints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """Links ``a < b`` between distinct fingerprints that differ in at most two bits.

    They connect exactly what all such pairs connect. Fingerprints meet by key. A key with up to ``PAIRWISE`` of them
    gives its verified pairs. Those of larger keys meet at every word one bit away from them or equal to them instead:
    two of them share such a word exactly if they differ in at most two bits, at most 65 meet at a word, and each is
    linked to the smallest there.
    """
    keyed = stage(fingerprints.select(F.col(column).alias("fp")).distinct().select("fp", F.explode(_keys("fp")).alias("key")), "keys")
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(keyed.join(counted, "key"), "shared")
    few = shared.filter(F.col("n") <= PAIRWISE)
    pairs = (
        few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .select("a", "b")
    )
    between = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    many = shared.filter(F.col("n") > PAIRWISE).select("fp").distinct()
    met = many.select("fp", F.explode(F.transform(between, lambda m: m.bitwiseXOR(F.col("fp")))).alias("word"))
    met = met.groupBy("word").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    stars = met.select("a", F.explode("all").alias("b")).filter("a < b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id among the rows reachable over links of at most two differing bits. Null texts
    count as empty; empty texts have fingerprint zero and are linked like any other. Repeated rows and ids are kept. A
    null id is never the smallest; a component of null ids only has a null ``component_id``. Other columns are ignored.
    """
    marked = stage(docs.select(F.col(id_column).alias("id"), fingerprint(F.col(text_column), words, seed).alias("fp")), "marks")
    smallest = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    stars = components(near_pairs(smallest, "fp"), "a", "b")
    rooted = smallest.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` without near copies, all columns kept: one row of each component stays.

    It is the row with the smallest id (null first); of rows that share it, the one with the smallest hash of all
    columns; of rows that are equal in all columns, one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marks = [F.xxhash64(whole).alias("m1"), F.xxhash64(F.lit("again"), whole).alias("m2")]
    keyed = docs.select(F.struct(F.col(id_column).alias("id"), *marks).alias("key"), F.col(text_column).alias("text"))
    classes = near_duplicates(keyed, "key", "text", words, seed)
    kept = classes.filter("key <=> component_id").select("key.m1", "key.m2").distinct()
    rows = docs.select(whole.alias("row"), *marks).join(kept, ["m1", "m2"])
    return rows.dropDuplicates(["m1", "m2"]).select("row.*")
