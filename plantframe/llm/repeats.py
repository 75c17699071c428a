"""Passages that documents share, by common-prefix interval trees over suffix arrays.

Every window of ``length`` bytes belongs to the rarest-looking piece inside it: the one whose hash is the smallest.
Equal windows belong to equal pieces, so neighbouring windows of one piece travel together as one string, and all that
is equal meets under the key of its piece. Only keys that two different texts have are looked at further. Under them,
the suffixes of the distinct strings are sorted, their common-prefix intervals come from one scan with a stack, and an
interval is a maximal repeat if what precedes its members is not the same for all. All members of a repeat are known
at once, and with them the smallest document that has it.

Equal texts are one text here, that of their smallest id. Equality of texts and strings is that of 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantframe.session import release, scope, stage

from .words import pieces, text_bytes

#: Windows that are keyed at once.
STEP = 1 << 16
#: Windows of one key that travel in one string at most; longer runs go in parts.
RUN = 64
#: Bytes of text for each bucket of keys, and of strings for each suffix array.
KEY_BYTES = 32 << 20
ARRAY_BYTES = 1 << 20
#: Keys with more distinct strings than one suffix array should hold have their windows aggregated one by one instead.
MANY = 10_000
#: Bits of a key that say whether it is shared; a false match only costs time.
_SHORT = (1 << 40) - 1
_LAST = (1 << 63) - 1


def _mixed(h: np.ndarray, odd: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(odd)
    return h ^ (h >> np.uint64(29))


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """Key of each window of ``length`` bytes: the smallest hash of the pieces in it, mixed again."""
    size = max(8, 2 * length // 5)
    n = len(data) - size + 1
    if len(data) < length:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    hashes = np.zeros(n, np.uint64)
    for at in sorted({*range(0, size - 7, 8), size - 8}):
        hashes = _mixed(hashes ^ words[at : at + n], 0x9E3779B97F4A7C15)
    span, width = 1, length - size + 1
    while 2 * span <= width:
        hashes = np.minimum(hashes[:-span], hashes[span:])
        span *= 2
    if span < width:
        hashes = np.minimum(hashes[: len(hashes) - (width - span)], hashes[width - span :])
    return _mixed(hashes, 0xD6E8FEB86659FD93)


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Neighbouring windows with the same key: row, start in the row, number of windows (``RUN`` at most) and key."""
    for low in range(0, max(len(data) - length + 1, 0), STEP):
        key = window_keys(data[low : low + STEP + length - 1], length)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, low, low + len(key))))
        at = np.flatnonzero(low + np.arange(len(key)) + length <= offsets[row + 1])
        if not len(at):
            continue
        key, row = key[at], row[at]
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
        n = np.diff(np.append(begin, len(at)))
        parts = -(-n // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        n, begin = np.minimum(np.repeat(n, parts) - nth * RUN, RUN), np.repeat(begin, parts) + nth * RUN
        yield row[begin], low + at[begin] - offsets[row[begin]], n, key[begin]


def _ends(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each value of a sorted array."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return first, np.append(first, len(key))[1:] - 1


def _packed(refs: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Pairs of a text and a short key, the texts once with their numbers of keys."""
    order = np.argsort(refs, kind="stable")
    refs, keys = refs[order], keys[order]
    first, last = _ends(refs)
    n = last - first + 1
    short = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
    return refs[first].astype("<i8").tobytes(), n.astype("<u4").tobytes(), short.tobytes()


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    whole = {c: b"".join(table[c].to_pylist()) for c in ("refs", "counts", "keys")}
    refs = np.repeat(np.frombuffer(whole["refs"], "<i8"), np.frombuffer(whole["counts"], "<u4"))
    wide = np.zeros((len(refs), 8), np.uint8)
    wide[:, :5] = np.frombuffer(whole["keys"], np.uint8).reshape(-1, 5)
    return refs, wide.view("<u8").ravel()


def shared_keys(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """``ref`` and ``keys`` (5 bytes each) of the keys that texts with different ``ref`` share; several rows for a ref.

    Each batch knows the keys that its own texts share. It sends two of their texts to the key's bucket, as witnesses
    for other batches, and the others anywhere, so a key that all texts have fills no bucket.
    """

    def dealt(batches):
        for batch in batches:
            refs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            data, offsets = text_bytes(batch.column(1))
            names = batch.column(0).to_numpy()
            for low, high in pieces(offsets):
                for row, _, _, key in runs(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], length):
                    refs.append(names[low + row])
                    keys.append(key)
            ref, key = np.concatenate(refs), np.concatenate(keys)
            order = np.lexsort((ref, key))
            ref, key = ref[order], key[order]
            once = np.append(True, (ref[1:] != ref[:-1]) | (key[1:] != key[:-1]))[: len(key)]
            ref, key = ref[once], key[once]
            if not len(key):
                continue
            first, last = _ends(key)
            witness = np.zeros(len(key), bool)
            witness[first] = witness[last] = True
            out = []
            if not witness.all():
                out.append((int(key[0] % np.uint64(buckets)), True, *_packed(ref[~witness], key[~witness])))
            ref, key = ref[witness], key[witness]
            bucket = (key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
            for low, high in zip(*_ends(bucket)):
                out.append((int(bucket[low]), False, *_packed(ref[low : high + 1], key[low : high + 1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out])] + [pa.array([r[i] for r in out], pa.binary()) for i in (2, 3, 4)],
                ["bucket", "known", "refs", "counts", "keys"],
            )

    def met(table: pa.Table) -> pa.Table:
        known = table["known"].to_numpy()
        ref, key = _unpacked(table.filter(pa.array(~known)))
        if len(key):
            order = np.lexsort((ref, key))
            ref, key = ref[order], key[order]
            first, last = _ends(key)
            shared = np.repeat(ref[first] != ref[last], last - first + 1)
            ref, key = ref[shared], key[shared]
        other_ref, other_key = _unpacked(table.filter(pa.array(known)))
        names, counts, keys = _packed(np.concatenate([ref, other_ref]), np.concatenate([key, other_key]))
        ends = np.cumsum(np.frombuffer(counts, "<u4"), dtype=np.int64) * 5
        lists = [keys[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return pa.table({"ref": pa.array(np.frombuffer(names, "<i8")), "keys": pa.array(lists, pa.binary())})

    blobs = texts.mapInArrow(dealt, "bucket int, known boolean, refs binary, counts binary, keys binary")
    return blobs.groupBy("bucket").applyInArrow(met, "ref long, keys binary")


def strings_of(texts: DataFrame, length: int) -> DataFrame:
    """Strings of neighbouring windows under shared keys: ``key``, ``s``, and where it stands (``t1``, ``least``, ``pos``).

    ``texts`` has ``t1``, ``least``, ``text`` and ``keys``, all rows of ``shared_keys`` of the text.
    """

    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            wanted = batch.column(3).to_pylist()
            names = [batch.column(i).to_numpy() for i in range(2)]
            for low, high in pieces(offsets):
                part = data[offsets[low] : offsets[high]]
                own = offsets[low : high + 1] - offsets[low]
                sets = [np.frombuffer(b"".join(k), np.uint8).reshape(-1, 5) for k in wanted[low:high]]
                wide = np.zeros((sum(map(len, sets)), 8), np.uint8)
                wide[:, :5] = np.concatenate(sets)
                known = np.unique(wide.view("<u8").ravel())
                whole = part.tobytes()
                for row, start, n, key in runs(part, own, length):
                    at = np.minimum(np.searchsorted(known, key & np.uint64(_SHORT)), len(known) - 1)
                    keep = known[at] == key & np.uint64(_SHORT)
                    row, start, n, key = row[keep], start[keep], n[keep], key[keep]
                    begin = own[row] + start
                    found = [whole[a:b] for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(found, pa.binary()), *[pa.array(x[low + row]) for x in names], pa.array(start.astype(np.int64))],
                        ["key", "s", "t1", "least", "pos"],
                    )

    return texts.select("t1", "least", "text", "keys").mapInArrow(cut, "key long, s binary, t1 long, least long, pos long")


def _sharing(strings: list[bytes], keys: np.ndarray, length: int) -> np.ndarray:
    """Places of the strings that may share a window with another one of their key, by hashes of windows."""
    _, of_key, n = np.unique(keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(n[of_key] > 1)
    some = [strings[i] for i in several]
    sizes = np.array([len(s) for s in some], np.int64)
    n = sizes - length + 1
    string = np.repeat(np.arange(len(some)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(sizes) - sizes, n)
    padded = np.frombuffer(b"".join(some) + bytes(8), np.uint8)
    loads = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    hashes = np.zeros(len(at), np.uint64)
    for step in sorted({*range(0, length - 7, 8), length - 8}):
        hashes = _mixed(hashes ^ loads[at + step], 0x9E3779B97F4A7C15)
    order = np.argsort(hashes)
    string, hashes = string[order], hashes[order]
    met = np.flatnonzero((hashes[1:] == hashes[:-1]) & (string[1:] != string[:-1]))
    return several[np.unique(np.concatenate([string[met], string[met + 1]]))]


class IntervalTree:
    """Common-prefix intervals, ``length`` bytes deep or more, of the suffixes of strings, and which are maximal repeats."""

    def __init__(self, strings: list[bytes], length: int):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.begin = np.cumsum(sizes) - sizes
        n = sizes - length + 1
        string = np.repeat(np.arange(len(strings)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self._sort(string, offset, sizes)
        self._scan(length)

    def _sort(self, string: np.ndarray, offset: np.ndarray, sizes: np.ndarray) -> None:
        """Suffix array with the common prefix of each suffix and the one before it."""
        left = sizes[string] - offset
        n_words = -(-int(left.max()) // 8)
        padded = np.ascontiguousarray(np.append(self.data, np.zeros(8 * n_words + 8, np.uint8)))
        loads = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
        at = self.begin[string] + offset
        words = np.empty((n_words, len(at)), np.uint64)
        for j in range(n_words):
            beyond = np.clip(8 * (j + 1) - left, 0, 8).astype(np.uint64) * np.uint64(8)
            word = loads[np.minimum(at + 8 * j, len(loads) - 1)].astype(np.uint64)
            words[j] = np.where(beyond >= 64, np.uint64(0), word >> np.minimum(beyond, np.uint64(63)) << np.minimum(beyond, np.uint64(63)))
        order = np.lexsort((left, *words[::-1]))
        self.string, self.at, left = string[order], at[order], left[order]
        self.before = np.where(offset[order] > 0, self.data[np.maximum(self.at - 1, 0)].astype(np.int16), np.int16(-1))
        common = np.zeros(len(at), np.int64)
        same = np.ones(max(len(at) - 1, 0), bool)
        for j in range(n_words):
            w = words[j][order]
            apart = w[1:] ^ w[:-1]
            common[1:] += np.where(same, sum((apart < np.uint64(1 << 8 * b)).astype(np.int64) for b in range(8)), 0)
            same &= apart == 0
        self.common = np.minimum(common, np.minimum(left, np.append(0, left[:-1])))

    def _scan(self, length: int) -> None:
        """One pass with a stack over the common prefixes; intervals are closed where the prefix gets shorter."""
        deep = np.flatnonzero(self.common >= length)
        depths, lows, highs = [], [], []
        stack: list[tuple[int, int]] = []
        last = -2
        for i, depth in zip(deep.tolist(), self.common[deep].tolist()):
            if i != last + 1:
                for d, low in stack:
                    depths.append(d), lows.append(low), highs.append(last)
                stack = []
            low = i - 1
            while stack and depth < stack[-1][0]:
                d, low = stack.pop()
                depths.append(d), lows.append(low), highs.append(i - 1)
            if not stack or depth > stack[-1][0]:
                stack.append((depth, low))
            last = i
        for d, low in stack:
            depths.append(d), lows.append(low), highs.append(last)
        self.depth, self.low, self.high = (np.array(x, np.int64) for x in (depths, lows, highs))
        # what precedes the members differs, or a string begins there and more may precede it
        change = np.append(False, self.before[1:] != self.before[:-1])
        changes, edges = np.cumsum(change), np.append(0, np.cumsum(self.before < 0))
        maximal = (changes[self.high] > changes[self.low]) | (edges[self.high + 1] > edges[self.low]) if len(deep) else np.zeros(0, bool)
        self.depth, self.low, self.high = self.depth[maximal], self.low[maximal], self.high[maximal]

    def members(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every member of the chosen repeats: number of the repeat, place in the suffix array."""
        n = (self.high - self.low + 1)[chosen]
        which = np.repeat(chosen, n)
        return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.low[which]

    def least(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest value of the members' strings, for each repeat."""
        of = np.append(values[self.string], 0)
        ends = np.stack([self.low, self.high + 1], axis=1).ravel()
        if not len(ends):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.minimum.reduceat(of, ends)[::2], np.maximum.reduceat(of, ends)[::2]

    def covered(self, values: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Per string, the runs of bytes in repeats that a string of a smaller value has too."""
        low, high = self.least(values)
        which, place = self.members(np.flatnonzero(low < high))
        later = values[self.string[place]] > low[which]
        at, depth = self.at[place[later]], self.depth[which[later]]
        steps = np.bincount(at, minlength=len(self.data) + 1) - np.bincount(at + depth, minlength=len(self.data) + 1)
        inside = np.cumsum(steps)[:-1] > 0
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.begin] = edge[-1] = True
        marks = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
        stops = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
        string = np.searchsorted(self.begin, marks, "right") - 1
        found: dict[int, list[tuple[int, int]]] = {}
        for s, a, b in zip(string.tolist(), (marks - self.begin[string]).tolist(), (stops - self.begin[string]).tolist()):
            found.setdefault(s, []).append((a, b))
        yield from found.items()


_SPANS = "array<struct<b:long,e:long>>"


def _text_hashes(text: str) -> tuple:
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("again"), text).alias("t2")


def _strings(docs: DataFrame, id_column: str, text_column: str, length: int):
    """Rows of ``docs`` by identity, strings under shared keys with their places, and distinct strings."""
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("d"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    named = rows.select("d", *_text_hashes("text"), "text")
    marks = stage(named.select("d", "t1", "t2", F.octet_length("text").cast("long").alias("n")).distinct(), "texts")
    size = marks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    firsts = marks.groupBy("t1", "t2").agg(F.min("d").alias("least"))
    long_enough = named.filter(F.octet_length("text") >= length)
    shared = shared_keys(long_enough.select(F.col("t1").alias("ref"), "text"), length, max(16, -(-size // KEY_BYTES)))
    shared = stage(shared, "shared-keys")
    release(docs.sparkSession)
    keys = shared.groupBy("ref").agg(F.collect_list("keys").alias("keys"))
    wanted = firsts.join(keys, F.col("t1") == F.col("ref")).select("t1", "t2", F.col("least").alias("d"), "keys")
    texts = long_enough.join(wanted, ["t1", "t2", "d"]).withColumnRenamed("d", "least")
    places = stage(strings_of(texts, length), "strings", compression="zstd")
    release(docs.sparkSession)
    hashes = [F.xxhash64("key", "s").alias("s1"), F.xxhash64(F.lit("again"), "key", "s").alias("s2")]
    distinct = places.groupBy("key", "s").agg(F.min("least").alias("low"), F.max("least").alias("high"))
    distinct = stage(distinct.select("key", "s", *hashes, "low", "high"), "distinct-strings", compression="zstd")
    release(docs.sparkSession)
    places = places.select(*hashes, "t1", "least", "pos", F.octet_length("s").cast("long").alias("n"))
    return marks, firsts, places, distinct


def _dealt(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct strings dealt to suffix arrays, and those of keys too common for one."""
    common = stage(distinct.groupBy("key").count().filter(F.col("count") > MANY).select("key"), "common-keys")
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("s")), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-size // ARRAY_BYTES)))).alias("bucket")
    return distinct.join(common, "key", "left_anti").select("*", bucket), distinct.join(common, "key")


def _windows(strings: DataFrame, length: int) -> DataFrame:
    """Single windows of strings: their hash ``g1``, ``g2`` and offset ``o``."""
    offsets = F.explode(F.sequence(F.lit(0), F.octet_length("s") - length)).alias("o")
    windows = strings.select("s1", "s2", "low", "s", offsets).withColumn("w", F.expr(f"substring(s, o + 1, {int(length)})"))
    return windows.select("s1", "s2", "low", "o", "w", F.xxhash64("w").alias("g1"), F.xxhash64(F.lit("again"), "w").alias("g2"))


def shared_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 50) -> DataFrame:
    """``t1``, ``t2``, ``d`` and ``spans`` of the rows with bytes that a row of a smaller id has, too.

    ``t1``, ``t2`` are the hashes of the text, ``d`` is the id, the largest long for null. ``spans`` are the runs of
    covered bytes ``b`` to ``e`` (exclusive), in order, apart from each other.
    """
    if length < 16:
        raise ValueError("passages have at least 16 bytes")
    marks, firsts, places, distinct = _strings(docs, id_column, text_column, length)
    dealt, crowded = _dealt(distinct)

    def scan(table: pa.Table) -> pa.Table:
        strings, s1, s2 = table["s"].to_pylist(), table["s1"].to_numpy(), table["s2"].to_numpy()
        some = _sharing(strings, table["key"].to_numpy(), length)
        found = list(IntervalTree([strings[i] for i in some], length).covered(table["low"].to_numpy()[some])) if len(some) else []
        at = some[[i for i, _ in found]] if found else some[:0]
        spans = pa.array([[{"b": b, "e": e} for b, e in runs] for _, runs in found], pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())])))
        return pa.table({"s1": pa.array(s1[at]), "s2": pa.array(s2[at]), "spans": spans})

    tree = dealt.select("bucket", "key", "s", "s1", "s2", "low").groupBy("bucket").applyInArrow(scan, f"s1 long, s2 long, spans {_SPANS}")
    windows = _windows(crowded, length)
    least = windows.groupBy("g1", "g2").agg(F.min("low").alias("least"))
    later = windows.select("s1", "s2", "low", "o", "g1", "g2").join(least, ["g1", "g2"]).filter("least < low")
    single = later.groupBy("s1", "s2").agg(F.collect_list(F.struct(F.col("o").cast("long").alias("b"), (F.col("o") + length).cast("long").alias("e"))).alias("spans"))
    spans = stage(tree.unionByName(single), "string-spans")
    release(docs.sparkSession)
    fates = distinct.select("s1", "s2", "low", "high").join(spans, ["s1", "s2"], "left").filter("low < high OR spans IS NOT NULL")
    hit = places.join(fates, ["s1", "s2"]).filter("least > low OR spans IS NOT NULL")
    whole = F.array(F.struct(F.col("pos").alias("b"), (F.col("pos") + F.col("n")).alias("e")))
    shifted = F.transform("spans", lambda x: F.struct((F.col("pos") + x.b).alias("b"), (F.col("pos") + x.e).alias("e")))
    of_text = hit.select("t1", "least", F.when(F.col("least") > F.col("low"), whole).otherwise(shifted).alias("spans"))
    of_text = of_text.groupBy("t1", "least").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    @F.arrow_udf(_SPANS)
    def merged(spans: pa.Array) -> pa.Array:
        begin, end = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        row = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
        order = np.lexsort((begin, row))
        row, begin, end = row[order], begin[order], end[order]
        # the furthest end so far, row by row: rows are lifted above each other
        lift = row * (int(end.max(initial=0)) + 1)
        far = np.maximum.accumulate(end + lift) - lift
        first = np.append(True, (row[1:] != row[:-1]) | (begin[1:] > far[:-1]))[: len(row)]
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], len(row)) - 1 if len(starts) else starts
        at = np.zeros(len(spans) + 1, np.int32)
        np.cumsum(np.bincount(row[starts], minlength=len(spans)), out=at[1:])
        values = pa.StructArray.from_arrays([pa.array(begin[starts]), pa.array(far[stops])], ["b", "e"])
        return pa.ListArray.from_arrays(pa.array(at), values)

    of_text = of_text.select("t1", "least", merged("spans").alias("spans"))
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("b"), F.col("n").alias("e")))
    known = marks.join(firsts, ["t1", "t2"]).join(of_text, ["t1", "least"], "left")
    fate = F.when(F.col("d") > F.col("least"), F.when(F.col("n") >= length, all_of_it)).otherwise(F.col("spans"))
    return known.select("t1", "t2", "d", fate.alias("spans")).filter("spans IS NOT NULL")


def remove(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 50) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), ``kept`` (the bytes that stay) and ``spans`` of every row.

    A byte goes if it lies in a string of ``length`` bytes that starts in a text with a smaller id, too. Null texts
    count as empty, null ids as the largest long; rows of one id do not take from each other. Rows are neither dropped
    nor merged. ``spans`` are the maximal removed runs, empty where nothing goes. An empty table gives an empty result.
    """
    with scope(docs.sparkSession):
        spans = stage(shared_spans(docs, id_column, text_column, length), "spans", keep=True)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("d"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    ).select("row", "d", *_text_hashes("text"))
    known = rows.join(spans, ["t1", "t2", "d"], "left").withColumn("bytes", F.coalesce(F.col("row")[text_column], F.lit("")).cast("binary"))
    between = (
        "transform(sequence(0, size(spans)), i -> hex(substring(bytes, CAST(IF(i = 0, 0, spans[i - 1].e) AS INT) + 1, "
        "CAST(IF(i = size(spans), length(bytes), spans[i].b) - IF(i = 0, 0, spans[i - 1].e) AS INT))))"
    )
    kept = F.expr(f"CASE WHEN spans IS NULL THEN bytes ELSE unhex(array_join({between}, '')) END")
    return known.select("row", kept.alias("kept"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.octet_length("bytes").cast("long").alias("n_bytes"))


def passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 50) -> DataFrame:
    """Maximal repeats that different texts share, each with all its occurrences: ``passage``, ``doc_id``, ``start``.

    ``doc_id`` is the smallest id of the text (null for the largest long), ``start`` counts bytes. A repeat reaches as
    far as its windows have one key, at most ``RUN`` windows; passages that go on are listed in parts that overlap.
    """
    _, _, places, distinct = _strings(docs, id_column, text_column, length)
    dealt, crowded = _dealt(distinct)

    def scan(table: pa.Table) -> pa.Table:
        tree = IntervalTree(table["s"].to_pylist(), length)
        which, place = tree.members(np.arange(len(tree.depth)))
        string, at, depth = tree.string[place], tree.at[place], tree.depth[which]
        whole = tree.data.tobytes()
        found = [whole[a:b] for a, b in zip(at.tolist(), (at + depth).tolist())]
        return pa.table(
            {"passage": pa.array(found, pa.binary()), "s1": pa.array(table["s1"].to_numpy()[string]), "s2": pa.array(table["s2"].to_numpy()[string]), "o": pa.array(at - tree.begin[string])}
        )

    tree = dealt.select("bucket", "s", "s1", "s2").groupBy("bucket").applyInArrow(scan, "passage binary, s1 long, s2 long, o long")
    single = _windows(crowded, length).select(F.col("w").alias("passage"), "s1", "s2", F.col("o").cast("long").alias("o"))
    alone = distinct.filter("low < high").select(F.col("s").alias("passage"), "s1", "s2", F.lit(0).cast("long").alias("o"))
    found = tree.unionByName(single).unionByName(alone).join(places, ["s1", "s2"])
    found = found.select("passage", F.when(F.col("least") < _LAST, F.col("least")).alias("doc_id"), (F.col("pos") + F.col("o")).alias("start")).distinct()
    several = found.groupBy("passage").agg(F.count_distinct(F.coalesce("doc_id", F.lit(_LAST))).alias("texts")).filter("texts > 1").select("passage")
    return found.join(several, "passage")
