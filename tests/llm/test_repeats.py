"""Repeated passages against brute force over all windows."""

import random

import numpy as np
import pytest

from plantframe.llm import repeats

LAST = (1 << 63) - 1


def spans_of(inside):
    return [(a, next((b for b in range(a, len(inside)) if not inside[b]), len(inside))) for a in range(len(inside)) if inside[a] and (a == 0 or not inside[a - 1])]


@pytest.mark.parametrize("seed", range(25))
def test_interval_tree(seed):
    """Maximal repeats with all members, and what a string of a smaller value has too."""
    rng, length = random.Random(seed), 6
    strings = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randint(length, 14))) for _ in range(rng.randint(1, 12))})
    values = np.array([rng.randint(1, 5) for _ in strings])
    places = {}
    for i, s in enumerate(strings):
        for a in range(len(s)):
            for b in range(a + length, len(s) + 1):
                places.setdefault(s[a:b], []).append((i, a))
    want = {}
    for w, at in places.items():
        before = {strings[i][a - 1] if a else ("edge", i) for i, a in at}
        after = {strings[i][a + len(w)] if a + len(w) < len(strings[i]) else ("edge", i) for i, a in at}
        diverse = [len(side) > 1 or any(isinstance(x, tuple) for x in side) for side in (before, after)]
        if len(at) > 1 and all(diverse):
            want[w] = sorted(at)
    tree = repeats.IntervalTree(strings, length)
    got = {}
    for repeat, place in zip(*tree.members(np.arange(len(tree.depth)))):
        i, a = int(tree.string[place]), int(tree.at[place] - tree.begin[tree.string[place]])
        got.setdefault(strings[i][a : a + int(tree.depth[repeat])], []).append((i, a))
    assert {k: sorted(v) for k, v in got.items()} == want
    least = {w: min(values[i] for i, _ in at) for w, at in places.items() if len(w) == length}
    covered = dict(tree.covered(values))
    for i, s in enumerate(strings):
        inside = [any(0 <= j - a < length and least[s[a : a + length]] < values[i] for a in range(len(s) - length + 1)) for j in range(len(s))]
        assert covered.get(i, []) == spans_of(inside)


def brute(rows, length=50):
    least, texts = {}, [(LAST if i is None else i, i, (t or "").encode()) for i, t in rows]
    for d, _, b in texts:
        for a in range(len(b) - length + 1):
            least[b[a : a + length]] = min(least.get(b[a : a + length], LAST), d)
    out = []
    for d, i, b in texts:
        inside = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if least[b[a : a + length]] < d:
                inside[a : a + length] = b"\1" * length
        out.append((i, len(b), bytes(x for x, y in zip(b, inside) if not y), spans_of(inside)))
    return sorted(out, key=str)


def removed(df, **options):
    out = repeats.remove(df, **options)
    return sorted([(r.doc_id, r.n_bytes, bytes(r.kept), [(s.b, s.e) for s in r.spans]) for r in out.select("row.doc_id", "n_bytes", "kept", "spans").collect()], key=str)


def some_rows(rng):
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 400))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            b = rng.choice(base)
            a = rng.randint(0, max(0, len(b) - 1))
            parts.append(b[a : a + rng.randint(0, 200)])
        rows.append((rng.choice([i, i, i, 7, None]), "".join(parts)))
    rows += [(100, None), (101, ""), (102, "x" * 5000), (3, "x" * 300), (103, "x" * 49), (104, "x" * 50), (105, rows[5][1]), (105, rows[5][1]), (None, rows[6][1])]
    return rows


@pytest.mark.parametrize("many", [10_000, 0])
def test_removed_bytes(spark, monkeypatch, many):
    """Nulls, empty texts, repeated rows and ids, one long run, and keys too common for one suffix array."""
    monkeypatch.setattr(repeats, "MANY", many)
    rows = some_rows(random.Random(3 + many))
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_a_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 700)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij ") for _ in range(6000))
    rows = [(1, text), (2, text[1000:4000] + "other" * 30), (3, "other" * 40 + text[:60])]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_growth_with_a_group_of_near_copies(spark):
    """Twice the near copies give about twice the strings."""
    words = [f"w{i * 7919 % 1000}" for i in range(200)]

    def strings(n):
        rng = random.Random(1)
        rows = []
        for i in range(n):
            own = list(words)
            own[rng.randrange(200)] = f"n{rng.random()}"
            rows.append((i, " ".join(own)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return repeats._strings(df, "doc_id", "text", 50)[2].count()

    assert strings(80) < 2.3 * strings(40)


def test_passages_have_all_their_occurrences(spark):
    rng = random.Random(4)
    shared = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(90)) for _ in range(3)]
    rows = []
    for i in range(12):
        own = "".join(rng.choice("qrstuvwxyz") for _ in range(60))
        rows.append((i, own + shared[i % 3] + own[::-1] + (shared[0] if i % 5 == 0 else "")))
    found = {}
    for r in repeats.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(bytes(r.passage), set()).add((r.doc_id, r.start))
    assert found
    for passage, at in found.items():
        assert at == {(i, a) for i, t in rows for a in range(len(t)) if t.encode().startswith(passage, a)}
    # parts of passages overlap; together they are all windows that two texts share
    having = {}
    for i, t in rows:
        for a in range(len(t) - 49):
            having.setdefault(t[a : a + 50], set()).add(i)
    want = {(i, j) for i, t in rows for a in range(len(t) - 49) if len(having[t[a : a + 50]]) > 1 for j in range(a, a + 50)}
    assert {(i, j) for p, at in found.items() for i, a in at for j in range(a, a + len(p))} == want


def test_odd_tables(docs, no_docs, clashing):
    assert repeats.remove(no_docs).count() == 0
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert removed(docs) == brute(rows)
    out = repeats.remove(clashing)
    assert out.select("row.*").columns == clashing.columns and out.count() == clashing.count()
    with pytest.raises(ValueError):
        repeats.remove(docs, length=8)
