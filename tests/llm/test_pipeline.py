"""The pipeline's stages against plain computations over the smallest table, each on what the stage before it kept."""

import hashlib
import math
from collections import Counter

import pytest

import corpus_pipeline
from plantframe.llm import pii
from plantframe.session import stage
from test_texts import plain_redaction, slow_fingerprint, slow_measures

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], FOLDER), f"test-{name}"))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "personal_data", "mixing", "bpe"]


def test_quality_rules(stages):
    def keeps(text):
        n, chars, symbols, lines, repeated_lines, repeats = slow_measures(text)
        capitals = sum("A" <= c <= "Z" for c in text or "")
        return not (
            n < 50 or 100 * repeats > 50 * n or 10 * symbols > n or 2 * repeated_lines > lines or 2 * capitals > chars or 2 * chars < 5 * n or chars > 11 * n
        )

    assert rows(stages[1]) == sorted((tuple(r) for r in stages[0].collect() if keeps(r.text)), key=str)


def test_near_dedup(stages):
    docs = stages[1].collect()
    marks = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in marks:
        for j in marks:
            if i < j and (marks[i] ^ marks[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert rows(stages[2]) == sorted((tuple(r) for r in docs if find(r.doc_id) == r.doc_id), key=str)
    assert len(docs) > stages[2].count()


def test_personal_data(stages):
    docs = stages[2]
    spans = {r.row.doc_id: r for r in pii.find(docs).collect()}
    want = []
    for r in docs.collect():
        text = plain_redaction(r.text, spans[r.doc_id])
        want.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert rows(stages[3]) == sorted(want, key=str) and any("<EMAIL>" in w[1] for w in want)


def test_mixing(stages):
    docs = stages[3].collect()
    bucket = lambda s: s if s in corpus_pipeline.WEIGHTS else "*"
    size = Counter()
    for r in docs:
        size[bucket(r.source)] += len(r.text or "")
    weight = {b: corpus_pipeline.WEIGHTS.get(b, 1.0) for b in size}
    want = Counter()
    for r in docs:
        b = bucket(r.source)
        rate = weight[b] / sum(weight.values()) * sum(size.values()) / size[b]
        u = (int(hashlib.md5(f"draw:0:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, below, p = 0, 0.0, math.exp(-rate)
        while below + p < u:
            below, n = below + p, n + 1
            p *= rate / n
        want[r.doc_id] += n
    assert Counter(r.doc_id for r in stages[4].collect()) == +want
    assert set(rows(stages[4])) <= set(rows(stages[3]))


def test_token_ids(stages, bpe_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_path)
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    out = stages[5].collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in stages[4].collect())
    for r in out:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.round_trip


def test_odd_documents(spark, docs, clashing, tmp_path):
    """Nulls, repeats, long texts and clashing columns go through every stage; the kept columns are those of the input."""
    for df in (docs, clashing):
        out = df
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = stage(step(spark, out, ""), f"odd-{name}")
            assert out.columns == df.columns
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in df.collect()}
