import random

import numpy as np
import pytest

from tidemark.llm import spans


def brute(texts, span):
    seen = {}
    for i, t in texts:
        if t:
            for k in range(len(t) - span + 1):
                seen.setdefault(t[k : k + span], set()).add(i)
    pairs, covered = set(), {i: [False] * len(t or "") for i, t in texts}
    for ids in seen.values():
        pairs |= {(a, b) for a in ids for b in ids if a < b}
    for i, t in texts:
        for k in range(len(t or "") - span + 1):
            if len(seen[t[k : k + span]]) > 1:
                covered[i][k : k + span] = [True] * span
    return pairs, {i: sum(c) for i, c in covered.items()}


def corpus():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("股價漲跌ab\n😀") for _ in range(n))
    shared = [text(90), text(60), text(45)]
    rows = [(i, text(rng.randint(0, 80)) + rng.choice(shared)[rng.randint(0, 20) :] + text(rng.randint(0, 60))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "短"), (103, rows[0][1]), (104, rows[0][1]), (105, "啊" * 3000), (106, "啊" * 41), (107, shared[0]), (108, text(8000) + shared[1])]


@pytest.mark.parametrize("hot", [1000, 2])
def test_pairs_and_shares_equal_brute_force(spark, hot):
    rows = corpus()
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id bigint, text string, k binary, start int")
    pairs, shares = brute(rows, 40)
    got = [(r.doc_id_a, r.doc_id_b) for r in spans.shared_pairs(df, 40, gram=16, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    links = {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    classes = {r.doc_id: (r.class_id, r.links) for r in spans.document_classes(df, 40, gram=16, hot=hot).collect()}
    assert {i: n for i, (_, n) in classes.items() if n} == links and classes[104][0] == classes[103][0] == 0
    rates = {r.doc_id: (r.shared_chars, r.share) for r in spans.document_shares(df, 40, gram=16, hot=hot).collect()}
    assert {i: c for i, (c, _) in rates.items()} == shares and rates[100] == (0, 0.0)
    stretches = spans.document_spans(df, 40, gram=16, hot=hot).collect()
    total = {}
    for r in stretches:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.stop - r.start
    assert total == {i: c for i, c in shares.items() if c}


def test_long_runs_are_split(spark, monkeypatch):
    bucket, first, last = spans.super_kmers("啊" * 3000, 100, 40)
    assert len(set(bucket.tolist())) == 1 and (last - first).max() + 1 == spans.LONGEST_RUN and last[-1] == 2900 and (first[1:] == last[:-1] + 1).all()
    df = spark.createDataFrame([(1, "啊" * 30_000), (2, "哦" + "啊" * 2000)], "doc_id bigint, text string")
    assert [tuple(r) for r in spans.shared_pairs(df, hot=1000).collect()] == [(1, 2)]
    assert {r.doc_id: r.shared_chars for r in spans.document_shares(df).collect()} == {1: 30_000, 2: 2000}


def test_minimum_and_runs():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1000, 300).astype(np.uint64)
    for width in (1, 2, 7, 61, 64, 300):
        want = [values[i : i + width].min() for i in range(300 - width + 1)]
        assert spans.sliding_min(values, width).tolist() == want
    bucket, first, last = spans.super_kmers("abcdefgh" * 40, 100, 40)
    assert first[0] == 0 and last[-1] == 220 and (first[1:] == last[:-1] + 1).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.shared_pairs(df).count() == 0 and spans.document_shares(df).count() == 0


def test_many_texts_with_one_span(spark):
    """Thousands of texts in one bucket: a row each, and pairs in blocks."""
    rng = random.Random(7)
    shared = "".join(rng.choice("股價漲跌甲乙丙丁") for _ in range(100))
    rows = [(i, chr(0x5000 + i) + shared + chr(0x5000 + i)) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = spans.distinct_texts(df)
    assert spans.shared_sets(texts).count() == 2500
    assert spans.text_pairs(texts).count() == 2500 * 2499 // 2
    assert spans.document_classes(df).where("links = 2499").count() == 2500
    assert spans.document_shares(df).where("shared_chars = 100").count() == 2500
