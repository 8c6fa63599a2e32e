import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bytepairs as B

tiktoken = pytest.importorskip("tiktoken")
ALPHABET = "ab  \n\t'sé中文😀１12,.​\r"


def reference(name):
    return tiktoken.Encoding("t", pat_str=B.PATTERN, mergeable_ranks=B.read_ranks(f"{B.TOKENIZER_DIR}/{name}.tiktoken"), special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_same_ids_as_the_library(name):
    ours, theirs, rng = B.encoder(name), reference(name), random.Random(1)
    texts = ["", " ", "hello world", "漲漲漲漲漲", "<|endoftext|>", "a" * 5000, "中" * 5000] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for text in texts:
        ids = ours.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert ours.decode(ids) == text


def test_prefix_table_appends_and_splices_exactly():
    v, rng = B.encoder().vocabulary, random.Random(2)
    data = bytes(rng.choice(b"abcab tthhe") for _ in range(200))
    table = B.PrefixTable(v, data[:70])
    table.append(data[70:])
    assert table.last == B.PrefixTable(v, data).last
    table.splice(50, 60, b"xyz")
    assert table.last == B.PrefixTable(v, data[:50] + b"xyz" + data[60:]).last
    for size in range(1, 60):
        assert B.PrefixTable(v, data[:size]).ids() == v.merged(data[:size])


def test_edits_encode_only_pieces_near_the_change():
    ours, theirs, rng = B.encoder(), reference("byte_bpe_50k"), random.Random(4)
    long = B.EditableText(ours, "the price of it, " * 500)
    assert long.replace(4000, 4005, "漲 漲") < 12 and long.ids() == theirs.encode_ordinary(long.text)
    for _ in range(400):
        edited = B.EditableText(ours, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))))
        for _ in range(3):
            a = rng.randint(0, len(edited.text))
            edited.replace(a, rng.randint(a, min(len(edited.text), a + 6)), "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 5))))
            assert edited.ids() == theirs.encode_ordinary(edited.text)


def test_frames(spark):
    rows = [(1, "推", "x"), (2, None, "x"), (3, "", "x"), (4, "中" * 30_000, "x"), (4, "推", "x"), (None, "推", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = B.encoded(df, F.col("doc_id"), F.col("text")).collect()
    assert len(got) == 6 and [r.ids for r in got if r.doc_id in (2, 3)] == [[], []]
    sizes = B.token_counts(df, F.col("doc_id"), F.col("text")).collect()
    assert sorted(len(r.ids) for r in got) == sorted(r.n_tokens for r in sizes)
    assert B.encoded(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0
