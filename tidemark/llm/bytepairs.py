"""Byte-pair encoding by dynamic programming over prefixes (problem 6).

For every prefix of a piece there is exactly one token that can end its encoding: the one whose left neighbour in the
encoding of the rest it may follow. Storing that last token for each prefix gives the encoding by walking back, makes
appending exact (stored prefixes never change), and lets an edit reuse everything before it.

Texts are cut into pieces by the tokenizer's pattern first; pieces repeat, so each worker keeps a bounded table of
pieces it has encoded.

Defined results: null and empty texts have the empty list of ids. Lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.batches import parts

#: Where the public vocabulary files lie; a parameter of every operator below.
TOKENIZER_DIR = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k"
#: Fixed value: how this family of tokenizers cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker remembers; beyond it the table starts anew.
CACHED_PIECES = 300_000
#: Neighbours of tokens a worker remembers, likewise.
CACHED_PAIRS = 1_000_000


class Vocabulary:
    """Ranks of tokens, the tokens that may end at a byte, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._splits: dict[bytes, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        #: For each last two bytes: the lengths of tokens that end so, longest first.
        self._lengths: dict[bytes, list[int]] = {}
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            ends.setdefault(token[-2:], set()).add(len(token))
        for end, lengths in ends.items():
            if len(end) == 2:
                lengths = lengths | ends.get(end[1:], set())
            self._lengths[end] = sorted(lengths, reverse=True)

    def merged(self, text: bytes) -> list[int]:
        """Plain merging by rank: the definition, used for short texts only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: bytes) -> bool:
        """Does merging the token's own bytes give the token?"""
        known = self._splits.get(token)
        if known is None:
            known = self._splits[token] = self.merged(token) == [self.ranks[token]]
        return known

    def follows(self, left: int, right: int) -> bool:
        """Do the two tokens stay two when their bytes are merged together?"""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            known = self._pairs[(left, right)] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known


class PrefixTable:
    """The unique last token of each prefix of one piece; ``last[i]`` is that of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def append(self, more: bytes) -> None:
        """Exact: tokens of longer prefixes depend on shorter ones only."""
        v, start = self.vocabulary, len(self.text)
        self.text = text = self.text + more
        last, ranks, lengths = self.last, v.ranks, v._lengths
        for end in range(start + 1, len(text) + 1):
            for size in lengths.get(text[max(0, end - 2) : end]) or lengths[text[end - 1 : end]]:
                if size > end:
                    continue
                token = text[end - size : end]
                rank = ranks.get(token)
                if rank is None or not v.whole(token):
                    continue
                if size == end or v.follows(last[end - size - 1], rank):
                    last.append(rank)
                    break
            else:
                raise ValueError("no token ends here")

    def truncate(self, size: int) -> None:
        self.text, self.last = self.text[:size], self.last[:size]

    def splice(self, start: int, stop: int, new: bytes) -> None:
        """Replace bytes; prefixes before the edit keep their tokens, only the rest is worked out again."""
        tail = self.text[stop:]
        self.truncate(start)
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        out.reverse()
        return out


class Encoder:
    """Pieces, their tables and the bounded memory of what pieces gave."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self._known
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                data = piece.encode()
                rank = self.vocabulary.ranks.get(data)
                ids = [rank] if rank is not None and self.vocabulary.whole(data) else PrefixTable(self.vocabulary, data).ids()
                if len(known) >= CACHED_PIECES:
                    known.clear()
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.vocabulary.tokens[i] for i in ids).decode("utf-8", "replace")


class EditableText:
    """A text with its ids, kept exact under appends and edits by encoding only the pieces near the change."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.pieces = encoder, "", []
        self.replace(0, 0, text)

    def replace(self, start: int, stop: int, new: str) -> int:
        """Replace text[start:stop]; gives the number of pieces that were encoded again."""
        old, shift = self.pieces, len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        keep, at = 0, 0
        while keep < len(old) and at + len(old[keep][0]) < start:
            at += len(old[keep][0])
            keep += 1
        if keep:  # a run of spaces looks one piece ahead
            keep -= 1
            at -= len(old[keep][0])
        starts, place = {}, 0
        for i, (piece, _) in enumerate(old):
            if place >= stop:
                starts[place + shift] = i
            place += len(piece)
        made, tail = [], []
        for match in self.encoder.pattern.finditer(self.text, at):
            i = starts.get(match.start())
            if i is not None and match.start() > start + len(new):
                tail = old[i:]
                break
            made.append((match.group(), self.encoder.encode(match.group())))
        self.pieces = old[:keep] + made + tail
        return len(made)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [i for _, ids in self.pieces for i in ids]


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


@lru_cache(4)
def encoder(name: str = DEFAULT, folder: str = TOKENIZER_DIR) -> Encoder:
    return Encoder(Vocabulary(read_ranks(f"{folder}/{name}.tiktoken")))


def encoded(frame: DataFrame, key: Column, text: Column, name: str = DEFAULT, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids array<int>) of each row, one map-only pass. Only key and text cross to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder).encode
        for batch in batches:
            for part in parts(batch, 1, 1000):
                ids = [encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return frame.select(key.cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_counts(frame: DataFrame, key: Column, text: Column, name: str = DEFAULT, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, n_tokens): as above, but only counts leave Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder).encode
        for batch in batches:
            for part in parts(batch, 1, 1000):
                sizes = [len(encode(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return frame.select(key.cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def spread(frame: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deal rows over all cores where the input has fewer splits than there are cores; large inputs stay as they are."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores * 3, key) if frame.rdd.getNumPartitions() < cores else frame


__all__ = ["Encoder", "EditableText", "PrefixTable", "Vocabulary", "encoded", "encoder", "read_ranks", "spread", "token_counts"]
