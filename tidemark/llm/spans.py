"""Long exact spans shared between documents, by super-k-mer partitioning (problem 8).

Every window of ``SPAN`` code points has a minimiser, the smallest hash among its m-grams. Consecutive windows with one
minimiser travel as one packed string to that minimiser's bucket; equal windows always meet, as they have equal
minimisers. In the bucket the windows are sorted, so equal ones stand together and are counted exactly.

Only buckets that two different texts reach are packed at all: positions go first, strings after. A bucket with more
than ``HOT_BUCKET`` windows isn't given to one task; its windows are spread one by one by their own hash, with the
same result. Equal texts are worked on once and expanded at the end.

No task builds pairs of a group: buckets give the different sets of texts that have a window in common, one row for each
text of a set, and only ``p8_found`` joins them to pairs, large sets in blocks. Spans, shares and links need no pairs of
documents. A set is known by a 128-bit hash of its texts (in crowded buckets by number, sum and xor of 64-bit hashes).

Defined results: null texts and texts shorter than the span share nothing; a text with a copy is shared in full; spans
that recur only within one document aren't shared. Lengths are in code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.batches import parts
from tidemark.session import materialize

SPAN = 100
#: Length of the grams whose smallest hash names the bucket: long, so that phrases of a genre don't share buckets.
GRAM = 40
#: The most windows that a bucket's task sorts at once, and the most in one string.
HOT_BUCKET = 50_000
LONGEST_RUN = 500
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: So many texts of a set are joined with so many in one task.
PAIR_BLOCK = 1000
_SETS, _STRETCHES = "g binary, n int, k binary", "k binary, start int, stop int"
_SET_ARROW = pa.schema([("g", pa.binary()), ("n", pa.int32()), ("k", pa.binary())])
_STRETCH_ARROW = pa.schema([("k", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])
_RUNS = "k binary, bucket bigint, start int, stop int"


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, grown as longer texts come."""

    def __init__(self) -> None:
        self.size, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > self.size:
            self.size = max(size, 1 << 14, 2 * self.size)
            with np.errstate(over="ignore"):
                make = lambda base: np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.size - 1, base, np.uint64)])
                self.up, self.down = make(_BASE), make(pow(_BASE, -1, 1 << 64))
        return self.up[:size], self.down[:size]


_POWERS = Powers()


def gram_hashes(text: str, gram: int) -> np.ndarray:
    """A well-mixed 64-bit hash of every gram of the text."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    up, down = _POWERS.upto(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * down, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[: len(codes) - gram + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span :]) if width > span else out


def super_kmers(text: str, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first window, last window) of each run of windows with one minimiser; a run of more than ``LONGEST_RUN``
    windows, as repetitive texts have, goes in several strings."""
    least = sliding_min(gram_hashes(text, gram), span - gram + 1)
    cut = least[1:] != least[:-1]
    first = np.r_[0, np.flatnonzero(cut) + 1]
    if np.diff(np.r_[first, len(least)]).max() > LONGEST_RUN:
        since = np.arange(len(least)) - np.repeat(first, np.diff(np.r_[first, len(least)]))
        first = np.flatnonzero(since % LONGEST_RUN == 0)
    last = np.r_[first[1:] - 1, len(least) - 1]
    return least[first].view(np.int64), first.astype(np.int32), last.astype(np.int32)


def _runs(texts: DataFrame, span: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, 500):
                made = [super_kmers(t, span, gram) for t in part.column(1).to_pylist()]
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(made)), [len(b) for b, _, _ in made])))
                cols = [np.concatenate(c) for c in zip(*made)]
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, cols)], names=["k", "bucket", "start", "stop"])

    return texts.select("k", "text").mapInArrow(run, _RUNS)


def _pack(span: int):
    """The packed strings of the runs that are kept, cut out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, 500):
                texts, runs = part.column(1).to_pylist(), part.column(2)
                bucket, n, start, stop = runs.flatten().flatten()
                owner = np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy())
                seqs = [texts[o][a : b + span] for o, a, b in zip(owner, start.to_numpy().tolist(), stop.to_numpy().tolist())]
                yield pa.RecordBatch.from_arrays([bucket, n, part.column(0).take(pa.array(owner)), start, pa.array(seqs, pa.string())], names=["bucket", "n", "k", "start", "seq"])

    return run


def bucket_matches(rows: list[tuple[bytes, int, str]], span: int) -> tuple[set[tuple[bytes, ...]], list[tuple[bytes, int, int]]]:
    """(text key, first window, packed string) of one bucket: the different sets of texts with an equal window, each in
    order, and the shared stretches."""
    windows = sorted((seq[i : i + span], k, start + i) for k, start, seq in rows for i in range(len(seq) - span + 1))
    sets: set[tuple[bytes, ...]] = set()
    shared: dict[bytes, list[int]] = {}
    for _, group in groupby(windows, key=lambda w: w[0]):
        met = list(group)
        keys = tuple(dict.fromkeys(k for _, k, _ in met))  # sorted, as the windows are
        if len(keys) > 1:
            sets.add(keys)
            for _, k, at in met:
                shared.setdefault(k, []).append(at)
    stretches = []
    for k, places in shared.items():
        places.sort()
        start = before = places[0]
        for at in [*places[1:], -1]:
            if at != before + 1:
                stretches.append((k, start, before + span))
                start = at
            before = at
    return sets, stretches


def _set_rows(held: list, span: int) -> list[tuple]:
    return [(hashlib.md5(b"".join(keys)).digest(), len(keys), k) for keys in bucket_matches(held, span)[0] for k in keys]


def _stretch_rows(held: list, span: int) -> list[tuple]:
    return bucket_matches(held, span)[1]


def _sorted_buckets(span: int, close: Callable[[list, int], list[tuple]], schema: pa.Schema):
    """Rows come sorted by bucket; one bucket is held at a time, also across batches."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, [], []
        for batch in batches:
            for bucket, k, start, seq in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != current:
                    if len({k for k, _, _ in held}) > 1:
                        out += close(held, span)
                    current, held = bucket, []
                    if len(out) > 10_000:
                        yield made(out)
                        out = []
                held.append((k, start, seq))
        if len({k for k, _, _ in held}) > 1:
            out += close(held, span)
        if out:
            yield made(out)

    return run


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def distinct_texts(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(k, text, copies) of each different text long enough to share a span."""
    long = documents.where(F.length("text") >= span).select(text_key(F.col("text")).alias("k"), "text")
    return long.groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def _packed(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(bucket, n, k, start, seq): the packed strings of the buckets that two texts reach."""
    runs = materialize(_runs(texts, span, gram))
    reached = runs.groupBy("bucket").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum(F.col("stop") - F.col("start") + 1).alias("n")).where("lo < hi").select("bucket", "n")
    kept = runs.join(reached, "bucket").groupBy("k").agg(F.collect_list(F.struct("bucket", "n", "start", "stop")).alias("runs"))
    return texts.join(kept, "k").select("k", "text", "runs").mapInArrow(_pack(span), "bucket bigint, n bigint, k binary, start int, seq string")


def _usual(packed: DataFrame, hot: int) -> DataFrame:
    return packed.where(F.col("n") <= hot).select("bucket", "k", "start", "seq").repartition("bucket").sortWithinPartitions("bucket")


def shared_sets(texts: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT_BUCKET) -> DataFrame:
    """(g, n, k): the sets of n texts that have a window in common, a row for each text of each set."""
    packed = materialize(_packed(texts, span, gram))
    usual = _usual(packed, hot).mapInArrow(_sorted_buckets(span, _set_rows, _SET_ARROW), _SETS)
    windows = _windows(packed.where(F.col("n") > hot), span).select("w", "k").distinct()
    groups = _groups(windows)
    once = groups.groupBy("n", "s", "x").agg(F.min("w").alias("w"), F.min("n").alias("size"))
    crowded = windows.join(once.select("w", "size"), "w").select(F.col("w").alias("g"), F.col("size").cast("int").alias("n"), "k")
    return usual.unionByName(crowded).dropDuplicates(["g", "k"])


def shared_stretches(texts: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT_BUCKET) -> DataFrame:
    """(k, start, stop): shared stretches of texts, which may touch or overlap."""
    packed = materialize(_packed(texts, span, gram))
    usual = _usual(packed, hot).mapInArrow(_sorted_buckets(span, _stretch_rows, _STRETCH_ARROW), _STRETCHES)
    windows = _windows(packed.where(F.col("n") > hot), span)
    shared = windows.join(_groups(windows.select("w", "k").distinct()).select("w"), "w")
    return usual.unionByName(shared.select("k", F.col("at").cast("int").alias("start"), (F.col("at") + span).cast("int").alias("stop")))


def _windows(packed: DataFrame, span: int) -> DataFrame:
    """(w, k, at): the windows of crowded buckets, to be spread by their own hash."""
    windows = packed.select("k", "start", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - span)).alias("i"))
    return windows.select(text_key(F.expr(f"substring(seq, i + 1, {span})")).alias("w"), "k", (F.col("start") + F.col("i")).alias("at"))


def _groups(members: DataFrame) -> DataFrame:
    """(w, n, s, x) of the windows that several texts have; equal sets of texts have equal n, s and x."""
    return members.groupBy("w").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("x")
    ).where("n > 1")


def text_pairs(texts: DataFrame, span: int = SPAN, **kw: int) -> DataFrame:
    """(k_a, k_b), k_a < k_b: different texts that share a span. Sets are joined with themselves in blocks of bounded size,
    so no task gets all pairs of a large one."""
    members = materialize(shared_sets(texts, span, **kw))
    blocks = F.ceil(F.col("n") / PAIR_BLOCK).cast("int")
    block = F.pmod(F.xxhash64("k"), blocks).cast("int")
    each = F.explode(F.sequence(F.lit(0), blocks - 1))
    a = members.select("g", block.alias("i"), each.alias("j"), F.col("k").alias("k_a"))
    b = members.select("g", each.alias("i"), block.alias("j"), F.col("k").alias("k_b"))
    return a.join(b, ["g", "i", "j"]).where("k_a < k_b").select("k_a", "k_b").distinct()


def shared_pairs(documents: DataFrame, span: int = SPAN, **kw: int) -> DataFrame:
    """All pairs of documents with a common span: pairs of different texts expanded to their copies, and copies."""
    members = documents.where(F.length("text") >= span).select(text_key(F.col("text")).alias("k"), F.col("doc_id").cast("bigint").alias("doc_id"))
    pairs = text_pairs(distinct_texts(documents, span), span, **kw)
    a = members.select(F.col("k").alias("k_a"), F.col("doc_id").alias("x"))
    b = members.select(F.col("k").alias("k_b"), F.col("doc_id").alias("y"))
    across = pairs.join(a, "k_a").join(b, "k_b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    same = a.join(b, F.col("k_a") == F.col("k_b")).where("x < y").select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))
    return across.where("doc_id_a < doc_id_b").unionByName(same)


def document_classes(documents: DataFrame, span: int = SPAN, **kw: int) -> DataFrame:
    """(doc_id, class_id, links): every document long enough, the smallest id with the same text, and how many other
    documents share a span with it. Pairs are counted between different texts only, each weighed with its copies."""
    members = documents.where(F.length("text") >= span).select(text_key(F.col("text")).alias("k"), F.col("doc_id").cast("bigint").alias("doc_id"))
    classes = members.groupBy("k").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    pairs = text_pairs(distinct_texts(documents, span), span, **kw)
    both = pairs.unionByName(pairs.select(F.col("k_b").alias("k_a"), F.col("k_a").alias("k_b")))
    linked = both.join(classes.select(F.col("k").alias("k_b"), "copies"), "k_b").groupBy(F.col("k_a").alias("k")).agg(F.sum("copies").alias("others"))
    known = classes.join(linked, "k", "left").select("k", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(known, "k").select("doc_id", "class_id", "links")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, starts, stops) to (k, spans): stretches that touch or overlap become one."""
    for batch in batches:
        spans = []
        for starts, stops in zip(batch.column(1), batch.column(2)):
            a, b = starts.values.to_numpy(), stops.values.to_numpy()
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            first = np.r_[True, a[1:] > b[:-1]]
            spans.append([{"start": x, "stop": y} for x, y in zip(a[first].tolist(), b[np.r_[first[1:], True]].tolist())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["k", "spans"])


def text_spans(documents: DataFrame, span: int = SPAN, **kw: int) -> DataFrame:
    """(k, spans): the maximal shared stretches of each text that has any, touching stretches merged."""
    texts = distinct_texts(documents, span)
    found = shared_stretches(texts, span, **kw)
    copied = texts.where("copies > 1").select("k", F.lit(0).alias("start"), F.length("text").alias("stop"))
    grouped = found.unionByName(copied).groupBy("k").agg(F.collect_list(F.struct("start", "stop")).alias("s")).select("k", F.col("s.start").alias("a"), F.col("s.stop").alias("b"))
    return grouped.mapInArrow(_merged, "k binary, spans array<struct<start:int,stop:int>>")


def document_spans(documents: DataFrame, span: int = SPAN, **kw: int) -> DataFrame:
    """One row per shared stretch of each document."""
    members = documents.where(F.length("text") >= span).select(text_key(F.col("text")).alias("k"), "doc_id")
    return members.join(text_spans(documents, span, **kw), "k").select("doc_id", F.explode("spans").alias("x")).select("doc_id", F.col("x.start").alias("start"), F.col("x.stop").alias("stop"))


def document_shares(documents: DataFrame, span: int = SPAN, **kw: int) -> DataFrame:
    """Every document with the number and share of its characters found elsewhere; 0 where nothing is shared."""
    rows = documents.select("doc_id", text_key(F.col("text")).alias("k"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    chars = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["stop"] - x["start"])
    joined = rows.join(text_spans(documents, span, **kw).select("k", chars.alias("c")), "k", "left")
    shared = F.coalesce("c", F.lit(0))
    return joined.select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("share"))
