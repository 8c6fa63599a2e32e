"""Scores for abusive, hateful and sexual passages (problem 1).

Texts are folded to one form, lowered, numbers and listed names become one symbol each, and are read through overlapping
windows: every full window, and one from each clause's start that may be shorter, so a passage of up to a window's width
stands whole in one. Training picks from windows that start at clauses and every ``STRIDE`` characters within them.
A bidirectional gated recurrent network with attention pooling (``gru``) scores every window; a row's score is that of
its worst window. No window is left out: equal windows have equal scores, so a worker scores each different window once
and remembers it by a 64-bit hash, and what several windows begin or end with is worked out once (``gru.Scorer``).

The network is trained when the query runs, on the reviewed rows: labels are per row, so for a positive row the window
that scores highest stands for it, for a negative row all windows do. Reviewers err; rows the network firmly contradicts
after a while are left out, and looked at again later. ``MAX_LABELS`` bounds the sample (chosen by hash); the number of
training steps is fixed.

Defined results: null, empty and blank texts score 0. Without labels of both kinds every row scores 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.batches import parts
from tidemark.llm.forms import _rows as fold_rows
from tidemark.llm.gru import WIDTH, Adam, Scorer, features, initial, step
from tidemark.llm.names import Finder
from tidemark.llm.spans import Powers as _Powers

STRIDE = 12
#: The most reviewed rows to train on.
MAX_LABELS = 6000
STEPS, BATCH = 1500, 96
#: Rows without review that join the sample, per source table.
UNREVIEWED = {"comments": 3000, "articles": 400, "documents": 1200}
#: Training looks at all windows anew in so many phases; rows of up to so many windows are short.
PHASES, SHORT_ROW = 12, 6
#: Enrichment of trigrams from which a window may be what was marked, and from which it isn't used as a negative.
ORDINARY, SUSPECT = 4.0, 4.0
THRESHOLD = 0.93
#: All windows are looked at, whatever their neighbours score; only a test still names this bound.
LOOK = 0.0
#: Different windows a worker remembers (12 bytes each); beyond it the memory starts anew. So many are scored at once.
CACHED_WINDOWS, TOGETHER = 12_000_000, 524_288
#: About so many characters of texts are looked through at once.
TEXTS_TOGETHER = 1_000_000
_BREAKS = re.compile(r"[,，.。!！?？;；:：、\n\r…]+")
_NUMBER = re.compile(r"\d[\d.,%]*")
_SPACES = re.compile(r"[^\S\n]+")
_BREAK = np.array([ord(c) for c in ",，.。!！?？;；:：、\n\r…"], np.uint32)
_SPACE = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
_HASH = _Powers()
# Signs written over a hidden character.
MASKS = "○*x口·"


class _Table(dict):
    """A table for str.translate that notes characters it doesn't change; to miss them each time is slow."""

    def __missing__(self, code: int) -> int:
        self[code] = code
        return code


class Reader:
    """Texts to their windows."""

    def __init__(self, names: list[str]):
        table = {ord(c): r for c, r in zip(fold_rows()["ch"].to_pylist(), fold_rows()["repl"].to_pylist())}
        self.table = _Table(str.maketrans({**table, 0: None}))
        names = {n.translate(self.table).lower().strip() for n in names}
        self.find = Finder(n for n in names if len(n) > 1 and not n.isascii())

    def normal(self, texts: list[str]) -> list[str]:
        joined = "\0".join(t.translate(self.table) for t in texts).lower()
        if self.find:
            out, at = [], 0
            for start, stop in self.find(joined):
                out.append(joined[at:start])
                at = stop
            out.append(joined[at:])
            joined = "甲".join(out)
        joined = _SPACES.sub(" ", _NUMBER.sub("0", joined))
        return joined.split("\0")

    @staticmethod
    def windows(text: str, stride: int) -> list[str]:
        """What training picks from."""
        starts, at = [], 0
        for found in _BREAKS.finditer(text):
            starts.append(at)
            at = found.end()
        starts.append(at)
        out = []
        for start, stop in zip(starts, [*starts[1:], len(text)]):
            for i in range(start, max(start + 1, stop - 3), stride):
                window = text[i : i + WIDTH].strip()
                if window:
                    out.append(window)
        return out


def window_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts with a 0 after each, starts, sizes, text, whether a clause begins there) of the windows;
    white space at a window's ends isn't part of it."""
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    end = (np.cumsum(lengths + 1) - 1)[owner]
    at = np.arange(len(codes))
    space, stop_sign = np.isin(codes, _SPACE), np.isin(codes, _BREAK)
    first = np.r_[True, codes[:-1] == 0]
    clause = first | (np.r_[False, stop_sign[:-1]] & ~stop_sign)
    # The start of a clause that begins with white space is its first other sign.
    begins = np.zeros(len(codes), bool)
    later = np.minimum.accumulate(np.where(space, len(codes), at)[::-1])[::-1]
    begins[np.minimum(later[clause], len(codes) - 1)] = True
    starts = np.flatnonzero((codes > 0) & ~space & (begins | (at + WIDTH <= end)))
    solid = np.maximum.accumulate(np.where(space | (codes == 0), 0, at))
    sizes = solid[np.minimum(starts + WIDTH, end[starts]) - 1] - starts + 1
    return codes, starts, sizes, owner[starts], begins[starts]


class Memory:
    """Scores of windows by hash, in order of hash; recent ones stand apart until they are an eighth, so that few additions
    move the rest."""

    def __init__(self, most: int = CACHED_WINDOWS):
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.runs = [(np.empty(0, np.uint64), np.empty(0, np.float32)) for _ in range(2)]

    def __len__(self) -> int:
        return sum(len(keys) for keys, _ in self.runs)

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the keys, and which of them are there."""
        scores, there = np.empty(len(keys), np.float32), np.zeros(len(keys), bool)
        for mine, kept in self.runs:
            place = np.searchsorted(mine, keys)
            inside = np.flatnonzero(place < len(mine))
            found = inside[mine[place[inside]] == keys[inside]]
            scores[found], there[found] = kept[place[found]], True
        return scores, there

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        """Keys in order that aren't there."""
        if len(self) + len(keys) > self.most:
            self._forget()
        old, recent = self.runs[0], _merged(*self.runs[1], keys, scores)
        if len(recent[0]) * 8 > len(old[0]):
            self.runs = [_merged(*old, *recent), (recent[0][:0].copy(), recent[1][:0].copy())]
        else:
            self.runs = [old, recent]


def _merged(keys: np.ndarray, scores: np.ndarray, more: np.ndarray, their: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(keys, more)
    return np.insert(keys, place, more), np.insert(scores, place, their)


def coded(windows: list[str]) -> np.ndarray:
    """Windows as a matrix of code points, 0 after their end."""
    data = "".join(w.ljust(WIDTH, "\0") for w in windows).encode("utf-32-le")
    return np.frombuffer(data, "<u4").reshape(-1, WIDTH)


def _masked(codes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A third of the windows with characters hidden or split by signs, as writers do to evade filters."""
    codes = codes.copy()
    signs = [ord(c) for c in MASKS]
    for i in np.flatnonzero(rng.random(len(codes)) < 0.35):
        size = int((codes[i] > 0).sum())
        if size < 2:
            continue
        sign = signs[rng.integers(len(signs))]
        if rng.random() < 0.6:
            codes[i, rng.integers(size)] = sign
        else:
            at, n = int(rng.integers(size)), int(rng.integers(1, 4))
            row = list(codes[i, :size])
            row = row[:at] + [v for c in row[at : at + n] for v in (c, sign)] + row[at + n :]
            codes[i] = (row + [0] * WIDTH)[:WIDTH]
    return codes


def _grams(window: str) -> set[str]:
    """Three characters, or eight where they are ASCII: a syllable of letters says less than one of ideographs."""
    out = {window[i : i + 3] for i in range(len(window) - 2) if not window[i : i + 3].isascii()}
    out |= {window[i : i + 8] for i in range(len(window) - 7) if window[i : i + 8].isascii()}
    return out or {window}


def enrichment(rows: list[list[str]], y: np.ndarray, short: np.ndarray, least: int, doubt: float = 0.0) -> np.ndarray:
    """Per window: how much oftener its trigrams stand in positive rows than other rows of the same kind, short or long,
    let expect (the third best of them). ``doubt``: so many standard deviations are taken off each count."""
    counts: dict[tuple[bool, bool], Counter] = {(a, b): Counter() for a in (False, True) for b in (False, True)}
    for windows, mark, kind in zip(rows, y, short):
        counts[bool(mark == 1), bool(kind)].update(set().union(*map(_grams, windows)))
    size = {(a, b): int((((y == 1) == a) & (short == b)).sum()) for a in (False, True) for b in (False, True)}
    ratio = {}
    for g in counts[True, True].keys() | counts[True, False].keys():
        n = counts[True, True][g] + counts[True, False][g]
        if n >= least:
            expected = sum(size[True, k] * (counts[False, k][g] + 0.5) / (size[False, k] + 1) for k in (True, False))
            ratio[g] = (n - doubt * n**0.5) / expected
    return np.array([sorted((ratio.get(g, 0.0) for g in _grams(w)), reverse=True)[:3][-1] for r in rows for w in r])


def train(texts: list[str], labels: list[int], reader: Reader, unreviewed: list[str] = (), steps: int = STEPS, seed: int = 7) -> dict | None:
    """The parameters learned from rows with labels 0 and 1 and from rows without; None unless both labels occur."""
    rows = [reader.windows(t, STRIDE) for t in reader.normal([*texts, *unreviewed])] if texts else []
    marks = [*labels, *[-1] * len(unreviewed)]
    keep = [i for i, w in enumerate(rows) if w]
    rows, y = [rows[i] for i in keep], np.array([marks[i] for i in keep])
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    sizes = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    known: dict[str, int] = {}
    place = np.array([known.setdefault(w, len(known)) for r in rows for w in r])
    different = coded(list(known))
    codes = different[place]
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    short = sizes <= SHORT_ROW
    # What reviewers marked stands in positive rows far oftener than elsewhere; a positive row without such a window was
    # marked in error, and a window like that isn't taken for a negative.
    loose, firm = enrichment(rows, y, short, 1), enrichment(rows, y, short, 2)
    strict = enrichment(rows, y, short, 2, 1.5)  # a long row has many windows, so chance is counted off
    best_loose, best_strict = np.maximum.reduceat(loose, first), np.maximum.reduceat(strict, first)
    marked = (y == 1) & np.where(short, best_loose >= ORDINARY, best_strict >= SUSPECT)
    positive = np.flatnonzero(marked) if marked.any() else np.flatnonzero(y == 1)
    # Unless the very same window stands in more other rows than in positive ones.
    with_it, against = Counter(), Counter()
    for windows, mark in zip(rows, y):
        (with_it if mark == 1 else against).update(set(windows))
    harmless = np.array([against[w] >= 3 and against[w] > 2 * with_it[w] for r in rows for w in r])
    clean = np.flatnonzero((y[owner] == 0) & ((firm < 2 * SUSPECT) | harmless))
    clean = clean if len(clean) else np.flatnonzero(y[owner] == 0)
    free = np.flatnonzero((y[owner] == -1) & ((firm < SUSPECT) | harmless))
    free = free if len(free) else clean
    top = lambda value: np.array([f + int(value[f : f + n].argmax()) for f, n in zip(first, sizes)])
    rank = np.where(harmless, 0, np.where(short[owner], loose, strict))
    chosen = top(rank)
    both = np.r_[clean, free]
    hard = both
    p = initial(seed)
    adam = Adam(p)
    every = max(1, steps // PHASES)
    half, share = BATCH // 2, BATCH // 16
    for at in range(steps):
        if at and at % every == 0:
            score = Scorer(p)(different)[place]
            hard = both[np.argsort(-score[both])[: max(50, len(both) // 40)]]
            # Any window of a positive row that is as telling as the chosen one may stand for it.
            chosen = top(np.where(rank >= np.minimum(SUSPECT, np.maximum.reduceat(rank, first)[owner]), score + 1, score))
        pos = chosen[rng.choice(positive, half)]
        neg = np.concatenate([rng.choice(clean, 3 * share), rng.choice(free, 2 * share), rng.choice(hard, 3 * share)])
        chars, words = features(_masked(codes[np.r_[pos, neg]], rng))
        target = np.r_[np.full(half, 0.97), np.full(len(neg), 0.01)].astype(np.float32)
        _, grad = step(p, chars, words, target, np.ones(len(target), np.float32))
        adam.rate = 0.006 * (1 - 0.9 * at / steps)
        adam.apply(grad)
    return p


_WORKER: dict[str, tuple[Reader, Scorer, Memory]] = {}


def worker(query: str, names: list[str], params: dict) -> tuple[Reader, Scorer, Memory]:
    """What a worker process keeps from one task of a query to its next. Tasks call this by name; a dictionary that their
    function refers to would be a copy of its own for each task."""
    if query not in _WORKER:
        _WORKER.clear()
        _WORKER[query] = (Reader(names), Scorer(params), Memory())
    return _WORKER[query]


def row_scores(texts: list[str | None], reader: Reader, scorer: Scorer, memory: Memory) -> np.ndarray:
    """The worst window of each text, new windows scored together."""
    real = [i for i, t in enumerate(texts) if t and not t.isspace()]
    out = np.zeros(len(texts))
    if not real:
        return out
    codes, starts, sizes, owner, _ = window_places(reader.normal([texts[i] for i in real]))
    if not len(starts):
        return out
    up, down = _HASH.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)], out=sums[1:])
    keys = (sums[starts + sizes] - sums[starts]) * up[starts]
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    scores = _window_scores(codes, starts, sizes, keys, scorer, memory)
    np.maximum.at(out, np.array(real)[owner], scores.astype(float))
    return out


def _window_scores(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, scorer: Scorer, memory: Memory) -> np.ndarray:
    keys, pick, back = np.unique(keys, return_index=True, return_inverse=True)
    scores, there = memory.known(keys)
    new, made = pick[~there], np.empty(int((~there).sum()), np.float32)
    steps, full = np.arange(WIDTH), sliding_window_view(np.r_[codes, np.zeros(WIDTH - 1, np.uint32)], WIDTH)
    for low in range(0, len(new), TOGETHER):
        at, size = starts[new[low : low + TOGETHER]], sizes[new[low : low + TOGETHER]]
        windows, short = full[at], np.flatnonzero(size < WIDTH)
        windows[short] *= steps < size[short, None]
        made[low : low + TOGETHER] = scorer(windows)
    scores[~there] = made
    memory.add(keys[~there], made)
    return scores[back]


def scored(texts: DataFrame, params: dict | None, names: list[str]) -> DataFrame:
    """(src, row_id, source, score) for (src, row_id, source, text); map-only."""
    if params is None:
        return texts.select("src", "row_id", "source", F.lit(0.0).alias("score"))
    query = uuid4().hex  # scores aren't kept from one query to another

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker(query, names, params)
        for batch in batches:
            for part in parts(batch, 3, 20_000, TEXTS_TOGETHER):
                scores = row_scores(part.column(3).to_pylist(), *kept)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(scores)], names=["src", "row_id", "source", "score"])

    return texts.select("src", "row_id", "source", "text").mapInArrow(run, "src string, row_id bigint, source string, score double")


def reviewed(texts: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> tuple[list[str], list[int]]:
    """The texts and labels to train on, at most ``most``, chosen by hash of the row."""
    sample = labels.where("is_abusive in (0, 1)").orderBy(F.xxhash64("src", "row_id", "reviewer"), "src", "row_id").limit(most)
    rows = texts.where("text is not null").join(F.broadcast(sample.select("src", "row_id", "is_abusive")), ["src", "row_id"]).select("src", "row_id", "text", "is_abusive").collect()
    rows.sort(key=lambda r: (r["src"], r["row_id"], r["is_abusive"]))
    return [r["text"] for r in rows], [r["is_abusive"] for r in rows]


def unreviewed(texts: DataFrame, labels: DataFrame, counts: dict[str, int] | None = None) -> list[str]:
    """Texts without a review, a bounded number of each source table, chosen by hash."""
    out = []
    for src, count in (counts or UNREVIEWED).items():
        of = texts.where((F.col("src") == src) & F.col("text").isNotNull()).select("src", "row_id", "text")
        # Twice as many candidates as wanted, so that reviewed rows among them can go.
        candidates = of.orderBy(F.xxhash64("row_id", F.lit(3)), "row_id").limit(2 * count)
        kept = candidates.join(labels.select("src", "row_id"), ["src", "row_id"], "left_anti")
        out += [r["text"] for r in kept.orderBy(F.xxhash64("row_id", F.lit(3)), "row_id").limit(count).select("text").collect()]
    return out


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows and abusive rows of each source."""
    hit = F.sum((F.col("score") >= threshold).cast("bigint"))
    return scores.groupBy("src", "source").agg(F.count("*").alias("rows"), hit.alias("abusive_rows"), (hit / F.count("*")).alias("abusive_share"))
