"""Texts that a collector cut before their end (problem 2).

Two kinds of evidence are combined in one posterior per row:

* Length. Per source, a mixture of lognormals is fitted to the lengths by maximum likelihood, with the values at a
  candidate limit right-censored (EM on the histogram of lengths, in code points and in UTF-8 bytes). A limit is a length
  that the censored fit explains far better than the uncensored one, and than rows of its own there would. A row at a limit is censored with
  probability 1 - expected / observed; elsewhere ``MID_TRANSFER`` is the prior of a cut.
* Ending. Over all texts it is counted how often each context (the last 1 to 9 symbols) is followed by more text and how
  often a text ends there. Numbers are one symbol, names of the reference list another, begun names a third; an ellipsis
  at the end is put there by people and by collectors alike, so the ending before it is judged. The shares of ends in
  longer contexts are drawn towards those in shorter ones. Ends and cuts are estimated together: an end counts with the
  probability that it is none of a cut, which follows from the counts, so both are worked out again in turn
  (``TURNS``); else cut texts would vouch for each other where a context is cut often. So few ends as cuts alone would
  cause don't count either. An open bracket is evidence too; a broken character at the end is proof.

Defined results: null and blank texts aren't cut; a text shorter than all contexts uses those it has; sources may be
null. Statistics are over distinct texts, so copies of a cut text don't vouch for each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, erfc, log, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.batches import parts
from tidemark.llm.forms import _rows as fold_rows
from tidemark.llm.forms import text_key
from tidemark.llm.names import Finder
from tidemark.operators.dictionary import small
from tidemark.session import materialize

LEVELS = (1, 2, 3, 4, 6, 9)
#: So many occurrences a context needs to weigh as much as the next shorter one.
SUPPORT = 3
#: Prior of a cut away from a limit. Sources cut far fewer rows than this; it is set so that contexts which hardly ever
#: end a text suffice, as one missed cut weighs as much as one false alarm.
MID_TRANSFER = 0.1
#: Ends up to this share of a context's occurrences, and two deviations more, are put down to cuts.
CUT_ENDS = 0.05
#: How often ends and cuts are estimated from each other.
TURNS = 4
#: A cut text is fetched again once or twice; a text with more copies is a phrase, and they count as ends.
REFETCHED = 3
OPEN_BRACKET = 100.0
#: What the log-likelihood gains by a limit at least (and so many times the spread around the fit, more where a limit
#: holds a part of the longer rows only), what it gains where broken characters prove it, and the least part a limit
#: holds. Phrases and templates make small steps everywhere, so a limit that holds fewer isn't told from them.
LIMIT_GAIN, PROVEN_GAIN, LIMIT_HELD = 15.0, 10.0, 0.2
COMPONENTS, ROUNDS = 3, 60
BROKEN = "�"
_BASE = 0x9E3779B97F4A7C15 | 1
_N, _PART, _NUM, _EDGE = 1, 2, 3, 0


def texts_of(comments: DataFrame, articles: DataFrame) -> DataFrame:
    """(src, row_id, source, text) of the two fields."""
    a = comments.select(F.lit("comments").alias("src"), F.col("comment_id").alias("row_id"), "source", F.col("comment").alias("text"))
    b = articles.select(F.lit("articles").alias("src"), F.col("id").alias("row_id"), "source", F.col("paragraph_title").alias("text"))
    return a.unionByName(b)


def measured(texts: DataFrame) -> DataFrame:
    """Lengths in code points and bytes; bytes before a broken last character where there is one."""
    broken = F.col("text").endswith(BROKEN)
    return texts.withColumns({
        "broken": F.coalesce(broken, F.lit(False)), "chars": F.length("text"),
        "bytes": F.when(broken, F.octet_length(F.rtrim(F.col("text"), F.lit(BROKEN)))).otherwise(F.octet_length("text")),
    })


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of a lognormal mixture by EM; lengths from the limit on are known as 'at least'."""
    x = np.log(lengths)
    censored = lengths >= limit
    edge = log(limit)
    order = np.argsort(x)
    q = np.interp(np.linspace(0.15, 0.85, COMPONENTS), np.cumsum(counts[order]) / counts.sum(), x[order])
    w, m, s = np.full(COMPONENTS, 1 / COMPONENTS), q.copy(), np.full(COMPONENTS, max(x.std(), 0.2))
    for _ in range(ROUNDS):
        z = (edge - m) / s
        tail = np.maximum(1e-12, 0.5 * (1 - np.array([erf(v / sqrt(2)) for v in z])))
        hazard = np.exp(-z * z / 2) / sqrt(2 * pi) / tail
        density = np.exp(-(((x[:, None] - m) / s) ** 2) / 2) / (s * sqrt(2 * pi))
        r = w * np.where(censored[:, None], tail, density) + 1e-300
        r = r / r.sum(1, keepdims=True) * counts[:, None]
        mean = np.where(censored[:, None], m + s * hazard, x[:, None])
        second = np.where(censored[:, None], (m + s * hazard) ** 2 + s * s * np.maximum(0.05, 1 + z * hazard - hazard**2), x[:, None] ** 2)
        n = r.sum(0) + 1e-9
        w, m = n / n.sum(), (r * mean).sum(0) / n
        s = np.sqrt(np.maximum(0.01, (r * second).sum(0) / n - m * m))
    return w, m, s


def _mass(fit: tuple, low: float, high: float) -> float:
    w, m, s = fit
    cdf = lambda v: np.array([0.5 * (1 + erf((log(v) - a) / (b * sqrt(2)))) for a, b in zip(m, s)])
    return float((w * ((1.0 if high == np.inf else cdf(high)) - cdf(low))).sum())


_erfc = np.vectorize(erfc, otypes=[float])


def _fits(x: np.ndarray, n: np.ndarray, at: np.ndarray, spike: np.ndarray | None = None) -> tuple:
    """Many fits at once: log-likelihoods, expected genuine rows of each size (C, sizes), shares held.

    n (C, sizes): rows of each size; at (C, K): places of the limits. Of the genuine rows longer than a limit the share
    ``held``, which is fitted too, stands at the limit. ``spike``: place of a size that has rows of its own besides.
    """
    count, k, rows, each = len(n), at.shape[1], np.arange(len(n))[:, None], np.arange(len(n))
    lx, width, edge, total = np.log(x), np.log((x + 0.5) / (x - 0.5)), np.log(x + 0.5), n.sum(1)
    deviation = max(0.2, sqrt(np.average((lx - np.average(lx, weights=n[0])) ** 2, weights=n[0])))
    m = np.tile(np.interp(np.linspace(0.15, 0.85, COMPONENTS), np.cumsum(n[0]) / n[0].sum(), lx), (count, 1))
    w, s = np.full((count, COMPONENTS), 1 / COMPONENTS), np.full((count, COMPONENTS), deviation)
    here, beyond = n[rows, at], total[:, None] - np.cumsum(n, 1)[rows, at]
    held, own = np.full((count, k), 0.5), np.full(count, 0.01 if spike is not None else 0.0)
    for turn in range(ROUNDS + 1):
        parts_ = np.exp(-(((lx[None, :, None] - m[:, None]) / s[:, None]) ** 2) / 2) / (s[:, None] * sqrt(2 * pi)) * width[None, :, None] * w[:, None] + 1e-300
        f = parts_.sum(2)
        z = (edge[at][:, :, None] - m[:, None]) / s[:, None]
        tail = np.maximum(1e-12, 0.5 * _erfc(z / sqrt(2))) if k else np.ones_like(z)
        over = w[:, None] * tail
        past = over.sum(2)
        mixed = f[rows, at] + held * past
        if turn == ROUNDS:
            break
        cut = here * held * past / mixed
        genuine = n.copy()
        genuine[rows, at] -= cut
        if spike is not None:
            extra = n[each, spike] * own / ((1 - own) * f[each, spike] + own)
            genuine[each, spike] -= extra
            own = np.minimum(0.99, extra / total)
        held = np.clip(cut / np.maximum(1e-9, cut + beyond), 1e-6, 1 - 1e-6)
        r, rc = parts_ / f[:, :, None] * genuine[:, :, None], over / past[:, :, None] * cut[:, :, None]
        hazard = np.exp(-z * z / 2) / sqrt(2 * pi) / tail
        mean = m[:, None] + s[:, None] * hazard
        second = mean**2 + (s * s)[:, None] * np.maximum(0.05, 1 + z * hazard - hazard**2)
        size = r.sum(1) + rc.sum(1) + 1e-9
        m = ((r * lx[None, :, None]).sum(1) + (rc * mean).sum(1)) / size
        s = np.sqrt(np.maximum(0.01, ((r * lx[None, :, None] ** 2).sum(1) + (rc * second).sum(1)) / size - m * m))
        w = size / size.sum(1, keepdims=True)
    kept = np.prod(np.where(np.arange(len(x))[None, :, None] > at[:, None, :], 1 - held[:, None, :], 1.0), axis=2)
    like = f.copy()
    like[rows, at] = mixed
    like *= kept
    if spike is not None:
        like *= (1 - own)[:, None]
        like[each, spike] += own
    return (n * np.log(np.maximum(like, 1e-300))).sum(1), total[:, None] * f * kept, held


def _unit_limits(whole: pd.Series, broken: pd.Series) -> list[tuple[float, int, float]]:
    """(gain, limit, share) of one unit, from the rows of each size; ``broken`` ones end in a broken character."""
    x = np.array(sorted({int(v) for v in whole.index} | {int(v) + d for v in broken.index for d in (1, 2, 3)}))
    if not len(x):
        return []
    place = {v: i for i, v in enumerate(x.tolist())}
    plain, torn = np.zeros(len(x)), np.zeros((len(x), 3))
    for v, c in whole.items():
        plain[place[int(v)]] += c
    for v, c in broken.items():  # at a limit the broken character counts as whole
        for d in (1, 2, 3):
            torn[place[int(v) + d], d - 1] += c

    def counts(limits: list[int]) -> np.ndarray:
        n = plain.copy()
        for v, c in broken.items():
            n[next((i for i in limits if 1 <= x[i] - v <= 3), place[int(v) + 1])] += c
        return n

    found: list[tuple[float, int]] = []
    sizes = x.astype(float)
    while True:
        have = [i for _, i in found]
        best = None
        rest = [i for i in range(len(x)) if i not in have and x[i] >= 4]
        step = max(1, 400_000 // (len(x) * COMPONENTS))
        for low in range(0, len(rest), step):
            tried = np.array(rest[low : low + step])
            n = np.array([counts([*have, i]) for i in tried])
            old = np.tile(np.array(have, int), (len(tried), 1))
            none, *_ = _fits(sizes, n, old)
            limit, genuine, held = _fits(sizes, n, np.c_[old, tried])
            alone, *_ = _fits(sizes, n, old, tried)
            for j, i in enumerate(tried):
                expected, seen = genuine[j, i], n[j, i]
                gain, gap = limit[j] - none[j], limit[j] - alone[j]
                others = np.ones(len(x), bool)
                others[[*have, i]] = False
                # What the mixture can't follow elsewhere is no sign of a limit here.
                spread = float(np.median(((n[j] - genuine[j]) ** 2 / np.maximum(genuine[j], 1))[others])) / 0.455 if others.any() else 1.0
                # A broken character is proof of a cut, so rows of their own are no other explanation.
                proven = 2 * torn[i].sum() >= seen and gain >= PROVEN_GAIN
                whole_limit = gain >= max(LIMIT_GAIN, 4 * spread) and (gap >= 2 or seen >= 4 * expected)
                partial = gain >= max(LIMIT_GAIN, 10 * spread) and gap >= max(10.0, spread)
                sure = proven or (whole_limit if held[j, -1] >= 0.9 else partial)
                if seen > expected and held[j, -1] >= LIMIT_HELD and sure:
                    if best is None or gain > best[0]:
                        best = float(gain), int(i)
        if best is None:
            break
        found.append(best)
    if not found:
        return []
    have = [i for _, i in found]
    _, genuine, *_ = _fits(sizes, counts(have)[None], np.array([have]))
    return [(gain, int(x[i]), float(min(0.999, max(0.02, 1 - genuine[0, i] / max(1.0, plain[i]))))) for gain, i in found]


def _of_unit(hist: pd.DataFrame, unit: str) -> list[tuple[float, int, float]]:
    whole = hist[~hist["broken"]].groupby("size")["n"].sum()
    broken = hist[hist["broken"]].groupby("size")["n"].sum() if unit == "bytes" else pd.Series(dtype=int)
    return _unit_limits(whole, broken)


def find_limits(hist: pd.DataFrame) -> list[tuple[str, int, float]]:
    """(unit, limit, share of censored among the whole rows there) from rows (unit, size, broken, n) of one source."""
    part = lambda unit: hist[(hist["unit"] == unit) & (hist["size"] > 0)]
    return [(unit, size, share) for unit in ("chars", "bytes") for _, size, share in _of_unit(part(unit), unit)]


def source_limits(joint: pd.DataFrame) -> list[tuple[str, int, float]]:
    """The same from rows (chars, bytes, broken, n). The rows at the limits of the unit that gains more by them stay out
    of the other: 40 characters are mostly about 100 bytes, which then look like a limit as well."""
    of = lambda rows, unit: _of_unit(rows[rows[unit] > 0].rename(columns={unit: "size"}), unit)
    first = {unit: of(joint, unit) for unit in ("chars", "bytes")}
    lead = max(first, key=lambda unit: max((g for g, *_ in first[unit]), default=0.0))
    other = "bytes" if lead == "chars" else "chars"
    if first[lead]:
        tops = {size for _, size, _ in first[lead]}
        held = joint[lead].isin(tops)
        if lead == "bytes":
            held |= joint["broken"] & joint["bytes"].isin({t - d for t in tops for d in (1, 2, 3)})
        first[other] = of(joint[~held], other)
    return [(unit, size, share) for unit in ("chars", "bytes") for _, size, share in first[unit]]


def limits(sized: DataFrame) -> DataFrame:
    """(src, source, unit, size, share): the limits of each source, fitted from its histogram of lengths."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], key[1], *found) for found in source_limits(pdf)]
        return pd.DataFrame(rows, columns=["src", "source", "unit", "size", "share"])

    filled = sized.where("chars > 0").withColumn("source", F.coalesce("source", F.lit("")))
    counted = filled.groupBy("src", "source", "broken", "chars", "bytes").agg(F.count("*").alias("n"))
    # As many tasks as cores: there are few sources, and each fit takes seconds whatever the number of rows.
    counted = counted.repartition(counted.sparkSession.sparkContext.defaultParallelism, "src", "source")
    return counted.groupBy("src", "source").applyInPandas(run, "src string, source string, unit string, size int, share double")


class Contexts:
    """Hashes of the contexts of all positions of many texts at once."""

    def __init__(self, names: list[str]):
        table = {ord(c): r for c, r in zip(fold_rows()["ch"].to_pylist(), fold_rows()["repl"].to_pylist())}
        self.table = str.maketrans({**table, 0: None})
        names = sorted({n for n in (name.translate(self.table).strip() for name in names) if len(n) > 1 and not n.isascii()})
        self.begun = {n[:i] for n in names for i in range(1, len(n))} - set(names)
        self.longest = max(map(len, names), default=0)
        self.find = Finder(names)
        self.size, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def _powers(self, size: int) -> None:
        if size > self.size:
            self.size = max(2 * self.size, size, 1 << 16)
            make = lambda base: np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.size - 1, base, np.uint64)])
            self.up, self.down = make(_BASE), make(pow(_BASE, -1, 1 << 64))

    def of(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per level the hash at each position, the positions of the texts' last characters (-1: none), and which positions
        are places where a cut could be seen: not inside a number."""
        texts = [t.translate(self.table).rstrip() for t in texts]
        joined = "\0" + "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.where(sizes > 0, np.cumsum(sizes + 1) - 1, -1)
        digit = (codes >= 48) & (codes <= 57)
        point = np.zeros(len(codes), bool)
        point[1:-1] = (codes[1:-1] == 46) & digit[:-2] & digit[2:]
        number = digit | point
        last = codes + 16
        last[number] = _NUM
        inside = np.zeros(len(codes), bool)
        inside[:-1] = number[:-1] & number[1:]
        seen = ~inside
        if self.longest:
            for first, stop in self.find(joined):
                last[first : stop - 1], last[stop - 1] = _PART, _N
                inside[first : stop - 1] = True
        last[codes == 0] = _EDGE
        for i, (text, end) in enumerate(zip(texts, ends)):
            if end < 0 or last[end] in (_N, _NUM):
                continue
            for size in range(min(self.longest - 1, len(text)), 0, -1):
                if text[-size:] in self.begun:
                    last[end - size + 1 : end + 1] = _PART
                    inside[end - size + 1 : end] = True
                    break
        kept = ~inside
        before = np.cumsum(kept) - kept
        symbols = last[kept].astype(np.uint64)
        self._powers(len(symbols) + 1)
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols + np.uint64(1)) * self.down[: len(symbols)], out=sums[1:])
        edge = np.maximum.accumulate(np.where(codes == 0, before, 0))
        out = []
        for level in LEVELS:
            low = np.maximum(before - level + 1, edge)
            h = (sums[before] - sums[low]) * self.up[low] * np.uint64(0xC2B2AE3D27D4EB4F) + last.astype(np.uint64) * np.uint64(0x165667B19E3779F9) + (before - low).astype(np.uint64)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out.append((h ^ (h >> np.uint64(32))).view(np.int64))
        return out, ends, seen


_CACHE: dict[int, Contexts] = {}


def _contexts(names: list[str]) -> Contexts:
    key = hash(tuple(names))
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Contexts(names)
    return _CACHE[key]


_FOUND = pa.schema(
    [("k", pa.binary()), ("prior", pa.float64()), ("own", pa.int64()), ("open", pa.bool_()), ("hs", pa.list_(pa.int64())), ("level", pa.int32()), ("h", pa.int64()), ("c_int", pa.int64())]
)


def read_contexts(distinct: DataFrame, names: list[str]) -> DataFrame:
    """One pass over (k, text, prior, own), giving rows of two kinds: (k, prior, own, open, hs) the context hashes at a
    text's end and whether a bracket stays open, and (level, h, c_int) how often contexts are followed by more, counted
    within parts of batches before anything is shuffled. A text without characters gives no row of the first kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _contexts(names)
        for batch in (part for whole in batches for part in parts(whole, 1, 20_000)):
            texts = batch.column(1).to_pylist()
            hashes, ends, inner = made.of(texts)
            kept = np.flatnonzero(ends >= 0)
            hs = np.stack([h[ends[kept]] for h in hashes], 1)
            opened = [any(texts[i].rfind(a) > texts[i].rfind(b) for a, b in ("（）", "「」", "[]", "()")) for i in kept]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, hs.size + 1, len(LEVELS), dtype=np.int32)), pa.array(hs.ravel()))
            rows = batch.take(pa.array(kept))
            none = [pa.nulls(len(kept), f.type) for f in list(_FOUND)[5:]]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(opened, pa.bool_()), lists, *none], schema=_FOUND)
            inner[ends[kept]] = False
            inner[np.r_[True, np.zeros(len(inner) - 1, bool)]] = False
            for level, h in zip(LEVELS, hashes):
                unique, count = np.unique(h[inner], return_counts=True)
                none = [pa.nulls(len(unique), f.type) for f in list(_FOUND)[:5]]
                yield pa.RecordBatch.from_arrays([*none, pa.array(np.full(len(unique), level, np.int32)), pa.array(unique), pa.array(count)], schema=_FOUND)

    schema = "k binary, prior double, own bigint, open boolean, hs array<bigint>, level int, h bigint, c_int bigint"
    return distinct.select("k", "text", "prior", "own").mapInArrow(run, schema)


def _weighed(cells: DataFrame, places: DataFrame, n_int: float) -> DataFrame:
    """The cells with the probability of a cut worked out anew from the present ones.

    cells: (cell, prior, open, own, p); places: (cell, level, h, c_int), the contexts of each cell's ending."""
    ends = F.col("own") * (1 - F.col("p"))
    told = places.join(cells.select("cell", ends.alias("e"), (1 - F.col("p")).alias("mine")), "cell")
    per = told.groupBy("level", "h").agg(F.sum("e").alias("c_end"))
    looked = told.join(per, ["level", "h"]).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("level", "c_int", (F.col("c_end") - F.col("mine")).alias("c_end")))).alias("c"))
    total = F.broadcast(cells.agg(F.sum(ends).alias("n_end")))  # one row

    def deeper(p: Column, c: Column) -> Column:
        """The share of ends in a context, drawn towards that of the next shorter one."""
        met = F.greatest(F.lit(0.0), c["c_int"] + c["c_end"])
        by_cuts = CUT_ENDS * met
        return (F.greatest(F.lit(0.0), c["c_end"] - by_cuts - 2 * F.sqrt(by_cuts)) + SUPPORT * p) / (met + SUPPORT)

    root = F.col("n_end") / F.greatest(F.lit(1.0), F.lit(n_int) + F.col("n_end"))
    share = F.greatest(F.aggregate("c", root, deeper), 0.05 / F.greatest(F.lit(1.0), F.lit(n_int) + F.col("n_end")), F.lit(1e-12))
    ratio = (1 - share) / share * F.col("n_end") / F.greatest(F.lit(n_int), F.lit(1.0)) * F.when(F.col("open"), OPEN_BRACKET).otherwise(1.0)
    odds = F.col("prior") / (1 - F.col("prior")) * F.col("ratio")
    return cells.drop("p", "ratio").join(looked, "cell").crossJoin(total).withColumn("ratio", ratio).withColumn("p", odds / (1 + odds)).drop("c", "n_end")


def scored(texts: DataFrame, names: list[str]) -> DataFrame:
    """(src, row_id, source, p_cut) for (src, row_id, source, text)."""
    sized = measured(texts.select("src", "row_id", "source", "text"))
    bounds = materialize(limits(sized))
    pick = lambda unit: bounds.where(F.col("unit") == unit).select("src", F.col("source").alias("s"), F.col("size").alias(unit), F.col("share").alias(f"share_{unit}"))
    stem = F.regexp_replace("text", r"\s*(?:…|\.{2,})+\s*$", "")
    stem = F.when(stem == "", F.col("text")).otherwise(stem)
    keyed = sized.withColumns({"s": F.coalesce("source", F.lit("")), "text": stem}).withColumn("k", text_key(F.col("text")))
    # A source may have several limits; the size is part of the key, so a row meets one of each unit at most.
    keyed = keyed.join(small(pick("chars")), ["src", "s", "chars"], "left").join(small(pick("bytes")), ["src", "s", "bytes"], "left")
    share = F.greatest(F.col("share_chars"), F.when(~F.col("broken"), F.col("share_bytes")))
    keyed = keyed.withColumns({"limit": share, "prior": F.coalesce(share, F.lit(MID_TRANSFER))})
    # Equal texts are judged once, with the highest prior of their rows; a broken one is no end.
    distinct = keyed.where("trim(text) <> ''").groupBy("k").agg(
        F.first("text").alias("text"), F.max("limit").alias("limit"), F.max("prior").alias("prior"), F.greatest(F.lit(1), F.count("*") - REFETCHED).alias("own"), F.max("broken").alias("broken"),
    )
    own = F.when(F.col("broken"), 0).otherwise(F.col("own"))
    # Rows at a limit bring their prior; elsewhere texts count as whole at first.
    found = materialize(read_contexts(distinct.select("k", "text", "prior", own.alias("own")), names))
    ends = found.where("k is not null").withColumn("h9", F.col("hs")[len(LEVELS) - 1])
    counts = found.where("k is null").groupBy("level", "h").agg(F.sum("c_int").alias("c_int"))
    # One cell per kind of ending and prior; the longest context stands for all.
    kind = ["h9", "prior", "open", (F.col("own") == 0).alias("torn")]
    cell = F.xxhash64("h9", "prior", "open", "torn")
    start = F.when(F.col("prior") > MID_TRANSFER, F.col("prior")).otherwise(0.0)
    cells = ends.groupBy(*kind).agg(F.first("hs").alias("hs"), F.sum("own").alias("own")).withColumns({"cell": cell, "p": start})
    level_of = F.array(*[F.lit(v) for v in LEVELS])
    placed = cells.select("cell", "h9", "prior", "open", "torn", "own", "p", F.explode(F.arrays_zip(level_of.alias("level"), F.col("hs").alias("h"))).alias("z"))
    placed = materialize(placed.select("*", "z.level", "z.h").drop("z").join(counts, ["level", "h"], "left").withColumn("c_int", F.coalesce("c_int", F.lit(0))))
    places = placed.select("cell", "level", "h", "c_int")
    cells = placed.where(F.col("level") == LEVELS[-1]).select("cell", "h9", "prior", "open", "torn", "own", "p")
    n_int = float(_total(counts))
    for _ in range(TURNS):
        cells = materialize(_weighed(cells, places, n_int))
    judged = ends.select("k", *kind).join(cells.select("h9", "prior", "open", "torn", "ratio"), ["h9", "prior", "open", "torn"]).select("k", "ratio")
    rated = keyed.select("src", "row_id", "source", "k", "prior", "broken").join(judged, "k", "left")
    odds = F.col("prior") / (1 - F.col("prior")) * F.col("ratio")
    return rated.select("src", "row_id", "source", F.when(F.col("broken"), 1.0).otherwise(F.coalesce(odds / (1 + odds), F.lit(0.0))).alias("p_cut"))


def _total(counts: DataFrame) -> int:
    """Places in all texts where more follows: one number."""
    return counts.where(F.col("level") == 1).agg(F.sum("c_int")).first()[0] or 0


def rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows and cut rows of each source."""
    cut = F.sum((F.col("p_cut") >= threshold).cast("bigint"))
    return scores.groupBy("src", "source").agg(F.count("*").alias("rows"), cut.alias("cut_rows"), (cut / F.count("*")).alias("cut_share"))
