"""Filling sequences of fixed token capacity at balanced cost (problem 7).

An item's cost is linear in its tokens plus quadratic (attention). Items go, most costly first, to the sequence of lowest
cost that still has room; where none has, a new one opens. An item larger than the capacity is cut into full pieces with
a sequence each, and its rest is an item like others.

Documents are dealt by hash to shards of about ``shard_docs`` documents, each packed on its own in bounded memory; a
shard wastes at most the slack of its last sequences, so the loss to sharding is below one sequence in thousands.

Defined results: null and empty texts are items of 0 tokens and get a place; rows that share a doc_id are packed each on
their own; an empty table gives no rows; a null size counts as 0. Documents are dealt by id and size, so that rows of one
id don't gather in one shard unless they are equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
SHARD_DOCS = 20_000
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

ASSIGNMENT = "container bigint, doc_id bigint, piece int, first_token bigint, tokens bigint, cost double"


def cost(tokens: np.ndarray, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    return linear * tokens + quadratic * np.square(tokens, dtype=float)


def pack(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each item; every size is at most the capacity. Ties go to the earlier item and sequence."""
    count = max(1, -(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    room = np.full(max(count, 16), 0, np.int64)
    load = np.full(max(count, 16), np.inf)
    room[:count], load[:count] = capacity, 0.0
    out = np.empty(len(sizes), np.int64)
    costs = cost(sizes, linear, quadratic)
    for i in np.argsort(-costs, kind="stable"):
        fits = np.where(room[:count] >= sizes[i], load[:count], np.inf)
        at = int(fits.argmin())
        if not np.isfinite(fits[at]):
            at, count = count, count + 1
            if count > len(room):
                room, load = np.append(room, np.zeros(len(room), np.int64)), np.append(load, np.full(len(load), np.inf))
            room[at], load[at] = capacity, 0.0
        room[at] -= sizes[i]
        load[at] += costs[i]
        out[i] = at
    return out


def assignments(sized: DataFrame, total_docs: int, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """(doc_id, n_tokens) to one row per piece with its container. ``total_docs`` sets the number of shards."""
    shards = max(1, -(-total_docs // shard_docs))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable", ignore_index=True)
        tokens = pdf["n_tokens"].to_numpy(np.int64)
        full, rest = tokens // capacity, tokens % capacity
        item = np.flatnonzero((rest > 0) | (tokens == 0))
        place = pack(rest[item], capacity, linear, quadratic)
        opened = int(place.max()) + 1 if len(place) else 0
        owner = np.repeat(np.arange(len(tokens)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        rows = np.concatenate([owner, item])
        pieces = np.concatenate([piece, full[item]])
        sizes = np.concatenate([np.full(len(owner), capacity, np.int64), rest[item]])
        where = np.concatenate([opened + np.arange(len(owner)), place])
        return pd.DataFrame({
            "container": (int(key[0]) << 32) + where, "doc_id": pdf["doc_id"].to_numpy()[rows], "piece": pieces.astype(np.int32),
            "first_token": pieces * capacity, "tokens": sizes, "cost": cost(sizes, linear, quadratic),
        })

    # A null id would turn ids to floating point on the way through pandas.
    none = F.lit(-(2**63))
    rows = sized.select(F.coalesce(F.col("doc_id").cast("bigint"), none).alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    shard = F.pmod(F.xxhash64(F.col("doc_id"), F.col("n_tokens"), F.lit(7)), F.lit(shards))
    packed = rows.withColumn("shard", shard).groupBy("shard").applyInPandas(run, ASSIGNMENT)
    return packed.withColumn("doc_id", F.nullif("doc_id", none))


def containers(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per container: what it holds, its cost and its unused space."""
    return assigned.groupBy("container").agg(
        F.count("*").alias("pieces"), F.sum("tokens").alias("used"), (F.lit(capacity).cast("bigint") - F.sum("tokens")).alias("unused"), F.sum("cost").alias("cost")
    )


def totals(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused space and its share."""
    per = containers(assigned, capacity)
    return per.agg(
        F.count("*").alias("containers"), F.sum("used").alias("used"), F.sum("unused").alias("unused"),
        (F.sum("unused") / (F.count("*") * F.lit(capacity))).alias("unused_share"), F.max("cost").alias("max_cost"),
    )
