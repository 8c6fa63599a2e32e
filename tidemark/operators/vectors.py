"""A collection of embedded names, and exact nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Rows per block; a task holds two blocks and their product.
BLOCK = 2000


def collection(codes: DataFrame, names: DataFrame, model: str) -> DataFrame:
    """Both projections of the reference list in one collection: type, model, no, name, text."""
    make = lambda df, kind, text: df.select(F.lit(kind).alias("type"), F.lit(model).alias("model"), F.col("stock_no").alias("no"), F.col("stock_name").alias("name"), F.col(text).alias("text"))
    return make(codes, "code", "stock_no").unionByName(make(names, "name", "stock_name")).where("text is not null")


def embedded(items: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", column: str = "embedding") -> DataFrame:
    """The items with a vector each. ``embed`` is the model: texts in, as many vectors out; it is called per Arrow batch."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        made = embed(texts.tolist())
        if len(made) != len(texts):
            raise ValueError(f"{len(made)} vectors for {len(texts)} texts")
        return pd.Series(made)

    return items.withColumn(column, run(F.col(text)))


def write_collection(items: DataFrame, path: str, recreate: bool = True) -> None:
    """The vector store: codes recreate it, names are appended."""
    items.write.mode("overwrite" if recreate else "append").parquet(path)


def cosine(a: str, b: str) -> Column:
    """In double precision; null where a vector has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(queries: DataFrame, items: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 5) -> DataFrame:
    """(query_id, item_id, score, rank) of the ``top`` items by cosine for each query, exact.

    Queries and items are dealt by hash to blocks of about ``BLOCK`` rows; each pair of blocks is one product of two
    matrices in one task, which passes on ``top`` items per query. So no task holds more than two blocks, and what is
    shuffled last is queries x item blocks x top. Ties go to the smaller item id; vectors that are null, empty, of length
    0 or of a different dimension have no neighbours and are none.
    """
    ql, il = queries.where(F.size(vector) > 0), items.where(F.size(vector) > 0)
    qn, im = max(1, -(-queries.count() // BLOCK)), max(1, -(-items.count() // BLOCK))
    block = lambda df, mine, other, a, b: df.select(
        F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(mine)).cast("int").alias(a),
        F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(b),
    )

    def run(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = {len(v) for v in q["v"]} & {len(v) for v in m["v"]}
        for size in sorted(sizes):
            a, b = q[q["v"].str.len() == size], m[m["v"].str.len() == size].sort_values("k")
            scores = _unit(np.stack(a["v"].to_numpy())) @ _unit(np.stack(b["v"].to_numpy())).T
            keys = b["k"].to_numpy()
            order = np.argsort(-scores, axis=1, kind="stable")[:, :top]
            for i, k in enumerate(a["k"]):
                out += [(k, int(keys[j]), float(scores[i, j])) for j in order[i] if not np.isnan(scores[i, j])]
        return pd.DataFrame(out, columns=["query_id", "item_id", "score"])

    left, right = block(ql, qn, im, "qb", "ib"), block(il, im, qn, "ib", "qb")
    pairs = left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(run, "query_id bigint, item_id bigint, score double")
    ranked = pairs.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, item_id)"))
    return ranked.where(F.col("rank") <= top)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, size, out=np.full_like(m, np.nan), where=size > 0)
