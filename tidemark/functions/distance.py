"""Edit distance with transpositions of neighbours, and the similarity built on it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType


def restricted_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, no part edited twice."""
    if a == b:
        return 0
    before, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        last, row, older = row, [i] + [0] * len(b), before
        for j in range(1, len(b) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], older[j - 2] + 1)
        before = last
    return row[-1]


def swapped_neighbours(a: Column, b: Column) -> Column:
    """Do the texts differ in one swap of neighbours only? The first place where they differ decides."""
    n = F.length(a)
    place = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), F.lit(True)).cast("int")
    made = F.concat(F.substring(a, F.lit(1), place - 1), F.substring(a, place + 1, F.lit(1)), F.substring(a, place, F.lit(1)), F.substring(a, place + 2, n))
    return (n == F.length(b)) & (place > 0) & (place < n) & (made == b)


def within_one_edit(a: Column, b: Column) -> Column:
    """Is the restricted distance 0 or 1? It is the plain distance then, or one swap; no Python."""
    plain = F.levenshtein(a, b, 2)
    return (a == b) | plain.between(0, 1) | ((plain == 2) & swapped_neighbours(a, b))


def restricted_distance_col(a: str, b: str) -> Column:
    """The same for two columns; null if either is null. A plain distance of 0 or 1 and a single swap are found in the JVM,
    so only pairs further apart are worked out in Python, in Arrow batches."""

    @F.pandas_udf(IntegerType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else restricted_distance(p, q) for p, q in zip(x, y)], dtype="Int32")

    x, y = F.col(a), F.col(b)
    # A conditional doesn't keep Python from running, but empty texts cost nothing there.
    near = F.coalesce(within_one_edit(x, y), F.lit(True))
    far = run(F.when(near, "").otherwise(x), F.when(near, "").otherwise(y))
    return F.when(x.isNull() | y.isNull(), None).when(x == y, 0).when(near, 1).otherwise(far)
