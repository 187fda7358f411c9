"""Vector distances in double precision, as expressions, and a NumPy form for wide vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def checked(v: Column, dim: int) -> Column:
    """v, or an error where its dimension is another one."""
    return F.when(v.isNull() | (F.size(v) == dim), v).otherwise(F.raise_error(F.lit(f"vector is not of dimension {dim}")))


def l2_to(query: list[float]):
    """An Arrow-batched L2 distance to one query vector, for wide vectors where lambdas are slow."""
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        ok = v.notna().to_numpy()
        if ok.any():
            out[ok] = np.sqrt(((np.stack(v[ok].to_numpy()).astype(np.float64) - q) ** 2).sum(1))
        return pd.Series(out).where(ok, None)

    return distance
