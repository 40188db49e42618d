"""Embedding of texts: the built-in one, and any other behind the same call."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loomstore.functions import columns as C


@F.pandas_udf(ArrayType(DoubleType()))
def _dense(lists: pd.Series) -> pd.Series:
    out = []
    for b in lists:
        if b is None or not len(b):
            out.append(None)
            continue
        v = np.bincount(b, minlength=C.BUCKETS).astype(np.float64)
        out.append(v / np.sqrt((v * v).sum()))
    return pd.Series(out)


def built_in(text: Column) -> Column:
    """Counts of word buckets, of unit length, in Arrow batches; null for a text that is null or has no words."""
    return _dense(C.buckets(text))


def embed(rows: DataFrame, text: str = "content", provider: Callable[[Column], Column] = built_in) -> DataFrame:
    """``rows`` with ``embedding``; ``provider`` makes the column, so that another model can take the built-in one's place."""
    return rows.withColumn("embedding", provider(F.col(text)))
