"""Python forms of two built-in compositions: a table function and a grouped aggregate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


@udtf(returnType=StructType([StructField("pos", LongType())]))
class LinspaceIndices:
    """Places of at most ``n`` evenly spaced rows among ``count``, to be called laterally."""

    def eval(self, count: int, n: int):
        if not count or count <= 0 or not n or n <= 0:
            return
        if count <= n:
            places = range(count)
        else:
            step = (count - 1) / max(n - 1, 1)
            places = dict.fromkeys([*(int(i * step) for i in range(n - 1)), count - 1])
        for pos in places:
            yield (pos,)


@pandas_udf(DoubleType())
def weighted_median(values: pd.Series, weights: pd.Series) -> float:
    """First value, in ascending order, whose running weight reaches half; 0 without values.

    A group is held by one task: for groups of bounded size, such as a row's trend windows.
    """
    there = values.notna() & weights.notna()
    v, w = values[there].to_numpy(float), weights[there].to_numpy(float)
    if not len(v):
        return 0.0
    order = np.lexsort((w, v))
    run = np.cumsum(w[order])
    return float(v[order][np.argmax(run >= w[order].sum() / 2.0)])
