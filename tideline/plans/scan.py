"""Per-key ordered recursion for operators that are not a window aggregate.

One ``applyInPandas`` call computes every recursive column of a key, so a table needs one shuffle.
The caller must pass bar-level rows: one row per (key, day) bounds a group by the calendar (a century
of days is 36,525 rows), whatever share of the raw ticks the key had. For keys without that bound use
``plans.segments`` (sums, extremes, EMA) or ``plans.incremental.in_slices`` (any recursion, bounded time slices).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tideline.functions.frames import Frame

Kernel = Callable[[pd.DataFrame], dict[str, object]]


def scan(
    df: DataFrame,
    frame: Frame,
    kernel: Kernel,
    outputs: Sequence[tuple[str, T.DataType]],
) -> DataFrame:
    """Append the columns the kernel returns. The kernel sees one key's rows in order."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, t) for n, t in outputs])
    order = list(frame.order)
    types = dict(outputs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        for name, values in kernel(pdf).items():
            series = pd.Series(values, index=pdf.index)
            if isinstance(types[name], T.DoubleType):
                series = series.astype("float64").astype(object).where(np.isfinite(series.astype("float64")), None)
            pdf[name] = series
        return pdf[[f.name for f in schema.fields]]

    return df.groupBy(*frame.keys).applyInPandas(run, schema)
