"""Per-project stages: failures become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def by_row(df: DataFrame, keys: list[str], column: str, f: Callable, returns: str) -> DataFrame:
    """keys, `result` and `error`: a row whose call fails has the error's text and no result; the others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results, errors = [], []
            for value in frame[column]:
                try:
                    results.append(f(value))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a row is that row's result
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            kind = "Int64" if returns in ("long", "int") else object
            yield frame[keys].assign(result=pd.Series(results, index=frame.index, dtype=kind), error=pd.Series(errors, index=frame.index, dtype=object))

    shape = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, column).mapInPandas(run, f"{shape}, result {returns}, error string")
