"""Running user Python over rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def score_batches(df: DataFrame, load: Callable[[], Any], predict: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Score batches with a model that is loaded once per task, on the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield predict(model, batch)

    return df.mapInPandas(run, schema)


def map_rows(df: DataFrame, fn: Callable[..., dict], key: str, schema: str, **extra: Any) -> DataFrame:
    """Call ``fn(row, **extra)`` once per row; results keep their key, a failing row gets an ``error`` instead.

    A failing row does not stop the batch. To split results and errors, stage the table first, or ``fn`` runs for each.
    """

    names = [f.split()[0] for f in schema.split(",")]
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    made = fn(row, **extra)
                    rows.append({key: row[key], **{n: made.get(n) for n in names}, "error": None})
                except Exception as problem:  # noqa: BLE001 - reported in the error table
                    rows.append({key: row[key], **dict.fromkeys(names), "error": f"{type(problem).__name__}: {problem}"})
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    return df.mapInPandas(run, f"{key} {key_type}, {schema}, error string")
