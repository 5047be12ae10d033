"""Budgets shared by sources, and measures of samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def fair_choice(items: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Every source's cheapest item is reserved; sources in order of appearance take the first item that leaves room for
    the reservations that are still open; what is left is filled in order. Nothing if the reservations don't fit."""
    items = items.sort_values("place", kind="stable").reset_index(drop=True)
    sources = items["source"].drop_duplicates().tolist()
    reserved = items.groupby("source")["cost"].min()
    if reserved.sum() > limit:
        return items.iloc[:0]
    taken, used, open_ = set(), 0, reserved.sum()
    for source in sources:
        open_ -= reserved[source]
        own = items[items["source"] == source]
        pick = own.index[used + own["cost"] + open_ <= limit][0]
        taken.add(pick)
        used += items.at[pick, "cost"]
    for i in items.index:
        if i not in taken and used + items.at[i, "cost"] <= limit:
            taken.add(i)
            used += items.at[i, "cost"]
    return items.loc[sorted(taken)]


def fair(items: DataFrame, limit: int) -> DataFrame:
    """(request, source, place, cost) that a request takes; a request's candidates are few and meet in one task."""
    return items.groupBy("request").applyInPandas(lambda pdf: fair_choice(pdf, limit), items.schema)


def pcm(vectors: DataFrame, quiet: int = 328) -> DataFrame:
    """(vec_id, peak, clipped, silent, longest): an array of -1 to 1 as 16-bit samples."""

    def run(batches):
        for batch in batches:
            rows = []
            for vec_id, value in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                x = np.rint(np.clip(np.array(value.values if value.is_valid else [], float), -1, 1) * 32767)
                low = np.concatenate([[0], (np.abs(x) < quiet).astype(int), [0]])
                edges = np.flatnonzero(np.diff(low))
                rows.append((vec_id, int(np.abs(x).max(initial=0)), int((np.abs(x) >= 32767).sum()), int(low.sum()), int((edges[1::2] - edges[::2]).max(initial=0))))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array(c, pa.int64()) for c in columns[1:])], ["vec_id", "peak", "clipped", "silent", "longest"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, peak long, clipped long, silent long, longest long")
