"""Texts to vectors: what is embedded, and a deterministic embedder where no model is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def embedding_text(summary: Column, content: Column, kind: Column, context: Column) -> Column:
    """A summary if there is one, else the content under its type and context."""
    templated = F.concat(F.lit("Type: "), kind, F.lit("\nContext: "), F.coalesce(context, F.lit("none")), F.lit("\nCode:\n"), content)
    return F.coalesce(F.nullif(summary, F.lit("")), templated)


def hashing_vector(text: Column, dims: int = 16) -> Column:
    """Counts of words by hash, of unit length: the same text gives the same vector anywhere. All zero without words."""
    slots = F.transform(T.words(text), lambda w: F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(dims)).cast("int"))

    def counted(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(xs, lambda s: s == i)).cast("double"))

    def unit(xs: Column) -> Column:
        length = F.sqrt(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(xs, lambda x: F.when(length > 0, x / length).otherwise(0.0))

    # each step inside a one-element array, so that it is evaluated once
    return F.transform(F.transform(F.array(slots), counted), unit)[0]


def model_udf(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64):
    """A pandas UDF around any model: loaded once for each task, fed `batch` texts at a time; a null is an empty text."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            values = texts.fillna("").tolist()
            rows = [v for i in range(0, len(values), batch) for v in np.asarray(model(values[i : i + batch]), dtype=np.float32)]
            yield pd.Series([r.tolist() for r in rows], dtype=object)

    return embed
